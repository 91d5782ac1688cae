"""Every query with SQL agrees with DuckDB; the others run."""

from collections import Counter

import pytest

from emulsa.queries import registry

from .conftest import SF

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    r = duck.execute(ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert Counter(tuple(row[c] for c in columns) for row in df.collect()) == Counter(tuple(row[i] for i in at) for row in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_rows(spark, name):
    rows = registry.queries()[name](spark, SF).collect()
    assert rows and all(0 <= r[c] <= 1000 for r in rows for c in "rgb")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
