"""Runs of words against every period tried at every place, and the query against a plain version of its contract."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulsa.llm import periods

from ..conftest import SF
from .test_operators import DOCS, ODD, words


def plain_runs(x, min_length=6, min_exponent=4):
    n, seen = len(x), {}
    for p in range(1, n // min_exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            if j > i and j - i + p >= max(min_length, min_exponent * p):
                seen.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, m, p) for (s, m), p in seen.items())


def numbers(x):
    ids = {}
    return np.array([ids.setdefault(w, len(ids)) for w in x], np.int64)


@pytest.mark.parametrize("limits", [(6, 4), (6, 3), (2, 3), (12, 5)])
def test_all_runs_are_found(limits):
    rnd, found = random.Random(limits[0] * 10 + limits[1]), 0
    for _ in range(700):
        n, letters = rnd.randrange(90), rnd.choice([1, 2, 2, 3, 5])
        x = [rnd.randrange(letters) for _ in range(n)]
        for _ in range(rnd.randrange(4)):  # stretches that repeat, some within others
            if n > 4:
                i, p = rnd.randrange(n), rnd.randrange(1, 8)
                for k in range(i + p, min(n, i + rnd.randrange(1, 60))):
                    x[k] = x[k - p]
        if rnd.random() < 0.3:
            x = (x[:20] * 6)[: n + 40]
        want = plain_runs(x, *limits)
        assert [tuple(r) for r in periods.runs_of(numbers(x), *limits).tolist()] == want
        found += len(want)
    assert found > 200


def test_runs_inside_blocks_are_copied():
    inner = ["a"] * 7 + ["b", "c"]
    x = ["s", *inner, "t", "u", *inner, "v", "s", *inner, "t", "u", *inner, "v", "w"]
    got = [tuple(r) for r in periods.runs_of(numbers(x)).tolist()]
    assert got == plain_runs(x) and len(got) == 4


def test_long_and_monotonous():
    for x, want in (([0] * 300_000, [(0, 300_000, 1)]), ([i % 7 for i in range(200_003)], [(0, 200_003, 7)])):
        assert [tuple(r) for r in periods.runs_of(numbers(x)).tolist()] == want
    with pytest.raises(ValueError):
        periods.runs_of(numbers("abc"), 2, 2)


def plain_row(doc_id, text):
    w = words(text)
    n = len(w)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
key = lambda r: tuple((x is not None, x) for x in r)


def test_query(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(words(r.text)) < 1500]
    assert sum(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows) > 10
    got = {tuple(r[c] for c in NAMES) for r in periods.op12_periodic_runs(spark, SF).collect()}
    assert {plain_row(*r) for r in rows} <= got


def test_odd(spark, monkeypatch):
    odd = spark.createDataFrame([r for r in ODD if len(r[1] or "") < 20_000], DOCS).withColumns({c: F.lit(1) for c in ("runs", "n_words", "start", "best", "h")})
    monkeypatch.setattr(periods, "table", lambda *_: odd)
    got = periods.op12_periodic_runs(spark, SF)
    assert sorted((tuple(r[c] for c in NAMES) for r in got.collect()), key=key) == sorted((plain_row(r[0], r[1]) for r in ODD if len(r[1] or "") < 20_000), key=key)
    monkeypatch.setattr(periods, "table", lambda *_: spark.createDataFrame(ODD[7:9], DOCS))
    assert {(r.n_runs, r.length, r.period) for r in periods.op12_periodic_runs(spark, SF).collect()} == {(1, 30_000, 1), (0, None, None)}
    carried = periods.periodic_runs(odd, carry=("start", "h")).first()
    assert carried.start == 1 and carried.h == 1
    assert periods.periodic_runs(spark.createDataFrame([], DOCS)).collect() == []
    assert periods.periodic_runs(spark.createDataFrame([("a a a a a a",)], "text string")).first().text == "a"
