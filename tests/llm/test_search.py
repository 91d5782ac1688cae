"""Ranked search against scores of every document, whatever the shards, blocks and groups; what is skipped; SQL."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulsa.llm import search

from ..conftest import SF
from .test_operators import DOCS, ODD

ITEMS = "item_id long, text string"


def terms(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, k=10):
    own = [(d, Counter(w), len(w)) for d, t in docs if (w := terms(t))]
    n_docs, n_terms, df = len(own), sum(n for *_, n in own), Counter(t for _, c, _ in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        found = []
        for d, c, n in own:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, x in q.items() if t in c)
            if s > 0:
                found.append((s, d))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(i, r + 1, d, s) for r, (s, d) in enumerate(found[:k])]
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_sql(spark, duck):
    want = duck.execute(search.OP11_SQL).fetchall()
    assert got(search.op11_ranked_search(spark, SF)) == sorted(want) and len(want) > 50


@pytest.mark.parametrize(("shard", "group", "block"), [(20_000, 500_000, 128), (60_000, 100, 4), (10**9, 10**9, 2)])
def test_shards_groups_and_blocks_change_nothing(spark, monkeypatch, shard, group, block):
    monkeypatch.setattr(search, "BLOCK", block)
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    index = search.build_index(docs, shard)
    assert (index.select("shard").distinct().count() > 3) == (shard < 10**9)
    assert index.filter("term is null").agg(F.sum("df")).first()[0] == docs.count()
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 3)
    assert got(search.search(index, items, 3, group)) == want


def test_blocks_below_the_threshold_stay_packed():
    rng = np.random.default_rng(5)
    texts = [b" ".join(rng.choice([b"the", b"of", b"and", b"x%d" % (i % 7)], 30).tolist()) for i in range(4_000)]
    texts[3000] = b"rare the rarer"
    shard = search.index_shard(0, list(range(4_000)), texts, 4_000, sum(len(t.split()) for t in texts))
    rows = {r["term"]: r for r in shard.to_pylist()}
    m = np.frombuffer(rows[None]["data"], "<i8", 4_000, 32_000)
    assert len(rows["the"]["head"]) // search.HEAD.itemsize > 20 and len(rows["the"]["data"]) < 2.1 * rows["the"]["df"]
    lists = [(search.Postings(rows[t]["head"], rows[t]["data"]), w) for t, w in (("the", 1), ("of", 1), ("rare", 8_000), ("rarer", 8_000))]
    skipped = []
    places, scores = search.best_of_shard(lists, m, 1, 0, skipped)
    assert places.tolist() == [3000] and skipped[0] > 0.7 * sum(len(p.last) for p, _ in lists)
    assert sum(len(p.held) for p, _ in lists) == sum(len(p.last) for p, _ in lists) - skipped[0]
    # A threshold from elsewhere may skip all; a document with its very score is kept.
    assert search.best_of_shard(lists, m, 1, sum(w * int(p.top.max()) for p, w in lists) + 1, skipped)[0].tolist() == [] and skipped[1] == sum(len(p.last) for p, _ in lists)
    assert search.best_of_shard(lists, m, 1, int(scores[0]) + 1)[0].tolist() == []
    assert search.best_of_shard(lists, m, 1, int(scores[0]))[0].tolist() == [3000]


def test_odd(spark):
    docs = [(r[0], r[1]) for r in ODD] + [(9, "tie one"), (8, "one TIE"), (None, "tie One"), (8, "one TIE"), (10, "ÀB à naïve-x İ"), (11, "a\x00b"), (12, None)]
    items = [(1, "one tie"), (1, "word"), (2, None), (3, ""), (4, "nowhere"), (None, "naïve à À"), (None, "b"), (5, "one one tie 𝒳é")]
    table = spark.createDataFrame([(*d, None, None, None) for d in docs], DOCS).withColumns({c: F.lit(1) for c in ("shard", "term", "group", "df", "weight")})
    asked = spark.createDataFrame(items, ITEMS).withColumns({c: F.lit(1) for c in ("term", "n", "least")})
    for shard in (30, 10**9):
        assert got(search.search(search.build_index(table, shard), asked)) == plain(docs, items)
    index = search.build_index(table.limit(0))
    assert index.collect() == [] and search.search(index, asked).collect() == []
    assert search.search(search.build_index(table), asked.limit(0)).collect() == []
    assert search.search(search.build_index(spark.createDataFrame([(1, None), (2, "...")], "doc_id long, text string")), asked).collect() == []
