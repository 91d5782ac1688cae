"""Near copies against all pairs of whole sets: planted similarities around the limit, large groups, recall, odd rows."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from emulsa.llm import components, forest

from ..conftest import SF
from .test_operators import DOCS, ODD, words

PAIRS = "doc_id long, text string"


def shingled(text, size=5):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain(docs, similarity=85):
    """By pairs that have a shingle of those in the rarest part, which every link has."""
    sets = [shingled(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, links = {}, set()
    for i, s in enumerate(sets):
        for x in sorted(s)[: len(s) - -(-similarity * len(s) // 100) + 1]:
            for j in holders.get(x, ()):
                if (j, i) not in links:
                    common = len(s & sets[j])
                    if 100 * common >= similarity * len(s | sets[j]):
                        links.add((j, i))
                        parent[max(find(i), find(j))] = min(find(i), find(j))
            holders.setdefault(x, []).append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    own = [least[find(i)] if sets[i] else d for i, (d, _) in enumerate(docs)]
    return sorted(((d, len(sets[i]), own[i], d == own[i]) for i, (d, _) in enumerate(docs)), key=key), links


key = lambda r: tuple((x is not None, x) for x in r)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=key)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, links = plain(docs)
    assert got(forest.op13_minhash_forest(spark, SF)) == want and len(links) > 10


def text_of(rnd, n):
    return [f"w{rnd.randrange(3000)}" for _ in range(n)]


def test_recall_around_the_limit(spark):
    """Pairs with one word exchanged in so many, from under the limit to well over it; every linked pair of 400 is found."""
    rnd, docs = random.Random(3), []
    for k in range(400):
        w = text_of(rnd, rnd.randrange(20, 300))
        other = list(w)
        for i in rnd.sample(range(len(w)), rnd.randrange(1, 3 + len(w) // 50)):
            other[i] = "other"
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    want, links = plain(docs)
    near = [Fraction(len(shingled(docs[i][1]) & shingled(docs[j][1])), len(shingled(docs[i][1]) | shingled(docs[j][1]))) for i, j in links]
    assert 150 < len(links) < 390 and sum(x < 0.9 for x in near) > 30
    assert got(forest.near_duplicates(spark.createDataFrame(docs, PAIRS))) == want


@pytest.mark.parametrize("region", [4, 32])
def test_large_groups_of_near_copies(spark, region):
    """One group with half of all rows, one just under the limit to it, and groups that share half of their text."""
    rnd = random.Random(4)
    base, docs = text_of(rnd, 200), []
    shared = text_of(rnd, 100)
    for k in range(240):  # of most pairs in every third, the similarity is a little under the limit
        w = list(base)
        for i in rnd.sample(range(200), 1 + (k % 3 == 0)):
            w[i] = f"x{rnd.randrange(10**6)}"
        docs.append((k, " ".join(w)))
    for k in range(240, 400):
        docs.append((k, " ".join(shared + text_of(rnd, 60) if k % 2 else shared[:50] + text_of(rnd, 20))))
    for k in range(400, 440):
        w = list(base[:170]) + text_of(rnd, 30)
        docs.append((k, " ".join(w)))
    rnd.shuffle(docs)
    want, links = plain(docs)
    assert len(links) > 10_000 and len({r[2] for r in want}) > 150
    assert got(forest.near_duplicates(spark.createDataFrame(docs, PAIRS).repartition(5), region=region)) == want


def test_chains_spare_regions_of_one_component(spark):
    rnd = random.Random(5)
    base = text_of(rnd, 300)
    docs = []
    for k in range(800):
        w = list(base)
        w[rnd.randrange(300)] = f"x{k}"
        docs.append((k, " ".join(w)))
    sets = forest.written(forest.shingle_sets(spark.createDataFrame(docs, PAIRS).select("text")), "sets")
    live = forest.written(forest.neighbours(sets.select("node", "n", "signature"), 85), "live")
    chains = live.filter(f"next is not null and tree < {forest.CHAINS}")
    assert chains.count() <= forest.CHAINS * 800 and live.count() > 0.9 * forest.TREES * 800
    entries = live.withColumn("component", F.lit(b"one"))
    assert forest.region_pairs(entries.select("tree", "key", "node", "n", "component"), 85).isEmpty()


def test_hot_centres_are_split(spark):
    """A star with all edges, and one link beside it."""
    edges = spark.range(1, 4_000).selectExpr("id as a", "0L as b").union(spark.createDataFrame([(9_001, 9_000)], "a long, b long"))
    split = {tuple(r) for r in components.components(edges, many=10).collect()}
    assert split == {tuple(r) for r in components.components(edges).collect()} == {(i, 0) for i in range(1, 4_000)} | {(9_001, 9_000)}


def test_odd(spark):
    docs = [(r[0], r[1]) for r in ODD] + [(20, "A b c"), (21, "a\tB\nc"), (None, "a b c"), (None, "q r s t u v w"), (None, "q r s t u v w"), (22, " \n"), (23, "")]
    table = spark.createDataFrame([(*d, None, None, None) for d in docs], DOCS).withColumns({c: F.lit(1) for c in ("n", "node", "hashes", "signature", "tree", "key", "next", "region", "component")})
    want = [(d, n, c, d == c) for d, n, c, _ in plain(docs)[0]]
    assert got(forest.near_duplicates(table)) == sorted(want, key=key)
    assert forest.near_duplicates(table.limit(0)).collect() == []
    assert got(forest.near_duplicates(spark.createDataFrame([("a",)], "text string"))) == [(None, 1, None, True)]
    by_text = forest.near_duplicates(table.withColumn("doc_id", F.col("doc_id").cast("string")), id_type="string")
    assert {(r.doc_id, r.component_id) for r in by_text.filter("doc_id in ('20', '21')").collect()} == {("20", "20"), ("21", "20")}
