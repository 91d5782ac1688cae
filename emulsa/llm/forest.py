"""Near-dedup by an LSH forest: MinHash signatures sorted in several orders, links confirmed on whole shingle sets.

A set's signature has TREES times OWN MinHash values of 16 bits. Each tree is an order of it: the values from the tree's own
first one on, the others after them in a circle. Entries of a tree are sorted by DEPTH values, so those with the longest
common prefix are neighbours, and a region of the forest is a stretch of entries with a common prefix. A region is LEAST
values deep if it has at most REGION entries, else it is divided by more values, as far as it takes; where that has no end
at DEPTH values the region is compared as it is. So depth follows density and no partner is cut off.

Three rounds find what links. In the first, neighbours side by side in CHAINS of the orders are confirmed: these chains go
through groups of copies of any size with a pair or two for each entry. In the second, those in the other orders are, and in the
third whole regions, but only across the components so far, which is nothing in regions of one component. Candidates are
dropped if their sizes rule a link out, or if under AGREE of a key's DEPTH values or under ALIKE of the signature's values
agree (80 of 128 lie seven standard errors under what a link at 0.85 has in the mean).

Documents with the same set are one node; a node is 128 bits of hash of its set. Two sets that link share a region of LEAST
values in a tree with probability 0.61 or more, so 16 trees miss them with one of under 1e-6; regions that need d values
miss with (1 - 0.85 ** d) ** 16.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_split, pinned, row_key, table, written
from .components import component_ids, components

SHINGLE, SIMILARITY = 5, 85
TREES, OWN, DEPTH, LEAST = 16, 8, 16, 3
#: Depths by which a region that is too large is divided, and the most entries of one that is not.
DEPTHS, REGION = (LEAST, 4, 6, 8, 12, DEPTH), 32
#: Orders whose chains are confirmed first, across no components yet; values of a key, and of a signature, that must agree in a pair.
CHAINS, AGREE, ALIKE = 3, 6, 80
#: Entries from which regions with many of them are looked for; texts of which the keys are broadcast.
MANY, MAX_BROADCAST = 1_000_000, 1_000_000
NO_NODE = b""


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles (UTF-8); none without words."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    digest, joined = xxhash.xxh64_digest, b" ".join(words)
    if len(words) <= size:
        return np.frombuffer(digest(joined), ">u8").astype(np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    hashes = b"".join([digest(joined[a:b]) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)])
    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def _multipliers(n: int) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh64_digest(str(k), 7) for k in range(n)), "<u8") | np.uint64(1)


def signature(hashes: np.ndarray, n: int = TREES * OWN) -> np.ndarray:
    """n MinHash values of a set, 16 bits each."""
    factors = _multipliers(n)
    least = np.full(n, ~np.uint64(0))
    for lo in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[lo : lo + 2048, None] * factors).min(axis=0))
    mixed = (least ^ least >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(48)).astype(">u2")


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE, whole: bool = False) -> DataFrame:
    """docs (its last column is text) with, in place of text: n, node (empty for an empty set), signature; or, if whole, hashes."""
    kept = docs.columns[:-1]
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept) + "n bigint, node binary, " + ("hashes array<bigint>" if whole else "signature binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for lo in range(0, all_rows.num_rows, 500):
                batch = all_rows.slice(lo, 500)
                *others, texts = batch.columns
                sets = [shingles(x.as_py() or b"", shingle) for x in texts.cast(pa.binary())]
                nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else NO_NODE for s in sets]
                if whole:
                    last = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(s) for s in sets])), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                else:
                    last = pa.array([signature(s).tobytes() if len(s) else NO_NODE for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*others, pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), last], [*kept, "n", "node", "hashes" if whole else "signature"])

    return docs.mapInArrow(run, schema)


def _may_link(n: Column, m: Column, similarity: int) -> Column:
    return 100 * F.least(n, m) >= similarity * F.greatest(n, m)


def neighbours(classes: DataFrame, similarity: int) -> DataFrame:
    """tree, key, node, n of the entries that share LEAST values with the one before or after; next: the node after, where both may link.

    Sorted by ranges, so that entries of one prefix may be in several tasks: those at a task's ends count as if they shared.
    """
    circle = F.concat("signature", "signature")
    each = classes.select("node", "n", circle.alias("circle"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    key = F.expr(f"substring(circle, tree * {2 * OWN} + 1, {2 * DEPTH})")
    ordered = each.select("tree", key.alias("key"), "node", "n").repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the entry whose next one is not known
        shares = True  # whether it shares with the one before; a task's first counts so

        def told(batch: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch, bool]:
            n = batch.num_rows
            tree, size = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(n, DEPTH)
            same = keys[1:] == keys[:-1]
            near = (tree[1:] == tree[:-1]) & same[:, :LEAST].all(axis=1)
            live = np.append(shares, near) | np.append(near, last)
            link = near & (same.sum(axis=1) >= AGREE) & (100 * np.minimum(size[1:], size[:-1]) >= similarity * np.maximum(size[1:], size[:-1]))
            follows = pa.array(batch.column(2).to_pylist()[1:], pa.binary(), mask=~link) if n > 1 else pa.array([], pa.binary())
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays([follows, pa.array([None], pa.binary())])], [*batch.schema.names, "next"])
            end = n if last else n - 1  # the last entry waits
            return out.slice(0, end).filter(pa.array(live[:end])), batch.slice(n - 1, 1), bool(near[-1]) if len(near) else shares

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            out, held, shares = told(batch, False)
            yield out
        if held is not None:
            yield told(held, True)[0]

    return ordered.mapInArrow(run, "tree int, key binary, node binary, n bigint, next binary")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """a, b of the pairs of nodes (a < b, no repeats) whose whole sets are as similar; sets has node, signature and hashes, a row a node.

    Pairs of whose signatures under ALIKE values agree are dropped before their sets are compared.
    """
    side = lambda name: sets.select(F.col("node").alias(name), F.col("hashes").alias(f"of_{name}"), F.col("signature").alias(f"signed_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    value = lambda name, i: F.substring(f"signed_{name}", 2 * i + 1, F.lit(2))
    agree = F.aggregate(F.sequence(F.lit(0), F.lit(TREES * OWN - 1)), F.lit(0), lambda n, i: n + F.when(value("a", i) == value("b", i), 1).otherwise(0))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter((agree >= ALIKE) & (100 * common >= similarity * (F.size("of_a") + F.size("of_b") - common))).select("a", "b")


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def region_pairs(entries: DataFrame, similarity: int, region: int = REGION) -> DataFrame:
    """a, b: pairs of nodes of different components in a region that may link; entries (a written table): tree, key, node, n, component."""
    found, left = [], entries
    meet = (lambda of, mixed: join_split(written(of, "forest-entries"), mixed, "region")) if entries.count() >= MANY else (lambda of, mixed: of.join(mixed, "region"))
    for depth in DEPTHS:
        prefix = F.concat(F.encode(F.col("tree").cast("string"), "utf-8"), F.expr(f"substring(key, 1, {2 * depth})"))
        of = left.withColumn("region", prefix)
        mixed = of.groupBy("region").agg(F.count("*").alias("size"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("region", "size")
        placed = written(meet(of, written(mixed, "forest-regions")), "forest-entries")
        small = placed.filter(F.col("size") <= region) if depth < DEPTH else placed
        left = placed.filter(F.col("size") > region).select(entries.columns)
        agree = sum(F.when(F.expr(f"substring(l.key, {2 * i + 1}, 2) = substring(r.key, {2 * i + 1}, 2)"), 1).otherwise(0) for i in range(depth, DEPTH))
        apart = (F.col("l.region") == F.col("r.region")) & (F.col("l.node") < F.col("r.node")) & (F.col("l.component") != F.col("r.component"))
        may = _may_link(F.col("l.n"), F.col("r.n"), similarity) & (agree + depth >= AGREE)
        found.append(small.alias("l").join(small.alias("r"), apart & may).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")))
        if depth == DEPTH or left.isEmpty():
            break
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    return whole.distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, region: int = REGION, id_type: str = "bigint") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept (whether it is that).

    A text's set is its distinct shingles of so many words (ASCII white space between, A-Z lowered), or all its words as one
    if they are fewer. Sets link if 100 * intersection >= similarity * union. Null and empty texts and those without words
    have an empty set, which links with nothing. Repeated rows give repeated rows. Rows without doc_id get a component too;
    they are kept only if no row of the component has a doc_id. An empty table gives an empty result. Other columns are
    ignored. A text's set is held whole by a task, 8 bytes a shingle. id_type: the type of doc_id, any that has an order.
    """
    docs = pinned(docs, {"doc_id": id_type, "text": "string"}).select("doc_id", row_key("text").alias("text_key"), "text")
    signed = written(shingle_sets(docs, shingle), "set-signatures")
    one = F.min(F.struct("doc_id", "text_key"))  # nulls first: min() of doc_id alone would pass over them
    classes = written(signed.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), one.alias("one"), F.first("n").alias("n"), F.first("signature").alias("signature")), "set-classes")

    live = written(neighbours(classes.select("node", "n", "signature"), similarity), "forest")
    # Sets are made anew for a text of each node that has a neighbour, which are few, rather than written for all.
    wanted = written(classes.join(live.select("node").distinct(), "node", "left_semi").select("one"), "set-texts")
    few = wanted.count() <= MAX_BROADCAST
    texts = docs.join(F.broadcast(wanted) if few else wanted, F.struct("doc_id", "text_key").eqNullSafe(F.col("one")), "left_semi").select("text")
    whole = shingle_sets(texts, shingle, whole=True).groupBy("node").agg(F.first("hashes").alias("hashes"))
    sets = written(whole.join(classes.select("node", "signature"), "node"), "sets")

    nexts = live.filter(F.col("next").isNotNull()).select("tree", "node", "next")
    chains = written(nexts.filter(F.col("tree") < CHAINS).select(*_pair(F.col("node"), F.col("next"))).distinct(), "chain-pairs")
    links = written(confirmed(chains, sets, similarity), "chain-links")
    others = written(nexts.filter(F.col("tree") >= CHAINS).select(*_pair(F.col("node"), F.col("next"))).distinct().join(chains, ["a", "b"], "left_anti"), "other-chains")
    # Links found later are joined to the stars of the earlier ones, so that each round of components has few steps.
    roots = components(links)
    of = lambda name: roots.select(F.col("a").alias(name), F.col("b").alias(f"root_{name}"))
    apart = others.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    more = confirmed(apart, sets, similarity)
    roots = components(written(roots.union(more), "chain-links"))

    component = roots.select(F.col("a").alias("node"), F.col("b").alias("root"))
    entries = written(live.join(component, "node", "left").select("tree", "key", "node", "n", F.coalesce("root", "node").alias("component")), "forest-entries")
    links = written(roots.union(confirmed(region_pairs(entries, similarity, region), sets, similarity)), "near-links")

    named = component_ids(signed.select("doc_id", "n", "node"), classes.select("node", "doc_id"), links, "node")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op13_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
