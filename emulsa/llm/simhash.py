"""SimHash near-dedup by deletion variants.

Two fingerprints of 64 bits that differ in at most 4 bits, cut into 3 segments, have a segment that differs in at most
one bit. So every fingerprint is indexed by each segment with one bit taken out, in turn (64 keys of 20 or 21 bits); two
fingerprints that may link share a key, an equality join finds them and the join's condition verifies all 64 bits. A pair
leaves the join only under the first key that it shares, so each link comes out once.

More fingerprints need longer keys. Any c of c + 3 segments (c >= 2) hold a choice that differs in at most one bit in
all, which gives keys of 24 bits (c = 2) and 31 bits (c = 3); segment_plan() picks c from the number of fingerprints. All
plans find the same links.

A key has 16 bytes and a fingerprint 64, 256 or 640 keys by c, so the join deals 1, 4 or 10 KB for each distinct fingerprint:
at 10 billion of them 100 TB, which is what exact links between so many cost with keys this long.

Copies cost nothing: links are sought between distinct fingerprints only. Components come from alternating large-star and
small-star steps on tables in the shared folder; the driver sees two numbers a step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pinned, table, written
from .components import component_ids

SHINGLE, SEED, BITS, MAX_BITS = 4, 42, 64, 4
SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number; text is UTF-8."""
    words = [w for w in SPACES.split(text.lower()) if w]  # bytes: A-Z only
    if not words:
        return 0
    if len(words) <= shingle:
        digests = xxhash.xxh64_digest(b" ".join(words), SEED)
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = (ends[: len(words) - shingle + 1] - [len(w) for w in words[: len(words) - shingle + 1]]).tolist()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    votes = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(bits)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_type: str = "bigint") -> DataFrame:
    """doc_id, fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = pa.array((fingerprint(x.as_py() or b"", shingle) for x in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return pinned(docs, {"doc_id": id_type, "text": "string"}).mapInArrow(run, f"doc_id {id_type}, fp bigint")


def segment_plan(n: int) -> int:
    """How many segments make a key, for n fingerprints: candidates by one key stay few beside the keys themselves."""
    return 1 if n < 1 << 25 else 2 if n < 1 << 29 else 3


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def key_masks(c: int) -> list[list[int]]:
    """For each choice of segments its bits, as masks of one bit each."""
    n = c + (2 if c == 1 else 3)
    cuts = [round(BITS * k / n) for k in range(n + 1)]
    segments = [[1 << b for b in range(cuts[k], cuts[k + 1])] for k in range(n)]
    return [[b for s in chosen for b in s] for chosen in combinations(segments, c)]


def links(fps: DataFrame, c: int) -> DataFrame:
    """a < b of all distinct fingerprints (column fp, no repeats) at MAX_BITS or fewer differing bits, each pair once."""
    choices = key_masks(c)
    slots = [(k, bit, sum(bits) & ~bit) for k, bits in enumerate(choices) for bit in bits]
    at = F.explode(F.array(*[F.lit(i) for i in range(len(slots))])).alias("slot")
    of = lambda values, slot: F.get(F.array(*map(F.lit, values)), slot)
    keyed = fps.select("fp", at).select("fp", "slot", F.col("fp").bitwiseAND(of([_signed(m) for _, _, m in slots], F.col("slot"))).alias("key"))
    diff = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    inside = [diff.bitwiseAND(F.lit(_signed(sum(bits)))) for bits in choices]
    first = F.coalesce(*[F.when(F.bit_count(x) <= 1, k) for k, x in enumerate(inside)])
    slot = F.col("l.slot")
    found = F.get(F.array(*inside), of([k for k, _, _ in slots], slot))
    lowest = {k: bits[0] for k, bits in enumerate(choices)}
    this = (first == of([k for k, _, _ in slots], slot)) & ((found == of([_signed(b) for _, b, _ in slots], slot)) | ((found == 0) & of([b == lowest[k] for k, b, _ in slots], slot)))
    same = (F.col("l.slot") == F.col("r.slot")) & (F.col("l.key") == F.col("r.key"))
    near = (F.col("l.fp") < F.col("r.fp")) & (F.bit_count(diff) <= MAX_BITS)
    # Spark takes a table with its keys for as small as the one without, and would send all keys through the driver.
    return keyed.alias("l").join(keyed.hint("merge").alias("r"), same & near & this).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, id_type: str = "bigint") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links).

    Null texts are empty; texts without words have fingerprint zero and link like any other. Repeated rows give repeated
    rows. Rows without doc_id get a component too, null if no row of the component has a doc_id. An empty table gives an
    empty result. Other columns are ignored. id_type: the type of doc_id, any that has an order.
    """
    fps = written(fingerprints(docs, shingle, id_type), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "classes")
    edges = written(links(classes.select("fp"), segment_plan(classes.count())), "links")
    named = component_ids(fps, classes, edges, "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
