"""Runs: stretches of words that repeat with a period, all of them, and texts with the repeats taken out.

A document's suffix array comes from prefix doubling, whose ranks are kept: rank k numbers the stretches of 2 ** k words, so
two suffixes' longest common prefix (LCP) is read off bit by bit, for arrays of pairs at once. The LCP of a suffix with its
nearest neighbours in the suffix array that begin earlier is the longest previous factor (LPF), which cuts the words into
Lempel-Ziv blocks. A run lies strictly inside one block, or touches a boundary of blocks. The latter are extended from the
boundary, whose two blocks bound the period (Main). The former are copies of a run at the block's earlier place; runs are
held in buckets by their start, and blocks copy them from left to right.

All of a document's work is O(n log n) in words, also for one that repeats a single word; a document is one task's, whole.
Documents in which no stretch repeats that is long enough for a run end after the first doublings.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, pinned, table, text_of, upto, words_of

MIN_LENGTH, MIN_EXPONENT = 6, 4
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Suffixes:
    """Ranks of all stretches of 2 ** k words, and what follows from them."""

    def __init__(self, words: np.ndarray, enough: int = 0):
        """words: numbers from 0. repeats is False, and the rest is left out, if no stretch of enough words (or fewer) occurs twice."""
        self.n = n = len(words)
        count = np.bincount(words)
        # The rank of a stretch: how many places have a smaller one. Places whose stretch is theirs alone keep their rank.
        rank = (np.cumsum(count) - count)[words]
        open_ = np.flatnonzero(count[words] > 1)
        self.levels, width, self.repeats = [], 1, True
        while len(open_):
            self.levels.append(np.append(rank, -1))
            follow = np.minimum(open_ + width, n)
            key = rank[open_] * (n + 1) + self.levels[-1][follow] + 1
            order = np.argsort(key, kind="stable")
            key, at = key[order], open_[order]
            first = np.append(True, key[1:] != key[:-1])
            group = np.append(True, rank[at][1:] != rank[at][:-1])
            number = np.arange(len(at))
            start = np.maximum.accumulate(np.where(first, number, 0)) - np.maximum.accumulate(np.where(group, number, 0))
            rank = rank.copy()
            rank[at] += start
            alone = first & np.append(first[1:], True)
            open_, width = at[~alone], 2 * width
            if not len(open_) and width <= enough:
                self.repeats = False
                return
        self.repeats = bool(self.levels)
        self.rank = rank

    def lcp(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from places i and j (different ones) on."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            agree = self.levels[k][i] == self.levels[k][j]
            step = agree.astype(np.int64) << k
            i += step
            j += step
        return i - start

    def previous(self) -> tuple[np.ndarray, np.ndarray]:
        """The longest previous factor at every place, and an earlier place where it begins."""
        n = self.n
        array = np.empty(n, np.int64)
        array[self.rank] = np.arange(n)
        before, after, stack = [-1] * n, [-1] * n, [-1]
        for place in array.tolist():  # the neighbours in the suffix array that begin earlier
            while stack[-1] > place:
                after[stack.pop()] = place
            before[place] = stack[-1]
            stack.append(place)
        at, found = np.arange(n), []
        for near in (np.array(before), np.array(after)):
            has = np.flatnonzero(near >= 0)
            length = np.zeros(n, np.int64)
            length[has] = self.lcp(at[has], near[has])
            found.append((length, near))
        (a, x), (b, y) = found
        return np.maximum(a, b), np.where(a >= b, x, y)


def runs_of(words: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """start, length, period of each run of at least max(min_length, min_exponent * period) words, by start, then period.

    A run is a stretch with smallest period p that neither neighbour extends with that period. min_exponent: 3 or more.
    """
    if min_exponent < 3:
        raise ValueError("runs are sought from an exponent of 3")
    none, n = np.empty((0, 3), np.int64), len(words)
    longest_period = n // min_exponent
    if n < min_length or not longest_period:
        return none
    # A run of period p and length m has a stretch of m - p words that occurs twice.
    enough = min(max(min_length - p, (min_exponent - 1) * p) for p in range(1, min(longest_period, min_length) + 1))
    suffixes = Suffixes(words, enough)
    if not suffixes.repeats:
        return none
    factor, source = suffixes.previous()
    if factor.max() < enough:
        return none
    steps, starts, at = np.maximum(factor, 1).tolist(), [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array([*starts, n])
    lengths = np.diff(starts)

    # Of a run that ends in a block, that neither begins in the block before nor a period further on, that block would have reached to the run's end.
    most = np.minimum((lengths + np.append(lengths[1:], 0)) // (min_exponent - 1), longest_period)
    boundary = np.repeat(starts[1:], most)
    period = np.arange(len(boundary)) - np.repeat(np.cumsum(most) - most, most) + 1
    seeds = []
    for place in (boundary, boundary - 1 - period):
        inside = np.flatnonzero((place >= 0) & (place + period < n))
        inside = inside[words[place[inside]] == words[place[inside] + period[inside]]]
        seeds.append((place[inside], period[inside]))
    place, period = (np.concatenate(x) for x in zip(*seeds, strict=True))
    stop = place + suffixes.lcp(place, place + period) + period
    low, high = np.zeros(len(place), np.int64), place.copy()  # the first place from which words agree with those a period on, as far as place
    while len(wide := np.flatnonzero(low < high)):
        middle = (low[wide] + high[wide]) // 2
        reaches = suffixes.lcp(middle, middle + period[wide]) >= place[wide] - middle
        high[wide] = np.where(reaches, middle, high[wide])
        low[wide] = np.where(reaches, low[wide], middle + 1)
    length = stop - low
    keep = length >= np.maximum(min_length, min_exponent * period)
    found = np.stack([low[keep], length[keep], period[keep]], axis=1)
    found = found[np.lexsort(found.T[::-1])]
    found = found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))] if len(found) else found  # the smallest period of a stretch

    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for start, size, p in found.tolist():
        buckets[start].append((size, p))
    places = sorted(buckets)
    for k in np.flatnonzero(lengths >= min_length + 2).tolist() if places else []:
        start, size = int(starts[k]), int(lengths[k])
        came = int(source[start])
        i, last = bisect_right(places, came), came + size - 1
        while i < len(places) and places[i] + min_length <= last:
            copied = [x for x in buckets[places[i]] if places[i] + x[0] <= last]
            if copied:
                to = places[i] + start - came
                if to not in buckets:
                    insort(places, to)
                buckets[to] += copied
            i += 1
    return np.array(sorted((s, *x) for s in places for x in buckets[s]), np.int64).reshape(-1, 3)


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay if each run keeps its first period only."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth)[:n] == 0


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, carry: tuple[str, ...] = (), id_type: str = "bigint") -> DataFrame:
    """One row per row of docs: doc_id, the columns to carry, n_words, runs (array of start, length, period by start, then period), text.

    Words are what lies between ASCII white space, numbered from 0, and equal if their bytes are. text has the words that no
    run drops, joined by one space; a run drops its words after the first period. Null and empty texts have no words and an
    empty text. Repeated rows give repeated rows; rows without doc_id are like any other. An empty table gives an empty
    result. A text may have millions of words: about 200 bytes a word are held. Other columns are ignored.
    """
    kept = docs.select(F.col("doc_id").cast(id_type).alias("doc_id") if "doc_id" in docs.columns else F.lit(None).cast(id_type).alias("doc_id"), *[F.col(f"`{c}`") for c in carry], text_of().cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, texts = batch.columns
            sizes, rows, counts, out = [], [], [], []
            for text in texts.cast(pa.binary()):
                words, ids = text.as_py().split(), {}  # bytes: ASCII white space only
                found = runs_of(np.array([ids.setdefault(w, len(ids)) for w in words], np.int64), min_length, min_exponent)
                counts.append(len(words))
                sizes.append(len(found))
                if len(found):
                    words = [words[i] for i in np.flatnonzero(collapsed(len(words), found)).tolist()]
                rows.append(found)
                out.append(b" ".join(words))
            flat = np.concatenate(rows) if rows else np.empty((0, 3), np.int64)
            runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([*others, pa.array(counts, pa.int64()), runs, pa.array(out, pa.binary()).cast(pa.string())], [*batch.schema.names[:-1], "n_words", "runs", "text"])

    return kept.mapInArrow(run, f"{schema}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string")


def _repeating(docs: DataFrame) -> DataFrame:
    """doc_id, text: by the crc32 h of doc_id, every tenth text repeats its words from a place on, 3 to 10 times."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def rewritten(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(upto(n), lambda i: F.get(words, at(i))), " ")

    docs = pinned(docs, {"doc_id": "bigint", "text": "string"})
    return docs.select("doc_id", F.when((h % 10 == 0) & (F.length(F.trim(text_of())) > 0), let(words_of(text_of()), lambda w: F.when(F.size(w) > 0, rewritten(w)).otherwise(""))).otherwise(text_of()).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_repeating(table(spark, sf_dir, "documents")))
    none = "struct<start:bigint,length:bigint,period:bigint>"
    # Exactly: of fractions length / period the greater; the first of equal ones stays.
    best = F.aggregate("runs", F.lit(None).cast(none), lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise("")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
