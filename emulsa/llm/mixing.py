"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed random order, are cut into blocks. With weights of w_i out of a total of W, block k of
source i may not start before slot floor(k * W / w_i) and must be done by slot ceil((k + 1) * W / w_i); taking in each slot,
of all blocks that are released, the one with the earliest deadline, is a schedule in which every source is less than one
block away from its target at every slot (Pfair on one processor) as long as it has blocks. Weights are exact fractions and
every source has its own; a source that has run out leaves its slots empty, which moves no other block out of its window.

Weights of whole numbers w_i without common divisor make a schedule that begins anew every W slots. So only one period is
worked out, min(w_i, blocks of i) blocks of each source, and block k stands where block k mod w_i stands, k div w_i periods
on: what the driver does is bounded by W (and by the number of blocks, if that is less), not by the documents. Without
weights given, sources weigh by the whole root of their number of documents, so W is at most the root of the number of
sources times documents.

Numbering the documents of a source needs no task that holds the whole source: the md5 order is cut into CELLS equal
ranges, counted by (source, range), and a document's number is the count of the ranges before plus its place in its own.
Rows without doc_id are drawn by what is carried, so they spread over the ranges, too.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_dir, hashable, pinned, table

#: Documents in a block; rows of the period up to which it is broadcast.
BLOCK, MAX_BROADCAST = 16, 1_000_000
#: Rows that a range of the md5 order has about, at most; it fixes how many hex digits make a range.
CELL_ROWS = 4_096
#: Rows of a table that the driver writes at a time.
PART = 100_000
SLOTS = "line:string,k:bigint,r:bigint,d:bigint,t:bigint"
NO_SOURCE, REST = "\0none", "\0rest"


def shares_of(weights: dict[str, float]) -> dict[str, int]:
    """Whole shares exactly in proportion to the positive weights, a float being the decimal it is written as; without common divisor."""
    exact = {k: Fraction(repr(w)) if isinstance(w, float) else Fraction(w) for k, w in weights.items() if w > 0}
    scale = math.lcm(*[x.denominator for x in exact.values()])
    whole = {k: int(x * scale) for k, x in exact.items()}
    common = math.gcd(*whole.values())
    return {k: x // common for k, x in whole.items()}


def schedule(shares: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, k, release, deadline, slot) of the first blocks[source] blocks of each source: earliest deadline first among released blocks, ties by name."""
    q = sum(shares.values())
    coming = [(0, s, 0) for s in shares if blocks.get(s, 0) > 0]
    released, slot = [], 0
    heapq.heapify(coming)
    while coming or released:
        if not released:
            slot = max(slot, coming[0][0])
        while coming and coming[0][0] <= slot:
            release, s, k = heapq.heappop(coming)
            heapq.heappush(released, (-(-(k + 1) * q // shares[s]), s, k, release))
        deadline, s, k, release = heapq.heappop(released)
        yield s, k, release, deadline, slot
        if k + 1 < blocks[s]:
            heapq.heappush(coming, ((k + 1) * q // shares[s], s, k + 1))
        slot += 1


def _stored(spark: SparkSession, rows: Iterator[tuple], schema: str, name: str) -> tuple[DataFrame, int]:
    """rows as a written table, and how many there are. The driver holds PART of them at a time."""
    place, n = fresh_dir(spark, name), 0
    while (part := list(islice(rows, PART))) or not n:
        _literal(spark, part, schema).write.mode("append").parquet(place)
        n += len(part)
        if not part:
            break
    return spark.read.schema(schema.replace(":", " ")).parquet(place), n


def _literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of some rows made by the JVM alone."""
    names = [x.split(":")[0] for x in schema.split(",")]
    listed = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(listed), f"array<struct<{schema}>>")))


def _key(source: Column) -> Column:
    return F.coalesce(source, F.lit(NO_SOURCE))


def numbered(docs: DataFrame, digits: int) -> DataFrame:
    """docs and n: the number of each row in its line (column "line"), from 0, by the order of "draw" (hex digits, of which the first make a range); equal draws in any order."""
    docs = docs.withColumn("cell", F.substring("draw", 1, digits))
    cells = docs.groupBy("line", "cell").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("line").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    cells = cells.select("line", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("line", "cell").orderBy("draw", "doc_id")
    return docs.withColumn("in_cell", F.row_number().over(own) - 1).join(cells, ["line", "cell"]).withColumn("n", F.col("before") + F.col("in_cell")).drop("cell", "before", "in_cell")


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, block, release, deadline, slot, position, and the columns named in carry.

    position (unique) orders the mixture: slot * block + place in the block. Where a source has run out its slots stay
    empty, so the others keep their shares among themselves. Without weights, sources weigh by the whole root of their
    number of documents. Rows of a source without weight, if weights are given, come last: their slot is null and position
    goes on after the last slot in use. A null source is a source of its own (key None). Repeated rows each get a place;
    rows without doc_id are drawn by the carried columns, rows with the same doc_id in the order of these. An empty table
    gives an empty result. Clashing columns of docs are ignored. The driver holds a number for each source and PART rows of the schedule.
    """
    spark = docs.sparkSession
    kinds = {"doc_id": "bigint", "source": "string"} | {c: dict(docs.dtypes)[c] for c in carry or [] if c not in ("doc_id", "source")}
    docs = pinned(docs, kinds)
    counts = {NO_SOURCE if r["source"] is None else r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    given = {k: math.isqrt(n) for k, n in counts.items()} if weights is None else {NO_SOURCE if k is None else k: w for k, w in weights.items()}
    shares = shares_of({k: w for k, w in given.items() if weights is not None or k in counts})
    period, blocks = sum(shares.values()), {s: -(-counts.get(s, 0) // block) for s in shares}
    slots, n_slots = _stored(spark, schedule(shares, {s: min(shares[s], n) for s, n in blocks.items()}), SLOTS, "mix-slots")
    known, n_known = _stored(spark, iter(sorted(shares.items())), "line:string,share:bigint", "mix-shares")
    bound = lambda df, n: F.broadcast(df) if n <= MAX_BROADCAST else df
    extra = [c for c in kinds if c not in ("doc_id", "source")]
    rest = F.hex(F.xxhash64(*hashable(docs, extra))) if extra else F.lit("")
    draw = F.concat(F.md5(F.coalesce(F.col("doc_id").cast("string"), rest)), rest)
    packed = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in extra]).alias("carried") if extra else F.lit(None).alias("carried"), _key(F.col("source")).alias("line"), draw.alias("draw"))
    packed = packed.join(bound(known, n_known), "line", "left")
    # All sources without weight share one line, in order of their draws.
    packed = packed.withColumn("line", F.when(F.col("share").isNull(), F.lit(REST)).otherwise(F.col("line")))
    digits = 1
    while 16**digits * CELL_ROWS < max([*counts.values(), sum(n for s, n in counts.items() if s not in shares)], default=0):
        digits += 1
    rows = numbered(packed, digits).withColumn("block", F.floor(F.col("n") / block).cast("bigint"))
    rows = rows.withColumn("again", F.floor(F.col("block") / F.col("share")).cast("bigint") * period).withColumn("k", F.col("block") % F.col("share"))
    placed = rows.join(bound(slots, n_slots), ["line", "k"], "left")
    last = max((_last_slot(shares[s], period, n) for s, n in blocks.items() if n), default=-1)
    slot, tail = F.col("t") + F.col("again"), (last + 1) * block + F.col("n")  # after any slot of any line
    position = F.coalesce(slot * block + F.col("n") % block, tail).cast("bigint")
    out = placed.select("doc_id", "source", "block", (F.col("r") + F.col("again")).alias("release"), (F.col("d") + F.col("again")).alias("deadline"), slot.alias("slot"), position.alias("position"), "carried")
    return out.select("doc_id", "source", "block", "release", "deadline", "slot", "position", *[F.col("carried")[c].alias(c) for c in extra])


def _last_slot(share: int, period: int, blocks: int) -> int:
    """The last slot in which the last block may be."""
    return -(-blocks * period // share) - 1


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


#: The schedule is worked out slot by slot, for all blocks rather than for a period of them.
OP1_SQL = """
with recursive counts as (select coalesce(source, '') as line, source, count(*) as n from documents group by source),
     lines as (select *, n_blocks, row_number() over (order by line) as i from (select *, cast(floor(sqrt(n)) as bigint) as w, (n + 15) // 16 as n_blocks from counts)),
     -- Weights without a common divisor repeat after the least slots, but the order does not depend on it.
     total as (select sum(w)::bigint as q, count(*) as m, list(w order by i) as w, list(n_blocks order by i) as have, sum(n_blocks)::bigint as todo from lines),
     state as (
         select 0::bigint as t, 0::bigint as done, list_transform(range(1, m + 1), lambda x: 0::bigint) as k, null::bigint as took, null::bigint as block from total
         union all
         select t + 1, done + case when best is null then 0 else 1 end, case when best is null then k else list_transform(k, lambda x, j: case when j = best then x + 1 else x end) end, best, k[best]
         from (select s.t, s.done, s.k, todo,
                      list_extract(list_sort(list_transform(list_filter(range(1, m + 1), lambda j: s.k[j] < have[j] and s.k[j] * q // w[j] <= s.t), lambda j: {'d': ((s.k[j] + 1) * q + w[j] - 1) // w[j], 'j': j})), 1)['j'] as best
               from state s, total where s.done < todo)),
     numbered as (select *, row_number() over (partition by source order by md5(coalesce(doc_id::varchar, '')), doc_id) - 1 as n from (select doc_id, source from documents)),
     placed as (select d.doc_id, d.source, d.n, d.n // 16 as block, l.i, l.w from numbered d join lines l on d.source is not distinct from l.source)
select p.doc_id, p.source, p.block::bigint as block, (p.block * q // p.w)::bigint as release, (((p.block + 1) * q + p.w - 1) // p.w)::bigint as deadline, (s.t - 1)::bigint as slot,
       ((s.t - 1) * 16 + p.n % 16)::bigint as position
from placed p, total, state s where s.took = p.i and s.block = p.block
"""
