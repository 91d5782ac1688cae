"""Line dedup by the number of distinct sites that have a line.

Each distinct line (128 bits of hash) gets a HyperLogLog sketch of its sites, merged by a partial aggregate, so a line
that every document has costs one sketch a task. Lines whose estimate is within MARGIN of the limit are counted exactly
(distinct pairs of line and site, then a sum); the others stand by their estimate. Lines on SITES sites or more are
boilerplate and go from every document.

A document is found again by 128 bits of hash of its doc_id and text: rows alike in both lose the same lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_split, let, pinned, row_key, table, text_of, upto, written

#: Distinct sites from which a line is boilerplate; the fewest words of a line that is judged.
SITES, MIN_WORDS = 5, 3
#: log2 of the sketch's registers (a standard error of 1.04 / sqrt(2 ** 12) = 1.6 %), and the share around the limit that is counted exactly: 6 standard errors and one site at least.
LG_K, MARGIN = 12, 0.1


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """key of each line that is on so many distinct sites; lines has key and site (no nulls in key; null sites count as one site)."""
    lines = lines.select("key", F.coalesce("site", F.lit("\0none")).alias("site"))
    sketched = lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate"))
    margin = max(1.0, MARGIN * sites)
    judged = written(sketched.filter(F.col("estimate") > sites - margin), "sketched-lines")
    near = judged.filter(F.col("estimate") < sites + margin).select("key")
    pairs = lines.join(near, "key", "left_semi").groupBy("key", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= sites).select("key")
    return judged.filter(F.col("estimate") >= sites + margin).select("key").unionByName(exact)


def line_dedup(docs: DataFrame, sites: int = SITES, min_words: int = MIN_WORDS, site: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed (long), text without its boilerplate lines.

    Lines are cut at \\n and compared whole, without white space at their ends. Lines with fewer than min_words words stay.
    Null texts stay null, with no lines; a text that loses all lines is empty. Repeated rows give repeated rows; rows
    without doc_id or site are like any other. An empty table gives an empty result. Other columns are ignored.
    """
    docs = pinned(docs, {"doc_id": "bigint", "text": "string", site: "string"}).select("doc_id", "text", F.col(f"`{site}`").alias("site"))
    docs = docs.withColumn("row", row_key("doc_id", "text"))
    each = docs.select("row", "site", F.posexplode_outer(F.split(text_of(), "\n")).alias("at", "line"))
    line = F.regexp_replace("line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    each = each.select("row", "site", "at", line.alias("line")).filter(F.col("line").rlike(r"^(?:[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+|$)){%d}" % min_words))
    lines = written(each.select("row", "site", "at", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line", F.length("line")).alias("b")).alias("key")), "lines")
    found = boilerplate(lines, sites)
    gone = lines.join(found, "key", "left_semi").groupBy("row").agg(F.collect_set("at").alias("gone"))
    # By hash set, whatever the number of lines.
    text = let(F.split("text", "\n"), lambda x: F.array_join(F.transform(F.array_except(upto(F.size(x)), F.col("gone")), lambda i: F.get(x, i)), "\n"))
    out = join_split(docs, written(gone, "lines-gone"), "row", "left")
    return out.select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(text).alias("text"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with cut as (select rowid_, doc_id, text, source, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos, unnest(string_split(coalesce(text, ''), chr(10))) as raw
             from (select row_number() over () as rowid_, * from documents)),
     each as (select *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as line from cut),
     judged as (select *, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) >= 3 as long_enough from each),
     bad as (select line from judged where long_enough group by line having count(distinct coalesce(source, chr(1))) >= 5),
     told as (select j.*, j.long_enough and b.line is not null as gone from judged j left join bad b on j.line = b.line)
select doc_id, case when any_value(text) is null then 0 else count(*) end::bigint as n_lines, count(*) filter (where gone)::bigint as n_removed,
       case when any_value(text) is not null then coalesce(string_agg(raw, chr(10) order by pos) filter (where not gone), '') end as text
from told group by rowid_, doc_id
"""
