"""What the operators of this subpackage share: the shared folder, written tables, words, names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; what lies between is a word.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset one of our own, in local mode only."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if not place:
        place = "file://" + tempfile.mkdtemp(prefix="emulsa-")
        spark.sparkContext.setCheckpointDir(place)
    return re.sub(r"^file:/(?!/)", "file:///", place.rstrip("/"))  # one form for Spark and for pyarrow


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    place = fresh_dir(spark, name)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


#: Keys with more than one row in so many count as hot; there are at most so many of them.
HOT = 1_000


def join_split(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left (a written table) joined (inner or left) with right, which has one row a key.

    A key that holds more than a HOT-th of left's rows would be one task's; such keys, HOT at most, are joined by broadcast,
    so left's rows of them stay where they are.
    """
    n = left.count()
    heavy = written(left.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > max(1, n // HOT)).select(key), "hot-keys")
    if heavy.isEmpty():
        return left.join(right, key, how)
    heavy = F.broadcast(heavy)
    hot = right.join(heavy, key, "left_semi")
    some = left.join(heavy, left[key].eqNullSafe(heavy[key]), "left_semi").join(F.broadcast(hot), key, how)
    rest = left.join(heavy, left[key].eqNullSafe(heavy[key]), "left_anti").join(right, key, how)
    return some.unionByName(rest)


def row_key(*columns: str) -> Column:
    """128 bits of hash of the columns, nulls told apart from values."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit("\0none")) for c in columns]
    return F.struct(F.xxhash64(*told).alias("a"), F.xxhash64(F.lit(1), *told, *[F.length(x) for x in told]).alias("b"))


def hashable(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns as xxhash64 takes them: those with a map or variant in them as JSON."""
    kinds = dict(df.dtypes)
    return [F.to_json(F.struct(F.col(f"`{c}`"))) if re.search(r"\bmap<|\bvariant\b", kinds[c]) else F.col(f"`{c}`") for c in columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def running(sizes: Column) -> Column:
    """Sums of an array's elements (int) up to each; in two levels, so that a long array is not copied for each of its elements."""
    one = lambda x: F.aggregate(x, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda a, y: F.struct((a["at"] + y).alias("at"), F.concat(a["all"], F.array(a["at"] + y)).alias("all")), lambda a: a["all"])

    def parts(x: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x)))).cast("int")
        cut = F.transform(upto(F.ceil(F.size(x) / width).cast("int")), lambda i: one(F.slice(x, i * width + 1, width)))
        return let(cut, lambda c: let(one(F.transform(c, lambda p: F.get(p, F.size(p) - 1))), lambda ends: F.flatten(F.transform(c, lambda p, i: F.transform(p, lambda y: y + F.coalesce(F.get(ends, i - 1), F.lit(0)))))))

    return let(sizes, parts)


def upto(n: Column) -> Column:
    """0..n-1, empty if n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def pinned(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """The named columns of df only, typed; one that is missing becomes nulls."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in defaults.items()])
