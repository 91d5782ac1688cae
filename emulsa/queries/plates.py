"""Frames made of the test tables: pixels(image_id, y, x, r, g, b), and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quantised(x: Column) -> Column:
    """The same integer in any engine with IEEE doubles."""
    return F.floor(x * 1e6 + 0.5).cast("bigint")


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours without coordinates: for point operators and aggregates."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return d.select(F.col("l_returnflag").alias("image_id"), (F.col("l_quantity") / 50.0).alias("r"), (F.col("l_discount") * 10.0).alias("g"), (F.col("l_tax") / 0.08).alias("b"))


LINE = "select l_returnflag as image_id, l_quantity / 50e0 as r, l_discount * 10e0 as g, l_tax / 0.08e0 as b from lineitem"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense grid 100 wide."""
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    return d.select(
        F.lit("events").alias("image_id"), F.floor(F.col("event_id") / 100).cast("int").alias("y"), (F.col("event_id") % 100).cast("int").alias("x"),
        (F.col("value") / 500.0).alias("r"), ((F.col("user_id") % 64) / 63.0).alias("g"), ((F.col("event_id") * 37 % 101) / 100.0).alias("b"),
    )


EVENTS = "select 'events' as image_id, (event_id // 100)::int as y, (event_id % 100)::int as x, value / 500e0 as r, (user_id % 64) / 63e0 as g, (event_id * 37 % 101) / 100e0 as b from events"
