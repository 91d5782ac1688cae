"""Presets: JSON objects of parameter values, in files of a folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VALUES = "map<string,double>"


def scan(spark: SparkSession, folder: str, default_reference_mp: float | None = None) -> DataFrame:
    """name, values, reference_mp, lut, author, author_link of each *.json, by file name; broken files are left out.

    Values are under "values", or the object itself holds them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", F.decode("content", "utf-8").alias("text"))
    read = lambda path, kind: F.from_json(F.get_json_object("text", path), kind)
    whole = F.from_json("text", "map<string,string>")
    flat = F.map_filter(F.transform_values(whole, lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())
    nested = F.map_filter(F.transform_values(read("$.values", "map<string,string>"), lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())
    stem = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    return files.filter(whole.isNotNull() & F.get_json_object("text", "$").startswith("{")).select(
        F.coalesce(F.get_json_object("text", "$.name"), stem).alias("name"), F.coalesce(nested, flat).alias("values"),
        F.coalesce(F.get_json_object("text", "$.reference_mp").try_cast("double"), F.lit(default_reference_mp).cast("double")).alias("reference_mp"),
        F.get_json_object("text", "$.lut").alias("lut"), F.get_json_object("text", "$.author").alias("author"), F.get_json_object("text", "$.author_link").alias("author_link"), "path",
    ).orderBy("path").drop("path")


def dump(name: str, values: dict[str, float], **more) -> str:
    return json.dumps({"name": name, "values": values} | {k: v for k, v in more.items() if v is not None})
