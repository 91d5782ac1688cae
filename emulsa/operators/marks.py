"""Which tiles a mark can touch: by arithmetic on its window, so no join of sites with tiles is needed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsa.kernels.marks import specks


def dust_table(spark: SparkSession, p: dict[str, float], scale: float = 1.0) -> DataFrame:
    """k, y, x (shares of the frame), reach (pixels), light: 4000 rows at most."""
    c = specks(p, scale)
    rows = [{"k": k, "y": y, "x": x, "reach": r, "light": light} for k, ((y, x), r, light) in enumerate(zip(c["place"].tolist(), c["reach"].tolist(), c["light"].tolist(), strict=True))]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<k:int,y:double,x:double,reach:double,light:boolean>>")))


def site_tiles(sites: DataFrame, frames: DataFrame, tile: int) -> DataFrame:
    """image_id, k, ty, tx of every tile that a site's window meets; frames: image_id, h, w. Sites are few, so they are what is broadcast."""
    at = frames.select("image_id", "h", "w").join(F.broadcast(sites))
    first = lambda c, n: F.greatest(F.lit(0), F.floor(F.col(c) * F.col(n) - F.col("reach")).cast("int"))
    last = lambda c, n: F.least(F.col(n) - 1, F.ceil(F.col(c) * F.col(n) + F.col("reach")).cast("int"))
    at = at.select("image_id", "k", first("y", "h").alias("a"), last("y", "h").alias("b"), first("x", "w").alias("c"), last("x", "w").alias("d")).filter("a <= b and c <= d")
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / tile).cast("int"), F.floor(F.col(hi) / tile).cast("int")))
    return at.select("image_id", "k", span("a", "b").alias("ty"), "c", "d").select("image_id", "k", "ty", span("c", "d").alias("tx"))
