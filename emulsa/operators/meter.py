"""Metering of whole frames: aggregates over the pixels (partial sums first), a row for each image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsa.functions import colour as C

SAMPLES, LEAST, DARK, CLIPPED, NORM, KEY, MAX_EV, MAX_GAIN = 2_000_000, 256, 0.02, 0.92, 6, 0.179, 2.0, 1.6
DIVERSITY = (0.010, 0.045)
#: Images whose rows of measures are broadcast to the pixels; for more, pixels and measures are dealt by image.
MAX_BROADCAST = 100_000


def _meeting(df: DataFrame):
    """How pixels are joined with a row for each of their images: a count of the images decides."""
    few = df.select("image_id").distinct().limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return lambda pixels, measures: pixels.join(F.broadcast(measures) if few else measures, "image_id")


def meter(df: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """image_id, norm_ev, norm_gain_r, norm_gain_g, norm_gain_b, norm_toe, norm_white of pixels(image_id, y, x, r, g, b) (y and x may be missing).

    Frames of at least twice so many samples are read at every so many-th pixel in raster order, if y and x are there. Pixels
    are read, summed where they are, and never dealt (see MAX_BROADCAST).
    """
    meet = _meeting(df)
    lin = [C.linear(F.col(c)) for c in "rgb"]
    top, low = F.greatest(*map(F.col, "rgb")), F.least(*map(F.col, "rgb"))
    df = df.withColumns({"lr": lin[0], "lg": lin[1], "lb": lin[2], "top": top, "seen": low >= DARK, "ok": (low >= DARK) & (top <= CLIPPED)})
    # The peak is that of all pixels; everything else is measured on the sampled ones.
    peak = df.groupBy("image_id").agg(F.max("top").alias("peak"), *([(F.max("x") + 1).alias("w"), F.greatest(F.lit(1), F.floor(F.count("*") / samples)).alias("stride")] if {"y", "x"} <= set(df.columns) else []))
    if "stride" in peak.columns:
        df = meet(df, peak.drop("peak")).filter((F.col("y").cast("bigint") * F.col("w") + F.col("x")) % F.col("stride") == 0)
    total = F.greatest(F.col("lr") + F.col("lg") + F.col("lb"), F.lit(1e-6))
    first = df.groupBy("image_id").agg(
        F.count_if("seen").alias("n_seen"), F.count_if("ok").alias("n_ok"),
        *[F.avg(F.when(F.col("ok"), F.pow(f"l{c}", F.lit(float(NORM))))).alias(f"p{c}") for c in "rgb"], *[F.avg(F.when(F.col("ok"), F.col(f"l{c}") / total)).alias(f"c{c}") for c in "rgb"],
    )
    both = meet(df, first)
    spread = sum((F.abs(F.col(f"l{c}") / total - F.col(f"c{c}")) for c in "rgb"), F.lit(0.0)) / 3
    first = first.join(both.groupBy("image_id").agg(F.avg(F.when(F.col("ok"), spread)).alias("diversity")), "image_id")
    means = [F.greatest(F.pow(F.col(f"p{c}"), F.lit(1 / NORM)), F.lit(1e-6)) for c in "rgb"]
    first = first.withColumns(dict(zip(("mr", "mg", "mb"), means, strict=True)))
    damp = C.clamp((F.col("diversity") - DIVERSITY[0]) / (DIVERSITY[1] - DIVERSITY[0]))
    first = first.withColumns({f"g{c}": F.when(F.col("n_ok") >= LEAST, F.greatest(F.lit(1 / MAX_GAIN), F.least(F.lit(MAX_GAIN), 1 + ((F.col("mr") + F.col("mg") + F.col("mb")) / 3 / F.col(f"m{c}") - 1) * damp))).otherwise(1.0) for c in "rgb"})
    first = first.withColumn("gy", C.luma(*[F.col(f"g{c}") for c in "rgb"])).withColumns({f"g{c}": F.col(f"g{c}") / F.col("gy") for c in "rgb"})
    shown = F.greatest(C.luma(*[F.col(f"l{c}") * F.col(f"g{c}") for c in "rgb"]), F.lit(1e-6))
    key = meet(df, first.select("image_id", "gr", "gg", "gb")).groupBy("image_id").agg(F.exp(F.avg(F.when(F.col("seen"), F.ln(shown)))).alias("key"))
    out = first.join(key, "image_id").join(peak.select("image_id", "peak"), "image_id")
    limit = lambda x: F.greatest(F.lit(-MAX_EV), F.least(F.lit(MAX_EV), x))
    white = lambda ev: F.greatest(F.lit(1.0), C.linear(F.col("peak")) * F.greatest("gr", "gg", "gb") * F.pow(F.lit(2.0), F.col(ev)))
    out = out.withColumn("ev", limit(F.log2(KEY / F.col("key")))).withColumn("white", white("ev")).withColumn("k", F.col("key") * F.pow(F.lit(2.0), F.col("ev")))
    out = out.withColumn("rolled", F.col("k") * (1 + F.col("k") / (F.col("white") * F.col("white"))) / (1 + F.col("k")))
    out = out.withColumn("ev", limit(F.col("ev") + F.log2(KEY / F.col("rolled")))).withColumn("white", white("ev"))
    enough = F.col("n_seen") >= LEAST
    pick = lambda x, other: F.when(enough, x).otherwise(other)
    return out.select(
        "image_id", pick(F.col("ev"), 0.0).alias("norm_ev"), *[pick(F.col(f"g{c}"), 1.0).alias(f"norm_gain_{c}") for c in "rgb"],
        pick(C.clamp(-F.col("ev") / 2) * 0.6, 0.0).alias("norm_toe"), pick(F.col("white"), 1.0).alias("norm_white"),
    )


def pixels_of(frames: DataFrame) -> DataFrame:
    """pixels(image_id, y, x, r, g, b) of frames, in Arrow batches of some rows of a frame each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                image, h, w = (b.column(c)[k] for c in range(3))
                h, w = h.as_py(), w.as_py()
                planes = np.frombuffer(b.column(3)[k].as_buffer(), "<f4").reshape(3, h, w)
                step = max(1, 100_000 // w)
                for lo in range(0, h, step):
                    part = planes[:, lo : lo + step].reshape(3, -1).astype(np.float64)
                    n = part.shape[1]
                    names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([image.as_py()])).cast(pa.string())
                    at = np.arange(n, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([names, pa.array(at // w + np.int32(lo)), pa.array(at % w), *map(pa.array, part)], ["image_id", "y", "x", "r", "g", "b"])

    return frames.select("image_id", "h", "w", "planes").mapInArrow(run, "image_id string, y int, x int, r double, g double, b double")


def normalize(df: DataFrame, metered: DataFrame, highlight_priority: float = 0.0) -> DataFrame:
    """Exposure, balance and white point as metered; metered has a row for each image, which is small beside the frames."""
    d = _meeting(metered)(df.withColumns({f"s{c}": F.col(c) for c in "rgb"}), metered)
    d = d.withColumns({c: C.linear(F.col(c)) * F.col(f"norm_gain_{c}") * F.pow(F.lit(2.0), F.col("norm_ev")) for c in "rgb"})
    v = F.greatest(*map(F.col, "rgb"))
    d = d.withColumn("v", v).withColumn("k", F.when(F.col("norm_white") > 1, F.col("v") * (1 + F.col("v") / (F.col("norm_white") * F.col("norm_white"))) / (1 + F.col("v")) / F.greatest(F.col("v"), F.lit(1e-6))).otherwise(1.0))
    d = d.withColumns({c: C.display(F.col(c) * F.col("k")) for c in "rgb"}).withColumn("v", v)
    u = F.greatest(F.lit(0.0), (0.06 - F.col("v")) / 0.06)
    d = d.withColumn("u", u).withColumn("vt", F.when((F.col("norm_toe") > 0.001) & (F.col("v") < 0.06), 0.06 - 0.06 * (F.col("u") + F.col("norm_toe") * (1 - F.exp(-F.col("u")) - F.col("u")))).otherwise(F.col("v")))
    d = d.withColumns({c: F.col(c) * F.when(F.col("norm_toe") > 0.001, F.col("vt") / F.greatest(F.col("v"), F.lit(1e-4))).otherwise(1.0) for c in "rgb"})
    if highlight_priority > 0.001:
        w = C.smoothstep(0.15, 1.0, F.greatest("sr", "sg", "sb")) * highlight_priority
        d = d.withColumn("w", w).withColumns({c: F.col(c) + (F.col(f"s{c}") - F.col(c)) * F.col("w") for c in "rgb"})
    return d.withColumns({c: C.clamp(F.col(c)) for c in "rgb"}).select(df.columns)
