"""Queries of operators that SQL can't say: kernels on tiles, over frames made of the analytic scene and the events grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsa.operators.render import FRAME, planes_of, render
from emulsa.plans.planner import plan

KEPT: dict[str, tuple] = {}
#: All stages of grain, edges and halation off.
OFF = dict.fromkeys(("intensity", "global_intensity", "micro_blur", "acutance", "edge_erosion", "halation", "edge_jitter", "sharpen"), 0.0)


def events_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events grid as a frame of 100 columns."""
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("value") / 500).alias("r"), ((F.col("user_id") % 64) / 63).alias("g"), (F.col("event_id") * 37 % 101 / 100).alias("b"))
    # Blocks of 64 rows each make a frame of their own, so that frames are many and small.
    block = F.floor(F.col("event_id") / 6400)
    lists = d.groupBy(block.cast("string").alias("image_id")).agg(F.sort_array(F.collect_list(F.struct("event_id", "r", "g", "b"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x = np.stack([np.asarray(b.column(c)[k].as_py(), "<f4") for c in (1, 2, 3)])
                h = max(2, -(-x.shape[1] // 100))  # a row that is not full ends in black
                x = np.ascontiguousarray(np.pad(x, [(0, 0), (0, 100 * h - x.shape[1])]).reshape(3, h, 100))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([x.shape[1]], pa.int32()), pa.array([x.shape[2]], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["image_id", "h", "w", "planes"])

    return lists.select("image_id", "p.r", "p.g", "p.b").mapInArrow(run, FRAME)


def pixels(frames: DataFrame) -> DataFrame:
    """The long layout of frames, in thousandths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                image, h, w = (b.column(c)[k].as_py() for c in range(3))
                x = planes_of(b.column(3)[k].as_py(), h, w)
                y, u = np.mgrid[0:h, 0:w]
                q = np.floor(x * 1000 + 0.5).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([image] * (h * w)), pa.array(y.ravel().astype(np.int32)), pa.array(u.ravel().astype(np.int32)), *[pa.array(c.ravel()) for c in q]], ["image_id", "y", "x", "r", "g", "b"])

    return frames.select("image_id", "h", "w", "planes").mapInArrow(run, "image_id string, y int, x int, r int, g int, b int")


def _put(name: str, values: dict, supersample: float = 1) -> None:
    made = plan(OFF | values, supersample, tile=96)
    KEPT[name] = (lambda spark, sf_dir: pixels(render(events_frame(spark, sf_dir), made)), None)


_put("grain_points", {"global_intensity": 60, "global_size": 1.5, "global_size_max": 4})
_put("global_grain", {"global_intensity": 30, "global_src_r": 40, "global_src_g": 20, "global_src_b": 20, "global_src_l": 30, "global_chroma": 0.4, "global_mottle": 0.5, "global_smooth": 0.4, "global_blend": 1})
_put("main_grain", {"intensity": 40})
_put("dust", {"dust": 30, "dust_size": 6, "dust_irregular": 0.5, "dust_balance": 0.2})
_put("hair", {"hair": 4, "hair_length": 60})
_put("scratches", {"scratches": 8})
_put("light_leaks", {"light_leak": 3, "leak_size_min": 20, "leak_size_max": 60, "leak_feather": 20})
_put("antialias", {"aa_strength": 2})
_put("sand", {"edge_sand": 0.8, "edge_sand_grit": 1.2})
_put("jitter", {"edge_jitter": 1.0, "jitter_aniso": 0.5, "jitter_angle": 30})
_put("edge_soften", {"edge_soften": 0.8})
_put("edge_erosion", {"edge_erosion": 0.6, "intensity": 30})
_put("scatter_stage", {"scatter": 0.6, "scatter_pattern": 6})
_put("reconstruct", {"grade_recover": 1.0, "grade_recover_radius": 4})
_put("halation_guard", {"halation": 0.5, "halation_radius": 6, "halation_blue": 1.0, "halation_recovery": 0.5})
_put("supersample", {"intensity": 30}, 2)
_put("supersample_fraction", {"intensity": 30}, 1.5)
_put("full_pipeline", {"intensity": 32, "micro_blur": 0.45, "acutance": 0.25, "edge_erosion": 0.5, "edge_jitter": 0.3, "halation": 0.35, "halation_radius": 6, "grade_exposure": 0.3, "grade_contrast": 0.2, "global_intensity": 10, "dust": 10, "sharpen": 0.5}, 2)


def _resized(spark: SparkSession, sf_dir: str, scale: float) -> DataFrame:
    from emulsa.kernels.primitives import downscale, upscale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                h, w = b.column(1)[k].as_py(), b.column(2)[k].as_py()
                x = planes_of(b.column(3)[k].as_py(), h, w)
                x = np.ascontiguousarray(downscale(x, scale) if scale < 1 else upscale(x, round(h * scale), round(w * scale)), "<f4")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([x.shape[1]], pa.int32()), pa.array([x.shape[2]], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["image_id", "h", "w", "planes"])

    return pixels(events_frame(spark, sf_dir).mapInArrow(run, FRAME))


KEPT["downscale"] = (lambda s, d: _resized(s, d, 0.5), None)
KEPT["upscale"] = (lambda s, d: _resized(s, d, 1.5), None)
