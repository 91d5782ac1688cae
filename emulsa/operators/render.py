"""Rendering frames: padded tiles are cut once, dealt to tasks, run through all stages there, and cut to their cores.

frames: image_id string, h int, w int, planes binary (float32, channels first). tiles have one row a tile; one shuffle of
tiles is the only exchange, and no stage after it needs another. A tile's result depends on its place alone, so any tile
size and any number of tasks give the same frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsa.kernels.stages import PARTS, Place, enlarged, reduced, working_place, working_shape
from emulsa.kernels.stages import render as render_parts
from emulsa.plans.planner import Plan, tile_grid

FRAME = "image_id string, h int, w int, planes binary"
TILE = "image_id string, ty int, tx int, y_a int, y_b int, x_a int, x_b int, py_a int, py_b int, px_a int, px_b int, frame_h int, frame_w int, planes binary"
NAMES = [x.split()[0] for x in TILE.split(", ")]
METER = ("norm_ev", "norm_gain_r", "norm_gain_g", "norm_gain_b", "norm_toe", "norm_white")


def planes_of(data: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(data, "<f4").reshape(3, h, w)


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def cut(frames: DataFrame, plan: Plan) -> DataFrame:
    types = [pa.string(), *[pa.int32()] * 12, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                image, h, w, data = (batch.column(c)[k].as_py() for c in ("image_id", "h", "w", "planes"))
                x = planes_of(data, h, w)
                for ty, tx, *at in tile_grid(h, w, plan.tile, plan.halo):
                    yield _batch([(image, ty, tx, *at, h, w, np.ascontiguousarray(x[:, at[4] : at[5], at[6] : at[7]]).tobytes())], types, NAMES)

    return frames.select("image_id", "h", "w", "planes").mapInArrow(run, TILE)


def render_tiles(tiles: DataFrame, plan: Plan, meter: DataFrame | None = None, first: int = 0, last: int = len(PARTS), done: Accumulator | None = None) -> DataFrame:
    """Tiles with their padded planes, to tiles with the rendered core. meter: a row of METER for each image; done counts tiles.

    first and last choose parts of the stages: from a part on, tiles have their padded working picture in the column fine;
    up to a part that is not the last one, they get it there.
    """
    types = [pa.string(), *[pa.int32()] * 12, pa.binary()]
    if meter is not None:
        tiles = tiles.join(meter.select("image_id", F.struct(*METER).alias("meter")), "image_id", "left")
    else:
        tiles = tiles.withColumn("meter", F.lit(None).cast("struct<norm_ev:double>"))
    ends, begun = last == len(PARTS), ["fine"] if first else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {n: batch.column(n)[k].as_py() for n in [*NAMES, *begun, "meter"]}
                h, w = r["py_b"] - r["py_a"], r["px_b"] - r["px_a"]
                x = planes_of(r["planes"], h, w)
                place = working_place(Place(r["py_a"], r["px_a"], r["frame_h"], r["frame_w"], plan.scale, plan.lut, r["meter"] or {}), h, plan.supersample)
                y = planes_of(r["fine"], *working_shape(h, w, plan.supersample)) if first else enlarged(x, plan.supersample)
                y = render_parts(y, plan.params, place, first, last)
                if not ends:
                    r["fine"] = np.ascontiguousarray(y, dtype="<f4").tobytes()
                    yield _batch([tuple(r[n] for n in [*NAMES, "fine"])], [*types, pa.binary()], [*NAMES, "fine"])
                    continue
                y = reduced(y, x, plan.params, plan.supersample)
                if done is not None:
                    done.add(1)
                core = y[:, r["y_a"] - r["py_a"] : r["y_b"] - r["py_a"], r["x_a"] - r["px_a"] : r["x_b"] - r["px_a"]]
                r["planes"] = np.ascontiguousarray(core, dtype="<f4").tobytes()
                yield _batch([tuple(r[n] for n in NAMES)], types, NAMES)

    return tiles.select(*NAMES, *begun, "meter").mapInArrow(run, TILE if ends else f"{TILE}, fine binary")


def stitch(tiles: DataFrame) -> DataFrame:
    """Frames from the cores of their tiles; a task holds one frame at a time."""

    def join(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = np.empty((3, rows[0]["frame_h"], rows[0]["frame_w"]), "<f4")
        for r in rows:
            out[:, r["y_a"] : r["y_b"], r["x_a"] : r["x_b"]] = planes_of(r["planes"], r["y_b"] - r["y_a"], r["x_b"] - r["x_a"])
        return pa.Table.from_arrays([pa.array([rows[0]["image_id"]]), pa.array([out.shape[1]], pa.int32()), pa.array([out.shape[2]], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["image_id", "h", "w", "planes"])

    return tiles.groupBy("image_id").applyInArrow(join, FRAME)


def render(frames: DataFrame, plan: Plan, meter: DataFrame | None = None, partitions: int | None = None, done: Accumulator | None = None) -> DataFrame:
    """Frames put through the plan; a neutral plan gives the frames back. done: counts the tiles that tasks have finished."""
    if plan.neutral:
        return frames.select("image_id", "h", "w", "planes")
    tiles = cut(frames, plan)
    keys = ["image_id", "ty", "tx"]
    n = partitions or frames.sparkSession.sparkContext.defaultParallelism * 4
    return stitch(render_tiles(tiles.repartition(n, *keys), plan, meter, done=done))


def view(frames: DataFrame, plan: Plan, box: tuple[int, int, int, int], meter: DataFrame | None = None) -> DataFrame:
    """tiles of the part (y_a, y_b, x_a, x_b) of each frame: only tiles that meet it are rendered."""
    tiles = cut(frames, plan).filter((F.col("y_b") > box[0]) & (F.col("y_a") < box[1]) & (F.col("x_b") > box[2]) & (F.col("x_a") < box[3]))
    return render_tiles(tiles.repartition("image_id", "ty", "tx"), plan, meter)
