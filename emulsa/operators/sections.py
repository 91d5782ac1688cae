"""Renders that begin where the parameters changed: pictures at the boundaries of sections, kept as tables.

A boundary's table has the padded tiles of a source at the working size. Its key is made of what lies above: the source's
content, all parameters but those of the sections below, the lookup table's content, tile size, supersampling and scale. So
nothing has to be declared stale: a change below a boundary finds the table, and reads neither the source nor a stage above
it; a change above makes another key. Tables are written first and read back, for a first render too, so that both give the
same frame.

Which tables there are is in a small file for each of them; the least recently used are taken out beyond a budget of bytes.
All is in one folder that driver and executors share, and other sessions may use it as well.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import replace

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsa.kernels.stages import BOUNDARIES, PARTS
from emulsa.params.catalog import PARAMS
from emulsa.plans.planner import Plan

from .render import METER, NAMES, cut, render_tiles, stitch

#: Tiles get an overlap of a multiple of so many pixels, so that most changes of a radius below a boundary keep within it.
OVERLAP_STEP = 32
#: Sections that lie below a boundary, but are read above it: the tone curve shapes the masks of the grain.
READ_ABOVE = {"Halation": {"Tone Response"}}


def below(boundary: str) -> set[str]:
    """Keys of the parameters that nothing above a boundary reads."""
    sections = list(dict.fromkeys(p.section for p in PARAMS))
    after = set(sections[sections.index(boundary) :]) - READ_ABOVE.get(boundary, set())
    return {p.key for p in PARAMS if p.section in after}


def signature(plan: Plan, boundary: str) -> str:
    """Of all that the picture at a boundary depends on, but the source and the overlap."""
    skip = below(boundary)
    told = [sorted((k, float(v)) for k, v in plan.params.items() if k not in skip and isinstance(v, (int, float))), boundary, plan.tile, plan.supersample, plan.scale]
    digest = hashlib.sha256(json.dumps(told).encode())
    for k, v in sorted((plan.lut or {}).items()):
        digest.update(repr((k, getattr(v, "shape", None))).encode() + (v.tobytes() if hasattr(v, "tobytes") else repr(v).encode()))
    return digest.hexdigest()


class Sections:
    """Sources and boundary tables under a folder (a URI that Spark and pyarrow open)."""

    def __init__(self, spark: SparkSession, place: str, budget: int = 8 << 30):
        self.spark, self.place, self.budget = spark, place.rstrip("/"), budget
        self.store, self.root = pafs.FileSystem.from_uri(self.place)
        for folder in ("sources", "tables", "known"):
            self.store.create_dir(f"{self.root}/{folder}", recursive=True)

    def open(self, frames: DataFrame, meter: DataFrame | None = None) -> str:
        """The id of frames with their metered values: the same content has the same id, and is written once."""
        frames = frames.select("image_id", "h", "w", "planes")
        known = frames.withColumn("meter", F.lit(None).cast("string")) if meter is None else frames.join(meter.select("image_id", F.to_json(F.struct(*METER)).alias("meter")), "image_id", "left")
        digests = [F.sum(F.xxhash64(F.lit(k), "image_id", "h", "w", "planes", F.coalesce("meter", F.lit(""))).cast("decimal(38,0)")) for k in (1, 2)]
        source = hashlib.sha256(repr(tuple(known.agg(F.count("*"), *digests).first())).encode()).hexdigest()[:32]
        if self.store.get_file_info(f"{self.root}/sources/{source}/_SUCCESS").type == pafs.FileType.NotFound:
            known.write.mode("overwrite").parquet(f"{self.place}/sources/{source}")
        return source

    def known(self) -> list[dict]:
        """The boundary tables: key, folder, overlap, bytes, used; the least recently used first."""
        files = self.store.get_file_info(pafs.FileSelector(f"{self.root}/known"))
        out = []
        for f in files:
            if f.extension == "json":
                with self.store.open_input_stream(f.path) as stream:
                    out.append(json.loads(stream.read()))
        return sorted(out, key=lambda e: e["used"])

    def _note(self, entry: dict) -> None:
        with self.store.open_output_stream(f"{self.root}/known/{entry['folder']}.json") as out:
            out.write(json.dumps(entry | {"used": time.time()}).encode())

    def _forget(self, entry: dict) -> None:
        self.store.delete_file(f"{self.root}/known/{entry['folder']}.json")
        self.store.delete_dir(f"{self.root}/tables/{entry['folder']}")

    def _trim(self, keep: set[str]) -> None:
        entries = self.known()
        total = sum(e["bytes"] for e in entries)
        for e in entries:
            if total <= self.budget:
                return
            if e["folder"] not in keep:
                self._forget(e)
                total -= e["bytes"]

    def _written(self, tiles: DataFrame, key: str, overlap: int) -> dict:
        folder = uuid.uuid4().hex
        tiles.write.parquet(f"{self.place}/tables/{folder}")
        size = sum(f.size for f in self.store.get_file_info(pafs.FileSelector(f"{self.root}/tables/{folder}")) if f.type == pafs.FileType.File)
        entry = {"key": key, "folder": folder, "overlap": overlap, "bytes": size}
        self._note(entry)
        return entry

    def _read(self, entry: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.place}/tables/{entry['folder']}")

    def tiles(self, source: str, plan: Plan) -> DataFrame:
        """The rendered tiles of a source. Read them before so many other renders that the budget is used up."""
        plan = replace(plan, halo=-(-plan.halo // OVERLAP_STEP) * OVERLAP_STEP)
        whole = self.spark.read.parquet(f"{self.place}/sources/{source}")
        if plan.neutral:
            return cut(whole, replace(plan, halo=0))
        meter = whole.filter("meter is not null").select("image_id", F.from_json("meter", ", ".join(f"{c} double" for c in METER)).alias("m")).select("image_id", "m.*")
        meter = meter if plan.params["normalize"] >= 0.5 else None
        active = [plan.params["normalize"] >= 0.5, True, True]  # a boundary below which nothing has been done is not kept
        keys = {k: hashlib.sha256(f"{source} {signature(plan, b)}".encode()).hexdigest() for k, b in enumerate(BOUNDARIES) if active[k]}
        entries = self.known()
        done, used = None, set()
        for k in sorted(keys, reverse=True):
            fits = [e for e in entries if e["key"] == keys[k] and e["overlap"] >= plan.halo]
            if fits:
                done = k, min(fits, key=lambda e: e["overlap"])
                break
        if done:
            at, entry = done
            overlap, now = entry["overlap"], self._read(entry)
            self._note(entry)
            used.add(entry["folder"])
        else:
            at, overlap = -1, plan.halo
            n = self.spark.sparkContext.defaultParallelism * 4
            now = cut(whole, plan).repartition(n, "image_id", "ty", "tx")
        for k in sorted(keys):
            if k > at:
                entry = self._written(render_tiles(now, plan, meter if at < 0 else None, at + 1, k + 1), keys[k], overlap)
                used.add(entry["folder"])
                at, now = k, self._read(entry)
        self._trim(used)
        return render_tiles(now, plan, None, at + 1, len(PARTS)).select(*NAMES)

    def render(self, source: str, plan: Plan) -> DataFrame:
        """The rendered frames of a source."""
        return stitch(self.tiles(source, plan))
