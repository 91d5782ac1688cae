"""What a caller of the service does: upload, look at a preview, export. The newest preview wins; exports run as tagged jobs."""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark import Accumulator, InheritableThread
from pyspark.sql import DataFrame, SparkSession

from emulsa.operators.meter import meter, pixels_of
from emulsa.operators.render import FRAME, render
from emulsa.operators.sections import Sections
from emulsa.params.ops import clamp_supersample, schema
from emulsa.plans.planner import Plan, plan, tile_grid
from emulsa.sources import cube, presets
from emulsa.sources.images import encoded, export_name, proxies

#: Frames, and finished exports, that are kept.
MAX_UPLOADS, MAX_EXPORTS = 12, 8


@dataclass
class Upload:
    frames: DataFrame
    name: str
    proxy: DataFrame
    megapixels: float
    metered: DataFrame | None = None
    #: Ids of the preview's source among the kept pictures, without and with metered values.
    sources: dict[bool, str] = field(default_factory=dict)


@dataclass
class Job:
    id: str
    filename: str
    status: str = "running"
    error: str = ""
    data: bytes = b""
    tiles: int = 0
    done: Accumulator | None = None
    told: float = 0.0
    created: float = field(default_factory=time.time)


class Service:
    def __init__(self, spark: SparkSession, kept: Sections | None = None):
        """kept: where previews find and leave pictures at the boundaries of sections; without it each is rendered whole."""
        self.spark, self.kept, self.uploads, self.jobs = spark, kept, OrderedDict(), OrderedDict()
        self._ticket, self._lock = 0, threading.Lock()

    def health(self) -> dict:
        return {"ok": True}

    def params(self, preset_folder: str | None = None, default_reference_mp: float | None = None) -> dict:
        """The schema, with the presets of a folder (some dozens of small files)."""
        found = presets.scan(self.spark, preset_folder, default_reference_mp).collect() if preset_folder else []
        return schema([r.asDict() for r in found], default_reference_mp=default_reference_mp)

    def upload(self, frames: DataFrame, name: str) -> str:
        """Keeps a frame (one row of frames) under a new id; the least recently used goes beyond MAX_UPLOADS."""
        frames = frames.select(*[x.split()[0] for x in FRAME.split(", ")]).persist()
        h, w = frames.select("h", "w").first()
        key = uuid.uuid4().hex
        self.uploads[key] = Upload(frames, name, proxies(frames).persist(), h * w / 1e6)
        while len(self.uploads) > MAX_UPLOADS:
            _, old = self.uploads.popitem(last=False)
            old.frames.unpersist()
            old.proxy.unpersist()
            if old.metered is not None:
                old.metered.unpersist()
        return key

    def get(self, key: str) -> Upload:
        self.uploads.move_to_end(key)  # KeyError if unknown
        return self.uploads[key]

    def _metered(self, up: Upload, p: Plan) -> DataFrame | None:
        if p.params["normalize"] < 0.5:
            return None
        if up.metered is None:  # once for each image
            up.metered = meter(pixels_of(up.frames)).persist()
        return up.metered

    def source(self, key: str) -> bytes:
        """The frame itself, as a JPEG file."""
        return bytes(encoded(self.get(key).proxy, "jpeg").first()["bytes"])

    def _planned(self, key: str, values: dict, supersample, full: bool, reference_mp: float | None, lut: dict | None) -> tuple[Upload, DataFrame, Plan]:
        up = self.get(key)
        source = up.frames if full else up.proxy
        scale = 1.0 if full else source.select("scale").first()[0]
        return up, source, plan(values, clamp_supersample(supersample), up.megapixels, reference_mp, lut, scale)

    def rendered(self, key: str, values: dict, supersample=2.0, full: bool = False, reference_mp: float | None = None, lut: dict | None = None, job: Job | None = None) -> DataFrame:
        """The rendered frame; job gets the number of its tiles, and a count of those that are done."""
        up, source, p = self._planned(key, values, supersample, full, reference_mp, lut)
        metered = self._metered(up, p)
        if self.kept and not full and job is None:
            normal = metered is not None
            if normal not in up.sources:
                up.sources[normal] = self.kept.open(source, metered)
            return self.kept.render(up.sources[normal], p)
        if job is not None:
            h, w = source.select("h", "w").first()
            job.tiles, job.done = 0 if p.neutral else len(tile_grid(h, w, p.tile, p.halo)), self.spark.sparkContext.accumulator(0)
        return render(source, p, metered, done=job and job.done)

    def preview(self, key: str, values: dict, **more) -> bytes | None:
        """The rendered frame as a JPEG file; None if a newer preview was asked for meanwhile."""
        with self._lock:
            self._ticket += 1
            mine = self._ticket
        self.spark.interruptTag("preview")
        self.spark.addTag("preview")
        try:
            data = encoded(self.rendered(key, values, **more), "jpeg").first()["bytes"]
        except Exception:
            if mine != self._ticket:
                return None
            raise
        finally:
            self.spark.removeTag("preview")
        return bytes(data) if mine == self._ticket else None

    def export(self, key: str, values: dict, fmt: str = "png16", supersample=2.0, full: bool = False, quality: int = 95, **more) -> str:
        up = self.get(key)
        job = Job(uuid.uuid4().hex, export_name(up.name, clamp_supersample(supersample), full, fmt))
        self.jobs[job.id] = job
        for old in [j.id for j in self.jobs.values() if j.status != "running"][:-MAX_EXPORTS]:
            del self.jobs[old]

        def run() -> None:
            try:
                self.spark.addTag(f"export-{job.id}")  # of this thread's jobs
                data = bytes(encoded(self.rendered(key, values, supersample, full, job=job, **more), fmt, quality).first()["bytes"])
                if job.status == "running":
                    job.data, job.status = data, "done"
            except Exception as e:  # the job's status tells
                if job.status == "running":
                    job.status, job.error = "error", str(e)

        InheritableThread(target=run, daemon=True, session=self.spark).start()
        return job.id

    def exports(self) -> list[dict]:
        """id, filename, status, error, created of the exports, the latest first."""
        return [{"id": j.id, "filename": j.filename, "status": j.status, "error": j.error, "created": j.created} for j in reversed(self.jobs.values())]

    def progress(self, job_id: str) -> float:
        """The share of an export's tiles that are done; it never goes back, and is 1 when the export is done."""
        job = self.jobs[job_id]
        if job.status == "done":
            return 1.0
        if job.tiles and job.done is not None:  # a task that runs twice counts twice
            job.told = max(job.told, min(1.0, job.done.value / job.tiles))
        return job.told

    def cancel(self, job_id: str) -> None:
        """Ends an export that runs."""
        job = self.jobs[job_id]
        if job.status == "running":
            job.status = "cancelled"
            self.spark.interruptTag(f"export-{job_id}")

    def download(self, job_id: str) -> tuple[str, bytes]:
        """File name and bytes of an export that is done, as often as asked for while it is among the latest MAX_EXPORTS."""
        job = self.jobs[job_id]
        if job.status != "done":
            raise ValueError(f"the export is {job.status}")
        return job.filename, job.data

    def luts(self, root: str) -> list[dict]:
        """id, name, group, size of the tables under root, and of those uploaded."""
        found = cube.scan(self.spark, root).select("id", "name", "group", "size").collect()
        return [{**x, "group": "uploads"} for x in cube.uploads()] + [r.asDict() for r in found]

    def upload_lut(self, name: str, content: bytes) -> str:
        return cube.upload(name, content)
