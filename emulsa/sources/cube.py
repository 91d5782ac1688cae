"""3D lookup tables in .cube files."""

from __future__ import annotations

import os
import re
import threading
import uuid
from collections import OrderedDict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES, SIZES = 24_000_000, range(2, 97)


def parse(text: str, name: str = "") -> dict:
    """size, dmin, dmax, table (red fastest), name; unknown words are skipped, 1D and truncated tables refused."""
    size, dmin, dmax, values = 0, [0.0] * 3, [1.0] * 3, []
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        word, *rest = line.split()
        key = word.upper()
        if key == "TITLE":
            name = line[len(word) :].strip().strip('"') or name
        elif key == "LUT_1D_SIZE":
            raise ValueError("a one-dimensional table")
        elif key == "LUT_3D_SIZE":
            size = int(rest[0])
        elif key == "DOMAIN_MIN":
            dmin = [float(x) for x in rest[:3]]
        elif key == "DOMAIN_MAX":
            dmax = [float(x) for x in rest[:3]]
        elif key in ("LUT_3D_INPUT_RANGE", "LUT_1D_INPUT_RANGE"):
            dmin, dmax = [float(rest[0])] * 3, [float(rest[1])] * 3
        elif re.match(r"[-+.\d]", word):
            values += [float(x) for x in (word, *rest)[:3]]
    if size not in SIZES:
        raise ValueError("no size, or one out of range")
    if any(b - a <= 0 for a, b in zip(dmin, dmax, strict=True)):
        raise ValueError("an empty domain")
    if len(values) < 3 * size**3:
        raise ValueError("a truncated table")
    return {"name": name, "size": size, "dmin": dmin, "dmax": dmax, "table": values[: 3 * size**3]}


def safe_id(lut_id: str) -> str:
    """lut_id if it is a relative path without tricks."""
    if not lut_id or "\\" in lut_id or lut_id.startswith("/") or any(p in ("", ".", "..") for p in lut_id.split("/")):
        raise ValueError(f"not a table's id: {lut_id!r}")
    return lut_id


def scan(spark: SparkSession, root: str) -> DataFrame:
    """id, name, group, size, dmin, dmax, table of all tables under root that can be read; ids are paths without suffix, those at the root first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][uU][bB][eE]").load(root)
    files = files.filter(F.col("length") <= MAX_BYTES).select("path", F.decode("content", "utf-8").alias("text"))
    base = re.sub(r"^file:/*", "/", root).rstrip("/")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lut_id = re.sub(r"^file:/*", "/", path).removeprefix(base).lstrip("/").rsplit(".", 1)[0]
                try:
                    t = parse(text, lut_id.rsplit("/", 1)[-1])
                except ValueError:
                    continue
                row = {"id": [lut_id], "name": [t["name"]], "group": [lut_id.rpartition("/")[0]], "size": pa.array([t["size"]], pa.int32()), "dmin": [t["dmin"]], "dmax": [t["dmax"]], "table": pa.array([t["table"]], pa.list_(pa.float32()))}
                yield pa.RecordBatch.from_pydict(row)

    out = files.mapInArrow(run, "id string, name string, `group` string, size int, dmin array<double>, dmax array<double>, `table` array<float>")
    return out.orderBy(F.col("group") != "", "group", "name")


_READ: OrderedDict[tuple, dict | None] = OrderedDict()
_UPLOADED: OrderedDict[str, dict] = OrderedDict()
#: Tables that the driver remembers, of each kind; the least recently used go.
MAX_READ, MAX_UPLOADED = 16, 8
UPLOAD = "upload:"
_lock = threading.Lock()  # exports run in threads


def _recent(kept: OrderedDict, key, most: int, value=None):
    """The value under key (None if there is none), which is now the most recently used; with a value, after putting it there."""
    with _lock:
        if value is not None:
            kept[key] = value
        if key not in kept:
            return None
        kept.move_to_end(key)
        while len(kept) > most:
            kept.popitem(last=False)
        return kept[key]


def inside(root: str, path: str) -> bool:
    """Whether a path lies under root with all links followed; stores that are no local folder have no links."""
    if "://" in root and not root.startswith("file:"):
        return True
    root, path = (os.path.realpath(re.sub(r"^file:/*", "/", x)) for x in (root, path))
    return path.startswith(root.rstrip("/") + "/")


def get(spark: SparkSession, root: str, lut_id: str) -> dict | None:
    """One table for a plan; None if there is none, or one that is too large or bad. Read once as long as its time and size stay."""
    if lut_id.startswith(UPLOAD):
        return _recent(_UPLOADED, lut_id, MAX_UPLOADED)
    path = f"{root}/{safe_id(lut_id)}.cube"
    if not inside(root, path):
        return None
    try:
        found = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length").collect()
    except AnalysisException:  # no such file
        return None
    if not found or found[0]["length"] > MAX_BYTES:
        return None
    key = tuple(found[0])
    if (held := _recent(_READ, key, MAX_READ)) is not None:
        return held
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    try:
        return _recent(_READ, key, MAX_READ, parse(bytes(data).decode("utf-8", "replace"), lut_id.rsplit("/", 1)[-1]) | {"id": lut_id})
    except ValueError:
        return None


def upload(name: str, content: bytes) -> str:
    """Keeps an uploaded table under a new id, the MAX_UPLOADED last ones; ValueError if it is none, or too large."""
    if not name.lower().endswith(".cube"):
        raise ValueError("not a .cube file")
    if len(content) > MAX_BYTES:
        raise ValueError("too large")
    lut_id = UPLOAD + uuid.uuid4().hex
    _recent(_UPLOADED, lut_id, MAX_UPLOADED, parse(content.decode("utf-8", "replace"), name.rsplit("/", 1)[-1].rsplit(".", 1)[0]) | {"id": lut_id})
    return lut_id


def uploads() -> list[dict]:
    """id, name, size of the uploaded tables, the latest first."""
    with _lock:
        return [{"id": k, "name": v["name"], "size": v["size"]} for k, v in reversed(_UPLOADED.items())]
