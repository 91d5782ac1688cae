"""Image files as frames, and frames as image files.

PNG (8 and 16 bits) is decoded here, JPEG by Spark's image source; both end as frames(image_id, h, w, planes). Files that
are too large, of another kind, or broken come back as a table of rejects with a reason.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsa.kernels.primitives import downscale
from emulsa.operators.render import FRAME, planes_of

from . import jpeg, png

MAX_BYTES, MAX_PIXELS, PROXY_EDGE = 30_000_000, 120_000_000, 2400
# Media type, extension and bits of each export format.
FORMATS = {"png16": ("image/png", "png", 16), "png8": ("image/png", "png", 8), "jpeg": ("image/jpeg", "jpg", 8)}


def kind_of(content: Column) -> Column:
    magic = F.hex(F.substring(content, 1, 4))
    return F.when(magic == "89504E47", "png").when(magic.startswith("FFD8FF"), "jpeg")


def scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, length, content, kind, reason (null if the file may be read) of all files under path, or of a list of files."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = kind_of(F.col("content"))
    big = F.conv(F.hex(F.substring("content", 17, 4)), 16, 10).cast("bigint") * F.conv(F.hex(F.substring("content", 21, 4)), 16, 10).cast("bigint") > MAX_PIXELS
    reason = F.when(F.col("length") > MAX_BYTES, "too large").when(kind.isNull(), "unsupported type").when((kind == "png") & big, "too many pixels")
    return d.select("path", "length", "content", kind.alias("kind"), reason.alias("reason"))


def orientation(data: bytes) -> int:
    """The EXIF orientation of a JPEG file, 1 if it tells none."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            t = data[at + 10 : at + 2 + n]
            end = "<" if t[:2] == b"II" else ">"
            (ifd,) = struct.unpack(end + "I", t[4:8])
            (count,) = struct.unpack(end + "H", t[ifd : ifd + 2])
            for k in range(count):
                tag, _, _, value = struct.unpack(end + "HHIH", t[ifd + 2 + 12 * k : ifd + 12 + 12 * k])
                if tag == 0x0112:
                    return value if 1 <= value <= 8 else 1
            return 1
        if marker == 0xDA:
            break
        at += 2 + n
    return 1


def oriented(x: np.ndarray, tag: int) -> np.ndarray:
    """Planes turned upright."""
    if tag in (5, 6, 7, 8):
        x = x.transpose(0, 2, 1)
    flips = {2: (2,), 3: (1, 2), 4: (1,), 6: (2,), 7: (1, 2), 8: (1,)}.get(tag, ())
    return np.ascontiguousarray(np.flip(x, flips) if flips else x)


def _decode_png(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            x, why = None, None
            try:
                x = png.decode(b.column(1)[k].as_py())
            except Exception as e:  # a broken file becomes a reject with this reason
                why = f"broken: {e}"
            h, w = x.shape[1:] if x is not None else (None, None)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([x.tobytes() if x is not None else None], pa.binary()), pa.array([why], pa.string())], ["image_id", "h", "w", "planes", "reason"])


def _decode_jpeg(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            image, h, w, n, data, head = (b.column(c)[k].as_py() for c in range(6))
            v = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(np.float32) / 255
            v = v[..., [2, 1, 0]] if n >= 3 else np.repeat(v, 3, axis=-1)
            x = oriented(np.moveaxis(v, -1, 0), orientation(head))
            yield pa.RecordBatch.from_arrays([pa.array([image]), pa.array([x.shape[1]], pa.int32()), pa.array([x.shape[2]], pa.int32()), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())], ["image_id", "h", "w", "planes"])


def read_images(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """frames of the images under path (or of a list of files), and rejects(path, reason): every file is in one of them."""
    files = scan(spark, path)
    pngs = files.filter("kind = 'png' and reason is null").select(F.col("path").alias("image_id"), "content").mapInArrow(_decode_png, FRAME + ", reason string")
    norm = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    heads = files.filter("kind = 'jpeg' and reason is null").select(norm(F.col("path")).alias("image_id"), F.substring("content", 1, 65536).alias("head"))
    shown = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path).select("image.*")
    shown = shown.select(norm(F.col("origin")).alias("image_id"), "height", "width", "nChannels", "data")
    big = F.col("height").cast("bigint") * F.col("width") > MAX_PIXELS
    jpegs = shown.filter(~big).join(heads, "image_id").mapInArrow(_decode_jpeg, FRAME)
    told = heads.select("image_id").join(shown.select("image_id", big.alias("big")), "image_id", "left")
    bad = told.filter("big is null or big").select(F.col("image_id").alias("path"), F.when(F.col("big"), "too many pixels").otherwise("broken: not a JPEG file that can be read").alias("reason"))
    frames = pngs.filter("reason is null").drop("reason").unionByName(jpegs)
    rejects = files.filter("reason is not null").select("path", "reason").union(pngs.filter("reason is not null").select("image_id", "reason")).union(bad)
    return frames, rejects


def proxies(frames: DataFrame, edge: int = PROXY_EDGE) -> DataFrame:
    """Frames no larger than edge on a side, with the scale they were brought to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                h, w = b.column(1)[k].as_py(), b.column(2)[k].as_py()
                scale = min(1.0, edge / max(h, w))
                x = downscale(planes_of(b.column(3)[k].as_py(), h, w), scale)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([x.shape[1]], pa.int32()), pa.array([x.shape[2]], pa.int32()), pa.array([np.ascontiguousarray(x, dtype="<f4").tobytes()], pa.binary()), pa.array([scale])], ["image_id", "h", "w", "planes", "scale"])

    return frames.select("image_id", "h", "w", "planes").mapInArrow(run, FRAME + ", scale double")


def encoded(frames: DataFrame, fmt: str = "png16", quality: int = 95) -> DataFrame:
    """image_id, mime, bytes of the frames as files; quality (60 to 100) is for JPEG."""
    mime, _, depth = FORMATS[fmt]  # KeyError for a format that is not listed
    quality = min(100, max(60, quality))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x = planes_of(b.column(3)[k].as_py(), b.column(1)[k].as_py(), b.column(2)[k].as_py())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([mime]), pa.array([jpeg.encode(x, quality) if fmt == "jpeg" else png.encode(x, depth)], pa.binary())], ["image_id", "mime", "bytes"])

    return frames.select("image_id", "h", "w", "planes").mapInArrow(run, "image_id string, mime string, bytes binary")


def export_name(name: str, supersample: float, full: bool, fmt: str) -> str:
    stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    tag = ("_full" if full else "") + (f"_ss{supersample:g}" if supersample != 1 else "")
    return f"{stem}_grain{tag}".replace(".", "_") + "." + FORMATS[fmt][1]


def write_images(frames: DataFrame, place: str, fmt: str = "png16", supersample: float = 1.0, full: bool = False, quality: int = 95) -> DataFrame:
    """Writes each frame to a file in a folder that all executors share; image_id, file, n_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(place)
        store.create_dir(path, recursive=True)
        for b in batches:
            for k in range(b.num_rows):
                image, data = b.column(0)[k].as_py(), b.column(2)[k].as_py()
                name = export_name(image, supersample, full, fmt)
                with store.open_output_stream(f"{path}/{name}") as out:
                    out.write(data)
                yield pa.RecordBatch.from_arrays([pa.array([image]), pa.array([name]), pa.array([len(data)])], ["image_id", "file", "n_bytes"])

    return encoded(frames, fmt, quality).mapInArrow(run, "image_id string, file string, n_bytes bigint")
