"""WARC archives: written with an index, read by coalesced byte ranges.

Writing: payload digests are grouped (with partial sums) to find the smallest page_id of each that repeats. Digests that a
large share of the pages have meet their pages by broadcast, so such pages stay where they are; the others by a join. One
task writes one archive of gzip members, a warcinfo record and then a record for each page, and yields its part of the index:
file, offset, length, url, digest. Reading: the index rows that are wanted are dealt by archive and by RANGE bytes of it,
sorted by offset, and neighbours are read in one request. Archives of runs that failed or were repeated are in no index, so
they count nowhere.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, fresh_dir, pinned, table, written

INDEX = "page_id bigint, url string, payload_digest string, record_type string, refers_to bigint, file string, offset bigint, length bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint, length bigint, payload binary"
#: A reading task's part of an archive; gaps that are read rather than skipped.
RANGE, GAP, REQUEST = 32 << 20, 64 << 10, 4 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def warcinfo(name: str) -> bytes:
    """The record at the head of an archive."""
    block = b"software: emulsa\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 6, mtime=0)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_to_url: str | None = None) -> bytes:
    """A WARC 1.1 record as one gzip member: a response, or a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Target-URI: {_line(url) if url else 'about:blank'}", f"WARC-Date: {DATE}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}:{url}')}>", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {_line(refers_to_url) if refers_to_url else 'about:blank'}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """The record's headers (lower-case names) and its payload, taken from the HTTP message."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    return fields | {"payload": block.partition(b"\r\n\r\n")[2]}


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_warc(pages: DataFrame, place: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row (page_id, url, html) into archives under place; the index.

    Of records with equal payloads of at least least_bytes, that with the smallest page_id is a response and the others
    revisit it; where rows repeat that page_id with that payload, each of them is a response. Null html is an empty payload.
    Rows without page_id are responses, unless a row with a page_id has their payload. Null urls are written as about:blank
    and stay null in the index. An empty table writes nothing.
    """
    rows = pinned(pages, {"page_id": "bigint", "url": "string", "html": "string"}).withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "utf-8")))
    # A null page_id comes last, so it is the first only where no row of the payload has one.
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    first = rows.filter(F.octet_length("html") >= least_bytes).groupBy("sha").agg(least.alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    first = written(first.select("sha", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"), "n"), "warc-first")
    # Payloads of more than a HOT-th of the rows that repeat, so HOT of them at most: their pages are not dealt by digest.
    repeated = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot, rest = first.filter(F.col("n") > max(1, repeated // HOT)).select("sha", F.col("first").alias("hot"), F.col("first_url").alias("hot_url")), first.filter(F.col("n") <= max(1, repeated // HOT)).select("sha", "first", "first_url")
    told = rows.join(F.broadcast(hot), "sha", "left")
    told = told.withColumn("sha", F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))  # spread out: met already
    told = told.join(rest, "sha", "left").withColumn("first", F.coalesce("hot", "first")).withColumn("first_url", F.when(F.col("hot").isNotNull(), F.col("hot_url")).otherwise(F.col("first_url")))
    told = told.select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"), "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, ""
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            index = []
            for lo in range(0, batch.num_rows, 256):
                for page_id, url, html, refers_to, first_url in zip(*[c.to_pylist() for c in batch.slice(lo, 256).columns], strict=True):
                    if out is None:
                        store, path = pafs.FileSystem.from_uri(place)
                        store.create_dir(path, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                        out.write(head := warcinfo(name))
                        at = len(head)
                    payload = html.encode()
                    digest = digest_of(payload)
                    data = record(page_id, url, payload, digest, refers_to, first_url)
                    out.write(data)
                    index.append((page_id, url, digest, "response" if refers_to is None else "revisit", refers_to, name, at, len(data)))
                    at += len(data)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), schema.types, strict=True)], schema=schema)
        if out is not None:
            out.close()

    return written(told.mapInArrow(run, INDEX), "warc-index")


def requests(wanted: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
    """From row, to row, first byte, last byte (both ends exclusive) of the reads for rows (file, offset, length, ...) in order."""
    k = 0
    while k < len(wanted):
        file, start = wanted[k][:2]
        end, j = start + wanted[k][2], k + 1
        while j < len(wanted) and wanted[j][0] == file and wanted[j][1] <= end + GAP and wanted[j][1] + wanted[j][2] <= start + REQUEST:
            end = max(end, wanted[j][1] + wanted[j][2])
            j += 1
        yield k, j, start, end
        k = j


def read_warc(index: DataFrame, place: str, with_payload: bool = True) -> DataFrame:
    """The records of the index rows given, as RECORDS; payload_digest and payload_bytes of responses are those of the bytes read."""
    dealt = index.select("file", "offset", "length", "url", F.floor(F.col("offset") / RANGE).alias("part"))
    # Index rows are small beside what they name, so the number of tasks is given, or they would be coalesced into one.
    n = index.agg(F.coalesce(F.ceil(F.sum("length") / RANGE), F.lit(1))).first()[0]
    dealt = dealt.repartition(max(1, int(n)), "file", "part").sortWithinPartitions("file", "offset")
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(place)
        for batch in batches:
            wanted = list(zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True))
            for k, j, start, end in requests(wanted):
                file = wanted[k][0]
                with store.open_input_file(f"{path}/{file}") as source:
                    data = source.read_at(end - start, start)
                rows = []
                for _, offset, length, url in wanted[k:j]:
                    got = parse(data[offset - start : offset - start + length])
                    response = got["warc-type"] == "response"
                    digest = digest_of(got["payload"]) if response else got["warc-payload-digest"].removeprefix("sha1:")
                    n = len(got["payload"]) if response else int(got["x-payload-length"])
                    rows.append((int(got["x-page-id"]) if got["x-page-id"] else None, url, n, digest, got["warc-type"], int(got["x-refers-to-page-id"]) if "x-refers-to-page-id" in got else None, file, offset, length, got["payload"] if response and with_payload else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return dealt.mapInArrow(run, RECORDS)


def warc(pages: DataFrame, selected: Column | None = None, least_bytes: int = 0, place: str | None = None, with_payload: bool = True) -> DataFrame:
    """Writes all pages, then reads back the records whose index rows meet selected (all if none)."""
    place = place or fresh_dir(pages.sparkSession, "warc")
    index = write_warc(pages, place, least_bytes)
    return read_warc(index if selected is None else index.filter(selected), place, with_payload)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc(table(spark, sf_dir, "pages"), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: Base32 of the digest: 160 bits, five at a time.
OP2_SQL = """
with p as (select page_id, url, encode(coalesce(html, '')) as data from pages),
     d as (select *, sha1(data) as sha from p),
     bits as (select *, array_to_string(list_transform(string_split(sha, ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') as b from d),
     told as (select *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_transform(string_split(substr(b, cast(5 * i + 1 as int), 5), ''), lambda x: cast(x as int)), lambda a, x: 2 * a + x), 1)), '') as digest,
                     min(page_id) over (partition by sha) as first from bits)
select page_id, octet_length(data)::bigint as payload_bytes, digest as payload_digest, case when page_id is distinct from first then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from first then first end as refers_to, url
from told
"""
