"""Token ids in fixed-width bit-packed files.

Rows are range-partitioned by doc_id (or kept in the order of the files they were read from), sorted, encoded, and each
task writes one file; ids take the fewest bits that the vocabulary needs. A file:

    magic "TOKPACK1", then uint32 bits, uint32 ids a block; the packed blocks, each beginning on a byte;
    footer: int64 byte offset of each block, int64 first id of each document (and the end), int64 doc_id, uint8 doc_id is null;
    tail: int64 number of blocks, int64 number of documents, int64 number of ids, int64 offset of the footer.

A range of ids is read by the offsets of the blocks that hold it, and unpacked with numpy. A task that is run again writes
a file of another name; the written list of files names those that count.
"""

from __future__ import annotations

import os
import re
import sys
import types
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_dir, pinned, table, written

MAGIC, BLOCK, END = b"TOKPACK1", 8192, 0
DOUBLE_SPACE, CUT = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")
FILES = "file string, n_ids bigint, n_docs bigint, part int"
#: A worker's memory of encoded pieces: a new one is begun beyond so many bytes, beside the last. Longer pieces are not kept.
MEMORY, LONG = 96 << 20, 256
#: What a piece costs beside its characters and ids.
OVERHEAD = 160


class Encoder:
    """Ids of texts by a byte-level tokenizer, as little-endian bytes of dtype.

    Such a tokenizer never joins what stands before a space between two visible characters with what follows, so texts are
    cut there and each piece is encoded once, all that are new to a batch of texts in one call. test_tokens holds this
    against whole texts. What is remembered is bounded in bytes; pieces of over LONG characters (lines of unspaced scripts,
    encoded data) are encoded each time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread: tasks share out the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = "<u2" if self.vocabulary <= 1 << 16 else "<u4"
        lengths = np.zeros(self.vocabulary, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            lengths[i] = len(token)  # a byte-level token has a character for each byte
        self.lengths = lengths
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """One for all tasks of a Python worker, which unpickles this module anew for each task."""
        state = sys.modules.setdefault("emulsa_worker_state", types.ModuleType("emulsa_worker_state"))
        encoders = state.__dict__.setdefault("encoders", {})
        if path not in encoders:
            encoders[path] = cls(path)
        return encoders[path]

    @staticmethod
    def pieces(text: str) -> list[str]:
        if DOUBLE_SPACE.search(text):
            head, *rest = CUT.split(text)
            return [head, *[" " + x for x in rest]]
        if "\0" not in text:
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):  # a line end between two visible characters stands alone, too
            head, *rest = line.split(" ")
            if k:
                out.append("\n")
            out.append(head)
            out += [" " + x for x in rest]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.pieces(x) for x in texts]
        if self.held >= MEMORY:
            self.known, self.older, self.held = {}, self.known, 0
        new = set().union(*cut).difference(self.known)
        again = {x for x in new if x in self.older}  # intersection() would go through all that is older
        self._keep((x, self.older[x]) for x in again)
        fresh = new - again
        long = [x for x in fresh if len(x) > LONG]
        self._learn([x for x in fresh if len(x) <= LONG])
        once = {x: np.array(e.ids, self.dtype).tobytes() for x, e in zip(long, self.tokenizer.encode_batch_fast(long, add_special_tokens=False), strict=True)} if long else {}
        self.known.update(once)
        out = [b"".join(map(self.known.__getitem__, x)) for x in cut]
        for x in once:
            del self.known[x]
        return out

    def _keep(self, pairs: Iterable[tuple[str, bytes]]) -> None:
        for piece, ids in pairs:
            self.known[piece] = ids
            self.held += len(piece) + len(ids) + OVERHEAD

    def _learn(self, new: list[str]) -> None:
        """Encodes new pieces, hundreds joined to a text: ids are dealt out again by the bytes that they stand for."""
        plain, odd = [x for x in new if x[:1] == " " and x != " "], [x for x in new if x[:1] != " " or x == " "]
        groups = [plain[k : k + 1024] for k in range(0, len(plain), 1024)] + [[x] for x in odd]
        joined = ["".join(g) for g in groups]
        for group, text, e in zip(groups, joined, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            if len(group) == 1:
                self._keep([(group[0], ids.tobytes())])
                continue
            ends = np.cumsum(list(map(len, group)) if text.isascii() else [len(x.encode()) for x in group])
            reached = np.cumsum(self.lengths[ids])
            cuts = np.searchsorted(reached, ends) + 1
            if len(ids) == 0 or cuts[-1] != len(ids) or not np.array_equal(reached[cuts - 1], ends):
                self._keep((x, np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, self.dtype).tobytes()) for x in group)
            else:
                data, at = ids.tobytes(), (ids.itemsize * cuts).tolist()
                self._keep(zip(group, [data[a:b] for a, b in zip([0, *at], at, strict=False)], strict=True))


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}", copy=False).tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    each = np.zeros((n, 32), np.uint8)
    each[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return np.packbits(each, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    def __init__(self, out, bits: int, dtype: str = "<u4", block: int = BLOCK):
        self.out, self.bits, self.dtype, self.block = out, bits, np.dtype(dtype), block
        self.held, self.n_held, self.n_ids, self.offsets, self.starts, self.docs = [], 0, 0, [], [], []
        out.write(MAGIC + np.array([bits, block], "<u4").tobytes())
        self.at = len(MAGIC) + 8

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.starts.append(self.n_ids)
        self.docs.append(doc_id)
        self.held.append(ids)
        self.n_held += len(ids) // self.dtype.itemsize
        self.n_ids += len(ids) // self.dtype.itemsize
        if self.n_held >= 16 * self.block:
            self._flush(self.block)

    def _flush(self, least: int) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        k = 0
        while len(ids) - k >= max(least, 1):
            data = pack(ids[k : k + self.block], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
            k += self.block
        left = ids[k:]
        self.held, self.n_held = [left.tobytes()], len(left)

    def close(self) -> None:
        self._flush(1)
        nulls = np.array([d is None for d in self.docs], np.uint8)
        ints = lambda x: np.array(x, "<i8").tobytes()
        self.out.write(ints(self.offsets) + ints([*self.starts, self.n_ids]) + ints([d or 0 for d in self.docs]) + nulls.tobytes() + ints([len(self.offsets), len(self.docs), self.n_ids, self.at]))


class Reader:
    """Random access to the ids and documents of a file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n_blocks, self.n_docs, self.n_ids, footer = np.frombuffer(source.read_at(32, size - 32), "<i8").tolist()
        head = source.read_at(len(MAGIC) + 8, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block = np.frombuffer(head, "<u4", 2, len(MAGIC)).tolist()
        rest = source.read_at(size - 32 - footer, footer)
        self.offsets = np.append(np.frombuffer(rest, "<i8", n_blocks), footer)
        self.starts = np.frombuffer(rest, "<i8", self.n_docs + 1, 8 * n_blocks)
        at = 8 * (n_blocks + self.n_docs + 1)
        ids, nulls = np.frombuffer(rest, "<i8", self.n_docs, at), np.frombuffer(rest, np.uint8, self.n_docs, at + 8 * self.n_docs)
        self.docs = [None if x else d for d, x in zip(ids.tolist(), nulls.tolist(), strict=True)]
        self._at, self._ids = -1, np.empty(0, "<u4")

    def ids(self, start: int, end: int) -> np.ndarray:
        parts = [np.empty(0, "<u4")]
        while start < end:
            k = start // self.block
            if k != self._at:
                a, b = int(self.offsets[k]), int(self.offsets[k + 1])
                self._at, self._ids = k, unpack(self.source.read_at(b - a, a), min(self.block, self.n_ids - k * self.block), self.bits)
            stop = min(end, (k + 1) * self.block)
            parts.append(self._ids[start - k * self.block : stop - k * self.block])
            start = stop
        return np.concatenate(parts)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_tokens(docs: DataFrame, tokenizer: str, place: str, in_file_order: bool = False) -> DataFrame:
    """Writes the ids of all texts, each with END after it, into files under place; the table of the files: file, n_ids, n_docs, part.

    part numbers the files in the order of their documents: ascending doc_id (nulls first; equal ids by text), or, with
    in_file_order, the order of the Parquet files and rows that docs was read from. Null texts are empty.
    """
    if in_file_order:
        # A range of (file, row): Spark numbers a table's files in the order of its partitions; 100,000 and more have more digits.
        number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("bigint")
        docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(number.alias("n"), F.col("_metadata.file_name").alias("name")).alias("a"), F.col("_metadata.row_index").alias("b"))
    else:
        docs = pinned(docs, {"doc_id": "bigint", "text": "string"}).select("doc_id", "text", F.col("doc_id").alias("a"), F.xxhash64("text").alias("b"))
    dealt = docs.repartitionByRange("a", "b").sortWithinPartitions("a", "b", "text").withColumn("part", F.spark_partition_id()).select("doc_id", "text", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, encoder, part, end = None, None, 0, b""
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                doc_ids, texts, parts = [c.to_pylist() for c in some.columns]
                encoder = encoder or Encoder.shared(tokenizer)
                for doc_id, ids, p in zip(doc_ids, encoder.encode([x or "" for x in texts]), parts, strict=True):
                    if writer is None:
                        part = p
                        store, path = pafs.FileSystem.from_uri(place)
                        store.create_dir(path, recursive=True)
                        name = f"part-{p:06d}-{uuid.uuid4().hex}.tok"
                        out = store.open_output_stream(f"{path}/{name}")
                        writer, end = Writer(out, bits_for(encoder.vocabulary), encoder.dtype), np.array([END], encoder.dtype).tobytes()
                    writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n_ids": [writer.n_ids], "n_docs": [len(writer.docs)], "part": pa.array([part], pa.int32())})

    return written(dealt.mapInArrow(run, FILES), "token-files")


def read_tokens(files: DataFrame, place: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file of every document in the files; start counts the ids of all documents before it."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    placed = placed.repartition(max(1, files.count()))  # a number that is given is not coalesced: rows are few, what they name is large

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(place)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{path}/{row['file']}") as source:
                    reader = Reader(source)
                    for lo in range(0, reader.n_docs, 10_000):
                        ks = range(lo, min(lo + 10_000, reader.n_docs))
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array([reader.docs[k] for k in ks], pa.int64()), "start": (reader.starts[lo : ks[-1] + 1] + row["start"]).astype(np.int64),
                            "n_tokens": np.diff(reader.starts[lo : ks[-1] + 2]), "ids_crc32": pa.array([zlib.crc32(reader.document(k).tobytes()) for k in ks], pa.int64()), "file": [row["file"]] * len(ks),
                        })

    return placed.select("file", "start").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, file string")


def token_output(docs: DataFrame, tokenizer: str, in_file_order: bool = False, place: str | None = None) -> DataFrame:
    """write_tokens and read_tokens in one. An empty table writes no file and gives an empty result; repeated rows are encoded each; other columns are ignored."""
    place = place or fresh_dir(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, tokenizer, place, in_file_order), place)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), default_tokenizer())
