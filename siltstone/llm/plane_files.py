"""Token-id files of shuffled planes.

A file holds whole documents in order. Their ids, end id included, are cut into blocks of ``block`` ids; a block's
little-endian ids are transposed into byte planes (all first bytes, all second bytes, ...) or bit planes, and each
plane is a zstandard frame. Layout:

    "SLTP" u8 version=1, u8 bytes of an id, u8 plane kind (1 byte, 2 bit), u8 0, u32 block size
    planes of block 0, 1, ...
    index: zstandard frame of
        u64 documents, u64 ids, u64 blocks, u32 planes
        blocks x (u64 offset, u32 ids, u32 crc32 of the ids' bytes, planes x u32 frame length)
        documents x i64 doc_id, documents x u8 whether it is null, documents x u64 ids
    u64 offset of the index, "SLTP"

Files are written under a temporary name and renamed; a repeated task attempt writes the same bytes again.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, docs_of, slices
from .encoding import PieceEncoder, kept

MAGIC, BLOCK, FILE_IDS = b"SLTP", 1 << 16, 1 << 22
BYTE, BIT = 1, 2


def to_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """Planes of an id block. Bit planes hold one bit of every id, packed 8 to a byte."""
    rows = ids.view(np.uint8).reshape(len(ids), ids.itemsize)
    if kind == BYTE:
        return [np.ascontiguousarray(rows[:, i]).tobytes() for i in range(ids.itemsize)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(bits.shape[1])]


def from_planes(planes: list[bytes], n: int, dtype: np.dtype, kind: int) -> np.ndarray:
    if kind == BYTE:
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], 1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view(dtype).reshape(n)


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK, kind: int = BYTE, level: int = 3) -> bytes:
    """A file's bytes. ``ids``: those of all documents, end to end; ``lengths``: how many each has."""
    width = ids.itemsize
    press = zstandard.ZstdCompressor(level=level)
    out, at, index = [MAGIC + struct.pack("<BBBBI", 1, width, kind, 0, block)], 12, []
    n_planes = width * (1 if kind == BYTE else 8)
    for i in range(0, len(ids), block):
        part = ids[i : i + block]
        frames = [press.compress(p) for p in to_planes(part, kind)]
        index.append(struct.pack(f"<QII{n_planes}I", at, len(part), zlib.crc32(part.tobytes()), *map(len, frames)))
        out += frames
        at += sum(map(len, frames))
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = struct.pack("<QQQI", len(docs), len(ids), len(index), n_planes)
    out.append(press.compress(head + b"".join(index) + docs.tobytes() + null.tobytes() + lengths.astype("<u8").tobytes()))
    return b"".join([*out, struct.pack("<Q", at), MAGIC])


class PlaneFile:
    """Reads a file's bytes: its index at once, blocks as they are asked for."""

    def __init__(self, data: bytes):
        if len(data) < 24 or data[:4] != MAGIC or data[-4:] != MAGIC:
            raise ValueError("not a plane file")
        _, self.width, self.kind, _, self.block = struct.unpack_from("<BBBBI", data, 4)
        self.data, self.dtype = memoryview(data), np.dtype(f"<u{self.width}")
        (at,) = struct.unpack_from("<Q", data, len(data) - 12)
        raw = zstandard.ZstdDecompressor().decompress(data[at : len(data) - 12])
        n_docs, self.n_ids, n_blocks, planes = struct.unpack_from("<QQQI", raw)
        size = 16 + 4 * planes
        self.blocks = [struct.unpack_from(f"<QII{planes}I", raw, 28 + i * size) for i in range(n_blocks)]
        at = 28 + n_blocks * size
        docs = np.frombuffer(raw, "<i8", n_docs, at).tolist()
        null = np.frombuffer(raw, np.uint8, n_docs, at + 8 * n_docs).tolist()
        self.doc_ids = [None if z else d for d, z in zip(docs, null, strict=True)]
        self.lengths = np.frombuffer(raw, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        self.open = zstandard.ZstdDecompressor()

    def read_block(self, i: int) -> np.ndarray:
        at, n, crc, *sizes = self.blocks[i]
        planes = []
        for s in sizes:
            planes.append(self.open.decompress(self.data[at : at + s]))
            at += s
        ids = from_planes(planes, n, self.dtype, self.kind)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
        return ids

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) of the file, from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, self.dtype)
        first = start // self.block
        part = np.concatenate([self.read_block(i) for i in range(first, (end - 1) // self.block + 1)])
        return part[start - first * self.block : end - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids), a block at a time in memory."""
        at, block, held, base = 0, 0, np.zeros(0, self.dtype), 0
        for doc, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            parts = [held[at - base : at - base + n]]
            while at + n > base + len(held):
                base += len(held)
                held = self.read_block(block)
                block += 1
                parts.append(held[: at + n - base])
            yield doc, at, parts[0] if len(parts) == 1 else np.concatenate(parts)
            at += n


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _write(folder: str, path: str, end_id: int, block: int, kind: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(PieceEncoder, path, True)
        part, store, where = TaskContext.get().partitionId(), *_store(folder)
        docs, lengths, parts, size, k, done = [], [], [], 0, 0, []

        def put():
            nonlocal docs, lengths, parts, size, k
            data = encode_file(docs, np.concatenate(lengths), np.concatenate(parts), block, kind)
            name = f"{where}/part-{part:06d}-{k:06d}.sltp"
            draft = f"{where}/_draft-{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as f:
                f.write(data)
            store.move(draft, name)
            done.append((part, k, size))
            docs, lengths, parts, size, k = [], [], [], 0, k + 1

        for piece in slices(batches, column=1):
            ids, n = encoder.encode(piece.column(1))
            docs += piece.column(0).to_pylist()
            parts.append(np.insert(ids, np.cumsum(n), end_id))
            lengths.append(n + 1)
            size += len(parts[-1])
            if size >= FILE_IDS:
                put()
        if docs:
            put()
        c = list(zip(*done, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64())], ["part", "file", "n_ids"])

    return run


def write_token_files(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 0, block: int = BLOCK, kind: int = BYTE) -> tuple[str, DataFrame]:
    """Encodes ``docs(doc_id, text)`` and writes files in ascending doc_id order (nulls first, ties by a hash
    of the text, then the text, so that the rows of one doc_id needn't meet in a task).

    Returns the folder and the table of files (part, file, n_ids, base), base being the ids in all files before.
    """
    s = Scratch(spark, "planes")
    folder = f"{s.path}/files"
    store, where = _store(folder)
    store.create_dir(where, recursive=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    files = s.save(ordered.mapInArrow(_write(folder, path, end_id, block, kind), "part int, file int, n_ids long"), "table")
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task: few
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.join(totals, "part").withColumn("base", F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return folder, files


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            _, part, k = name.rsplit("/", 1)[1].split(".")[0].split("-")
            rows = [(doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, start, ids in PlaneFile(data.as_py()).documents()]
            c = list(zip(*rows, strict=True))
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part)] * n, pa.int32()), pa.array([int(k)] * n, pa.int32()), *(pa.array(x, pa.int64()) for x in c)],
                ["part", "file", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.sltp").load(folder).select("path", "content")
    rows = raw.mapInArrow(_read, "part int, file int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(files.select("part", "file", "base"), ["part", "file"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op1_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text: only the end id. Null doc_id: before all others. Rows with the same doc_id: each its own row.

    An empty table has no files and gives an empty result.
    """
    docs = docs_of(spark, sf_dir)
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_documents(spark, *write_token_files(spark, docs, public_tokenizers.path("byte_bpe_50k.json")))
