"""Shared pieces of the training-data operators: scratch tables, word splitting, hashing, components.

Words are the maximal runs of bytes other than space and ``\\t\\n\\v\\f\\r``; ``bytes.split()``
splits on exactly those, and no UTF-8 sequence contains one of them.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of this machine where unset, in local mode only."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "siltstone-checkpoints")


class Scratch:
    """Tables of one run in the shared folder. Writing a table cuts lineage and survives lost executors.

    Results are read from them, so the folder is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        p = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = p.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(p)
        store.deleteOnExit(p)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that no result still needs, and lets Spark clean shuffles of finished steps."""
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.free()

    def free(self) -> None:
        gc.collect()
        self.spark._jvm.System.gc()


def docs_of(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """``docs(doc_id, text)`` with ids that no two rows share.

    Where doc_ids are unique and none is null, the rows as they are. Else each distinct pair of doc_id and text gets its
    place in the order of doc_id (null last) and the text's SHA-256 for an id, and the second table has doc_id, node (that
    id) and copies (how many rows it stands for).
    """
    ids = docs.groupBy("doc_id").count()
    if ids.where("count > 1 or doc_id is null").isEmpty():
        return docs, None
    rows = docs.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    order = F.sha2(F.coalesce(F.col("text"), F.lit(b"")), 256)
    rows = rows.orderBy(F.col("doc_id").asc_nulls_last(), order, F.col("text").isNull()).withColumn("node", F.monotonically_increasing_id())
    rows = scratch.save(rows, "numbered")
    return rows.select(F.col("node").alias("doc_id"), "text"), rows.select("doc_id", "node", "copies")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deals the rows out anew where the scan has fewer splits than half the cores, as for one small file. Rows of a
    partition are then sorted, as they arrive in any order."""
    sc = df.sparkSession.sparkContext
    if df.rdd.getNumPartitions() * 2 < sc.defaultParallelism:
        return df.repartition(sc.defaultParallelism, *cols).sortWithinPartitions(*df.columns)
    return df


# ---- words and their hashes ------------------------------------------------------------------------

_LONG = 128  # bytes of a word that is hashed on its own
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_KEYS = [tuple(int.from_bytes(blake2b(f"{seed} {i}".encode(), digest_size=8).digest(), "little") | 1 for i in range(5)) for seed in range(2)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _stir(h: np.ndarray, keys: tuple[int, ...]) -> np.ndarray:
    """As ``mix``, by a seed's keys and in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(keys[0])
    h ^= h >> np.uint64(29)
    h *= np.uint64(keys[1])
    h ^= h >> np.uint64(32)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of parts of bytes that have eight more bytes behind them: by length and bytes, eight at a time."""
    keys = _KEYS[seed]
    size = ends - starts
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = size.astype(np.uint64) * np.uint64(keys[2]) + np.uint64(keys[3])
    h ^= eight[starts] & _MASKS[np.minimum(size, 8)]
    h = _stir(h, keys)
    more, at = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(more):
        part = h[more] ^ (eight[starts[more] + at] & _MASKS[np.minimum(size[more] - at, 8)])
        h[more] = _stir(part, keys)
        at += 8
        more = more[size[more] > at]
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=16).digest()[8 * seed : 8 * seed + 8], "little")
    return h


class Words:
    """Words of a text, and 64-bit hashes of them and of runs of them, for each of two seeds (128 bits together).

    A word is hashed by its length and its bytes, eight at a time; a run by the hashes of its words. Each step is a
    keyed bijection with multiplications, shifts and xor, so that no words collide by their structure.
    """

    BLOCK = 1 << 18  # words whose runs are hashed at once

    def __init__(self, text: bytes | None):
        self.text = text = text or b""
        self.data = np.frombuffer(text + bytes(8), np.uint8)
        other = np.ones(len(text) + 2, np.int8)  # not in a word; text and one byte on each side
        body = self.data[: len(text)]
        other[1:-1] = (body == 32) | (body - np.uint8(9) < 5)
        edge = np.flatnonzero(other[1:] != other[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        self.n = len(self.starts)
        self._runs: dict[tuple[int, int], np.ndarray] = {}

    def list(self) -> list[bytes]:
        return self.text.split()

    def part(self, a: int, b: int) -> Words:
        """Words [a, b), of the same text."""
        out = object.__new__(Words)
        out.text, out.data, out.starts, out.ends, out.n, out._runs = self.text, self.data, self.starts[a:b], self.ends[a:b], b - a, {}
        return out

    def between(self, a: int, b: int) -> bytes:
        """Words [a, b) joined by one space."""
        return b" ".join(self.text[self.starts[a] : self.ends[b - 1]].split()) if b > a else b""

    def hashes(self, seed: int = 0) -> np.ndarray:
        if (1, seed) not in self._runs:
            self._runs[1, seed] = span_hashes(self.data, self.starts, self.ends, seed)
        return self._runs[1, seed]

    def _doubled(self, k: int, seed: int) -> np.ndarray:
        """Hashes of runs of k words, k a power of two."""
        if (k, seed) not in self._runs:
            half = self._doubled(k // 2, seed) if k > 2 else self.hashes(seed)
            self._runs[k, seed] = self._joined(half[: -(k // 2)], half[k // 2 :], seed)
        return self._runs[k, seed]

    @staticmethod
    def _joined(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
        return _stir(a * np.uint64(_KEYS[seed][4]) + b, _KEYS[seed])

    def runs(self, k: int, seed: int = 0) -> np.ndarray:
        """Hashes of the n - k + 1 runs of k words."""
        m = self.n - k + 1
        if m < 1 or k < 1:
            return np.zeros(0, np.uint64)
        if m > self.BLOCK:
            return np.concatenate([self.part(i, min(self.n, i + self.BLOCK + k - 1)).runs(k, seed) for i in range(0, m, self.BLOCK)])
        out, done = None, 0
        for bit in range(k.bit_length() - 1, -1, -1):
            if k >> bit & 1:
                part = self.hashes(seed) if bit == 0 else self._doubled(1 << bit, seed)
                part = part[done : done + m]
                out = part if out is None else self._joined(out, part, seed)
                done += 1 << bit
        return out


class Bits:
    """A bit per hash value: membership with false positives only. Its size is fixed when it's made."""

    def __init__(self, n: int, per: int = 16, most: int = 1 << 29):
        self.size = min(most, 1 << max(16, (max(n, 1) * per - 1).bit_length()))
        self.bits = np.zeros(self.size // 8, np.uint8)

    def add(self, h: np.ndarray) -> None:
        for x in (h, mix(h ^ np.uint64(0x9E3779B97F4A7C15))):
            x = x & np.uint64(self.size - 1)
            np.bitwise_or.at(self.bits, (x >> np.uint64(3)).astype(np.int64), (1 << (x & np.uint64(7))).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        return in_bits(self.bits, h)


def in_bits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out, size = np.ones(len(h), bool), np.uint64(len(bits) * 8 - 1)
    for x in (h, mix(h ^ np.uint64(0x9E3779B97F4A7C15))):
        x = x & size
        out &= (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def membership(spark: SparkSession, df: DataFrame, column: str, hashed: bool = False):
    """Broadcasts a bitmap of a long column's values (16 bits a value, 64 MB at most; then more false positives).

    The bitmap is or-ed together on the executors in slices, so neither a task nor the driver holds the values. The
    slices come in one job: fetching them partition by partition costs a job for each.
    """
    n = df.count()
    size = Bits(n).size
    slice_bytes = min(size // 8, 1 << 18)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Bits(n)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            b.add(h if hashed else mix(h))
        for i in range(0, len(b.bits), slice_bytes):
            part = b.bits[i : i + slice_bytes]
            if part.any():
                yield pa.RecordBatch.from_pydict({"i": pa.array([i // slice_bytes], pa.int32()), "b": pa.array([part.tobytes()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.uint8)
                have[i] = have[i] | x if i in have else x
        for i, x in have.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "b": pa.array([x.tobytes()], pa.binary())})

    rows = df.select(column).where(F.col(column).isNotNull()).mapInArrow(lean(per_task), "i int, b binary").repartition(-(-size // 8 // slice_bytes), "i").mapInArrow(lean(merge), "i int, b binary")
    whole = np.zeros(size // 8, np.uint8)
    for r in rows.collect():
        whole[r["i"] * slice_bytes : (r["i"] + 1) * slice_bytes] = np.frombuffer(r["b"], np.uint8)
    return spark.sparkContext.broadcast(whole)


# ---- Arrow helpers ---------------------------------------------------------------------------------


def give_back() -> None:
    """Returns freed memory to the system: workers outlive tasks, and each would keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def lean(run):
    """A mapInArrow function that returns freed memory when it ends."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024, column: int | None = None, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, or of at most so many bytes of a string or binary column (a row at least).

    A worker then has Python objects of one part only; after the last one it returns freed memory.
    """
    try:
        for batch in batches:
            if column is None:
                for i in range(0, batch.num_rows, rows):
                    yield batch.slice(i, rows)
                continue
            col = batch.column(column)
            wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
            ends = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4)) if len(col) else np.zeros(1, np.int64)
            i = 0
            while i < len(col):
                to = min(max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1), len(col))
                yield batch.slice(i, to - i)
                i = to
    finally:
        give_back()


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``, both long: rows ``(node, root)``, root the smallest node reachable.

    Alternates the large-star and small-star steps of public papers; each round is written to the shared
    folder, and only a count and a checksum come to the driver. Nodes without an edge to another get no row.
    """
    e = scratch.save(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), f"{name}-0")
    seen, k = None, 0
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        e = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        to = e.join(low, "a")
        e = to.select("a", F.col("m").alias("b")).union(to.where("b <> m").select("b", "m")).distinct()
        k += 1
        e = scratch.save(e, f"{name}-{k}")
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        scratch.drop(f"{name}-{k - 1}")
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
