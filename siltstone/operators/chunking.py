"""Chunking and fingerprints: fixed blocks, content-defined chunks, weak and strong hashes, signatures."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

# fixed values: they must equal the reference's
SEED, MULTIPLIER = 0x811C9DC5, 0x01000193
MIB = 1 << 20


@dataclass(frozen=True)
class Profile:
    """Sizes of content-defined chunks; mask: cut where the fingerprint's bits under it are all 0."""

    smallest: int
    average: int
    largest: int

    @property
    def mask(self) -> int:
        return (1 << (max(64, self.average).bit_length() - 1)) - 1


def server_profile(average: int = 16384) -> Profile:
    return Profile(max(512, average // 4), average, min(4 * MIB, average * 64))


def web_profile(average: int = 1024) -> Profile:
    return Profile(max(256, average // 4), average, min(256 * 1024, average * 32))


def adaptive_size(size: Column) -> Column:
    """Average chunk size by file size; 0: too small to chunk."""
    return F.when(size < 32768, 0).when(size < 262144, 4096).when(size < 10485760, 16384).otherwise(65536)


def cdc_ends(data: bytes, p: Profile) -> list[int]:
    """Ends of the chunks. The first byte tested is number smallest + 1 of a chunk; a cut falls after its byte."""
    ends, start, n, mask = [], 0, len(data), p.mask
    while start < n:
        f, at = SEED, start
        top = min(start + p.largest, n)
        free = min(start + p.smallest, top)
        while at < free:
            f = (f * MULTIPLIER & 0xFFFFFFFF) ^ data[at]
            at += 1
        while at < top:
            f = (f * MULTIPLIER & 0xFFFFFFFF) ^ data[at]
            at += 1
            if not f & mask:
                break
        ends.append(at)
        start = at
    return ends


def _running_xor(bits: np.ndarray) -> None:
    """Each row's running xor of 0s and 1s, in place; rows are a multiple of 64 long. 64 places at once, as one number."""
    words = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    for step in (1, 2, 4, 8, 16, 32):
        words ^= words << np.uint64(step)
    if words.shape[1] > 1:
        carry = np.bitwise_xor.accumulate(words >> np.uint64(63), axis=1)
        words[:, 1:] ^= np.uint64(0) - carry[:, :-1]
    bits[:] = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")


def _fingerprints(first: np.ndarray, data: np.ndarray, bits: int) -> np.ndarray:
    """Low bits of the fingerprint after each byte, of rows that start from ``first``; as wide as first.

    The multiplier is odd, so bit i of a product is bit i of the factor, flipped by what the bits below it carry up. Each
    bit is thus a running xor over the row once the bits below are known: a pass over the rows for each bit.
    """
    kind, (rows, width) = first.dtype.type, data.shape
    before, after, flips = np.zeros(data.shape, kind), np.zeros(data.shape, kind), np.empty(data.shape, kind)
    running = np.zeros((rows, width + -width % 64), np.uint8)
    multiplier = kind(MULTIPLIER & ((1 << 8 * first.itemsize) - 1))
    for i in range(bits):
        before[:, 0] = first & kind((1 << i) - 1)
        np.multiply(before, multiplier, out=flips)
        if i < 8:
            flips ^= data
        flips >>= kind(i)
        running[:, :width] = flips
        running &= np.uint8(1)
        running[:, 0] ^= (first >> kind(i) & kind(1)).astype(np.uint8)
        _running_xor(running)
        bit = running[:, :width].astype(kind)
        bit <<= kind(i)
        after |= bit
        before[:, 1:] |= bit[:, :-1]
    return after


def _scan(files: list, p: Profile, state: tuple[int, int] | None = None) -> tuple[list[list[int]], tuple[int, int]]:
    """Ends of the chunks that a mask or the largest size cuts, and of the last file the fingerprint and length so far of what
    follows its last cut. ``state``: those of what came before, for one file in parts. Files go a block of each at a time."""
    bits = p.mask.bit_length()
    kind = np.uint16 if bits <= 16 else np.uint32
    sizes = np.array([len(f) for f in files], np.int64)
    block = int(min(p.largest, max(64, p.smallest + p.average)))
    buf = np.frombuffer(b"".join([*files, bytes(block)]), np.uint8)
    views = np.lib.stride_tricks.sliding_window_view(buf, block)
    base = np.cumsum(sizes) - sizes
    at = np.zeros(len(files), np.int64)  # place in each file
    start = SEED if state is None else state[0]
    f, run = np.full(len(files), start & p.mask, kind), np.full(len(files), 0 if state is None else state[1], np.int64)
    out: list[list[int]] = [[] for _ in files]
    rows = max(1, (1 << 18) // block)
    live = np.flatnonzero(sizes)
    live = live[np.argsort(-sizes[live], kind="stable")]
    while len(live):
        for i in range(0, len(live), rows):
            own = live[i : i + rows]
            width = int(min(block, (sizes[own] - at[own]).max()))
            got = _fingerprints(f[own], views[base[own] + at[own], :width], bits)
            left = np.minimum(sizes[own] - at[own], width)
            # the first place where the mask cuts, behind the smallest size; the largest cuts in any case
            place = np.arange(width)
            hit = ((got & kind(p.mask)) == 0) & (place >= (p.smallest - run[own])[:, None])
            first = np.where(hit.any(1), hit.argmax(1), width)
            first = np.minimum(first, p.largest - run[own] - 1)
            cut = first < left
            end = np.where(cut, first + 1, left)
            at[own] += end
            f[own] = np.where(cut, kind(SEED & p.mask), got[np.arange(len(own)), end - 1])
            run[own] = np.where(cut, 0, run[own] + end)
            for r, e in zip(own[cut].tolist(), at[own[cut]].tolist(), strict=True):
                out[r].append(e)
        live = live[at[live] < sizes[live]]
    return out, (int(f[-1]), int(run[-1])) if len(files) else (SEED, 0)


def cdc_ends_many(files: list[bytes], p: Profile) -> list[list[int]]:
    """As ``cdc_ends`` for each file: many bytes of many files in a step."""
    out, _ = _scan(files, p)
    for ends, f in zip(out, files, strict=True):
        if len(f) and (not ends or ends[-1] < len(f)):
            ends.append(len(f))
    return out


class Cutter:
    """Chunks of one file that comes in parts of any size: holds what follows the last cut, at most the largest chunk."""

    def __init__(self, p: Profile):
        self.profile, self.state, self.rest = p, None, b""

    def push(self, data: bytes) -> list[bytes]:
        if not data:
            return []
        (ends,), self.state = _scan([data], self.profile, self.state)
        cuts = [0, *ends]
        out = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if out:
            out[0] = self.rest + out[0]
            self.rest = b""
        self.rest += data[cuts[-1] :]
        return out

    def end(self) -> list[bytes]:
        out, self.rest, self.state = [self.rest] if self.rest else [], b"", None
        return out


def _by_bytes(batch: pa.RecordBatch, column: int, most: int = 16 * MIB) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes in a binary column, a row at least."""
    size = np.cumsum([0, *(x or 0 for x in pc.binary_length(batch.column(column)).to_pylist())])
    i = 0
    while i < batch.num_rows:
        to = max(i + 1, int(np.searchsorted(size, size[i] + most, "right")) - 1)
        yield batch.slice(i, to - i)
        i = to


def with_cdc(df: DataFrame, content: str, p: Profile, *keep: str) -> DataFrame:
    """One row a chunk: the kept columns, block_index, offset, length, block. Files of no bytes give none."""
    names = [*keep, content]
    df = df.select(*names)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.drop(content).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_bytes(batch, len(keep)):
                ends = cdc_ends_many([x or b"" for x in part.column(len(keep)).to_pylist()], p)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ends, pa.list_(pa.int64()))], [*names, "ends"])

    cut = df.mapInArrow(run, f"{fields}{', ' if fields else ''}{content} binary, ends array<bigint>")
    cut = cut.select(*keep, content, "ends", F.posexplode("ends").alias("block_index", "end"))
    offset = F.when(F.col("block_index") > 0, F.get("ends", F.col("block_index") - 1)).otherwise(F.lit(0)).cast("long")
    cut = cut.withColumn("offset", offset).withColumn("length", F.col("end") - F.col("offset"))
    return cut.select(*keep, "block_index", "offset", "length", slice_of(content, "offset", "length").alias("block"))


def slice_of(content: str, offset: str, length: str) -> Column:
    return F.col(content).substr((F.col(offset) + 1).cast("int"), F.col(length).cast("int"))


def with_fixed(df: DataFrame, content: str, size: int, *keep: str) -> DataFrame:
    """As ``with_cdc`` with blocks of one size; the last is as long as what's left."""
    starts = F.when(F.octet_length(content) > 0, F.sequence(F.lit(0), F.octet_length(content) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    cut = df.select(*keep, content, F.posexplode(starts).alias("block_index", "o"))
    block = F.col(content).substr(F.col("o") + 1, F.lit(size))
    cut = cut.select(*keep, "block_index", F.col("o").cast("long").alias("offset"), block.alias("block"))
    return cut.select(*keep, "block_index", "offset", F.octet_length("block").cast("long").alias("length"), "block")


@arrow_udf(LongType())
def adler32(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else zlib.adler32(x) for x in data.to_pylist()], pa.int64())


def weak16(weak: Column) -> Column:
    return weak.bitwiseAND(F.lit(0xFFFF))


def strong(data: str | Column) -> Column:
    return F.sha2(data, 256)


def object_key(h: Column) -> Column:
    """Keys are sharded by the first two digits of the hash; temporary ones aren't."""
    return F.when(h.startswith("temp-"), h).otherwise(F.concat_ws("/", F.substring(h, 1, 2), h))


def signatures(df: DataFrame, content: str, *keep: str, mode: str = "cdc", size: int = 16384, profile: str = "server") -> DataFrame:
    """Kept columns, block_index, offset, length, weak_hash, strong_hash for each chunk."""
    if mode == "fixed":
        cut = with_fixed(df, content, size, *keep)
    else:
        cut = with_cdc(df, content, server_profile(size) if profile == "server" else web_profile(size), *keep)
    return cut.select(*keep, "block_index", "offset", "length", adler32("block").alias("weak_hash"), strong("block").alias("strong_hash"))


def hash_slices(df: DataFrame, content: str, offsets: str, lengths: str, *keep: str) -> DataFrame:
    """Hashes of given slices, clamped at the end; the length reported is the one asked for. Unequal lists raise."""
    same = F.when(F.size(offsets) == F.size(lengths), F.arrays_zip(F.col(offsets).alias("o"), F.col(lengths).alias("l"))).otherwise(F.raise_error(F.lit("offsets and lengths differ in size")))
    rows = df.select(*keep, content, F.posexplode(same).alias("slice_index", "s"))
    part = F.col(content).substr((F.col("s.o") + 1).cast("int"), F.col("s.l").cast("int"))
    return rows.select(*keep, "slice_index", F.col("s.o").alias("offset"), F.col("s.l").alias("length"), adler32(part).alias("weak_hash"), strong(part).alias("strong_hash"))


WINDOW = 2 * MIB


def windowed_profile(average: int) -> Profile:
    """Sizes for files that are read in windows."""
    return Profile(max(512, average // 4), average, min(MIB, average * 64))


def _windows(path: str, size: int) -> Iterator[bytes]:
    store, where = fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)
    with store.open_input_stream(where) as f:
        while data := f.read(size):
            yield data


def file_signatures(files: DataFrame, mode: str = "cdc", size: int = 16384, window: int = WINDOW) -> DataFrame:
    """``files(path)`` of any size -> path, block_index, offset, length, weak_hash, strong_hash.

    A file is read in windows: a task holds one window and at most one chunk that goes on. Chunks are those of the whole
    file under ``windowed_profile``. Files are spread over tasks; a single one can't be, as each chunk starts at a cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                cutter, index, at = Cutter(windowed_profile(size)) if mode == "cdc" else _Blocks(size), 0, 0
                for data in _and_end(_windows(path, window)):
                    out = []
                    for c in cutter.end() if data is None else cutter.push(data):
                        out.append((path, index, at, len(c), zlib.adler32(c), sha256(c).hexdigest()))
                        index, at = index + 1, at + len(c)
                    cols = list(zip(*out, strict=True)) or [[]] * 6
                    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "block_index", "offset", "length", "weak_hash", "strong_hash"])

    return files.select("path").mapInArrow(run, "path string, block_index int, offset long, length long, weak_hash long, strong_hash string")


def _and_end(parts: Iterator[bytes]) -> Iterator[bytes | None]:
    yield from parts
    yield None


class _Blocks:
    """As ``Cutter``, with blocks of one size."""

    def __init__(self, size: int):
        self.size, self.rest = size, b""

    def push(self, data: bytes) -> list[bytes]:
        data = self.rest + data
        whole = len(data) // self.size * self.size
        self.rest = data[whole:]
        return [data[i : i + self.size] for i in range(0, whole, self.size)]

    def end(self) -> list[bytes]:
        out, self.rest = [self.rest] if self.rest else [], b""
        return out


def file_hashes(files: DataFrame, part: int = 1 << 16) -> DataFrame:
    """``files(path)`` of any size -> path, bytes, sha256, read in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                h, n = sha256(), 0
                for data in _windows(path, part):
                    h.update(data)
                    n += len(data)
                out.append((path, n, h.hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["path", "bytes", "sha256"])

    return files.select("path").mapInArrow(run, "path string, bytes long, sha256 string")


def scan_report(content: DataFrame, column: str, p: Profile, key: str) -> DataFrame:
    """Of each file: bytes, sha256, cdc_chunks, avg_target."""
    chunks = with_cdc(content.select(key, column), column, p, key).groupBy(key).agg(F.count("*").alias("n"))
    rows = content.select(key, F.octet_length(column).cast("long").alias("bytes"), strong(column).alias("sha256"))
    return rows.join(chunks, key, "left").select(key, "bytes", "sha256", F.coalesce("n", F.lit(0)).cast("long").alias("cdc_chunks"), F.lit(p.average).alias("avg_target"))
