"""Concatenate and cut: documents' ids in one long row, cut into windows of fixed size.

Pass one encodes each partition once and writes ids with their start inside the partition. A running sum over the
partitions' totals gives each partition its global offset; pass two cuts at multiples of the window without a shuffle
of ids: windows that lie in one batch are written whole, those that cross batches or partitions leave boundary records,
which are put together by sequence. A sequence has its ids and the pieces of documents in them; results per piece are
read from the written sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, docs_of, slices, spread
from .encoding import PieceEncoder, kept

WINDOW, END = 4096, 2


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """Parts of an array's bytes; ``ends`` in values, from 0."""
    kind, offsets = (pa.binary(), np.int32) if data.nbytes < 1 << 31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer((ends * data.itemsize).astype(offsets)), pa.py_buffer(np.ascontiguousarray(data))])


def _encode(path: str, end_id: int, spaces_matter: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(PieceEncoder, path, spaces_matter)
        part, at = TaskContext.get().partitionId(), 0
        for piece in slices(batches, column=1):
            ids, n = encoder.encode(piece.column(1))
            ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            ends = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), piece.column(0), pa.array(at + ends[:-1]), pa.array(n), _binary(ids, ends)], ["part", "doc_id", "at", "n", "ids"])
            at += int(ends[-1])

    return run


def concatenated(spark: SparkSession, docs: DataFrame, path: str, end_id: int, spaces_matter: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, at (global, gapless), n, ids (little-endian, 2 or 4 bytes each)."""
    s = Scratch(spark, "packing")
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows = s.save(docs.mapInArrow(_encode(path, end_id, spaces_matter), "part int, doc_id long, at long, n long, ids binary"), "ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    base = rows.groupBy("part").agg(F.sum("n").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    base = s.save(base, "base")
    if base.count() < 1_000_000:  # 12 bytes a partition; beyond that Spark chooses the join
        base = F.broadcast(base)
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("at")).alias("at"), "n", "ids")


_PIECES = ["doc_ids", "starts", "lengths", "doc_tokens", "offsets"]
_SEQUENCE = "sequence_id long, offset long, n_ids long, width int, ids binary, " + ", ".join(f"{c} array<bigint>" for c in _PIECES)


def _cut(window: int):
    """Rows of (sequence_id, offset, n_ids, ids, pieces): a sequence whole where n_ids is the window, else a boundary record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=3):
            at, n = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 2))
            raw = batch.column(3)
            ends = np.frombuffer(raw.buffers()[1], np.int64 if pa.types.is_large_binary(raw.type) else np.int32, len(raw) + 1, raw.offset * (8 if pa.types.is_large_binary(raw.type) else 4))
            data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            ids = data.view(f"<u{len(data) // int(n.sum())}")
            held = np.cumsum(n) - n  # where each document begins in ids
            cut = [0, *(np.flatnonzero(at[1:] != at[:-1] + n[:-1]) + 1).tolist(), len(n)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):  # a run of documents without a gap
                first, last = at[a:b] // window, (at[a:b] + n[a:b] - 1) // window
                many = last - first + 1
                doc = np.repeat(np.arange(a, b), many)
                seq = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
                start = np.maximum(0, seq * window - at[doc])
                size = np.minimum(n[doc], (seq + 1) * window - at[doc]) - start
                of = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
                lists = pa.array(np.append(of, len(seq)).astype(np.int32))
                place = np.append(held[doc[of]] + start[of], held[b - 1] + n[b - 1])
                whose = batch.column(0).take(pa.array(doc))
                offset = at[doc] + start - seq * window
                values = [whose, *map(pa.array, (start, size, n[doc], offset))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seq[of]), pa.array(offset[of]), pa.array(np.diff(place)), pa.array(np.full(len(of), ids.itemsize, np.int32)), _binary(ids[place[0] : place[-1]], place - place[0]), *(pa.ListArray.from_arrays(lists, v) for v in values)],
                    ["sequence_id", "offset", "n_ids", "width", "ids", *_PIECES],
                )

    return run


def sequences(spark: SparkSession, rows: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Writes the sequences of ``concatenated`` rows and reads them back: sequence_id, n_ids, width, ids, and the
    pieces in them (doc_ids, starts, lengths, doc_tokens, offsets: lists in order of place).

    ids: little-endian, of ``width`` bytes each, padded to the window unless n_ids is a power of two (so is a full window's).
    Only the last sequence isn't full. Boundary records of a sequence are at most as many as its ids.
    """
    s = Scratch(spark, "sequences")
    parts = s.save(rows.select("doc_id", "at", "n", "ids").mapInArrow(_cut(window), _SEQUENCE), "parts")
    records = parts.where(F.col("n_ids") < window).groupBy("sequence_id", "width").agg(F.sum("n_ids").alias("n_ids"), F.sort_array(F.collect_list(F.struct("offset", "ids", *_PIECES))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    zero = F.substring(F.lit(pad_id.to_bytes(4, "little").hex()), F.lit(1), 2 * F.col("width"))
    pad = F.when(F.bit_count("n_ids") == 1, F.lit(b"")).otherwise(F.unhex(F.repeat(zero, (window - F.col("n_ids")).cast("int"))))
    split = records.select("sequence_id", "n_ids", "width", F.concat(ids, pad).alias("ids"), *(F.flatten(f"p.{c}").alias(c) for c in _PIECES))
    whole = parts.where(F.col("n_ids") == window).select("sequence_id", "n_ids", "width", "ids", *_PIECES)
    return whole.union(s.save(split, "joined"))


_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pieces(with_ids: bool):
    names = _PIECE + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            counts = np.diff(batch.column(4).offsets.to_numpy())
            doc, start, size, total, offset = (batch.column(4 + k).flatten() for k in range(5))
            sizes, places, out, k = size.to_pylist(), offset.to_pylist(), [], 0
            for width, raw, m in zip(batch.column(2).to_pylist(), batch.column(3), counts.tolist(), strict=True):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}").astype("<u4")
                out += [ids[places[i] : places[i] + sizes[i]].tobytes() for i in range(k, k + m)]
                k += m
            cols = [doc, start, size, pa.array([zlib.crc32(x) for x in out], pa.int64()), total, pa.array(np.repeat(batch.column(0).to_numpy(), counts)), offset]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(out, pa.binary())] * with_ids, names)

    return run


def pieces(packed: DataFrame, with_ids: bool = False) -> DataFrame:
    """Pieces of ``sequences``: where each lies in its document and in its sequence, and its ids' crc32."""
    kinds = ", ".join(f"{c} long" for c in _PIECE) + (", ids binary" if with_ids else "")
    return packed.select("sequence_id", "n_ids", "width", "ids", *_PIECES).mapInArrow(_pieces(with_ids), kinds)


def pack(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` under the default vocabulary, end id and window.

    Null or empty text: one piece of the end id. Rows with null or equal doc_id: each is a document of its own. Order
    of documents: by input partition, then as they come; only the last sequence is not full. Extra columns are
    ignored; an empty table gives an empty result.
    """
    return pieces(sequences(spark, concatenated(spark, docs, public_tokenizers.path("word_bpe_49k.json"), END)))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, docs_of(spark, sf_dir))
