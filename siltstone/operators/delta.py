"""Deltas between versions: copies and literals, statistics, patching, materialising."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunk_ops(new: DataFrame, old: DataFrame, key: str, files: DataFrame | None = None, web: bool = False) -> DataFrame:
    """Ops of chunked versions: ``new`` and ``old`` are signatures with a pair key.

    A new chunk that equals an old one (strong hash and length; the weak one then agrees too) copies the first such
    block; others are literals, one each. literal_offset is the place in the blob of all literals, new_offset the place
    in the new file. With ``files(key, size)``, new files of which ``old`` has no signature are one literal, empty ones
    too; the web form gives none for those.
    """
    first = old.groupBy(key, "strong_hash", "length").agg(F.min("block_index").alias("block"))
    if files is not None:
        bare = files.select(key, F.col("size").cast("long").alias("size")).join(old.select(key).distinct(), key, "left_anti")
        new = new.join(bare.select(key), key, "left_anti")
    rows = new.join(first, [key, "strong_hash", "length"], "left")
    before = Window.partitionBy(key).orderBy("block_index").rowsBetween(Window.unboundedPreceding, -1)
    literal = F.when(F.col("block").isNull(), F.col("length")).otherwise(F.lit(0))
    at = F.coalesce(F.sum(literal).over(before), F.lit(0))
    ops = rows.select(
        key,
        F.col("block_index").alias("op_index"),
        F.when(F.col("block").isNull(), "literal").otherwise("copy").alias("kind"),
        F.col("block").alias("copy_block"),
        F.when(F.col("block").isNull(), at).alias("literal_offset"),
        F.col("offset").alias("new_offset"),
        "length",
    )
    if files is None:
        return ops
    bare = bare.where("size > 0") if web else bare
    zero = F.lit(0).cast("long")
    return ops.union(bare.select(key, F.lit(0), F.lit("literal"), F.lit(None).cast("int"), zero, zero, "size"))


_STEP = 1 << 18  # places looked at in one go


def _weak_sums(data: np.ndarray, size: int) -> np.ndarray:
    """Adler-32 of all windows, by prefix sums."""
    x = data.astype(np.int64)
    s, w = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * np.arange(len(x)))])
    i = np.arange(len(x) - size + 1)
    total = s[i + size] - s[i]
    return (size + (i + size) * total - (w[i + size] - w[i])) % 65521 * 65536 + (1 + total) % 65521


def fixed_delta(new: bytes, old: bytes, size: int, web: bool = False) -> list[tuple[str, int | None, int, int]]:
    """Greedy leftmost match of fixed blocks: (kind, block, new offset, length); literals between are joined.

    Where a block matches, the next one is tried right behind it. Where none does, weak sums of the windows that follow
    are made in stretches that grow, and strong hashes on weak hits only. The web form has whole blocks as candidates
    only and gives no op for an empty file.
    """
    blocks: dict[int, dict[bytes, int]] = {}
    for i in range(0, len(old), size):
        b = old[i : i + size]
        if len(b) == size:  # a shorter last block equals no window
            blocks.setdefault(zlib.adler32(b), {}).setdefault(sha256(b).digest(), i // size)
    ops, start, at, n, step = [], 0, 0, len(new), 2 * size
    view, body = memoryview(new), np.frombuffer(new, np.uint8)
    low = np.zeros(1 << 16, bool)  # of the weak sums that occur, by their lower half
    low[[k & 0xFFFF for k in blocks]] = True

    def match(i: int) -> int | None:
        window = view[i : i + size]
        known = blocks.get(zlib.adler32(window))
        return None if known is None else known.get(sha256(window).digest())

    while blocks and at + size <= n:
        block = match(at)
        if block is None:
            last = min(n - size, at + step)
            sums = _weak_sums(body[at : last + size], size)[1:]
            hits = np.flatnonzero(low[sums & 0xFFFF]) + 1
            found = next((i for i in (hits + at).tolist() if match(i) is not None), None)
            step = 2 * size if found is not None else min(_STEP, 2 * step)
            at = last + 1 if found is None else found
            continue
        if at > start:
            ops.append(("literal", None, start, at - start))
        ops.append(("copy", block, at, size))
        start = at = at + size
    if start < n or not (n or web):
        ops.append(("literal", None, start, n - start))
    return ops


def fixed_ops(pairs: DataFrame, key: str, new: str, old: str, size: int, web: bool = False) -> DataFrame:
    """``fixed_delta`` for each row: key, op_index, kind, copy_block, new_offset, length."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, i, *op) for k, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, op in enumerate(fixed_delta(a or b"", b or b"", size, web))]
            c = list(zip(*out, strict=True)) or [[]] * 6
            types = [batch.schema.types[0], pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], [key, "op_index", "kind", "copy_block", "new_offset", "length"])

    return pairs.select(key, new, old).mapInArrow(run, f"{key} {kind}, op_index int, kind string, copy_block int, new_offset long, length long")


def stats(ops: DataFrame, key: str) -> DataFrame:
    """Bytes copied and literal, distinct blocks reused and runs of literals of each delta."""
    before = F.lag("kind").over(Window.partitionBy(key).orderBy("op_index"))
    ops = ops.withColumn("starts", (F.col("kind") == "literal") & (F.coalesce(before, F.lit("copy")) == "copy"))
    copy = F.col("kind") == "copy"
    return ops.groupBy(key).agg(
        F.sum("length").alias("total_new_bytes"),
        F.sum(F.when(copy, F.col("length")).otherwise(0)).alias("copied_bytes"),
        F.sum(F.when(copy, 0).otherwise(F.col("length"))).alias("literal_bytes"),
        F.count_if(copy).alias("reused_blocks"),
        F.count_if("starts").alias("new_literal_runs"),
    )


def savings(stats: DataFrame, copy_bytes: int = 8) -> DataFrame:
    """Bytes of the delta, and the share saved in percent to two digits (halves up)."""
    delta = F.col("literal_bytes") + copy_bytes * F.col("reused_blocks")
    share = F.when(F.col("total_new_bytes") > 0, F.floor((1 - delta / F.col("total_new_bytes")) * 10000 + 0.5) / 100).otherwise(0.0)
    return stats.withColumn("delta_bytes", delta).withColumn("saved_percent", share)


def heat_cells(length, size):
    return F.greatest(F.lit(1), F.ceil(length / F.greatest(F.lit(64), size / 16)).cast("int"))


def patch(old: DataFrame, new: DataFrame, ops: DataFrame, old_signatures: DataFrame, key: str, old_content: str, new_content: str) -> DataFrame:
    """Rebuilds files: copies are read from the old file, literals from the new one. key, content.

    Files meet their ops once, as one row each, and are cut where they are.
    """
    o = ops.join(old_signatures.select(key, F.col("block_index").alias("copy_block"), F.col("offset").alias("old_offset")), [key, "copy_block"], "left")
    copy = F.col("kind") == "copy"
    at = F.when(copy, F.col("old_offset")).otherwise(F.col("new_offset")).alias("at")
    o = o.groupBy(key).agg(F.collect_list(F.struct("op_index", copy.alias("copy"), at, "length")).alias("ops"))
    files = o.join(old.select(key, F.col(old_content).alias("_old")), key).join(new.select(key, F.col(new_content).alias("_new")), key)
    rows = files.select(key, "_old", "_new", F.explode("ops").alias("o"))
    piece = lambda c: F.col(c).substr((F.col("o.at") + 1).cast("int"), F.col("o.length").cast("int"))
    return joined(rows.select(key, F.col("o.op_index").alias("op_index"), F.when(F.col("o.copy"), piece("_old")).otherwise(piece("_new")).alias("piece")), key, "op_index", "piece")


def joined(rows: DataFrame, key: str, index: str, piece: str) -> DataFrame:
    """Byte pieces of each key in order of an index as one: key, content."""
    return rows.groupBy(key).agg(F.coalesce(F.expr(f"listagg({piece}) within group (order by {index})"), F.lit(b"")).alias("content"))


def pack_delta(new: DataFrame, signatures: DataFrame, key: str, content: str, size: int = 16384) -> DataFrame:
    """``new(key, content)`` against known signatures, by content-defined chunks: key, ops (first layout), literals."""
    from . import chunking, codecs

    files = new.select(key, content)
    sizes = files.select(key, F.octet_length(content).alias("size"))
    ops = chunk_ops(chunking.signatures(files, content, key, size=size), signatures, key, sizes)
    row = F.struct("op_index", "kind", F.col("copy_block").cast("long").alias("block_index"), "literal_offset", F.when(F.col("kind") == "literal", F.col("length")).alias("literal_length"), "new_offset")
    both = files.join(ops.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("ops")), key)
    cut = both.select(key, content, F.explode(F.filter("ops", lambda x: x["kind"] == "literal")).alias("o"))
    cut = cut.select(key, F.col("o.op_index").alias("op_index"), F.col(content).substr((F.col("o.new_offset") + 1).cast("int"), F.col("o.literal_length").cast("int")).alias("piece"))
    literals = joined(cut, key, "op_index", "piece").withColumnRenamed("content", "literals")
    return both.select(key, codecs.encode_ops1("ops").alias("ops")).join(literals, key, "left").select(key, "ops", F.coalesce("literals", F.lit(b"")).alias("literals"))


def materialise(ops: DataFrame, previous: DataFrame, literals: DataFrame, key: str) -> DataFrame:
    """Manifest rows of uploaded ops: copies take the previous chunk's row, literals are hashed from their stream.

    ``literals``: key, blob. Rows have an ``error`` where a copy names an unknown block.
    """
    from .chunking import adler32, strong

    prev = previous.select(key, F.col("block_index").alias("copy_block"), F.col("length").alias("_len"), F.col("weak_hash").alias("_weak"), F.col("strong_hash").alias("_strong"))
    o = ops.join(prev, [key, "copy_block"], "left").join(literals.select(key, "blob"), key, "left")
    data = F.col("blob").substr((F.col("literal_offset") + 1).cast("int"), F.col("length").cast("int"))
    copy = F.col("kind") == "copy"
    o = o.select(
        key, F.col("op_index").alias("block_index"), F.when(copy, F.col("_len")).otherwise(F.octet_length(data)).cast("long").alias("length"),
        F.when(copy, F.col("_weak")).otherwise(adler32(data)).alias("weak_hash"), F.when(copy, F.col("_strong")).otherwise(strong(data)).alias("strong_hash"),
        F.when(copy & F.col("_strong").isNull(), F.lit("unknown block")).alias("error"),
    )
    return o.withColumn("offset", running_offset(key))


def running_offset(key: str, order: str = "block_index", length: str = "length"):
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long")
