"""Exact n-gram Jaccard self-join of documents, as link components.

Rare-first prefix filtering: a document's shingles are ordered by how often they occur in the corpus, rarest
first; two sets with Jaccard similarity t or more share a shingle among the first |x| - ceil(t|x|) + 1 of each.
Documents meet by those prefix shingles only, go through the length, positional and suffix filters, and each pair
that is left is verified once against the full sets.

Equal sets are one class first, so groups of copies cost one row each. The components are what's asked for, so a
pair whose ends are linked through others already needs no check: a first round links each prefix group to two of
its members, later work is only on groups that still have members of different components, in blocks of bounded
size. No cap is put on groups, partners or candidates.

Order of shingles: counts come from hashed counters whose number grows with the corpus (up to ``MOST_COUNTERS``).
Any fixed order gives the exact result; counts only make prefixes rare. Shingles are 64-bit hashes (``common.Words``): two
given documents of 10,000 words share a hash by chance once in 10**11 pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, components, docs_of, in_bits, lean, membership, mix, slices, spread

WORDS, PERCENT = 5, 80
MOST_COUNTERS = 1 << 25
SLICE = 1 << 15
BINS = 512  # of the suffix filter
BLOCK = 512  # members of a prefix group that meet in one block


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles after lower-casing A-Z; of the whole text where it's shorter."""
    words = Words(text.lower()) if text else None
    if not words or not words.n:
        return np.zeros(0, np.uint64)
    return np.unique(words.runs(min(k, words.n)))


def prefix_length(n: np.ndarray | int, percent: int):
    return n - (percent * n + 99) // 100 + 1


def needed(a, b, percent: int):
    """Smallest intersection with 100 * i >= percent * (a + b - i)."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=1):
            sizes, keys = [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, k)
                sizes.append(len(s))
                keys.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "n", "key"])

    return run


def _counters(k: int, width: int):
    """Occurrences of hashed shingles in this task, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width, np.uint16)
        held: list[np.ndarray] = []
        size = 0

        def put():
            ids, n = np.unique(np.concatenate(held) & np.uint64(width - 1), return_counts=True)
            ids = ids.astype(np.int64)
            counts[ids] = np.minimum(counts[ids].astype(np.int64) + n, 65535).astype(np.uint16)

        for batch in slices(batches, column=0):
            for text in batch.column(0).to_pylist():
                held.append(shingle_set(text, k))
                size += len(held[-1])
                if size > 1 << 20:
                    put()
                    held, size = [], 0
        if held:
            put()
        for i in range(0, width, SLICE):
            part = counts[i : i + SLICE]
            if part.any():
                yield pa.RecordBatch.from_pydict({"i": pa.array([i // SLICE], pa.int32()), "c": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices; 0-127 as they are, then in steps of an eighth of a doubling: the order needs no more."""
    have: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(x), np.uint16)
            have.setdefault(i, np.zeros(SLICE, np.int64))[: len(x)] += x
    for i, total in have.items():
        steps = 128 + np.minimum(127, np.log2(np.maximum(total, 1) / 127.0) * 8).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "c": pa.array([np.where(total > 127, steps, total).astype(np.uint8).tobytes()], pa.binary())})


def corpus_counts(spark: SparkSession, docs: DataFrame, k: int):
    """Broadcasts one byte per hashed counter over all documents: a step of the count. At most MOST_COUNTERS bytes, in one job."""
    letters = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = max(SLICE, min(MOST_COUNTERS, 1 << max(0, int(letters // 48)).bit_length()))
    rows = docs.select(F.col("text").cast("binary")).mapInArrow(_counters(k, width), "i int, c binary").repartition("i").mapInArrow(lean(_add), "i int, c binary")
    whole = np.zeros(width, np.uint8)
    for r in rows.collect():
        part = np.frombuffer(r["c"], np.uint8)
        whole[r["i"] * SLICE : (r["i"] + 1) * SLICE] = part[: max(0, width - r["i"] * SLICE)]
    return spark.sparkContext.broadcast(whole)


def _prefixes(k: int, percent: int, counts, chosen):
    """Rows (hash, doc, n, pos) for the prefix of each representative; shingles that occur once lead nowhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        width = np.uint64(len(table) - 1)

        def out(parts):
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3])], ["h", "doc", "n", "pos"])

        parts, size = [], 0
        for batch in slices(batches, column=1):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            use = in_bits(chosen.value, mix(ids.view(np.uint64)))
            for i in np.flatnonzero(use).tolist():
                s = shingle_set(batch.column(1)[i].as_py(), k)
                if not len(s):
                    continue
                c = table[(s & width).astype(np.int64)]
                order = np.argsort(c, kind="stable")  # s is sorted: by count, then hash
                order = order[: prefix_length(len(s), percent)]
                keep = np.flatnonzero(c[order] > 1)
                m = len(keep)
                if m:
                    parts.append((s[order[keep]], np.full(m, ids[i], np.int64), np.full(m, len(s), np.int32), keep.astype(np.int32)))
                    size += m
                if size > 60_000:
                    yield out(parts)
                    parts, size = [], 0
        if parts:
            yield out(parts)

    return run


def _rows(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h, those whose h has more than one row."""
    last: pa.RecordBatch | None = None  # the last row so far, undecided
    before = None  # its h's earlier neighbour
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        (h,) = _rows(batch, "h")
        same = h[1:] == h[:-1]
        left = np.concatenate([[before is not None and before == h[0]], same])
        keep = left[:-1] | same
        if keep.any():
            yield batch.slice(0, len(h) - 1).filter(pa.array(keep))
        before = h[-2] if len(h) > 1 else before if left[0] else None
        last = batch.slice(len(h) - 1, 1)
    if last is not None and before is not None and before == _rows(last, "h")[0][0]:
        yield last


def _stars(percent: int):
    """Pairs that tie each prefix group together: each row with the group's first row, its previous, and a middle one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[np.ndarray] | None = None
        seen: set[tuple[int, int]] = set()

        def pairs(h, doc, n, pos, part):
            start = np.concatenate([[True], (h[1:] != h[:-1]) | (part[1:] != part[:-1])])
            at = np.flatnonzero(start)
            group = np.cumsum(start) - 1
            size = np.diff(np.append(at, len(h)))
            idx = np.arange(len(h))
            found = []
            for other in (at[group], np.where(start, idx, idx - 1), at[group] + size[group] // 2):
                lo, hi = np.minimum(idx, other), np.maximum(idx, other)
                a, b = n[lo].astype(np.int64), n[hi].astype(np.int64)
                most = 1 + np.minimum(a - pos[lo] - 1, b - pos[hi] - 1)
                ok = (idx != other) & (doc[lo] != doc[hi]) & (100 * a >= percent * b) & (np.minimum(pos[lo], pos[hi]) + most >= needed(a, b, percent))
                found.append(np.stack([np.minimum(doc[lo], doc[hi])[ok], np.maximum(doc[lo], doc[hi])[ok]], 1))
            p = np.unique(np.concatenate(found), axis=0)
            fresh = [x for x in map(tuple, p.tolist()) if x not in seen]
            if len(seen) > 500_000:
                seen.clear()
            seen.update(fresh)
            return pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in fresh], pa.int64()), "b": pa.array([x[1] for x in fresh], pa.int64())})

        for batch in batches:
            now = _rows(batch, "h", "doc", "n", "pos", "part")
            if not len(now[0]):
                continue
            if tail is not None:
                now = [np.concatenate(x) for x in zip(tail, now, strict=True)]
            cut = int(np.argmax((now[0] == now[0][-1]) & (now[4] == now[4][-1])))  # the last group may go on
            if cut:
                yield pairs(*(x[:cut] for x in now))
            tail = [x[cut:] for x in now]
        if tail is not None and len(tail[0]):
            yield pairs(*tail)

    return run


def _near(k: int, chosen):
    """(doc, n, bins, shingles) of the documents in a bitmap: how many shingles fall in each bin, and all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=1):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out = []
            for i in np.flatnonzero(in_bits(chosen.value, mix(ids.view(np.uint64)))).tolist():
                s = shingle_set(batch.column(1)[i].as_py(), k)
                if len(s):
                    bins = np.minimum(np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=BINS), 65535).astype(np.uint16)
                    out.append((int(ids[i]), len(s), bins.tobytes(), s.tobytes()))
                if len(out) >= 1000:
                    yield _near_batch(out)
                    out = []
            if out:
                yield _near_batch(out)

    return run


def _near_batch(rows) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())], ["doc", "n", "bins", "shingles"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _rest(percent: int):
    """Pairs of one block that are in different components and pass the length, positional and suffix filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        seen: set[tuple[int, int]] = set()

        def pairs(batch: pa.RecordBatch):
            doc, n, pos, comp, side, x, y = _rows(batch, "doc", "n", "pos", "comp", "side", "x", "y")
            n = n.astype(np.int64)
            bins = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("bins")).to_pylist()), np.uint16).reshape(len(doc), BINS).astype(np.int32)
            coarse = bins.reshape(len(doc), 32, BINS // 32).sum(2)
            fresh = []
            for i in range(1, len(doc)):
                j0 = int(np.searchsorted(n[:i], -(-percent * n[i] // 100)))  # rows are in order of n
                j = np.arange(j0, i)
                ok = (comp[j] != comp[i]) & (doc[j] != doc[i])
                if x[i] != y[i]:
                    ok &= side[j] != side[i]
                a, need = n[j], needed(n[j], n[i], percent)
                ok &= np.minimum(pos[j], pos[i]) + 1 + np.minimum(a - pos[j] - 1, n[i] - pos[i] - 1) >= need
                j, need = j[ok], need[ok]
                for b in (coarse, bins):  # each differing shingle differs in a bin or is cancelled by another there
                    if len(j):
                        fit = np.abs(b[j] - b[i]).sum(1) <= n[j] + n[i] - 2 * need
                        j, need = j[fit], need[fit]
                p, q = doc[j], int(doc[i])
                fresh += [(min(q, z), max(q, z)) for z in p.tolist() if (min(q, z), max(q, z)) not in seen]
                if len(fresh) > 20_000:
                    seen.update(fresh)
                    yield fresh
                    fresh = []
            if len(seen) > 500_000:
                seen.clear()
            seen.update(fresh)
            yield fresh

        def out():
            if held:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                h, x, y = _rows(whole, "h", "x", "y")
                cut = np.flatnonzero((h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
                for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(h)], strict=True):
                    if e - s > 1:
                        for fresh in pairs(whole.slice(s, e - s)):
                            yield pa.RecordBatch.from_pydict({"a": pa.array([z[0] for z in fresh], pa.int64()), "b": pa.array([z[1] for z in fresh], pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            h, x, y = _rows(batch, "h", "x", "y")
            cut = int(np.argmax((h == h[-1]) & (x == x[-1]) & (y == y[-1])))
            if cut or (held and tuple(v[0] for v in _rows(held[-1], "h", "x", "y")) != (h[0], x[0], y[0])):
                held.append(batch.slice(0, cut))
                yield from out()
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        yield from out()

    return run


def link_components(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs(doc_id, text)`` -> one row each: doc_id, n_shingles, component_id, class_id.

    component_id: smallest doc_id reachable over links (100 * intersection >= percent * union of the shingle sets);
    class_id: smallest doc_id with the same set. Null, empty or blank text: 0 shingles, own component. Rows without
    doc_id: null component, linked with nothing. Rows that share a doc_id are one node: each row's links count for
    all of them. Extra columns are ignored; an empty table gives an empty result.
    """
    s = Scratch(spark, "jaccard")
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    sig = s.save(docs.mapInArrow(_signatures(words), "doc_id long, n long, key binary"), "sets")
    classes = s.save(sig.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n")), "classes")
    known = docs.where("doc_id is not null and text is not null")
    chosen = membership(spark, classes, "class_id")
    counts = corpus_counts(spark, docs, words)
    # a document in the bitmap by chance is a copy or the like: its rows are dropped by the join below
    rows = known.mapInArrow(_prefixes(words, percent, counts, chosen), "h long, doc long, n int, pos int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = s.save(rows.repartition(parts, "h").sortWithinPartitions("h", "n", "doc").mapInArrow(lean(_shared), "h long, doc long, n int, pos int"), "groups")
    counts.unpersist()
    s.free()
    groups = s.save(groups.join(classes.select(F.col("class_id").alias("doc")).distinct(), "doc", "left_semi"), "members")
    members = groups.select("doc").distinct()
    near_ids = membership(spark, members, "doc")
    near = s.save(known.mapInArrow(_near(words, near_ids), "doc long, n int, bins binary, shingles binary"), "near")
    s.drop("groups")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        a = near.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
        b = near.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
        return s.save(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(_verify(percent), "a long, b long").distinct(), name)

    # large groups are tied together in parts; what links the parts is found in the second round
    many = groups.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1")
    dealt = groups.join(many, "h", "left").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc"), F.col("parts"))).otherwise(0).cast("int"))
    stars = dealt.repartition(parts, "h", "part").sortWithinPartitions("h", "part", "n", "doc").select("h", "doc", "n", "pos", "part").mapInArrow(lean(_stars(percent)), "a long, b long").distinct()
    links = verified(stars, "links-0")
    # rows of one doc_id whose sets differ are one node
    own = sig.where("n > 0 and doc_id is not null").select("doc_id", "key").join(classes, "key").select("doc_id", "class_id")
    lowest = own.groupBy("doc_id").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low < high")
    links = links.union(own.join(lowest, "doc_id").where("low < class_id").select("low", "class_id"))
    comp = components(spark, links, s, "first")

    of = groups.join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("root", "doc")).drop("root")
    mixed = of.groupBy("h").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    mixed = mixed.select("h", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    left = of.join(mixed, "h").withColumn("side", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    left = left.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("h", "doc", "n", "pos", "comp", "side", F.least("side", "to").alias("x"), F.greatest("side", "to").alias("y"))
    left = left.join(near.select("doc", "n", "bins"), ["doc", "n"])
    left = left.repartition(parts, "h", "x", "y").sortWithinPartitions("h", "x", "y", "n", "doc")
    more = verified(left.mapInArrow(lean(_rest(percent)), "a long, b long").distinct(), "links-1")
    comp = components(spark, links.union(more), s, "second")

    node = sig.join(classes.select("key", "class_id"), "key", "left")
    node = node.join(comp.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
    return node.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "class_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark, docs_of(spark, sf_dir))
