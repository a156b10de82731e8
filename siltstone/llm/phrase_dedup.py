"""Substring dedup by repeated-phrase automata.

1. Anchors: in each window of 20 words, the 8-word run of smallest hash (leftmost on ties). Equal windows have equal
   anchors, so windows of an anchor that occurs once in distinct texts are unique. Anchors are counted over all texts.
2. Confirmed passages: windows with a recurring anchor are hashed (128 bits) and grouped; recurring ones have a first
   occurrence (smallest doc_id, then start). Consecutive first occurrences of a document merge into a passage.
3. Automata: passages are sharded by document; each shard compiles phrases of its passages, at least one in each
   window, with pyahocorasick over words coded as characters. A document's recurring windows say which shards have their first occurrences (each
   window one shard); the stretch of the document that they span streams through that shard's automaton. Each hit is
   extended word by word, so hashes never decide what is removed (they route: 128 bits, see ``common.Words``). Shards that many more documents
   need than others are copied, and the stretches are dealt over the copies.

Texts equal as word sequences are one class: beyond the first, all words are covered, if there are 20 or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, Words, docs_of, in_bits, lean, membership, mix, numbered, slices, spread

WINDOW, ANCHOR = 20, 8
PHRASE = 12  # words of a phrase in an automaton: the run of smallest hash in each window
SHARD_WORDS = 20_000  # windows of passages in one automaton, about
SHARD_DOCS, UNEVEN = 200, 2  # stretches that a shard has one automaton for: so many, or so many times the average shard's
SHARED = 4  # passages that a hit is tried against one by one; beyond, its windows are looked up
EMPTY = sha256(b"").hexdigest()


def anchor_starts(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs, and for each window the start of its anchor."""
    h = words.runs(k)
    at = np.empty(max(0, words.n - window + 1), np.int64)
    for i in range(0, len(at), 1 << 16):  # in blocks: a window view has window - k + 1 columns
        view = np.lib.stride_tricks.sliding_window_view(h[i : min(len(h), i + (1 << 16) + window - k)], window - k + 1)
        at[i : i + len(view)] = view.argmin(1) + np.arange(i, i + len(view))
    return h, at


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, column=1):
        n, out = [], []
        for text in batch.column(1).to_pylist():
            words = (text or b"").split()
            n.append(len(words))
            out.append(sha256(b" ".join(words)).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_words", "key"])


def _longs(*cols: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.astype(np.uint64).view(np.int64)) if c.dtype != np.int64 else pa.array(c) for c in cols]


def _among(batch: pa.RecordBatch, bits, hashed: bool = False) -> pa.RecordBatch:
    ids = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
    return batch.filter(pa.array(in_bits(bits.value, ids if hashed else mix(ids))))


def _anchors(window: int, k: int, singles):
    """(anchor, doc_id, place) of each anchor of each text but copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in slices(batches, column=1):
            batch = _among(batch, singles)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Words(text)
                if words.n < window:
                    continue
                h, at = anchor_starts(words, window, k)
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                at = np.unique(at)
                parts.append((h[at], np.full(len(at), doc, np.int64), at))
                size += len(at)
                if size > 60_000:
                    yield pa.RecordBatch.from_arrays(_longs(*(np.concatenate(x) for x in zip(*parts, strict=True))), ["anchor", "doc_id", "place"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays(_longs(*(np.concatenate(x) for x in zip(*parts, strict=True))), ["anchor", "doc_id", "place"])

    return run


def _windows(window: int, k: int, singles, recurring):
    """(h1, h2, doc_id, start) of the windows whose anchor recurs, of each text but copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts):
            return pa.RecordBatch.from_arrays(_longs(*(np.concatenate(x) for x in zip(*parts, strict=True))), ["h1", "h2", "doc_id", "start"])

        parts, size = [], 0
        for batch in slices(batches, column=1):
            batch = _among(batch, singles)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Words(text)
                if words.n < window:
                    continue
                h, at = anchor_starts(words, window, k)
                some = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                hit = in_bits(recurring.value, h[at[some]])
                if not hit.any():
                    continue
                keep = np.flatnonzero(np.repeat(hit, np.diff(np.append(some, len(at)))))
                h1, h2 = words.runs(window)[keep], words.runs(window, 1)[keep]
                m = len(keep)
                parts.append((h1, h2, np.full(m, doc, np.int64), keep))
                size += m
                if size > 60_000:
                    yield out(parts)
                    parts, size = [], 0
        if parts:
            yield out(parts)

    return run


def _chosen(bits, hashed: bool = False):
    """Rows whose first column, an id or a hash, may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _among(batch, bits, hashed)

    return run


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, runs of start and end) -> (doc_id, start, words) of each passage."""
    for batch in slices(batches, column=1):
        out = []
        for doc, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = Words(text)
            out += [(doc, r["start"], words.between(r["start"], r["end"])) for r in runs]
        c = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary())], ["doc_id", "start", "words"])


def coded(words: Words) -> str:
    """One character a word, by hash. Different words may share one; hits are compared word by word."""
    codes = (words.hashes() & np.uint64(0xFFFFF)).astype(np.uint32) + np.uint32(0x10000)
    return codes.astype("<u4").tobytes().decode("utf-32-le")


class PhraseAutomaton:
    """Passages (doc_id, start, text); finds where others' words repeat windows of them.

    A hit of a phrase that few passages have is tried against each. Where many have it, the windows that cover the hit
    are looked up by their hashes, so that a hit costs the same however many passages share the phrase.
    """

    def __init__(self, passages: list[tuple[int, int, bytes]], window: int):
        self.window, self.k = window, min(PHRASE, window)
        self.passages: list[tuple[int, int, list[bytes]]] = []
        lists: dict[str, list[tuple[int, int]]] = {}
        for i, (doc, start, text) in enumerate(passages):
            words = Words(text)
            self.passages.append((doc, start, words.list()))
            code = coded(words)
            for p in np.unique(anchor_starts(words, window, self.k)[1]).tolist():
                lists.setdefault(code[p : p + self.k], []).append((i, p))
        self.windows: dict[int, list[tuple[int, int]]] = {}
        for i in sorted({i for where in lists.values() if len(where) > SHARED for i, _ in where}):
            for p, h in enumerate(Words(passages[i][2]).runs(window).tolist()):
                self.windows.setdefault(h, []).append((i, p))
        self.automaton = ahocorasick.Automaton()
        for pattern, where in lists.items():
            self.automaton.add_word(pattern, where if len(where) <= SHARED else None)
        self.automaton.make_automaton()

    def _covering(self, own: list[int], at: int) -> list[tuple[int, int]]:
        """Passages and places that the words from ``at`` may lie at, by the windows that cover the phrase there."""
        out = []
        for s in range(max(0, at + self.k - self.window), min(at, len(own) - 1) + 1):
            out += [(i, p + at - s) for i, p in self.windows.get(own[s], ())]
        return out

    def spans(self, doc: int, text: bytes, base: int = 0) -> list[tuple[int, int]]:
        """Runs of words [from, to) that a passage has too, of a window or longer, besides the passage itself.

        ``base``: where the words begin in the document.
        """
        out, done = [], {}
        if not len(self.automaton):
            return out
        coming = Words(text)
        words, own, n = coming.list(), None, coming.n
        for end, where in self.automaton.iter(coded(coming)):
            at = end - self.k + 1
            if where is None:
                own = coming.runs(self.window).tolist() if own is None else own
                where = self._covering(own, at)
            for i, place in where:
                shift = at - place
                if done.get((i, shift), -1) >= at:
                    continue
                first, start, there = self.passages[i]
                if first == doc and start == shift + base:
                    continue
                lo, hi, size = place, place, len(there)
                while lo > 0 and lo + shift > 0 and there[lo - 1] == words[lo + shift - 1]:
                    lo -= 1
                while hi < size and hi + shift < n and there[hi] == words[hi + shift]:
                    hi += 1
                done[i, shift] = max(hi + shift - self.k, at)
                if hi - lo >= self.window:
                    out.append((lo + shift + base, hi + shift + base))
        return out


def _located(window: int):
    """Rows in order of (shard, copy), passages first: builds each shard's automaton, then streams its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, passages, automaton = None, [], None
        for batch in slices(batches, column=5):
            out = []
            for shard, copy, kind, doc, start, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, copy) != now:
                    now, passages, automaton = (shard, copy), [], None
                if kind == 0:
                    passages.append((doc, start, text))
                    continue
                if automaton is None:
                    automaton = PhraseAutomaton(passages, window)
                found = automaton.spans(doc, text, start)
                if found:
                    out.append((doc, np.array(found, np.int64).ravel().tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], ["doc_id", "spans"])

    return run


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, routes of shard, start and end) -> the stretch of the text for each shard."""
    for batch in slices(batches, column=1):
        out = []
        for doc, text, routes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = Words(text)
            out += [(r["shard"], doc, r["start"], words.between(r["start"], r["end"])) for r in routes]
        c = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.binary())], ["shard", "doc_id", "start", "text"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> what is left of the words."""
    for batch in slices(batches, column=1):
        removed, kept, texts = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = (text or b"").split()
            gone = np.zeros(len(words), bool)
            for s in spans or ():
                for a, b in zip(s[::2], s[1::2], strict=True):
                    gone[a:b] = True
            left = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
            removed.append(int(gone.sum()))
            kept.append(sha256(left).hexdigest())
            texts.append(left)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept), pa.array(texts, pa.binary())], ["doc_id", "n_removed", "kept_sha256", "kept"])


def dedup_substrings(spark: SparkSession, docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_words, n_removed, kept_sha256, kept (text; null where all words stay).

    A word goes when a window of ``window`` words that covers it starts earlier too (smaller doc_id, or the same
    document and an earlier start), judged on the input. Null, empty or shorter texts lose nothing. Rows with the same
    doc_id and text are one document, with equal results. Different texts of one doc_id are documents of their own, in
    the order of their SHA-256; so are those without doc_id, after all others. Extra columns are ignored; an empty
    table gives an empty result.
    """
    s = Scratch(spark, "phrases")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    docs, names = numbered(given, s)
    docs = spread(docs)
    all_docs = s.save(docs.mapInArrow(_digests, "doc_id long, n_words long, key binary"), "documents")
    firsts = s.save(all_docs.where(F.col("n_words") >= window).groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")), "classes")

    # a copy adds nothing: its class's first text has the same windows, earlier. Some copies get through the bitmap.
    singles = membership(spark, firsts, "first_id")
    rows = docs.mapInArrow(_anchors(window, k, singles), "anchor long, doc_id long, place long")
    seen = rows.groupBy("anchor").agg(*(f(c).alias(f"{n}_{c}") for c in ("doc_id", "place") for n, f in (("lo", F.min), ("hi", F.max))))
    recurring = s.save(seen.where("lo_doc_id < hi_doc_id or lo_place < hi_place").select("anchor"), "anchors")
    s.free()
    bits = membership(spark, recurring, "anchor", hashed=True)
    windows = docs.mapInArrow(_windows(window, k, singles, bits), "h1 long, h2 long, doc_id long, start long")
    windows = s.save(windows, "windows")
    s.drop("anchors")

    at = F.struct("doc_id", "start")
    found = windows.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last")
    found = s.save(found.select("h1", F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start")), "found")
    s.free()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(parts, found.count() // SHARD_WORDS)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    first = found.select("h1", shard.alias("shard"), F.col("doc_id").alias("first_id"), F.col("start").alias("first_start"))
    repeated = membership(spark, found, "h1", hashed=True)
    routes = windows.select("h1", "doc_id", "start").mapInArrow(lean(_chosen(repeated, hashed=True)), "h1 long, doc_id long, start long")
    routes = routes.join(first, "h1").where("doc_id <> first_id or start <> first_start")
    routes = routes.groupBy("doc_id", "shard").agg(F.min("start").alias("start"), (F.max("start") + window).alias("end"))
    routes = s.save(routes, "routes")
    s.drop("windows")

    order = Window.partitionBy("doc_id").orderBy("start")
    runs = found.withColumn("run", F.col("start") - F.row_number().over(order)).groupBy("doc_id", "run").agg(F.min("start").alias("start"), (F.max("start") + window).alias("end"))
    runs = s.save(runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs")), "runs")
    s.free()

    # documents with passages or stretches; copies aside
    wanted = membership(spark, routes.select("doc_id").union(runs.select("doc_id")).distinct(), "doc_id")
    extra = firsts.where("first_id < last_id").select("key", "first_id")
    copies = s.save(all_docs.join(extra, "key").where("doc_id > first_id").select("doc_id"), "copies")
    # passages and routes join the texts at once: one shuffle of texts for both
    routes = routes.groupBy("doc_id").agg(F.collect_list(F.struct("shard", "start", "end")).alias("routes"))
    texts = docs.mapInArrow(lean(_chosen(wanted)), "doc_id long, text binary").join(copies, "doc_id", "left_anti")
    texts = texts.join(runs, "doc_id", "left").join(routes, "doc_id", "left").where("runs is not null or routes is not null")
    texts = s.save(texts, "texts")

    passages = texts.where("runs is not null").select("doc_id", "text", "runs").mapInArrow(_passages, "doc_id long, start long, words binary")
    passages = s.save(passages.withColumn("shard", shard), "passages")
    parts_of = texts.where("routes is not null").select("doc_id", "text", "routes").mapInArrow(_stretches, "shard int, doc_id long, start long, text binary")
    parts_of = s.save(parts_of, "stretches")
    counts = s.save(parts_of.groupBy("shard").agg(F.count("*").alias("n")), "counts")
    all_parts, used = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    most = max(SHARD_DOCS, UNEVEN * all_parts // max(1, used))
    copies_of = counts.select("shard", F.ceil(F.col("n") / most).cast("int").alias("copies"))
    copies_of = F.broadcast(copies_of) if shards < 100_000 else copies_of
    heads = passages.join(copies_of, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    heads = heads.select("shard", "copy", F.lit(0).alias("kind"), "doc_id", "start", F.col("words").alias("text"))
    tails = parts_of.join(copies_of, "shard")
    tails = tails.select("shard", F.pmod(F.xxhash64("doc_id", "start"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), "doc_id", "start", "text")
    both = heads.union(tails).repartition(parts, "shard", "copy").sortWithinPartitions("shard", "copy", "kind", "doc_id", "start")
    spans = s.save(both.mapInArrow(_located(window), "doc_id long, spans array<long>"), "spans")
    s.free()
    spans = spans.groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))
    changed = texts.select("doc_id", "text").join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_removed long, kept_sha256 string, kept binary")
    changed = s.save(changed, "changed")
    s.drop("passages", "stretches", "texts", "found")

    out = all_docs.join(changed, "doc_id", "left").join(copies.withColumn("copy", F.lit(True)), "doc_id", "left")
    out = out.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("key")))).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept").cast("string")).alias("kept"),
    )
    if names is None:
        return out
    rows = names.withColumn("copies", F.explode(F.array_repeat("copies", F.col("copies").cast("int"))))
    return rows.join(out.withColumnRenamed("doc_id", "node"), "node").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept")


def op10_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark, docs_of(spark, sf_dir)).drop("kept")
