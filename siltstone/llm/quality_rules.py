"""Quality rules: exact rule statistics of whole texts, hard limits, and isolation forests over the statistics.

The forests are fitted on a bounded sample of labelled documents (``FIT_ROWS``, those of smallest hash, so the same ones
at any parallelism), on those labelled good: one forest over all statistics, which draws each equally often, and one
over each statistic alone, so that none is outweighed. Splits are drawn over the whole range a share can have, not only
the sample's: what lies outside the clean rows is isolated early even where those are all equal. A document's anomaly
is its largest score in relation to its forest's limit, the lowest one that loses at most an equal part of
``CLEAN_LOSS`` of all rows labelled good: only the trees come from the sample. Fit and limits take the clean shares moved by up to ``ROOM``: one symbol in a
short clean text rejects nobody.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, docs_of, in_bits, membership, mix, slices, spread, Words

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MOST_REPEATED = 50, 50  # base rules: words; percent of words in repeated windows
FIT_ROWS, TREES, SUBSAMPLE, CLEAN_LOSS, ROOM = 20_000, 50, 512, 0.001, 0.02  # room: one in the fewest words that pass
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OTHERS = ["n_lines", "n_distinct", "n_upper", "n_digits", "n_marks"]
STATS = COUNTS + OTHERS


def rule_stats(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    joined = np.frombuffer(b"".join(words), np.uint8)
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
        seen.add(line)
    repeated = 0
    if len(words) > 3:
        _, back, n = np.unique(Words(text).runs(3), return_inverse=True, return_counts=True)
        hit = n[back] > 1
        covered = np.zeros(len(words), bool)
        for i in range(3):
            covered[i : len(words) - 2 + i] |= hit
        repeated = int(covered.sum())
    upper = int(((joined >= 65) & (joined <= 90)).sum())
    digits = int(((joined >= 48) & (joined <= 57)).sum())
    marks = len(text) - len(text.translate(None, b".,;:!?\"'()"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), int(((joined & 0xC0) != 0x80).sum()), symbols, dup, repeated, lines, len(set(words)), upper, digits, marks


def ratios(stats: np.ndarray) -> np.ndarray:
    """What the forests look at: shares from 0 to 1, which don't depend on length."""
    words, chars, symbols, dup, repeat, lines, distinct, upper, digits, marks = stats.astype(np.float64).T
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    return np.stack([chars / (chars + 5 * w), symbols / (symbols + w), dup / np.maximum(lines, 1), repeat / w, np.minimum(1, distinct / np.sqrt(w) / 10), upper / c, digits / c, marks / (marks + w)], 1)


class IsolationForest:
    """Random-split trees in flat arrays: feature (-1: leaf), value, children, and path length at leaves."""

    def __init__(self, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 17):
        self.n, self.subsample, self.seed, self.trees = trees, subsample, seed, []

    @staticmethod
    def usual(n: int) -> float:
        """Mean path length of an unsuccessful search in a random binary tree of n rows."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else 1.0

    def fit(self, x: np.ndarray, shares: bool = False) -> IsolationForest:
        """shares: splits are drawn over the whole of a node's part of [0, 1], else over the range of its rows."""
        rng, dims = np.random.default_rng(self.seed), x.shape[1]
        size = min(self.subsample, len(x))
        self.size, deepest = size, int(np.ceil(np.log2(max(size, 2)))) + 4 * (dims if shares else 1)
        for _ in range(self.n):
            feature, value, left, right, length = [], [], [], [], []

            def grow(rows: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray) -> int:
                at = len(feature)
                for a, v in ((feature, -1), (value, 0.0), (left, 0), (right, 0), (length, depth + self.usual(len(rows)))):
                    a.append(v)
                if not shares and len(rows):
                    lo, hi = x[rows].min(0), x[rows].max(0)
                usable = np.flatnonzero(hi > lo)
                if len(rows) > 1 and depth < deepest and len(usable):
                    f = int(usable[rng.integers(len(usable))])
                    v = float(rng.uniform(lo[f], hi[f]))
                    below = x[rows, f] <= v
                    if shares or (below.any() and not below.all()):
                        feature[at], value[at] = f, v
                        cut = np.arange(dims) == f
                        left[at] = grow(rows[below], depth + 1, lo, np.where(cut, v, hi))
                        right[at] = grow(rows[~below], depth + 1, np.where(cut, v, lo), hi)
                return at

            if size:
                grow(rng.choice(len(x), size, replace=False), 0, np.zeros(dims), np.ones(dims))
                self.trees.append(tuple(map(np.array, (feature, value, left, right, length))))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1: the larger, the fewer splits isolate the row. 0 without trees."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for feature, value, left, right, length in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inside = np.flatnonzero(f >= 0)
                if not len(inside):
                    break
                n = node[inside]
                node[inside] = np.where(x[inside, f[inside]] <= value[n], left[n], right[n])
            total += length[node]
        return 2.0 ** (-total / len(self.trees) / max(self.usual(self.size), 1e-9))


def moved(x: np.ndarray) -> np.ndarray:
    """Each share moved by up to ``ROOM``, inside [0, 1]. By how much follows from the row alone."""
    h, out = np.zeros(len(x), np.uint64), []
    for c in x.T:
        h = mix(h ^ np.ascontiguousarray(c).view(np.uint64))
    for c in x.T:
        h = mix(h + np.uint64(1))
        out.append(np.clip(c + ROOM * (h / 2.0**63 - 1), 0, 1))
    return np.stack(out, 1)


class Forests:
    """A forest over all shares, and one over each, whose scores are a table over the intervals between its splits."""

    def __init__(self, clean: np.ndarray):
        x = moved(clean)
        self.joint, self.single = IsolationForest().fit(x, True), []
        for k in range(x.shape[1]):
            one = IsolationForest(seed=18 + k).fit(x[:, [k]], True)
            cuts = np.unique(np.concatenate([value[feature >= 0] for feature, value, *_ in one.trees]))
            self.single.append((cuts, one.score(np.append(cuts, 1.0)[:, None])))
        self.limits = np.ones(1 + x.shape[1])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self.joint.score(x), *(table[np.searchsorted(cuts, c)] for c, (cuts, table) in zip(x.T, self.single, strict=True))], 1)

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """Above 1: beyond the limit of some forest."""
        return (self.scores(x) / self.limits).max(1)


def _judge(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = model.value
        for part in slices(batches, column=1):
            stats = np.array(list(map(rule_stats, part.column(1).to_pylist())), np.int64).reshape(-1, len(STATS))
            score = forests.anomaly(ratios(stats)) if forests else np.zeros(len(stats))
            failed = (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MOST_REPEATED * stats[:, 0])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(stats[:, k]) for k in range(len(COUNTS))), pa.array(failed), pa.array(score), pa.array(~failed & (score <= 1))],
                ["doc_id", *COUNTS, "base_failed", "anomaly", "kept"],
            )

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Forests | None:
    """Forests from at most ``rows`` documents labelled good, limits from all of them; conflicting labels of an id
    count as bad. Rows of an id that differ are documents of their own."""
    s = Scratch(spark, "quality")
    marks = s.save(labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")), "marks")
    good = marks.where("quality > 0").select("doc_id")
    found = docs.where("doc_id is not null").mapInArrow(_labelled(membership(spark, good, "doc_id")), ", ".join(f"{c} long" for c in ["doc_id", *STATS]))
    # ids in the bitmap by chance are dropped by the join
    clean = s.save(found.groupBy("doc_id", *STATS).agg(F.count("*").alias("n")).join(good, "doc_id", "left_semi"), "clean")
    clean = clean.where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MOST_REPEATED} * n_words")
    total, distinct = clean.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    order, some = F.xxhash64("doc_id", *STATS), 1.2 * rows + 1000  # so many are expected below the bound, so that not all go to the driver
    near = clean.where(order <= int(some / distinct * 2**64) - 2**63) if distinct > some else clean
    sample = near.select("doc_id", *STATS).orderBy(order, "doc_id", *STATS).limit(rows).collect()
    if not sample:
        return None
    forests = Forests(ratios(np.array(sample, np.int64)[:, 1:]))
    parts = len(forests.limits)
    over = int(CLEAN_LOSS / parts * total)  # so many rows of each forest may be above its limit
    scores = clean.select(*STATS, "n").mapInArrow(_highest(spark.sparkContext.broadcast(forests), over + 1), "forest int, score double, n long")
    scores = s.save(scores.groupBy("forest", "score").agg(F.sum("n").alias("n")), "scores")
    limits = []
    for k in range(parts):
        top = scores.where(F.col("forest") == k).select("score", "n").orderBy(F.desc("score")).limit(over + 1).collect()
        limits.append(top[int(np.searchsorted(np.cumsum([r["n"] for r in top]), over, "right"))]["score"])
    forests.limits = np.array(limits)
    return forests


def _labelled(ids):
    """Statistics of the rows whose doc_id is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column=1):
            part = part.filter(pa.array(in_bits(ids.value, mix(part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))))
            stats = np.array(list(map(rule_stats, part.column(1).to_pylist())), np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, stats.T)], ["doc_id", *STATS])

    return run


def _highest(model, most: int):
    """Each forest's scores of the moved rows, without those that ``most`` rows of the batch exceed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192):
            *stats, n = (c.to_numpy() for c in batch.columns)
            for k, score in enumerate(model.value.scores(moved(ratios(np.stack(stats, 1)))).T):
                at = np.flatnonzero(score >= np.partition(score, -most)[-most]) if len(score) > most else np.arange(len(score))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(score[at]), pa.array(n[at])], ["forest", "score", "n"])

    return run


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    anomaly, kept; a row for each row.

    Null, empty or blank text: zero counts, fails the base rules. Null and equal doc_ids go through. Without documents
    labelled good that pass the base rules there are no forests, and what passes those is kept.
    """
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    model = spark.sparkContext.broadcast(fit(spark, docs, labels))
    return docs.mapInArrow(_judge(model), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, docs_of(spark, sf_dir), docs_of(spark, sf_dir, "labels"))
