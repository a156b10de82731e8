"""Exact top-k over binary codes by incremental multi-index hashing.

A code is the signs of a vector. Codes are cut into segments, and a table per segment lists codes by segment value. A
query probes all tables at segment radius 0, 1, 2, ...; after radius r every code within distance
segments * (r + 1) - 1 has been met, so the search ends once the kth verified distance is no more than that. Distances
tie by smaller id.

Rows with equal codes tie with each other for every query, so only the k smallest ids of a code go in the index. The
index is dealt to blocks that fit in a task's memory; every query meets every block, and streams through it. A block
gives its own k best; the k best of those are kept. Queries are dealt to parts only as far as the index has fewer
blocks than there are tasks, as each part needs the block anew: rows shuffled are codes x parts + queries x blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs_of, slices

K, EVERY = 10, 50
INDEX_BLOCK, LEAST_QUERIES, SEGMENT = 1_000_000, 500, 16  # codes of a block, some 50 MB; queries worth building one for


class MultiIndex:
    """Tables of one block of codes: (n, words) unsigned 64-bit."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, bits: int = SEGMENT):
        order = np.argsort(ids, kind="stable")
        self.ids, self.codes, self.bits = ids[order], codes[order], bits
        self.order, self.starts = [], []
        for p in self.segments(self.codes):
            self.order.append(np.argsort(p, kind="stable").astype(np.int32))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(p, minlength=1 << bits))]))

    def segments(self, codes: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        return [((codes[:, w] >> np.uint64(s)) & mask).astype(np.int64) for w in range(codes.shape[1]) for s in range(0, 64, self.bits)]

    def masks(self, radius: int) -> np.ndarray:
        return _masks(self.bits, radius)

    def search(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest, by distance, then id."""
        n = len(self.ids)
        seen, found, near = np.zeros(n, bool), [], np.zeros(0, np.int64)
        own = [int(s[0]) for s in self.segments(code[None, :])]
        for radius in range(self.bits + 1):
            for value, order, starts in zip(own, self.order, self.starts, strict=True):
                at = value ^ self.masks(radius)
                lo, size = starts[at], starts[at + 1] - starts[at]
                some = np.flatnonzero(size)
                if len(some):
                    lo, size = lo[some], size[some]
                    rows = order[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())]
                    rows = np.unique(rows[~seen[rows]])
                    seen[rows] = True
                    found.append((rows, np.bitwise_count(self.codes[rows] ^ code).sum(1).astype(np.int64)))
            near = np.concatenate([d for _, d in found]) if found else near
            if len(near) >= k and np.partition(near, k - 1)[k - 1] <= len(own) * (radius + 1) - 1:
                break
        rows = np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int64)
        best = np.lexsort((self.ids[rows], near))[:k]
        return self.ids[rows[best]], near[best]


_MASKS: dict[tuple[int, int], np.ndarray] = {}


def _masks(bits: int, radius: int) -> np.ndarray:
    if (bits, radius) not in _MASKS:
        _MASKS[bits, radius] = np.array([sum(1 << i for i in c) for c in combinations(range(bits), radius)], np.int64)
    return _MASKS[bits, radius]


def _answer(k: int):
    """Rows in order of (block, part, kind): a block's codes, then the queries that meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in slices(batches, 8192):
            i, q, kind, ids = (batch.column(c).to_numpy() for c in range(4))
            codes = batch.column(4).flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
            cut = [0, *(np.flatnonzero((i[1:] != i[:-1]) | (q[1:] != q[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(ids)]
            out = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if (i[a], q[a]) != now:
                    now, held, index = (i[a], q[a]), [], None
                if kind[a] == 0:
                    held.append((ids[a:b], codes[a:b]))
                elif held or index is not None:
                    if index is None:
                        index = MultiIndex(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                        held = []
                    for one, code in zip(ids[a:b].tolist(), codes[a:b], strict=True):
                        got, far = index.search(code, k)
                        out.append((np.full(len(got), one, np.int64), got, far))
            c = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in c], ["query_id", "vec_id", "distance"])

    return run


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``vectors(vec_id, embedding)``, ``queries(vec_id, embedding)`` -> query_id, rank (from 1), vec_id, distance.

    Bits: whether a number is over 0 (NaN is, null isn't); vectors shorter than the longest lack those bits. Rows
    without id or vector are neither found nor queries. A vector that is a row too finds itself. Repeated rows of an id
    are one row of each code. Fewer than k rows: all of them. Extra columns are ignored; empty tables give an empty result.
    """
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    words = max(1, -(-longest // 64))
    bit = F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)).otherwise(F.lit(0).cast("long")))
    code = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.aggregate(F.slice("bits", w * 64 + 1, F.lit(64)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))

    def coded(df: DataFrame) -> DataFrame:
        df = df.where("vec_id is not null and size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), bit.alias("bits"))
        return df.select("vec_id", code.alias("code")).distinct()

    rank = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    rows = coded(vectors).withColumn("r", rank).where(F.col("r") <= k).drop("r")
    asked = coded(queries)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-vectors.count() // INDEX_BLOCK))
    query_blocks = max(1, min(-(-parts // blocks), asked.count() // LEAST_QUERIES))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = rows.select(own(blocks).alias("i"), every(query_blocks).alias("q"), F.lit(0).alias("kind"), "vec_id", "code")
    both = both.union(asked.select(every(blocks).alias("i"), own(query_blocks).alias("q"), F.lit(1).alias("kind"), "vec_id", "code"))
    met = both.repartition(parts, "i", "q").sortWithinPartitions("i", "q", "kind").mapInArrow(_answer(k), "query_id long, vec_id long, distance long")
    # a query id with several codes keeps the nearest of each row
    met = met.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return met.withColumn("rank", place.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def op3_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = docs_of(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(spark, vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, r.vec_id,
    CAST(len(list_filter(list_zip(q.b, r.b), lambda z: z[1] <> z[2])) AS BIGINT) AS distance
  FROM v q, v r WHERE q.vec_id % {EVERY} = 0
), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM o WHERE rank <= {K}
"""
