"""What the registered queries share: the driver's tables as files, versions, chunks and jobs, in Spark and in SQL.

A source is a file, its documents are versions in order of doc_id, a text's bytes the content. Events are sync jobs,
requests and queue events. Times are relative to a fixed moment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import chunking

AS_OF = "2024-01-31 00:00:00"
BLOCK = 1024
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return t.withColumns({c: F.col(c).cast("timestamp") for c, kind in t.dtypes if kind == "timestamp_ntz"})


def docs(spark, d) -> DataFrame:
    """doc_id, file_id, content."""
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("file_id"), F.encode("text", "UTF-8").alias("content"))


def dealt_docs(spark, d) -> DataFrame:
    """``docs`` for byte kernels: over all cores where the table is one small file."""
    t, n = docs(spark, d), spark.sparkContext.defaultParallelism
    return t if t.rdd.getNumPartitions() >= n else t.repartition(n, "doc_id")


def versions(spark, d) -> DataFrame:
    row = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").select(F.col("source").alias("file_id"), F.col("doc_id").alias("version_id"), row.cast("long").alias("version_no"), F.octet_length("text").cast("long").alias("size"))


def chunks(spark, d, size=BLOCK) -> DataFrame:
    return chunking.with_fixed(docs(spark, d), "content", size, "doc_id", "file_id").select("doc_id", "file_id", F.col("block_index").cast("long").alias("block_index"), "offset", "length", chunking.strong("block").alias("strong_hash"))


def jobs(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("job_id"), "user_id", (F.col("event_id") % 500).alias("file_id"), "event_type", F.col("ts").alias("started_at"),
        F.floor(F.coalesce("value", F.lit(0.0)) * 100 + 0.5).cast("long").alias("bytes_transferred"), (F.col("event_id") % 1000 * 7).alias("bytes_saved"),
    )


CH = """ch AS (SELECT doc_id, source AS file_id, CAST(i AS BIGINT) AS block_index, CAST(i * 1024 AS BIGINT) AS "offset",
  CAST(least(1024, strlen(text) - i * 1024) AS BIGINT) AS length, sha256(unhex(substr(hex(text), 1 + i * 2048, 2048))) AS strong_hash
  FROM (SELECT doc_id, source, text, unnest(range(0, (strlen(text) + 1023) // 1024)) AS i FROM documents WHERE strlen(text) > 0))"""
JOBS = """jobs AS (SELECT event_id AS job_id, user_id, event_id % 500 AS file_id, event_type, ts AS started_at,
  CAST(floor(coalesce(value, 0) * 100 + 0.5) AS BIGINT) AS bytes_transferred, event_id % 1000 * 7 AS bytes_saved FROM events)"""
VERSIONS = """versions AS (SELECT source AS file_id, doc_id AS version_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS version_no,
  CAST(strlen(text) AS BIGINT) AS size FROM documents)"""


def adler_sql(block: str) -> str:
    """Adler-32 of a block in hexadecimal digits."""
    n = f"(length({block}) // 2)"
    byte = f"CAST('0x' || substr({block}, 2 * k + 1, 2) AS BIGINT)"
    return f"""CAST((({n} + coalesce(list_sum([({n} - k) * {byte} FOR k IN range(0, {n})]), 0)) % 65521) * 65536 + (1 + coalesce(list_sum([{byte} FOR k IN range(0, {n})]), 0)) % 65521 AS BIGINT)"""


def cdc_sql(name: str, source: str, p: chunking.Profile) -> str:
    """Content-defined chunks of ``source(doc_id, h)``, h in hexadecimal digits: doc_id, block_index, offset, length, block.
    A fold over the bytes: n is the place behind the byte, e the ends so far."""
    state = "{{'f': {f}, 'n': {n}, 'e': {e}}}"
    g = f"xor((a.f * {chunking.MULTIPLIER}) & 4294967295, x.f)"
    run = "x.n - coalesce(a.e[-1], 0)"
    byte = state.format(f="CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT)", n="CAST(k + 1 AS BIGINT)", e="CAST([] AS BIGINT[])")
    first = state.format(f=f"CAST({chunking.SEED} AS BIGINT)", n="CAST(0 AS BIGINT)", e="CAST([] AS BIGINT[])")
    cut, on = state.format(f=f"CAST({chunking.SEED} AS BIGINT)", n="x.n", e="list_append(a.e, x.n)"), state.format(f=g, n="x.n", e="a.e")
    return f"""{name}_b AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS size, list_transform(range(0, length(h) // 2), lambda k: {byte}) AS l FROM {source} WHERE h <> ''),
{name}_f AS (SELECT doc_id, h, size, list_reduce(l, lambda a, x: CASE WHEN ({run} > {p.smallest} AND ({g} & {p.mask}) = 0) OR {run} = {p.largest} THEN {cut} ELSE {on} END, {first}).e AS e FROM {name}_b),
{name}_e AS (SELECT doc_id, h, CASE WHEN coalesce(e[-1], 0) < size THEN list_append(e, size) ELSE e END AS e FROM {name}_f),
{name} AS (SELECT doc_id, CAST(i AS INTEGER) AS block_index, s AS "offset", t - s AS length, substr(h, 1 + 2 * s, 2 * (t - s)) AS block FROM (
  SELECT doc_id, h, i, coalesce(e[i], 0) AS s, e[i + 1] AS t FROM (SELECT doc_id, h, e, unnest(range(0, len(e))) AS i FROM {name}_e)))"""
