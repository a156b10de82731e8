"""A corpus pipeline: quality rules, near-duplicate removal, substring dedup, secret masking, packing.

Each stage takes all documents its predecessor kept and returns the columns of ``documents``; the last one returns
the pieces of the packed sequences. ``run`` writes each stage's result to the shared folder and reads it back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import jaccard_join, packing, phrase_dedup, quality_rules, secret_scan
from siltstone.llm.common import Scratch, docs_of, slices, spread

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the forest; null and blank texts don't. Rows without doc_id, or with an
    equal one, are judged as the others; an empty table gives an empty result."""
    docs = spread(_plain(docs))
    model = spark.sparkContext.broadcast(quality_rules.fit(spark, docs.withColumn("text", F.col("text").cast("binary")), docs_of(spark, sf_dir, "labels")))
    judge = quality_rules._judge(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column=1):
            slim = pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.binary())], ["doc_id", "text"])
            for verdict in judge(iter([slim])):
                yield part.filter(verdict.column(verdict.schema.get_field_index("kept")))

    return docs.mapInArrow(run, SCHEMA)


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows with a doc_id, and a column node that no two of them share: the doc_id, or where doc_ids repeat the row's
    place in the order of doc_id and text. Of rows equal in both, the first in the order of the others is left."""
    docs = docs.where("doc_id is not null")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.withColumn("node", F.col("doc_id"))
    rows = docs.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest")).select("doc_id", "text", "rest.*")
    return Scratch(spark, "numbered").save(rows.orderBy("doc_id", "text").withColumn("node", F.monotonically_increasing_id()), "rows")


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows of each partition in a fixed order: joins leave them as they arrive, and packing goes by their order."""
    return docs.sortWithinPartitions("doc_id", "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id (then the first text in order) in each component of links.

    Texts that share a doc_id are documents of their own: those not linked to or equal to another stay. Rows without
    doc_id, null and blank texts stay; an empty table gives an empty result.
    """
    docs = _plain(docs)
    rows = _numbered(spark, docs)
    found = jaccard_join.link_components(spark, rows.select(F.col("node").alias("doc_id"), "text"))
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("node")).distinct()
    return _in_order(rows.join(gone, "node", "left_anti").select(COLUMNS).union(docs.where("doc_id is null").select(COLUMNS)))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that windows repeat, joined by single spaces where any went; others as they are.

    Texts that share a doc_id are documents of their own, in order of text. Documents of which nothing is left go. Rows
    without doc_id, null and blank texts stay as they are; an empty table gives an empty result.
    """
    docs = _plain(docs)
    rows = _numbered(spark, docs)
    cut = phrase_dedup.dedup_substrings(spark, rows.select(F.col("node").alias("doc_id"), "text")).where("n_removed > 0").select(F.col("doc_id").alias("node"), F.col("kept").alias("left")).distinct()
    out = rows.join(cut, "node", "left").where("left is null or left <> ''")
    text = F.coalesce("left", "text")
    out = out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("left").isNotNull(), F.length("left").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
    return _in_order(out.union(docs.where("doc_id is null").select(COLUMNS)))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked; no document goes. Null texts stay null; an empty table gives an empty result."""
    docs = spread(_plain(docs))
    model = spark.sparkContext.broadcast(secret_scan.train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column=1):
            texts = [None if t is None else t.encode() for t in part.column(1).to_pylist()]
            found = secret_scan.find_secrets(model.value, texts)
            new = [None if t is None else secret_scan.masked(t, s).decode() for t, (_, s) in zip(texts, found, strict=True)]
            size = [len(t) if s else n for t, (_, s), n in zip(new, found, part.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.string()), part.column(2), part.column(3), pa.array(size, pa.int64())], COLUMNS)

    return docs.mapInArrow(run, SCHEMA)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids. Null and empty texts are one piece of the end id; an empty table gives none."""
    return packing.pack(spark, docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("substring dedup", substrings), ("secret scan", secrets), ("packing", packed)]

#: Forests and tokenizers aren't expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark, "pipeline")
    docs = docs_of(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = s.save(stage(spark, docs, sf_dir), str(i))
        if i:
            s.drop(str(i - 1))
    return docs
