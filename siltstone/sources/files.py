"""Readers and writers: whole files, inventories, object stores, compressed literals, results."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, StringType, StructType


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files of up to 2 GB; those of no bytes give no row. For larger ones: ``chunking.file_signatures``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Keys of an inventory: second field of each line at commas, without quotes and spaces; blank and temp- ones aside."""
    key = F.trim(F.regexp_replace(F.get(F.split("value", ","), 1), '"', ""))
    return spark.read.text(path).select(key.alias("key")).where("key is not null and key <> '' and not startswith(key, 'temp-')")


def write_objects(objects: DataFrame, path: str) -> None:
    """Objects by the first two digits of their hash, as their keys are."""
    objects.withColumn("prefix", F.substring("strong_hash", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("prefix")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


LITERALS = StructType().add("data", BinaryType()).add("encoding", StringType())


@arrow_udf(LITERALS)
def compress_literals(x: pa.Array) -> pa.Array:
    """Struct of data and encoding: gzip of what is longer than 1024 bytes, else the bytes as they are and no encoding."""
    out = [None if v is None else {"data": gzip.compress(v, mtime=0), "encoding": "gzip"} if len(v) > 1024 else {"data": v, "encoding": None} for v in x.to_pylist()]
    return pa.array(out, pa.struct([("data", pa.binary()), ("encoding", pa.string())]))


@arrow_udf(BinaryType())
def decompress_literals(x: pa.Array, encoding: pa.Array) -> pa.Array:
    """By the encoding that came with the data, never by its first bytes."""
    return pa.array([gzip.decompress(v) if v is not None and e == "gzip" else v for v, e in zip(x.to_pylist(), encoding.to_pylist(), strict=True)], pa.binary())


def download(content: DataFrame, column: str = "content") -> DataFrame:
    """Content as the text that a JSON answer holds, in one line."""
    return content.withColumn(column, F.regexp_replace(F.base64(column), "\r\n", ""))


def write_files(chunks: DataFrame, key: str, index: str, piece: str, folder: str) -> DataFrame:
    """Writes each key's pieces in order as one file below a folder, and gives key, bytes, sha256.

    A task streams its keys' pieces to disk, sorted, so a file of any size needs the memory of one batch. Files are
    written under another name first: a task that runs again leaves the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = fs.FileSystem.from_uri(folder) if ":" in folder.split("/", 1)[0] else (fs.LocalFileSystem(), folder)
        now, out, h, n, draft = None, None, None, 0, None

        def close():
            out.close()
            target = f"{where}/{now}"
            store.create_dir(target.rsplit("/", 1)[0], recursive=True)
            store.move(draft, target)
            return pa.RecordBatch.from_pydict({"key": [str(now)], "bytes": pa.array([n], pa.int64()), "sha256": [h.hexdigest()]})

        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now:
                    if out is not None:
                        yield close()
                    store.create_dir(where, recursive=True)
                    now, h, n, draft = k, sha256(), 0, f"{where}/_draft-{uuid.uuid4().hex}"
                    out = store.open_output_stream(draft)
                out.write(data)
                h.update(data)
                n += len(data)
        if out is not None:
            yield close()

    rows = chunks.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key), index, piece)
    return rows.repartition(key).sortWithinPartitions(key, index).select(key, piece).mapInArrow(run, "key string, bytes long, sha256 string")
