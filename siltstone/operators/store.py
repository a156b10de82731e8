"""Stores of chunks and versions: negotiation, reference counts, retention, verification, collection, commits.

State goes in and comes out as DataFrames; times are arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRACE_MS, KEEP_VERSIONS, SWEEP_LIMIT, FAILURE_HASHES = 24 * 3600 * 1000, 10, 1000, 100


def missing_chunks(chunks: DataFrame, *known: DataFrame) -> DataFrame:
    """Distinct hashes of ``chunks(strong_hash, block_index)`` that none of the tables has, with the first index."""
    first = chunks.groupBy("strong_hash").agg(F.min("block_index").alias("block_index"))
    for k in known:
        first = first.join(k.select("strong_hash"), "strong_hash", "left_anti")
    return first


def negotiation_counts(chunks: DataFrame, missing: DataFrame) -> DataFrame:
    """total_chunks, missing_chunks and existing_chunks = occurrences - distinct missing (units mixed on purpose)."""
    total, lost = chunks.agg(F.count("*").alias("total_chunks")), missing.agg(F.count("*").alias("missing_chunks"))
    return total.join(lost, how="cross").withColumn("existing_chunks", F.col("total_chunks") - F.col("missing_chunks"))


def legacy_accounting(ops: DataFrame, key: str) -> DataFrame:
    """Bytes moved by uploaded ops: those of their literals."""
    return ops.groupBy(key).agg(F.sum(F.when(F.col("kind") == "literal", F.col("length")).otherwise(0)).cast("long").alias("bytes_transferred"))


def commit_accounting(chunks: DataFrame, missing: DataFrame, key: str) -> DataFrame:
    """bytes_transferred sums every occurrence of a missing hash; bytes_saved is what is left of the size."""
    marked = chunks.join(missing.select("strong_hash", F.lit(True).alias("gone")), "strong_hash", "left")
    out = marked.groupBy(key).agg(F.sum("length").alias("new_size"), F.sum(F.when(F.col("gone"), F.col("length")).otherwise(0)).alias("bytes_transferred"))
    return out.withColumn("bytes_saved", F.greatest(F.lit(0).cast("long"), F.col("new_size") - F.col("bytes_transferred")))


def reference_counts(chunks: DataFrame) -> DataFrame:
    """One reference for each occurrence; size of the first sighting (by version, then place), last time referenced."""
    return chunks.groupBy("strong_hash").agg(F.count("*").alias("ref_count"), F.min_by("length", F.struct("version", "block_index")).alias("byte_size"), F.max("created_at").alias("last_referenced_at"))


def register(cas: DataFrame, hashes: DataFrame, at: Column) -> DataFrame:
    """Adds occurrences ``hashes(strong_hash, byte_size)`` to ``cas(strong_hash, ref_count, byte_size, first_seen_at, last_referenced_at)``."""
    new = hashes.groupBy("strong_hash").agg(F.count("*").alias("n"), F.first("byte_size").alias("size"))
    j = cas.join(new, "strong_hash", "full_outer")
    return j.select(
        "strong_hash", (F.coalesce("ref_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("ref_count"), F.coalesce("byte_size", "size").alias("byte_size"),
        F.coalesce("first_seen_at", at).alias("first_seen_at"), F.when(F.col("n").isNotNull(), at).otherwise(F.col("last_referenced_at")).alias("last_referenced_at"),
    )


def dereference(cas: DataFrame, hashes: DataFrame, at: Column) -> DataFrame:
    """One reference less for each occurrence, never under 0. The time is renewed, which starts the grace period anew."""
    gone = hashes.groupBy("strong_hash").agg(F.count("*").alias("n"))
    out = cas.join(gone, "strong_hash", "left").withColumn("ref_count", F.greatest(F.lit(0).cast("long"), F.col("ref_count") - F.coalesce("n", F.lit(0))))
    return out.withColumn("last_referenced_at", F.when(F.col("n").isNotNull(), at).otherwise(F.col("last_referenced_at"))).drop("n")


def sweepable(cas: DataFrame, as_of: Column, grace_ms: int = GRACE_MS, limit: int = SWEEP_LIMIT) -> DataFrame:
    """Unreferenced chunks whose grace is over, oldest first."""
    old = F.unix_millis("last_referenced_at") <= F.unix_millis(as_of) - grace_ms
    return cas.where((F.col("ref_count") <= 0) & old).orderBy("last_referenced_at", "strong_hash").limit(limit)


def next_version(files: DataFrame, versions: DataFrame) -> DataFrame:
    top = versions.groupBy("file_id").agg(F.max("version_no").alias("v"))
    return files.select("file_id").join(top, "file_id", "left").select("file_id", (F.coalesce("v", F.lit(0)) + 1).alias("next_version"))


def latest_version(versions: DataFrame) -> DataFrame:
    row = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("version_no")))
    return versions.withColumn("_r", row).where("_r = 1").drop("_r")


def specific_version(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """The versions that ``asked(file_id, version_no)`` names."""
    return versions.join(asked.select("file_id", "version_no"), ["file_id", "version_no"], "left_semi")


def current_version(files: DataFrame, versions: DataFrame) -> DataFrame:
    """By the file's pointer, which needn't be the largest number."""
    return files.select("file_id", F.col("current_version_id").alias("version_id")).join(versions, ["file_id", "version_id"])


def user_files(files: DataFrame, user_id) -> DataFrame:
    """A user's files, newest first (ties by path)."""
    return files.where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), "path")


def among(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose column is in the first column of a table."""
    return df.join(values.select(F.col(values.columns[0]).alias(column)), column, "left_semi")


def signatures_read(files: DataFrame, versions: DataFrame, manifests: DataFrame, blocks: DataFrame) -> DataFrame:
    """Signatures of each file's current version: file_id, version_no, block_size and the chunk rows. Files without one give none."""
    now = current_version(files, versions)
    return now.select("file_id", "version_id", "version_no", "block_size").join(version_chunks(now, among(manifests, "version_id", now.select("version_id")), blocks), "version_id")


def prunable(versions: DataFrame, files: DataFrame, keep: int = KEEP_VERSIONS) -> DataFrame:
    """Versions beyond the newest ``keep`` of a file, but for the current one."""
    row = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("version_no")))
    v = versions.withColumn("_r", row).join(files.select("file_id", "current_version_id"), "file_id", "left")
    return v.where((F.col("_r") > keep) & ~F.col("version_id").eqNullSafe(F.col("current_version_id"))).drop("_r", "current_version_id")


def prune(versions: DataFrame, files: DataFrame, chunks: DataFrame, cas: DataFrame, at: Column, keep: int = KEEP_VERSIONS) -> dict[str, DataFrame]:
    """Deletes the prunable versions with their chunk rows, and takes a reference off for each occurrence in them."""
    gone = prunable(versions, files, keep).select("version_id")
    lost = among(chunks, "version_id", gone)
    return {"versions": versions.join(gone, "version_id", "left_anti"), "chunks": chunks.join(gone, "version_id", "left_anti"), "cas": dereference(cas, lost, at), "pruned": gone}


def delete_file_chunks(cas: DataFrame, hashes: DataFrame, at: Column, batch: int = SWEEP_LIMIT) -> dict[str, DataFrame]:
    """After a file is deleted: references of its ``hashes(strong_hash, position)`` go, and so do the objects, in batches."""
    from .chunking import object_key

    return {"cas": dereference(cas, hashes, at), "deletes": hashes.select(object_key(F.col("strong_hash")).alias("key"), F.floor(F.col("position") / batch).alias("batch"))}


def collect_garbage(cas: DataFrame, at: Column, run_id: Column, inventory: DataFrame | None = None, references: DataFrame | None = None, grace_ms: int = GRACE_MS, limit: int = SWEEP_LIMIT) -> dict[str, DataFrame]:
    """A run of the collector: unreferenced chunks whose grace is over, then, with an inventory, its orphans.

    deleted: key, phase; cas: without the swept rows; run: one row with status and deleted_count, an object counted in
    each phase that deletes it.
    """
    from .chunking import object_key

    swept = sweepable(cas, at, grace_ms, limit).select("strong_hash")
    deleted = swept.select(object_key(F.col("strong_hash")).alias("key"), F.lit("sweep").alias("phase"))
    if inventory is not None:
        deleted = deleted.union(orphans(inventory, references).select("key", F.lit("inventory")))
    run = deleted.agg(F.count("*").alias("deleted_count")).select(run_id.alias("run_id"), F.lit("completed").alias("status"), "deleted_count", at.alias("finished_at"), F.lit(None).cast("string").alias("error"))
    return {"deleted": deleted, "cas": cas.join(swept, "strong_hash", "left_anti"), "run": run}


def begin_run(run_id: Column, at: Column, spark) -> DataFrame:
    return spark.range(1).select(run_id.alias("run_id"), F.lit("running").alias("status"), at.alias("started_at"))


def failed_run(run: DataFrame, at: Column, error: Column) -> DataFrame:
    return run.withColumns({"status": F.lit("failed"), "error": error, "finished_at": at})


def reference_set(*sources: DataFrame) -> DataFrame:
    out = sources[0].select("strong_hash")
    for s in sources[1:]:
        out = out.union(s.select("strong_hash"))
    return out.distinct()


def base_name(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)


def orphans(inventory: DataFrame, references: DataFrame) -> DataFrame:
    """Inventory keys whose last part no reference has; temporary and blank ones aside."""
    keys = inventory.where("key <> '' and not startswith(key, 'temp-')").withColumn("strong_hash", base_name(F.col("key")))
    return keys.join(references.select("strong_hash"), "strong_hash", "left_anti").select("key", "strong_hash")


def verification(versions: DataFrame, chunks: DataFrame, objects: DataFrame) -> DataFrame:
    """version_id, status, n_missing, missing (at most 100, in order) by distinct hashes that the objects lack."""
    lost = chunks.select("version_id", "strong_hash").distinct().join(objects.select("strong_hash"), "strong_hash", "left_anti")
    row = F.row_number().over(Window.partitionBy("version_id").orderBy("strong_hash"))
    lost = lost.withColumn("r", row).groupBy("version_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("r") <= FAILURE_HASHES, F.col("strong_hash")))).alias("missing"))
    out = versions.select("version_id").join(lost, "version_id", "left")
    return out.select("version_id", F.when(F.col("n") > 0, "corrupted").otherwise("verified").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n_missing"), "missing")


def verification_events(found: DataFrame, totals: DataFrame, versions: DataFrame, at: Column) -> dict[str, DataFrame]:
    """What ``verification`` found, applied: versions with their status, and an event for each corrupted one.

    ``totals(version_id, total_hashes)``; payload: JSON of versionId, fileId, missingHashes, totalHashes, missingCount.
    """
    status = found.select("version_id", F.col("status").alias("_s"))
    v = versions.join(status, "version_id", "left").withColumn("verification_status", F.coalesce("_s", "verification_status")).drop("_s")
    bad = found.where("status = 'corrupted'").join(totals, "version_id", "left").join(versions.select("version_id", "file_id"), "version_id")
    body = F.to_json(F.struct(F.col("version_id").alias("versionId"), F.col("file_id").alias("fileId"), F.col("missing").alias("missingHashes"), F.col("total_hashes").alias("totalHashes"), F.col("n_missing").alias("missingCount")))
    return {"versions": v, "events": bad.select(F.col("version_id").alias("aggregate_id"), F.lit("CHUNK_VERIFICATION_FAILED").alias("event_type"), body.alias("payload"), at.alias("created_at"))}


def download_status(status: Column, force: Column) -> Column:
    return F.when(status == "corrupted", 409).when((status == "pending") & ~force, 202).otherwise(200)


def reuse_map(chunks: DataFrame) -> DataFrame:
    """``chunks(file_id, version_no, block_index, strong_hash, ...)``, reused: whether the next older version has the hash."""
    order = chunks.select("file_id", "version_no").distinct()
    order = order.withColumn("older", F.lag("version_no").over(Window.partitionBy("file_id").orderBy("version_no")))
    had = chunks.select("file_id", F.col("version_no").alias("older"), "strong_hash", F.lit(True).alias("had")).distinct()
    return chunks.join(order, ["file_id", "version_no"]).join(had, ["file_id", "older", "strong_hash"], "left").withColumn("reused", F.coalesce("had", F.lit(False))).drop("older", "had")


def hash_pages(hashes: DataFrame, key: str, size: int = 10_000) -> DataFrame:
    """Distinct hashes of each key in order of first sight, dealt to pages."""
    first = hashes.groupBy(key, "strong_hash").agg(F.min("block_index").alias("first_index"))
    row = F.row_number().over(Window.partitionBy(key).orderBy("first_index"))
    return first.select(key, "strong_hash", "first_index", F.floor((row - 1) / size).cast("long").alias("page"))


def version_chunks(versions: DataFrame, manifests: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chunk rows of versions: those of a manifest, else of legacy blocks with offsets by block size."""
    cols = ["version_id", "block_index", "offset", "length", "weak_hash", "strong_hash"]
    rest = versions.join(manifests.select("version_id").distinct(), "version_id", "left_anti").join(blocks, "version_id")
    offset = F.col("block_index").cast("long") * F.col("block_size")
    rest = rest.withColumn("offset", offset).withColumn("length", F.least(F.col("block_size").cast("long"), F.col("size") - offset))
    return manifests.select(cols).unionByName(rest.select(cols))


def reconstruct(chunks: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """Content of each version from stored objects; error names a hash that lacks or doesn't match its object."""
    from .delta import joined

    o = chunks.join(objects.select("strong_hash", "bytes"), "strong_hash", "left")
    bad = F.when(F.col("bytes").isNull(), "NOT_FOUND").when(F.sha2("bytes", 256) != F.col("strong_hash"), "CORRUPT_BLOCK")
    o = o.withColumn("error", bad)
    errors = o.groupBy(key).agg(F.max("error").alias("error"))
    return joined(o, key, "block_index", "bytes").join(errors, key).select(key, F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error")


def chunk_manifest(chunks: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Manifest rows of listed chunks: running offsets, weak hash 0 where none is given, and an ``error`` on every row of a
    version whose lengths don't add up to ``sizes(key, new_size)``."""
    from .delta import running_offset

    total = F.coalesce(F.sum("length").over(Window.partitionBy(key)), F.lit(0))
    rows = chunks.join(sizes, key).withColumn("offset", running_offset(key)).withColumn("weak_hash", F.coalesce("weak_hash", F.lit(0).cast("long")))
    wrong = F.concat(F.lit("Reconstructed size "), total.cast("string"), F.lit(" does not match newSize "), F.col("new_size").cast("string"))
    return rows.withColumn("error", F.when(total != F.col("new_size"), wrong)).drop("new_size")


def request_error(path: Column, chunking: Column, block_size: Column, new_size: Column, digest: Column, n_chunks: Column) -> Column:
    """The first field of a negotiation that is out of its limits; null where all are fine."""
    from siltstone.functions.scalars import path_is_valid

    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    return (
        F.when(~path_is_valid(path), "path").when(chunking.isNotNull() & ~chunking.isin("cdc", "fixed"), "chunking")
        .when(bad(block_size.between(256, 1 << 20)), "blockSize").when(bad(new_size >= 0), "newSize")
        .when(bad(F.length(digest) == 64), "contentSha256").when(bad(n_chunks.between(0, 10_000_000)), "chunks")
    )


def chunk_error(strong_hash: Column, length: Column) -> Column:
    return F.when(~F.coalesce(F.length(strong_hash) == 64, F.lit(False)), "strongHash").when(~F.coalesce(length.between(1, 4 << 20), F.lit(False)), "length")


def upload_error(encoding: Column, content_length: Column, op_count: Column, n_ops: Column, new_size: Column) -> Column:
    """Why an upload is refused: too large, an op count that is missing or wrong, or no ops for a file that has bytes."""
    binary = encoding.isin("bin", "flatbuf")
    return (
        F.when(content_length > 500 << 20, "Payload too large").when(binary & op_count.isNull(), "opCount required when opsEncoding is bin/flatbuf")
        .when(binary & (op_count != n_ops), F.concat(F.lit("opCount "), op_count.cast("string"), F.lit(" does not match decoded ops ("), n_ops.cast("string"), F.lit(")")))
        .when(~binary & (n_ops.isNull() | ((n_ops == 0) & (new_size > 0))), "ops array required when opsEncoding is json")
    )


TTL_MS = 60 * 60 * 1000


def put_negotiations(state: DataFrame, new: DataFrame, at: Column, ttl_ms: int = TTL_MS) -> DataFrame:
    """Adds negotiations, or renews those of the same id but for their user; they expire after the time to live."""
    new = new.withColumn("expires_at", F.timestamp_millis(F.unix_millis(at) + ttl_ms))
    old = state.select("id", F.col("user_id").alias("_user"))
    return state.join(new.select("id"), "id", "left_anti").unionByName(new.join(old, "id", "left").withColumn("user_id", F.coalesce("_user", "user_id")).drop("_user"))


def live_negotiations(state: DataFrame, at: Column) -> DataFrame:
    """Those that haven't expired: what a read sees, and what a clean-up leaves."""
    return state.where(F.col("expires_at") >= at)


def clear_negotiations(state: DataFrame, ids: DataFrame) -> DataFrame:
    return state.join(ids.select("id"), "id", "left_anti")


def expired(sessions: DataFrame, at: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") < at)


def stored(objects: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(strong_hash)`` with whether each is stored."""
    have = objects.select("strong_hash", F.lit(True).alias("_have")).distinct()
    return asked.join(have, "strong_hash", "left").withColumn("stored", F.coalesce("_have", F.lit(False))).drop("_have")


def delete_objects(objects: DataFrame, gone: DataFrame) -> DataFrame:
    """What is left of the objects."""
    return objects.join(gone.select("strong_hash"), "strong_hash", "left_anti")


def put_objects(objects: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new(strong_hash, bytes)`` to append: hashes match and aren't stored yet."""
    return new.where(F.sha2("bytes", 256) == F.col("strong_hash")).dropDuplicates(["strong_hash"]).join(objects.select("strong_hash"), "strong_hash", "left_anti")


def commit(files: DataFrame, versions: DataFrame, cas: DataFrame, negotiation: DataFrame, chunks: DataFrame, at: Column) -> dict[str, DataFrame]:
    """Commits ``negotiation(file_id, snapshot_version_id, version_id, size, content_sha256)``, a row a file.

    A file whose pointer isn't the snapshot's (null-safe) is stale and in ``rejected``. Gives the new files, versions,
    jobs, events and cas; chunks: version_id, strong_hash, length of all occurrences.
    """
    n = negotiation.join(files, "file_id", "left")
    fine = F.col("current_version_id").eqNullSafe(F.col("snapshot_version_id"))
    good = n.where(fine).join(next_version(n, versions), "file_id")
    rows = good.select("file_id", "version_id", F.col("next_version").alias("version_no"), "size", "content_sha256", F.lit("pending").alias("verification_status"), at.alias("created_at"))
    pointer = good.select("file_id", F.col("version_id").alias("v"), F.col("size").alias("s"))
    moved = files.join(pointer, "file_id", "full_outer").select("file_id", F.coalesce("v", "current_version_id").alias("current_version_id"), F.coalesce("s", "total_size").alias("total_size"))
    own = chunks.join(good.select("version_id"), "version_id", "left_semi")
    return {
        "rejected": n.where(~fine).select("file_id"),
        "versions": versions.unionByName(rows, allowMissingColumns=True),
        "files": moved,
        "jobs": good.select("file_id", F.lit("push").alias("direction"), F.lit("done").alias("status"), at.alias("finished_at")),
        "events": good.select(F.col("version_id").alias("aggregate_id"), F.lit("FILE_VERSION_CREATED").alias("event_type"), F.to_json(F.struct("version_id", "file_id", "size")).alias("payload"), at.alias("created_at")),
        "cas": register(cas, own.select("strong_hash", F.col("length").alias("byte_size")), at),
    }


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest row of each key wins; rows of ``state`` are older than all changes."""
    both = state.withColumn("_o", F.lit(None).cast(changes.schema[order].dataType)).unionByName(changes.withColumn("_o", F.col(order)), allowMissingColumns=True)
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("_o")))
    return both.withColumn("_r", row).where("_r = 1").drop("_r", "_o")
