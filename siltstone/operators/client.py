"""Client-side state: three-way classification, session folds, cache trimming, journals, event queues, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ATTEMPTS, BATCH = 5, 50


def classify(local: Column, base: Column, server: Column, push: Column | None = None, pull: Column | None = None) -> Column:
    """What to do with a file: a side has changed if its hash is known and isn't the base's."""
    push, pull = F.lit(False) if push is None else push, F.lit(False) if pull is None else pull
    ours = local.isNotNull() & ~local.eqNullSafe(base)
    theirs = server.isNotNull() & ~server.eqNullSafe(base)
    same = F.coalesce(local == server, F.lit(False))
    return (
        F.when(~ours & ~theirs, "skipped").when(same, "skipped").when(ours & ~theirs, "push").when(~ours & theirs, "pull")
        .when(push, "push").when(pull, "pull").otherwise("conflict")
    )


def sync_plan(local: DataFrame, cache: DataFrame, server: DataFrame, push: Column | None = None, pull: Column | None = None) -> DataFrame:
    """``local(path, local_hash)``, ``cache(path, base_hash)``, ``server(path, server_hash)`` -> path, the three hashes, action.

    A path that any of them has gets a row; a server that can't be reached has no rows, which is: unchanged.
    """
    both = local.join(cache, "path", "full_outer").join(server, "path", "full_outer")
    return both.select("path", "local_hash", "base_hash", "server_hash", classify(F.col("local_hash"), F.col("base_hash"), F.col("server_hash"), push, pull).alias("action"))


def changed_files(local: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose hash isn't the one they had when last pushed."""
    return local.join(cache.select("path", F.col("base_hash").alias("local_hash")), ["path", "local_hash"], "left_anti")


def status_listing(remote: DataFrame, cache: DataFrame) -> DataFrame:
    """``remote(path, total_size)`` with the version the client has: v3, or (not pulled)."""
    shown = F.coalesce(F.concat(F.lit("v"), F.col("server_version").cast("string")), F.lit("(not pulled)"))
    return remote.join(cache.select("path", "server_version"), "path", "left").select("path", shown.alias("local_version"), "total_size")


def upload_places(missing: DataFrame, signatures: DataFrame) -> DataFrame:
    """Where the bytes of each missing hash are: its first signature. A hash without one has an error."""
    first = signatures.groupBy("strong_hash").agg(F.min_by(F.struct("offset", "length"), "block_index").alias("s"))
    out = missing.join(first, "strong_hash", "left").select("strong_hash", "s.offset", "s.length", F.col("s").isNull().alias("_lost"))
    return out.withColumn("error", F.when(F.col("_lost"), F.concat(F.lit("Hash mismatch for chunk "), F.col("strong_hash")))).drop("_lost")


def open_session(sessions: DataFrame, key: str = "root_path") -> DataFrame:
    """The session to resume of each root: the one last updated that is neither completed nor aborted."""
    live = sessions.where("state not in ('completed', 'aborted')")
    return live.groupBy(key).agg(F.max_by("session_id", F.struct("updated_at", "session_id")).alias("session_id"))


def update_sessions(sessions: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """Sets the state; counters that a change leaves out stay."""
    counters = ["total_files", "completed_files", "total_bytes", "transferred_bytes"]
    new = changes.select("session_id", F.col("state").alias("_state"), *(F.col(c).alias(f"_{c}") for c in counters))
    out = sessions.join(new, "session_id", "left")
    touched = F.col("_state").isNotNull()
    return out.select(*[
        F.coalesce(f"_{c}", c).alias(c) if c in [*counters, "state"] else F.when(touched, at).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in sessions.columns
    ])


def journal_upsert(journal: DataFrame, changes: DataFrame) -> DataFrame:
    """``(negotiation_id, strong_hash, status)``: the changes' status wins; each pair once in them."""
    return journal.join(changes.select("negotiation_id", "strong_hash"), ["negotiation_id", "strong_hash"], "left_anti").unionByName(changes)


def journal_clear(journal: DataFrame, negotiations: DataFrame) -> DataFrame:
    return journal.join(negotiations.select("negotiation_id"), "negotiation_id", "left_anti")


def api_users(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """``requests(request_id, header)`` -> request_id, user_id: by the hash of a bearer key that isn't revoked, else null."""
    from siltstone.functions.scalars import api_key_hash

    key = F.when(F.col("header").startswith("Bearer "), F.nullif(F.trim(F.substring("header", 8, 1 << 20)), F.lit("")))
    live = keys.where("revoked_at is null").groupBy("key_hash").agg(F.min("user_id").alias("user_id"))
    return requests.withColumn("key_hash", api_key_hash(key)).join(live, "key_hash", "left").select("request_id", "user_id")


def session_fold(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last state of session files: hash and negotiation keep the last known, counters the last above 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = events.withColumn("_r", last)
    for c in ("content_hash", "negotiation_id"):
        out = out.withColumn(c, F.last(c, ignorenulls=True).over(whole))
    for c in ("file_size", "total_chunks", "uploaded_chunks"):
        out = out.withColumn(c, F.coalesce(F.last(F.when(F.col(c) > 0, F.col(c)), ignorenulls=True).over(whole), F.lit(0).cast(events.schema[c].dataType)))
    return out.where("_r = 1").drop("_r")


def trim_cache(cache: DataFrame, existing: DataFrame, most: int) -> DataFrame:
    """Entries of files that exist, the ``most`` last accessed (ties by path)."""
    live = cache.join(existing.select("path"), "path", "left_semi")
    return live.orderBy(F.desc("last_accessed"), "path").limit(most)


def remaining(missing: DataFrame, journal: DataFrame) -> DataFrame:
    return missing.join(journal.where("status = 'completed'").select("strong_hash"), "strong_hash", "left_anti")


def outbox_batch(events: DataFrame, size: int = BATCH) -> DataFrame:
    return events.where(f"processed_at is null and attempts <= {MOST_ATTEMPTS}").orderBy("created_at", "id").limit(size)


def outbox_transition(events: DataFrame, ok: Column, error: Column, now: Column) -> DataFrame:
    """After a try: success sets processed_at; failure counts, and the fifth sends the event to the dead letters."""
    tries = F.col("attempts") + F.when(ok, 0).otherwise(1)
    dead = ~ok & (tries >= MOST_ATTEMPTS)
    return events.select(
        *[c for c in events.columns if c not in ("attempts", "processed_at", "last_error")],
        tries.alias("attempts"), F.when(ok | dead, now).otherwise(F.col("processed_at")).alias("processed_at"),
        F.when(dead, F.concat(F.lit(f"[DLQ] Exceeded {MOST_ATTEMPTS} attempts: "), error)).when(~ok, error).otherwise(F.col("last_error")).alias("last_error"),
    )


def routing(total_blocks: Column) -> Column:
    return F.when(total_blocks > 2000, "heavy").otherwise("fast")


def totals(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Sums over a user's files' jobs. total_files_joined counts a file once for each job; total_files once."""
    j = files.join(jobs, "file_id", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return j.groupBy("user_id").agg(zero("bytes_transferred").alias("bytes_transferred"), zero("bytes_saved").alias("bytes_saved"), F.count("file_id").alias("total_files_joined"), F.countDistinct("file_id").alias("total_files"))


def daily(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(F.date_trunc("day", "started_at").cast("date").alias("day")).agg(F.sum("bytes_transferred").alias("bytes_transferred"), F.sum("bytes_saved").alias("bytes_saved"))


def transfer_ratio(saved: Column, transferred: Column) -> Column:
    """Percent saved, halves up; 0 where nothing moved."""
    whole = saved + transferred
    return F.when(whole > 0, F.floor(saved / whole * 100 + 0.5)).otherwise(0).cast("long")


def recent_with_path(jobs: DataFrame, files: DataFrame, most: int = 10) -> DataFrame:
    """The jobs last started, with their file's path; null where the file is gone."""
    return page(jobs, 1, most, "started_at", "job_id").join(files.select("file_id", "path"), "file_id", "left")


def pushed_percent(saved: Column, size: Column) -> Column:
    """Percent of a pushed file's bytes that weren't sent, halves up; 0 for an empty file."""
    return F.when(size > 0, F.floor(saved / size * 100 + 0.5)).otherwise(0).cast("long")


def benchmark_metrics(results: DataFrame) -> DataFrame:
    """``results(workload, strategy, transfer_bytes, time_ms)``: bandwidth and time saved against the workload's ``full`` row."""
    from siltstone.functions.scalars import percent

    full = results.where("strategy = 'full'").select("workload", F.col("transfer_bytes").alias("_b"), F.col("time_ms").alias("_t"))
    out = results.join(full, "workload", "left")
    rest = F.col("strategy") != "full"
    out = out.withColumn("bw_saved", F.when(rest, percent(F.col("_b") - F.col("transfer_bytes"), F.col("_b"))))
    return out.withColumn("time_saved", F.when(rest, percent(F.col("_t") - F.col("time_ms"), F.col("_t")))).drop("_b", "_t")


def page(df: DataFrame, number: int, size: int, at: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(at), key).offset((number - 1) * size).limit(size)


def job_cleanup(jobs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Jobs that stay: unfinished, or finished in the last days."""
    return jobs.where(F.col("finished_at").isNull() | ~(F.unix_millis("finished_at") < F.unix_millis(as_of) - days * 86_400_000))
