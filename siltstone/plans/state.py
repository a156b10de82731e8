"""Queries over sessions, requests, negotiations, keys and runs of the collector, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import scalars
from siltstone.operators import chunking, client, store
from siltstone.plans.base import AS_OF, CH, JOBS, VERSIONS, chunks, dealt_docs, jobs, query, table, versions
from siltstone.sources import files



def _now():
    return F.lit(AS_OF).cast("timestamp")


_HALVES = CH + ", old AS (SELECT * FROM ch WHERE doc_id % 2 = 0), new AS (SELECT * FROM ch WHERE doc_id % 2 = 1)"


# ---- lookups ---------------------------------------------------------------------------------------


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 7 = 3")
def user_files(spark, d):
    f = table(spark, d, "documents").select("doc_id", "source", "n_chars", (F.col("doc_id") % 7).alias("user_id"), F.col("source").alias("path"), F.col("doc_id").alias("created_at"))
    return store.user_files(f, 3).select("doc_id", "source", "n_chars")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def files_among(spark, d):
    return store.among(table(spark, d, "documents").select("doc_id", "source"), "doc_id", table(spark, d, "labels").where("quality = 0").select("doc_id"))


@query(f"""WITH {CH}, {VERSIONS} SELECT versions.file_id, version_no, version_id, block_index, "offset", length, strong_hash FROM ch JOIN versions ON doc_id = version_id WHERE version_no = 2""")
def signatures_read(spark, d):
    v = versions(spark, d).withColumn("block_size", F.lit(1024))
    f = v.where("version_no = 2").select("file_id", F.col("version_id").alias("current_version_id"))
    c = chunks(spark, d).withColumnRenamed("doc_id", "version_id").withColumn("weak_hash", F.lit(0).cast("long")).drop("file_id")
    out = store.signatures_read(f, v, c.where("version_id % 2 = 0"), c.where("version_id % 2 = 1").select("version_id", "block_index", "weak_hash", "strong_hash"))
    return out.select("file_id", "version_no", "version_id", "block_index", "offset", "length", "strong_hash")


_REQUEST = """SELECT page_id, CASE page_id % 9 WHEN 0 THEN '/abs' ELSE 'docs/' || page_id END AS path, CASE page_id % 8 WHEN 0 THEN 'other' WHEN 1 THEN NULL ELSE 'cdc' END AS chunking, CAST(page_id * 13 % 5000 AS BIGINT) AS block_size,
  CAST(page_id % 11 - 1 AS BIGINT) AS new_size, substr('0123456789abcdef0123456789abcdef0123456789abcdef0123456789abcdef', 1, CAST(CASE WHEN page_id % 10 = 0 THEN 63 ELSE 64 END AS INTEGER)) AS digest, CAST(page_id % 13 * 900000 AS BIGINT) AS n_chunks FROM pages"""


@query(f"""SELECT page_id, CASE WHEN starts_with(path, '/') THEN 'path' WHEN chunking = 'other' THEN 'chunking' WHEN block_size NOT BETWEEN 256 AND 1048576 THEN 'blockSize' WHEN new_size < 0 THEN 'newSize'
  WHEN length(digest) <> 64 THEN 'contentSha256' WHEN n_chunks > 10000000 THEN 'chunks' END AS error FROM ({_REQUEST})""")
def request_errors(spark, d):
    r = spark.sql(_REQUEST.replace("FROM pages", "FROM {pages}"), pages=table(spark, d, "pages"))
    return r.select("page_id", store.request_error(*(F.col(c) for c in ("path", "chunking", "block_size", "new_size", "digest", "n_chunks"))).alias("error"))


@query("""SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'Payload too large' WHEN event_id % 3 < 2 AND event_id % 5 = 0 THEN 'opCount required when opsEncoding is bin/flatbuf'
  WHEN event_id % 3 < 2 AND event_id % 7 <> event_id % 6 THEN 'opCount ' || event_id % 7 || ' does not match decoded ops (' || event_id % 6 || ')' WHEN event_id % 3 = 2 AND event_id % 6 = 0 AND event_id % 4 > 0 THEN 'ops array required when opsEncoding is json' END AS error FROM events""")
def upload_errors(spark, d):
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "bin").when(i % 3 == 1, "flatbuf").otherwise("json")
    size = F.when(i % 23 == 0, (500 << 20) + 1).otherwise(500 << 20)
    return table(spark, d, "events").select("event_id", store.upload_error(kind, size, F.when(i % 5 != 0, i % 7), i % 6, i % 4).alias("error"))


@query("""WITH k AS (SELECT sha256('dks_' || c_custkey) AS h, c_custkey % 50 AS user_id FROM customer WHERE c_custkey % 3 <> 0), r AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'dks_' || user_id WHEN event_id % 5 = 1 THEN 'Bearer ' ELSE 'Bearer  dks_' || user_id || ' ' END AS header FROM events)
SELECT event_id AS request_id, min(user_id) AS user_id FROM r LEFT JOIN k ON event_id % 5 > 1 AND h = sha256(trim(substr(header, 8))) GROUP BY 1""")
def api_users(spark, d):
    keys = table(spark, d, "customer").select(F.sha2(F.concat(F.lit("dks_"), F.col("c_custkey").cast("string")), 256).alias("key_hash"), (F.col("c_custkey") % 50).alias("user_id"), F.when(F.col("c_custkey") % 3 == 0, F.lit(1)).alias("revoked_at"))
    i, key = F.col("event_id"), F.concat(F.lit("dks_"), F.col("user_id").cast("string"))
    header = F.when(i % 5 == 0, key).when(i % 5 == 1, "Bearer ").otherwise(F.concat(F.lit("Bearer  "), key, F.lit(" ")))
    return client.api_users(table(spark, d, "events").select(i.alias("request_id"), header.alias("header")), keys)


@query("""WITH k AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'dks_' || substr(sha256(props), 1, 43) WHEN 1 THEN 'dks_' || substr(sha256(props), 1, 32) WHEN 2 THEN 'dks_' || substr(sha256(props), 1, 41) || '-_' ELSE 'key_' || substr(sha256(props), 1, 43) END AS k FROM events)
SELECT event_id, event_id % 2 = 0 AS valid, CASE WHEN event_id % 2 = 0 THEN substr(k, 1, 12) END AS prefix, sha256(k) AS key_hash FROM k""")
def api_keys(spark, d):
    i, h = F.col("event_id") % 4, F.sha2("props", 256)
    k = F.when(i == 0, F.concat(F.lit("dks_"), F.substring(h, 1, 43))).when(i == 1, F.concat(F.lit("dks_"), F.substring(h, 1, 32))).when(i == 2, F.concat(F.lit("dks_"), F.substring(h, 1, 41), F.lit("-_"))).otherwise(F.concat(F.lit("key_"), F.substring(h, 1, 43)))
    return table(spark, d, "events").select("event_id", scalars.api_key_is_valid(k).alias("valid"), scalars.api_key_prefix(k).alias("prefix"), scalars.api_key_hash(k).alias("key_hash"))


@query(f"WITH {VERSIONS} SELECT file_id, version_id, version_no, size FROM versions WHERE version_no = 3")
def specific_version(spark, d):
    v = versions(spark, d)
    return store.specific_version(v, v.select("file_id").distinct().withColumn("version_no", F.lit(3).cast("long"))).select("file_id", "version_id", "version_no", "size")


@query(f"WITH {_HALVES} SELECT DISTINCT strong_hash, strong_hash IN (SELECT strong_hash FROM old) AS stored FROM new")
def objects_stored(spark, d):
    c = chunks(spark, d)
    return store.stored(c.where("doc_id % 2 = 0"), c.where("doc_id % 2 = 1").select("strong_hash").distinct())


@query(f"WITH {_HALVES} SELECT doc_id, block_index, strong_hash FROM old WHERE strong_hash NOT IN (SELECT strong_hash FROM new)")
def objects_left(spark, d):
    c = chunks(spark, d)
    return store.delete_objects(c.where("doc_id % 2 = 0"), c.where("doc_id % 2 = 1")).select("doc_id", "block_index", "strong_hash")


# ---- client ------------------------------------------------------------------------------------------


@query(f"""WITH {JOBS}, r AS (SELECT job_id, file_id, bytes_saved FROM jobs ORDER BY started_at DESC, job_id LIMIT 10) SELECT job_id, bytes_saved, source AS path FROM r LEFT JOIN documents ON file_id = doc_id""")
def recent_jobs_with_path(spark, d):
    f = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("path"))
    return client.recent_with_path(jobs(spark, d), f).select("job_id", "bytes_saved", "path")


_SIDES = """l AS (SELECT doc_id AS path, doc_id % 5 AS local_hash FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id AS path, doc_id % 4 AS base_hash FROM documents WHERE doc_id % 6 <> 0), s AS (SELECT doc_id AS path, doc_id % 3 AS server_hash FROM documents WHERE doc_id % 11 <> 0)"""


def _sides(spark, d):
    i = F.col("doc_id")
    t = table(spark, d, "documents").select("doc_id")
    return tuple(t.where(i % skip != 0).select(i.alias("path"), (i % n).alias(name)) for skip, n, name in ((7, 5, "local_hash"), (6, 4, "base_hash"), (11, 3, "server_hash")))


@query(f"""WITH {_SIDES}, j AS (SELECT * FROM l FULL JOIN b USING (path) FULL JOIN s USING (path)), c AS (SELECT *, local_hash IS NOT NULL AND local_hash IS DISTINCT FROM base_hash AS o, server_hash IS NOT NULL AND server_hash IS DISTINCT FROM base_hash AS t FROM j)
SELECT path, local_hash, base_hash, server_hash, CASE WHEN NOT o AND NOT t THEN 'skipped' WHEN local_hash = server_hash THEN 'skipped' WHEN o AND NOT t THEN 'push' WHEN NOT o AND t THEN 'pull' ELSE 'conflict' END AS action FROM c""")
def sync_plan(spark, d):
    return client.sync_plan(*_sides(spark, d))


@query(f"WITH {_SIDES} SELECT l.path, local_hash FROM l LEFT JOIN b USING (path) WHERE base_hash IS DISTINCT FROM local_hash")
def changed_files(spark, d):
    return client.changed_files(*_sides(spark, d)[:2])


@query("SELECT d.doc_id AS path, CASE WHEN l.doc_id IS NULL THEN '(not pulled)' ELSE 'v' || (l.quality + 1) END AS local_version, n_chars AS total_size FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)")
def status_listing(spark, d):
    cache = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("q")).select(F.col("doc_id").alias("path"), (F.col("q") + 1).alias("server_version"))
    return client.status_listing(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("total_size")), cache)


@query(f"""WITH {_HALVES}, miss AS (SELECT DISTINCT strong_hash FROM new WHERE strong_hash NOT IN (SELECT strong_hash FROM old) UNION ALL SELECT 'none'), f AS (SELECT strong_hash, arg_min("offset", doc_id * 1000 + block_index) AS "offset", arg_min(length, doc_id * 1000 + block_index) AS length FROM new GROUP BY 1)
SELECT strong_hash, "offset", length, CASE WHEN length IS NULL THEN 'Hash mismatch for chunk ' || strong_hash END AS error FROM miss LEFT JOIN f USING (strong_hash)""")
def upload_places(spark, d):
    c = chunks(spark, d)
    new = c.where("doc_id % 2 = 1").withColumn("block_index", F.col("doc_id") * 1000 + F.col("block_index"))
    missing = store.missing_chunks(new, c.where("doc_id % 2 = 0")).select("strong_hash").union(spark.range(1).select(F.lit("none")))
    return client.upload_places(missing, new)


@query("SELECT user_id AS root_path, arg_max(event_id, (ts, event_id)) AS session_id FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1")
def open_sessions(spark, d):
    state = F.when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "click", "aborted").otherwise("uploading")
    return client.open_session(table(spark, d, "events").select(F.col("user_id").alias("root_path"), F.col("event_id").alias("session_id"), state.alias("state"), F.col("ts").alias("updated_at")))


@query("""SELECT c_custkey AS session_id, CASE WHEN c_custkey % 3 = 0 THEN 'done' ELSE 'open' END AS state, CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE c_custkey % 10 END AS total_files, c_custkey % 4 AS completed_files, c_custkey % 5 AS total_bytes,
  CASE WHEN c_custkey % 3 = 0 THEN 7 ELSE c_custkey % 8 END AS transferred_bytes, CASE WHEN c_custkey % 3 = 0 THEN 99 ELSE 0 END AS updated_at FROM customer""")
def session_updates(spark, d):
    i, t = F.col("c_custkey"), table(spark, d, "customer")
    zero = F.lit(0).cast("long")
    s = t.select(i.alias("session_id"), F.lit("open").alias("state"), (i % 10).alias("total_files"), (i % 4).alias("completed_files"), (i % 5).alias("total_bytes"), (i % 8).alias("transferred_bytes"), zero.alias("updated_at"))
    none = F.lit(None).cast("long")
    c = t.where(i % 3 == 0).select(i.alias("session_id"), F.lit("done").alias("state"), F.when(i % 6 == 0, F.lit(1).cast("long")).alias("total_files"), none.alias("completed_files"), none.alias("total_bytes"), F.lit(7).cast("long").alias("transferred_bytes"))
    return client.update_sessions(s, c, F.lit(99).cast("long"))


@query(f"""WITH {CH}, j AS (SELECT DISTINCT file_id AS negotiation_id, strong_hash, 'pending' AS status FROM ch), u AS (SELECT DISTINCT file_id AS negotiation_id, strong_hash, 'completed' AS status FROM ch WHERE block_index % 2 = 0)
SELECT * FROM (SELECT * FROM j WHERE (negotiation_id, strong_hash) NOT IN (SELECT (negotiation_id, strong_hash) FROM u) UNION ALL SELECT * FROM u) WHERE negotiation_id NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 0)""")
def journal_state(spark, d):
    c = chunks(spark, d)
    rows = lambda x, s: x.select(F.col("file_id").alias("negotiation_id"), "strong_hash", F.lit(s).alias("status")).distinct()
    j = client.journal_upsert(rows(c, "pending"), rows(c.where("block_index % 2 = 0"), "completed"))
    return client.journal_clear(j, table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("source").alias("negotiation_id")))


@query("SELECT doc_id, CAST(CASE WHEN n_chars > 0 THEN floor((n_chars - doc_id % 37) / n_chars * 100 + 0.5) ELSE 0 END AS BIGINT) AS percent FROM documents")
def pushed_percent(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", client.pushed_percent(n - F.col("doc_id") % 37, n).alias("percent"))


@query("""WITH r AS (SELECT source AS workload, k AS strategy, CASE k WHEN 'full' THEN n * 1000 WHEN 'fixed' THEN n * 137 ELSE n * 1250 END AS transfer_bytes, CASE k WHEN 'full' THEN 0 ELSE n * 3 END AS time_ms FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1), (SELECT unnest(['full', 'fixed', 'cdc']) AS k))
SELECT workload, strategy, transfer_bytes, time_ms, CASE strategy WHEN 'fixed' THEN '86.3%' WHEN 'cdc' THEN '-25.0%' END AS bw_saved, CASE WHEN strategy <> 'full' THEN '0.0%' END AS time_saved FROM r""")
def benchmark_metrics(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    n = n.select("source", "n", F.explode(F.array(F.lit("full"), F.lit("fixed"), F.lit("cdc"))).alias("strategy"))
    moved = F.col("n") * F.when(F.col("strategy") == "full", 1000).when(F.col("strategy") == "fixed", 137).otherwise(1250)
    return client.benchmark_metrics(n.select(F.col("source").alias("workload"), "strategy", moved.alias("transfer_bytes"), F.when(F.col("strategy") == "full", 0).otherwise(F.col("n") * 3).alias("time_ms")))


# ---- stores ------------------------------------------------------------------------------------------


_KEPT = f"{VERSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY version_no DESC) AS r FROM versions), gone AS (SELECT version_id FROM r WHERE r > 10 AND version_no <> 1)"


def _pruned(spark, d):
    v, c = versions(spark, d), chunks(spark, d).withColumnRenamed("doc_id", "version_id")
    cas = store.reference_counts(c.withColumn("version", F.col("version_id")).withColumn("created_at", F.col("version_id")))
    return store.prune(v, v.where("version_no = 1").select("file_id", F.col("version_id").alias("current_version_id")), c, cas, F.lit(-1).cast("long"))


@query(f"WITH {CH}, {_KEPT} SELECT strong_hash, count(*) FILTER (doc_id NOT IN (SELECT version_id FROM gone)) AS ref_count, CASE WHEN count(*) FILTER (doc_id IN (SELECT version_id FROM gone)) > 0 THEN -1 ELSE max(doc_id) END AS last_referenced_at FROM ch GROUP BY 1")
def prune_references(spark, d):
    return _pruned(spark, d)["cas"].select("strong_hash", "ref_count", "last_referenced_at")


@query(f"WITH {CH}, {_KEPT} SELECT version_id, count(strong_hash) AS n_chunks FROM versions LEFT JOIN ch ON doc_id = version_id WHERE version_id NOT IN (SELECT version_id FROM gone) GROUP BY 1")
def prune_versions(spark, d):
    p = _pruned(spark, d)
    n = p["chunks"].groupBy("version_id").agg(F.count("*").alias("n"))
    return p["versions"].join(n, "version_id", "left").select("version_id", F.coalesce("n", F.lit(0)).alias("n_chunks"))


@query(f"""WITH {CH}, gone AS (SELECT strong_hash, row_number() OVER (ORDER BY doc_id, block_index) - 1 AS position FROM ch WHERE file_id = (SELECT min(source) FROM documents))
SELECT substr(strong_hash, 1, 2) || '/' || strong_hash AS key, CAST(position // 100 AS BIGINT) AS batch FROM gone""")
def deleted_file(spark, d):
    c = chunks(spark, d).join(table(spark, d, "documents").agg(F.min("source").alias("file_id")), "file_id")
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("doc_id", "block_index")) - 1
    rows = c.select("strong_hash", place.alias("position"))
    cas = c.select("strong_hash", F.lit(1).alias("ref_count"), F.lit(0).alias("last_referenced_at")).distinct()
    return store.delete_file_chunks(cas, rows, F.lit(0), 100)["deletes"]


_RUN = f"""{_HALVES}, dead AS (SELECT strong_hash, max(doc_id) AS last_doc FROM ch GROUP BY 1 HAVING count(*) FILTER (doc_id % 2 = 1) = 0), swept AS (SELECT strong_hash FROM dead WHERE TIMESTAMP '2024-01-30 00:00:00' + to_minutes(CAST(last_doc AS INTEGER) % 2880) <= TIMESTAMP '{AS_OF}' - INTERVAL 20 HOUR),
deleted AS (SELECT substr(strong_hash, 1, 2) || '/' || strong_hash AS key, 'sweep' AS phase FROM swept UNION ALL SELECT DISTINCT substr(strong_hash, 1, 2) || '/' || strong_hash, 'inventory' FROM ch WHERE strong_hash NOT IN (SELECT strong_hash FROM new))"""


def _run(spark, d):
    c = chunks(spark, d)
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-30 00:00:00").cast("timestamp")) + F.max("doc_id") % 2880 * 60)
    cas = c.groupBy("strong_hash").agg(F.count_if(F.col("doc_id") % 2 == 1).alias("ref_count"), at.alias("last_referenced_at"))
    keys = c.select(chunking.object_key(F.col("strong_hash")).alias("key")).distinct()
    return store.collect_garbage(cas, _now(), F.lit(7).cast("long"), keys, store.reference_set(c.where("doc_id % 2 = 1")), 20 * 3_600_000, 1_000_000)


@query(f"WITH {_RUN} SELECT key, phase FROM deleted")
def gc_deleted(spark, d):
    return _run(spark, d)["deleted"]


@query(f"WITH {_RUN} SELECT CAST(7 AS BIGINT) AS run_id, 'completed' AS status, count(*) AS deleted_count, CAST(NULL AS VARCHAR) AS error FROM deleted")
def gc_run(spark, d):
    return _run(spark, d)["run"].drop("finished_at")


@query(f"""WITH {_HALVES}, t AS (SELECT doc_id, count(DISTINCT strong_hash) AS total, count(DISTINCT strong_hash) FILTER (strong_hash NOT IN (SELECT strong_hash FROM old)) AS n FROM ch GROUP BY 1)
SELECT doc_id AS aggregate_id, 'CHUNK_VERIFICATION_FAILED' AS event_type, source AS file_id, total AS total_hashes, n AS missing_count, least(n, 100) AS listed FROM t JOIN documents USING (doc_id) WHERE n > 0""")
def verification_events(spark, d):
    c = chunks(spark, d).withColumnRenamed("doc_id", "version_id")
    v = table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), F.col("source").alias("file_id"), F.lit("pending").alias("verification_status"))
    totals = c.groupBy("version_id").agg(F.countDistinct("strong_hash").alias("total_hashes"))
    e = store.verification_events(store.verification(v, c, c.where("version_id % 2 = 0")), totals, v, _now())["events"]
    p = scalars.payload(F.col("payload"), "versionId long, fileId string, missingHashes array<string>, totalHashes long, missingCount long")
    return e.withColumn("p", p).select("aggregate_id", "event_type", F.col("p.fileId").alias("file_id"), F.col("p.totalHashes").alias("total_hashes"), F.col("p.missingCount").alias("missing_count"), F.size("p.missingHashes").cast("long").alias("listed"))


_ASKED = f"""n AS (SELECT doc_id AS id, CASE WHEN doc_id % 8 = 0 THEN doc_id % 7 WHEN doc_id % 4 = 0 THEN 100 ELSE doc_id % 7 END AS user_id, CASE WHEN doc_id % 4 = 0 THEN 'again' ELSE source END AS path,
  CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '{AS_OF}' + INTERVAL 1 HOUR ELSE TIMESTAMP '2024-01-30 00:00:00' + to_minutes(CAST(doc_id AS INTEGER) % 2880) END AS expires_at FROM documents)"""


def _asked(spark, d):
    """Negotiations of all documents but every other multiple of four; then all multiples of four ask, maybe again."""
    i, t = F.col("doc_id"), table(spark, d, "documents")
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-30 00:00:00").cast("timestamp")) + i % 2880 * 60)
    state = t.where((i % 4 != 0) | (i % 8 == 0)).select(i.alias("id"), (i % 7).alias("user_id"), F.col("source").alias("path"), at.alias("expires_at"))
    return store.put_negotiations(state, t.where(i % 4 == 0).select(i.alias("id"), F.lit(100).cast("long").alias("user_id"), F.lit("again").alias("path")), _now())


@query(f"WITH {_ASKED} SELECT id, user_id, path FROM n WHERE expires_at >= TIMESTAMP '{AS_OF}' AND id % 5 <> 0")
def negotiations_live(spark, d):
    n = store.live_negotiations(_asked(spark, d), _now())
    return store.clear_negotiations(n, n.where("id % 5 = 0").select("id")).select("id", "user_id", "path")


@query(f"WITH {_ASKED} SELECT id, user_id FROM n WHERE expires_at < TIMESTAMP '{AS_OF}'")
def negotiations_expired(spark, d):
    return store.expired(_asked(spark, d), _now()).select("id", "user_id")


# ---- literals and answers ----------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN strlen(text) > 1024 THEN 'gzip' END AS encoding, sha256(text) AS sha256 FROM documents")
def literals_roundtrip(spark, d):
    t = dealt_docs(spark, d).select("doc_id", files.compress_literals("content").alias("z"))
    return t.select("doc_id", F.col("z.encoding").alias("encoding"), F.sha2(files.decompress_literals("z.data", "z.encoding"), 256).alias("sha256"))


@query("SELECT doc_id, base64(encode(text)) AS content FROM documents")
def download_base64(spark, d):
    return files.download(dealt_docs(spark, d).select("doc_id", "content"))


@query("""SELECT event_id, regexp_replace(event_type || '?' || event_id, '[^a-zA-Z0-9_/-]', '_', 'g') AS key, least(30000, 250 * power(2, event_id % 12)) :: BIGINT AS backoff_ms,
  CASE event_id % 5 WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'PERMISSION_DENIED' WHEN 2 THEN 'SERVER_ERROR' WHEN 3 THEN 'CORRUPT_BLOCK' END AS error, CASE WHEN event_id % 4 = 0 THEN '0.0%' ELSE '50.0%' END AS pct FROM events""")
def scalar_surface(spark, d):
    i = F.col("event_id")
    status = F.when(i % 5 == 0, 404).when(i % 5 == 1, 403).when(i % 5 == 2, 503).otherwise(200)
    return table(spark, d, "events").select(
        "event_id", scalars.sanitise_key(F.concat("event_type", F.lit("?"), i.cast("string"))).alias("key"), scalars.backoff_bound(i % 12, 250, 30000).alias("backoff_ms"),
        scalars.error_class(status, i % 5 != 3).alias("error"), scalars.percent(i % 4, i % 4 * 2).alias("pct"),
    )
