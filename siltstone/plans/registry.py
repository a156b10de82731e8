"""The queries of the core engine over the driver's tables, with the SQL that gives the same rows.

A source is a file, its documents are versions in order of doc_id, a text's bytes the content. Events are sync jobs,
requests and queue events. Times are relative to a fixed moment.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import scalars
from siltstone.operators import chunking, client, codecs, delta, limits, store
from siltstone.plans.base import AS_OF, BLOCK, CH, JOBS, ORACLE_SQL, QUERIES, VERSIONS, adler_sql, cdc_sql, chunks, dealt_docs, docs, jobs, query, table, versions

# ---- chunks and hashes ---------------------------------------------------------------------------


@query(f"""WITH {CH}, u AS (SELECT strong_hash, count(*) AS refs, min(length) AS size FROM ch GROUP BY 1)
SELECT CAST(coalesce(sum(refs), 0) AS BIGINT) AS total_blocks, count(*) AS unique_blocks, CAST(coalesce(sum(refs * size), 0) AS BIGINT) AS logical_bytes, CAST(coalesce(sum(size), 0) AS BIGINT) AS unique_bytes FROM u""")
def dedup_fixed(spark, d):
    u = chunks(spark, d).groupBy("strong_hash").agg(F.count("*").alias("refs"), F.min("length").alias("size"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return u.agg(zero("refs").alias("total_blocks"), F.count("*").alias("unique_blocks"), zero(F.col("refs") * F.col("size")).alias("logical_bytes"), zero("size").alias("unique_bytes"))


_SIGNED = f"""{CH}, sg AS (SELECT doc_id, block_index, "offset", length, {adler_sql("b")} AS weak_hash, strong_hash FROM
  (SELECT ch.*, substr(hex(text), 1 + block_index * 2048, 2048) AS b FROM ch JOIN documents USING (doc_id)))"""


def _signed(spark, d):
    return _long(chunking.signatures(dealt_docs(spark, d), "content", "doc_id", mode="fixed", size=BLOCK), "block_index")


@query(f"WITH {_SIGNED} SELECT * FROM sg")
def sig_fixed(spark, d):
    return _signed(spark, d)


def _cdc(spark, d, profile):
    return chunking.with_cdc(dealt_docs(spark, d), "content", profile, "doc_id")


def _long(df, *cols):
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


_HEX = "hx AS (SELECT doc_id, hex(text) AS h FROM documents)"


def _cdc_signature_sql(profile) -> str:
    return f"""WITH {_HEX}, {cdc_sql("c", "hx", profile)} SELECT doc_id, block_index, "offset", length, {adler_sql("block")} AS weak_hash, sha256(unhex(block)) AS strong_hash FROM c"""


@query(_cdc_signature_sql(chunking.web_profile()))
def sig_cdc_web(spark, d):
    return _cdc(spark, d, chunking.web_profile()).select("doc_id", "block_index", "offset", "length", chunking.adler32("block").alias("weak_hash"), chunking.strong("block").alias("strong_hash"))


@query(_cdc_signature_sql(chunking.server_profile(1024)))
def sig_cdc_server(spark, d):
    return _cdc(spark, d, chunking.server_profile(1024)).select("doc_id", "block_index", "offset", "length", chunking.adler32("block").alias("weak_hash"), chunking.strong("block").alias("strong_hash"))


@query(f"""WITH {_HEX}, {cdc_sql("c", "hx", chunking.web_profile())}, u AS (SELECT sha256(unhex(block)) AS h, count(*) AS refs, min(length) AS size FROM c GROUP BY 1)
SELECT CAST(coalesce(sum(refs), 0) AS BIGINT) AS total_blocks, count(*) AS unique_blocks, CAST(coalesce(sum(refs * size), 0) AS BIGINT) AS logical_bytes, CAST(coalesce(sum(size), 0) AS BIGINT) AS unique_bytes FROM u""")
def dedup_cdc(spark, d):
    c = _cdc(spark, d, chunking.web_profile()).select(chunking.strong("block").alias("h"), "length").groupBy("h").agg(F.count("*").alias("refs"), F.first("length").alias("size"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return c.agg(zero("refs").alias("total_blocks"), F.count("*").alias("unique_blocks"), zero(F.col("refs") * F.col("size")).alias("logical_bytes"), zero("size").alias("unique_bytes"))


@query(f"""WITH {_HEX}, {cdc_sql("c", "hx", chunking.Profile(256, 256, 16384))} SELECT doc_id, CAST(block_index AS BIGINT) AS block_index, "offset", length FROM c""")
def cdc_cuts(spark, d):
    return _cdc(spark, d, chunking.Profile(256, 256, 16384)).select("doc_id", F.col("block_index").cast("long").alias("block_index"), "offset", "length")


@query(f"""WITH {_HEX}, {cdc_sql("c", "hx", chunking.server_profile(4096))}, n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256, coalesce(n, 0) AS cdc_chunks, 4096 AS avg_target FROM documents LEFT JOIN n USING (doc_id)""")
def scan_report(spark, d):
    return chunking.scan_report(dealt_docs(spark, d), "content", chunking.server_profile(4096), "doc_id")


@query("""SELECT doc_id, CAST(((strlen(text) + coalesce(list_sum([(strlen(text) - k) * CAST('0x' || substr(hex(text), 2 * k + 1, 2) AS BIGINT) FOR k IN range(0, strlen(text))]), 0)) % 65521) * 65536
  + (1 + coalesce(list_sum([CAST('0x' || substr(hex(text), 2 * k + 1, 2) AS BIGINT) FOR k IN range(0, strlen(text))]), 0)) % 65521 AS BIGINT) AS weak_hash FROM documents""")
def adler_docs(spark, d):
    return docs(spark, d).select("doc_id", chunking.adler32("content").alias("weak_hash"))


@query("SELECT doc_id, sha256(text) AS content_sha256, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def content_hash(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_sha256"), F.octet_length("text").cast("long").alias("size"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'temp-' || sha256(text) ELSE substr(sha256(text), 1, 2) || '/' || sha256(text) END AS key FROM documents")
def s3_keys(spark, d):
    h = F.sha2(F.encode("text", "UTF-8"), 256)
    h = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("temp-"), h)).otherwise(h)
    return table(spark, d, "documents").select("doc_id", chunking.object_key(h).alias("key"))


@query("SELECT doc_id, CASE WHEN n_chars * 1000 < 32768 THEN 0 WHEN n_chars * 1000 < 262144 THEN 4096 WHEN n_chars * 1000 < 10485760 THEN 16384 ELSE 65536 END AS size FROM documents")
def adaptive_size(spark, d):
    return table(spark, d, "documents").select("doc_id", chunking.adaptive_size(F.col("n_chars") * 1000).alias("size"))


@query(f"WITH {CH} SELECT length // 128 * 128 AS bucket, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM ch GROUP BY 1")
def chunk_size_histogram(spark, d):
    return chunks(spark, d).groupBy((F.floor(F.col("length") / 128) * 128).alias("bucket")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


@query("""SELECT doc_id, CAST(i AS BIGINT) AS slice_index, CAST(i * 100 AS BIGINT) AS "offset", CAST(150 AS BIGINT) AS length, sha256(unhex(substr(hex(text), 1 + i * 200, 300))) AS strong_hash
FROM (SELECT doc_id, text, unnest([0, 1, 2]) AS i FROM documents)""")
def hash_slices(spark, d):
    t = docs(spark, d).withColumn("o", F.array(*[F.lit(x).cast("long") for x in (0, 100, 200)])).withColumn("l", F.array(*[F.lit(150).cast("long")] * 3))
    return chunking.hash_slices(t, "content", "o", "l", "doc_id").select("doc_id", F.col("slice_index").cast("long").alias("slice_index"), "offset", "length", "strong_hash")


@query("""SELECT doc_id, CAST(i AS BIGINT) AS slice_index, CAST(i * 700 AS BIGINT) AS "offset", CAST(700 AS BIGINT) AS length, sha256(unhex(substr(hex(text), 1 + i * 1400, 1400))) AS strong_hash
FROM (SELECT doc_id, text, unnest(range(0, (strlen(text) + 699) // 700)) AS i FROM documents)""")
def hash_slices_whole(spark, d):
    n = F.octet_length("content")
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"), F.lit(700).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    t = docs(spark, d).withColumn("o", starts).withColumn("l", F.transform("o", lambda x: F.lit(700).cast("long")))
    return chunking.hash_slices(t, "content", "o", "l", "doc_id").select("doc_id", F.col("slice_index").cast("long").alias("slice_index"), "offset", "length", "strong_hash")


# ---- deltas ---------------------------------------------------------------------------------------


def pairs(spark, d) -> DataFrame:
    """Old and new content: a tail appended, a byte put in, or no change."""
    t = dealt_docs(spark, d)
    third = F.col("doc_id") % 3
    x = F.lit(b"X")
    half = F.floor(F.octet_length("content") / 2).cast("int")
    new = F.when(third == 0, F.concat("content", F.lit(b" and a tail that the old version lacks"))).when(third == 1, F.concat(F.col("content").substr(F.lit(1), half), x, F.col("content").substr(half + 1, F.lit(1 << 30)))).otherwise(F.col("content"))
    return t.select("doc_id", F.col("content").alias("old"), new.alias("new"))


_PAIRS = """pairs AS (SELECT doc_id, hex(text) AS old, CASE WHEN doc_id % 3 = 0 THEN hex(text || ' and a tail that the old version lacks')
  WHEN doc_id % 3 = 1 THEN substr(hex(text), 1, strlen(text) // 2 * 2) || '58' || substr(hex(text), strlen(text) // 2 * 2 + 1) ELSE hex(text) END AS new FROM documents),
o AS (SELECT doc_id, i AS block_index, sha256(unhex(substr(old, 1 + i * 512, 512))) AS h FROM (SELECT *, unnest(range(0, (length(old) // 2 + 255) // 256)) AS i FROM pairs)),
n AS (SELECT doc_id, i AS block_index, sha256(unhex(substr(new, 1 + i * 512, 512))) AS h, CAST(least(256, length(new) // 2 - i * 256) AS BIGINT) AS length FROM (SELECT *, unnest(range(0, (length(new) // 2 + 255) // 256)) AS i FROM pairs)),
f AS (SELECT doc_id, h, min(block_index) AS copy_block FROM o GROUP BY 1, 2),
ops AS (SELECT doc_id, CAST(n.block_index AS BIGINT) AS op_index, CASE WHEN copy_block IS NULL THEN 'literal' ELSE 'copy' END AS kind, CAST(copy_block AS BIGINT) AS copy_block,
  CASE WHEN copy_block IS NULL THEN CAST(coalesce(sum(CASE WHEN copy_block IS NULL THEN length ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n.block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS literal_offset,
  CAST(n.block_index * 256 AS BIGINT) AS new_offset, length FROM n LEFT JOIN f USING (doc_id, h))"""


def _block_ops(spark, d):
    p = pairs(spark, d)
    return delta.chunk_ops(chunking.signatures(p, "new", "doc_id", mode="fixed", size=256), chunking.signatures(p, "old", "doc_id", mode="fixed", size=256), "doc_id")


@query(f"WITH {_PAIRS} SELECT * FROM ops")
def delta_block_ops(spark, d):
    return _long(_block_ops(spark, d), "op_index", "copy_block", "literal_offset", "length")


_CDC_PAIRS = f"""pr AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE old END AS old, new FROM pairs), po AS (SELECT doc_id, old AS h FROM pr), pn AS (SELECT doc_id, new AS h FROM pr),
{cdc_sql("co", "po", chunking.web_profile(256))}, {cdc_sql("cn", "pn", chunking.web_profile(256))},
fo AS (SELECT doc_id, sha256(unhex(block)) AS h, length, min(block_index) AS copy_block FROM co GROUP BY ALL),
jn AS (SELECT doc_id, block_index, "offset", length, copy_block FROM (SELECT *, sha256(unhex(block)) AS h FROM cn) LEFT JOIN fo USING (doc_id, h, length) WHERE doc_id IN (SELECT doc_id FROM co)),
cdc_ops AS (SELECT doc_id, block_index AS op_index, CASE WHEN copy_block IS NULL THEN 'literal' ELSE 'copy' END AS kind, copy_block, CASE WHEN copy_block IS NULL THEN
  CAST(coalesce(sum(CASE WHEN copy_block IS NULL THEN length ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS literal_offset, "offset" AS new_offset, length FROM jn
UNION ALL SELECT doc_id, 0, 'literal', NULL, 0, 0, CAST(length(new) // 2 AS BIGINT) FROM pr WHERE doc_id NOT IN (SELECT doc_id FROM co))"""


def _cdc_pairs(spark, d):
    """``pairs``, a tenth of which have no old version."""
    return pairs(spark, d).withColumn("old", F.when(F.col("doc_id") % 10 == 0, F.lit(b"")).otherwise(F.col("old")))


@query(f"WITH {_PAIRS.split('o AS (SELECT')[0].rstrip().rstrip(',')}, {_CDC_PAIRS} SELECT * FROM cdc_ops")
def delta_cdc_ops(spark, d):
    p, w = _cdc_pairs(spark, d), {"mode": "cdc", "size": 256, "profile": "web"}
    sizes = p.select("doc_id", F.octet_length("new").alias("size"))
    return delta.chunk_ops(chunking.signatures(p, "new", "doc_id", **w), chunking.signatures(p, "old", "doc_id", **w), "doc_id", sizes)


_STATS = """st AS (SELECT doc_id, CAST(sum(length) AS BIGINT) AS total_new_bytes, CAST(sum(CASE WHEN kind = 'copy' THEN length ELSE 0 END) AS BIGINT) AS copied_bytes,
  CAST(sum(CASE WHEN kind = 'copy' THEN 0 ELSE length END) AS BIGINT) AS literal_bytes, count(*) FILTER (kind = 'copy') AS reused_blocks, count(*) FILTER (kind = 'literal' AND coalesce(prev, 'copy') = 'copy') AS new_literal_runs
  FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY op_index) AS prev FROM ops) GROUP BY doc_id)"""


@query(f"WITH {_PAIRS}, {_STATS} SELECT * FROM st")
def delta_stats(spark, d):
    return _long(delta.stats(_block_ops(spark, d), "doc_id"), "total_new_bytes", "copied_bytes", "literal_bytes", "reused_blocks", "new_literal_runs")


@query(f"""WITH {_PAIRS}, {_STATS} SELECT doc_id, literal_bytes + 8 * reused_blocks AS delta_bytes,
  CASE WHEN total_new_bytes > 0 THEN floor((1 - (literal_bytes + 8 * reused_blocks) / total_new_bytes) * 10000 + 0.5) / 100 ELSE 0.0 END AS saved_percent FROM st""")
def playground_savings(spark, d):
    return delta.savings(delta.stats(_block_ops(spark, d), "doc_id")).select("doc_id", F.col("delta_bytes").cast("long").alias("delta_bytes"), "saved_percent")


@query(f"WITH {_PAIRS} SELECT doc_id, op_index, CAST(greatest(1, ceil(length / 64)) AS INTEGER) AS cells FROM ops")
def heatmap_cells(spark, d):
    return _block_ops(spark, d).select("doc_id", F.col("op_index").cast("long").alias("op_index"), delta.heat_cells(F.col("length"), F.lit(256)).alias("cells"))


_FIXED = f"""{_PAIRS.split('o AS (SELECT')[0].rstrip().rstrip(',')},
ob AS (SELECT doc_id, md5(substr(old, 1 + i * 512, 512)) AS m, min(i) AS b FROM (SELECT doc_id, old, unnest(range(0, length(old) // 512)) AS i FROM pairs) GROUP BY 1, 2),
nw AS (SELECT doc_id, i, md5(substr(new, 1 + 2 * i, 512)) AS m FROM (SELECT doc_id, new, unnest(range(0, length(new) // 2 - 255)) AS i FROM pairs)),
ht AS (SELECT doc_id, list({{'pos': CAST(i AS BIGINT), 'b': CAST(b AS BIGINT), 'p': CAST([] AS STRUCT(pos BIGINT, b BIGINT)[])}} ORDER BY i) AS l FROM nw JOIN ob USING (doc_id, m) GROUP BY 1),
pk AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN x.pos >= a.pos THEN {{'pos': x.pos + 256, 'b': x.b, 'p': list_append(a.p, {{'pos': x.pos, 'b': x.b}})}} ELSE a END,
  {{'pos': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT), 'p': CAST([] AS STRUCT(pos BIGINT, b BIGINT)[])}}).p AS p FROM ht),
pc AS (SELECT doc_id, CAST(length(new) // 2 AS BIGINT) AS n, coalesce(p, []) AS p FROM pairs LEFT JOIN pk USING (doc_id)),
cp AS (SELECT doc_id, n, e.pos AS pos, e.b AS b, coalesce(lag(e.pos) OVER (PARTITION BY doc_id ORDER BY e.pos) + 256, 0) AS before FROM (SELECT doc_id, n, unnest(p) AS e FROM pc)),
al AS (SELECT doc_id, 'copy' AS kind, CAST(b AS INTEGER) AS copy_block, pos AS new_offset, CAST(256 AS BIGINT) AS length FROM cp
  UNION ALL SELECT doc_id, 'literal', NULL, before, pos - before FROM cp WHERE pos > before
  UNION ALL SELECT doc_id, 'literal', NULL, pos, n - pos FROM (SELECT doc_id, n, coalesce(p[-1].pos + 256, 0) AS pos FROM pc) WHERE pos < n OR n = 0),
fixed_ops AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY new_offset) - 1 AS INTEGER) AS op_index, kind, copy_block, new_offset, length FROM al)"""


@query(f"WITH {_FIXED} SELECT * FROM fixed_ops")
def delta_fixed_ops(spark, d):
    return delta.fixed_ops(pairs(spark, d), "doc_id", "new", "old", 256)


@query(f"""WITH {_FIXED} SELECT doc_id, CAST(coalesce(sum(length) FILTER (kind = 'literal'), 0) AS BIGINT) AS bytes_transferred FROM fixed_ops GROUP BY 1""")
def legacy_accounting(spark, d):
    return store.legacy_accounting(delta_fixed_ops(spark, d), "doc_id")


@query(f"WITH {_PAIRS} SELECT doc_id, CAST(length(new) // 2 AS BIGINT) AS size, sha256(unhex(new)) AS content_sha256 FROM pairs WHERE new <> ''")
def patch_verify(spark, d):
    p = pairs(spark, d)
    ops = delta.fixed_ops(p, "doc_id", "new", "old", 256)
    out = delta.patch(p, p, ops, chunking.with_fixed(p, "old", 256, "doc_id"), "doc_id", "old", "new")
    return out.select("doc_id", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("content_sha256"))


# ---- manifests and codecs ----------------------------------------------------------------------------


@query(f"""WITH {_SIGNED} SELECT doc_id, block_index, CAST(coalesce(sum(length) OVER (PARTITION BY doc_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", length,
  CASE WHEN doc_id % 2 = 0 THEN weak_hash ELSE 0 END AS weak_hash, strong_hash,
  CASE WHEN doc_id % 5 = 0 THEN 'Reconstructed size ' || sum(length) OVER (PARTITION BY doc_id) || ' does not match newSize ' || (strlen(text) + 1) END AS error FROM sg JOIN documents USING (doc_id)""")
def manifest_rows(spark, d):
    c = _signed(spark, d).drop("offset").withColumn("weak_hash", F.when(F.col("doc_id") % 2 == 0, F.col("weak_hash")))
    size = F.octet_length("text").cast("long") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    out = store.chunk_manifest(c, table(spark, d, "documents").select("doc_id", size.alias("new_size")), "doc_id")
    return out.select("doc_id", "block_index", "offset", "length", "weak_hash", "strong_hash", "error")


@query(f"WITH {_SIGNED} SELECT * FROM sg")
def manifest_roundtrip(spark, d):
    return _long(codecs.chunks_of(codecs.manifest_of(_signed(spark, d), "doc_id"), "doc_id"), "block_index")


@query(f"WITH {_PAIRS} SELECT doc_id, kind, copy_block AS block_index, literal_offset, CASE WHEN kind = 'literal' THEN length END AS literal_length, CAST(v AS INTEGER) AS version FROM ops, (SELECT unnest([1, 2]) AS v)")
def ops_roundtrip(spark, d):
    o = _block_ops(spark, d)
    row = F.struct("op_index", "kind", F.col("copy_block").cast("long").alias("block_index"), "literal_offset", F.when(F.col("kind") == "literal", F.col("length")).alias("literal_length"))
    o = o.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("o"))
    two = codecs.encode_ops2("o", F.lit(256), F.lit(None).cast("string"), F.lit(0))
    o = o.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("version"), codecs.encode_ops1("o").alias("b")), F.struct(F.lit(2).alias("version"), two.alias("b")))).alias("e"))
    return o.select("doc_id", "e.version", F.explode(codecs.decode_ops("e.b")).alias("x")).select("doc_id", "x.*", "version")


@query(f"""WITH {_PAIRS} SELECT doc_id, 256 + doc_id AS block_size, sha256(unhex(new)) AS content_sha256, CAST(length(new) // 2 AS BIGINT) AS new_size, count(*) AS n_ops, CAST(sum(length) FILTER (kind = 'literal') AS BIGINT) AS literal_bytes
FROM ops JOIN pairs USING (doc_id) GROUP BY doc_id, new""")
def ops_header(spark, d):
    o = _block_ops(spark, d)
    row = F.struct("op_index", "kind", F.col("copy_block").cast("long").alias("block_index"), "literal_offset", F.when(F.col("kind") == "literal", F.col("length")).alias("literal_length"))
    o = o.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("o"), F.sum("length").alias("size"))
    h = pairs(spark, d).select("doc_id", F.sha2("new", 256).alias("h"))
    x = codecs.decode_ops2(codecs.encode_ops2("o", F.col("doc_id") + 256, "h", "size"))
    x = o.join(h, "doc_id").select("doc_id", x.alias("x")).select("doc_id", "x.*")
    literals = F.aggregate(F.filter("ops", lambda v: v["kind"] == "literal"), F.lit(None).cast("long"), lambda a, v: F.coalesce(a, F.lit(0).cast("long")) + v["literal_length"])
    return x.select("doc_id", "block_size", "content_sha256", "new_size", F.size("ops").cast("long").alias("n_ops"), literals.alias("literal_bytes"))


@query(f"""WITH {_PAIRS.split('o AS (SELECT')[0].rstrip().rstrip(',')}, pr AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE old END AS old, new FROM pairs), po AS (SELECT doc_id, old AS h FROM pr), pn AS (SELECT doc_id, new AS h FROM pr),
{cdc_sql("co", "po", chunking.server_profile(1024))}, {cdc_sql("cn", "pn", chunking.server_profile(1024))},
fo AS (SELECT doc_id, sha256(unhex(block)) AS h, length, min(block_index) AS copy_block FROM co GROUP BY ALL),
jn AS (SELECT doc_id, length, copy_block FROM (SELECT *, sha256(unhex(block)) AS h FROM cn) LEFT JOIN fo USING (doc_id, h, length) WHERE doc_id IN (SELECT doc_id FROM co)),
al AS (SELECT doc_id, copy_block IS NULL AS lit, length FROM jn UNION ALL SELECT doc_id, true, length(new) // 2 FROM pr WHERE doc_id NOT IN (SELECT doc_id FROM co))
SELECT doc_id, 8 + CAST(sum(CASE WHEN lit THEN 9 ELSE 5 END) AS BIGINT) AS ops_bytes, CAST(coalesce(sum(length) FILTER (lit), 0) AS BIGINT) AS literal_bytes FROM al GROUP BY 1""")
def pack_delta(spark, d):
    p = _cdc_pairs(spark, d)
    sig = chunking.signatures(p, "old", "doc_id", size=1024)
    out = delta.pack_delta(p.select("doc_id", "new"), sig, "doc_id", "new", 1024)
    return out.select("doc_id", F.octet_length("ops").cast("long").alias("ops_bytes"), F.octet_length("literals").cast("long").alias("literal_bytes"))


@query(f"""WITH {CH} SELECT file_id, strong_hash, first_index, CAST((row_number() OVER (PARTITION BY file_id ORDER BY first_index) - 1) // 25 AS BIGINT) AS page FROM (
  SELECT file_id, strong_hash, min(doc_id * 1000 + block_index) AS first_index FROM ch GROUP BY 1, 2)""")
def hash_pages(spark, d):
    c = chunks(spark, d).withColumn("block_index", F.col("doc_id") * 1000 + F.col("block_index"))
    return store.hash_pages(c, "file_id", 25)


@query(f"""WITH {CH}, {VERSIONS}, v AS (SELECT ch.*, version_no FROM ch JOIN versions ON doc_id = version_id),
n AS (SELECT file_id, version_no, lag(version_no) OVER (PARTITION BY file_id ORDER BY version_no) AS older FROM (SELECT DISTINCT file_id, version_no FROM v))
SELECT v.file_id, v.version_no, v.block_index, v.strong_hash, EXISTS (SELECT 1 FROM v o WHERE o.file_id = v.file_id AND o.version_no = n.older AND o.strong_hash = v.strong_hash) AS reused
FROM v JOIN n USING (file_id, version_no)""")
def reuse_map(spark, d):
    v = versions(spark, d).select(F.col("version_id").alias("doc_id"), "version_no")
    c = chunks(spark, d).join(v, "doc_id").select("file_id", "version_no", "block_index", "strong_hash")
    return store.reuse_map(c).select("file_id", "version_no", "block_index", "strong_hash", "reused")


# ---- stores -----------------------------------------------------------------------------------------


def _halves(spark, d):
    c = chunks(spark, d)
    return c.where("doc_id % 2 = 0"), c.where("doc_id % 2 = 1")


_HALVES = CH + ", old AS (SELECT * FROM ch WHERE doc_id % 2 = 0), new AS (SELECT * FROM ch WHERE doc_id % 2 = 1), miss AS (SELECT strong_hash, min(block_index) AS block_index FROM new WHERE strong_hash NOT IN (SELECT strong_hash FROM old) GROUP BY 1)"


@query(f"WITH {_HALVES} SELECT * FROM miss")
def negotiate_missing(spark, d):
    old, new = _halves(spark, d)
    return store.missing_chunks(new, old)


@query(f"""WITH {_HALVES}, prev AS (SELECT strong_hash FROM ch WHERE doc_id % 8 = 0), idx AS (SELECT strong_hash FROM ch WHERE doc_id % 8 = 2), obj AS (SELECT strong_hash FROM ch WHERE doc_id % 8 = 4)
SELECT strong_hash, min(block_index) AS block_index FROM new WHERE strong_hash NOT IN (SELECT * FROM prev UNION ALL SELECT * FROM idx UNION ALL SELECT * FROM obj) GROUP BY 1""")
def negotiate_three_sources(spark, d):
    c = chunks(spark, d)
    return store.missing_chunks(_halves(spark, d)[1], *(c.where(F.col("doc_id") % 8 == k) for k in (0, 2, 4)))


@query(f"WITH {_HALVES} SELECT (SELECT count(*) FROM new) AS total_chunks, (SELECT count(*) FROM miss) AS missing_chunks, (SELECT count(*) FROM new) - (SELECT count(*) FROM miss) AS existing_chunks")
def negotiate_counts(spark, d):
    old, new = _halves(spark, d)
    return store.negotiation_counts(new, store.missing_chunks(new, old))


@query(f"WITH {_HALVES} SELECT DISTINCT strong_hash FROM new WHERE strong_hash NOT IN (SELECT strong_hash FROM old)")
def resume_missing(spark, d):
    old, new = _halves(spark, d)
    return store.missing_chunks(new, old).select("strong_hash")


@query(f"""WITH {_HALVES}, t AS (SELECT doc_id, CAST(sum(length) AS BIGINT) AS new_size, CAST(sum(CASE WHEN strong_hash IN (SELECT strong_hash FROM miss) THEN length ELSE 0 END) AS BIGINT) AS bytes_transferred FROM new GROUP BY 1)
SELECT *, greatest(0, new_size - bytes_transferred) AS bytes_saved FROM t""")
def commit_accounting(spark, d):
    old, new = _halves(spark, d)
    return store.commit_accounting(new, store.missing_chunks(new, old), "doc_id")


@query(f"WITH {VERSIONS} SELECT file_id, max(version_no) + 1 AS next_version FROM versions GROUP BY 1")
def next_version(spark, d):
    v = versions(spark, d)
    return store.next_version(v.select("file_id").distinct(), v)


_CAS = CH + ", cas AS (SELECT strong_hash, count(*) AS ref_count, arg_min(length, (doc_id, block_index)) AS byte_size, max(doc_id) AS last_doc FROM ch GROUP BY 1)"


def _cas(spark, d):
    return store.reference_counts(chunks(spark, d).withColumn("version", F.col("doc_id")).withColumn("created_at", F.col("doc_id")))


@query(f"WITH {_CAS} SELECT strong_hash, ref_count, byte_size, last_doc AS last_referenced_at FROM cas")
def cas_refcounts(spark, d):
    return _cas(spark, d)


@query(f"""WITH {_CAS} SELECT strong_hash, greatest(0, ref_count - (SELECT count(*) FROM ch WHERE ch.strong_hash = cas.strong_hash AND doc_id % 2 = 0)) AS ref_count,
  CASE WHEN strong_hash IN (SELECT strong_hash FROM ch WHERE doc_id % 2 = 0) THEN -1 ELSE last_doc END AS last_referenced_at FROM cas""")
def cas_after_deref(spark, d):
    return store.dereference(_cas(spark, d), _halves(spark, d)[0], F.lit(-1).cast("long")).select("strong_hash", "ref_count", "last_referenced_at")


@query(f"""WITH {_CAS}, l AS (SELECT strong_hash, max(TIMESTAMP '2024-01-30 00:00:00' + to_minutes(CAST(doc_id AS INTEGER) % 2880)) AS last_referenced_at FROM ch WHERE doc_id % 2 = 0 AND strong_hash NOT IN (SELECT strong_hash FROM ch WHERE doc_id % 2 = 1) GROUP BY 1)
SELECT strong_hash FROM l WHERE last_referenced_at <= TIMESTAMP '{AS_OF}' - INTERVAL 20 HOUR ORDER BY last_referenced_at, strong_hash LIMIT 1000""")
def cas_sweep(spark, d):
    return store.sweepable(_dropped(spark, d), F.lit(AS_OF).cast("timestamp"), 20 * 3_600_000).select("strong_hash")


def _at(c):
    return F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-30 00:00:00").cast("timestamp")) + F.col(c) % 2880 * 60)


def _dropped(spark, d):
    """The index after the even documents went, each at its own time."""
    c, even = _cas(spark, d).withColumn("last_referenced_at", _at("last_referenced_at")), _halves(spark, d)[0]
    when = even.groupBy("strong_hash").agg(F.max(_at("doc_id")).alias("gone_at"))
    return store.dereference(c.join(when, "strong_hash", "left"), even, F.col("gone_at")).drop("gone_at")


@query(f"""WITH {VERSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY version_no DESC) AS r FROM versions) SELECT file_id, version_id, version_no FROM r WHERE r > 10 AND version_no <> 1""")
def retention_delete(spark, d):
    v = versions(spark, d)
    return store.prunable(v, v.where("version_no = 1").select("file_id", F.col("version_id").alias("current_version_id"))).select("file_id", "version_id", "version_no")


@query(f"""WITH {_HALVES}, inv AS (SELECT DISTINCT substr(strong_hash, 1, 2) || '/' || strong_hash AS key FROM ch UNION SELECT 'ab/' || sha256(url) FROM pages UNION SELECT 'temp-1')
SELECT key, split_part(key, '/', 2) AS strong_hash FROM inv WHERE NOT starts_with(key, 'temp-') AND split_part(key, '/', 2) NOT IN (SELECT strong_hash FROM old)""")
def gc_orphans(spark, d):
    old, _ = _halves(spark, d)
    keys = chunks(spark, d).select(chunking.object_key(F.col("strong_hash")).alias("key"))
    keys = keys.union(table(spark, d, "pages").select(F.concat(F.lit("ab/"), F.sha2("url", 256)))).union(spark.range(1).select(F.lit("temp-1"))).distinct()
    return store.orphans(keys, store.reference_set(old))


_VERIFIED = f"""{_HALVES}, m AS (SELECT DISTINCT doc_id, strong_hash FROM ch WHERE strong_hash NOT IN (SELECT strong_hash FROM old)), g AS (SELECT doc_id, count(*) AS n, array_to_string(list(strong_hash ORDER BY strong_hash)[1:100], ',') AS missing FROM m GROUP BY 1),
vf AS (SELECT doc_id AS version_id, CASE WHEN n > 0 THEN 'corrupted' ELSE 'verified' END AS status, coalesce(n, 0) AS n_missing, coalesce(missing, '') AS missing FROM documents LEFT JOIN g USING (doc_id))"""


def _verified(spark, d):
    v = table(spark, d, "documents").select(F.col("doc_id").alias("version_id"))
    return store.verification(v, chunks(spark, d).withColumnRenamed("doc_id", "version_id"), _halves(spark, d)[0])


@query(f"WITH {_VERIFIED} SELECT * FROM vf")
def verify_versions(spark, d):
    return _verified(spark, d).withColumn("missing", F.coalesce(F.array_join("missing", ","), F.lit("")))


@query(f"WITH {VERSIONS} SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY version_no DESC) = 1")
def latest_version(spark, d):
    return store.latest_version(versions(spark, d))


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 409 WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN 202 ELSE 200 END AS INTEGER) AS code FROM documents")
def download_guard(spark, d):
    s = F.when(F.col("doc_id") % 3 == 0, "corrupted").when(F.col("doc_id") % 3 == 1, "pending").otherwise("verified")
    return table(spark, d, "documents").select("doc_id", store.download_status(s, F.col("doc_id") % 2 == 1).alias("code"))


@query("SELECT doc_id, sha256(text) AS content_sha256 FROM documents WHERE text <> ''")
def reconstruct_sha(spark, d):
    cut = chunking.with_fixed(docs(spark, d), "content", BLOCK, "doc_id").withColumn("strong_hash", chunking.strong("block"))
    objects = cut.groupBy("strong_hash").agg(F.first("block").alias("bytes"))
    return store.reconstruct(cut.select("doc_id", "block_index", "strong_hash"), objects, "doc_id").select("doc_id", F.sha2("content", 256).alias("content_sha256"))


# ---- client state, dashboards -------------------------------------------------------------------------


@query(f"""WITH {JOBS}, files AS (SELECT doc_id AS file_id, CAST(doc_id % 7 AS BIGINT) AS user_id FROM documents)
SELECT files.user_id, CAST(coalesce(sum(bytes_transferred), 0) AS BIGINT) AS bytes_transferred, CAST(coalesce(sum(bytes_saved), 0) AS BIGINT) AS bytes_saved, count(files.file_id) AS total_files_joined, count(DISTINCT files.file_id) AS total_files
FROM files LEFT JOIN jobs USING (file_id) GROUP BY 1""")
def dashboard_totals(spark, d):
    f = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), (F.col("doc_id") % 7).alias("user_id"))
    return client.totals(f, jobs(spark, d).drop("user_id"))


@query(f"WITH {JOBS} SELECT CAST(date_trunc('day', started_at) AS DATE) AS day, CAST(sum(bytes_transferred) AS BIGINT) AS bytes_transferred, CAST(sum(bytes_saved) AS BIGINT) AS bytes_saved FROM jobs GROUP BY 1")
def daily_series(spark, d):
    return client.daily(jobs(spark, d))


@query(f"SELECT count(*) AS active FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR")
def active_24h(spark, d):
    return table(spark, d, "events").where(F.col("ts") >= F.expr(f"timestamp '{AS_OF}' - interval 24 hours")).agg(F.count("*").alias("active"))


@query(f"""WITH {JOBS}, t AS (SELECT user_id, CAST(sum(bytes_saved) AS DOUBLE) AS s, CAST(sum(bytes_transferred) AS DOUBLE) AS t FROM jobs GROUP BY 1)
SELECT user_id, CAST(CASE WHEN s + t > 0 THEN floor(s / (s + t) * 100 + 0.5) ELSE 0 END AS BIGINT) AS ratio FROM t""")
def transfer_ratio(spark, d):
    t = jobs(spark, d).groupBy("user_id").agg(F.sum("bytes_saved").cast("double").alias("s"), F.sum("bytes_transferred").cast("double").alias("t"))
    return t.select("user_id", client.transfer_ratio(F.col("s"), F.col("t")).alias("ratio"))


@query(f"WITH {JOBS} SELECT job_id, user_id, bytes_transferred FROM jobs ORDER BY started_at DESC, job_id LIMIT 10")
def recent_jobs(spark, d):
    return client.page(jobs(spark, d), 1, 10, "started_at", "job_id").select("job_id", "user_id", "bytes_transferred")


@query(f"WITH {JOBS} SELECT job_id, user_id FROM jobs WHERE event_type = 'click' ORDER BY started_at DESC, job_id LIMIT 20 OFFSET 40")
def jobs_page(spark, d):
    return client.page(jobs(spark, d).where("event_type = 'click'"), 3, 20, "started_at", "job_id").select("job_id", "user_id")


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), '1')")
def files_search(spark, d):
    return table(spark, d, "pages").where(F.lower("url").contains("1")).select("page_id", "url")


_TRIPLES = """tr AS (SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 5 END AS l, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id % 4 END AS b, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 3 END AS s, doc_id % 13 = 0 AS push, doc_id % 17 = 0 AS pull FROM documents),
ac AS (SELECT path, CASE WHEN NOT o AND NOT t THEN 'skipped' WHEN l IS NOT NULL AND s IS NOT NULL AND l = s THEN 'skipped' WHEN o AND NOT t THEN 'push' WHEN NOT o AND t THEN 'pull' WHEN push THEN 'push' WHEN pull THEN 'pull' ELSE 'conflict' END AS action
  FROM (SELECT *, l IS NOT NULL AND l IS DISTINCT FROM b AS o, s IS NOT NULL AND s IS DISTINCT FROM b AS t FROM tr))"""


@query(f"WITH {_TRIPLES} SELECT * FROM ac")
def sync_classify(spark, d):
    i = F.col("doc_id")
    part = lambda no, n: F.when(i % no != 0, i % n)
    return table(spark, d, "documents").select(i.alias("path"), client.classify(part(7, 5), part(6, 4), part(11, 3), i % 13 == 0, i % 17 == 0).alias("action"))


@query(f"WITH {_TRIPLES} SELECT action, count(*) AS n FROM ac GROUP BY 1")
def sync_summary(spark, d):
    return sync_classify(spark, d).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS path FROM documents WHERE doc_id % 10 <> 0 ORDER BY (doc_id * 7919) % 1009 DESC, doc_id LIMIT 100")
def lru_prune(spark, d):
    t = table(spark, d, "documents")
    cache = t.select(F.col("doc_id").alias("path"), ((F.col("doc_id") * 7919) % 1009).alias("last_accessed"))
    return client.trim_cache(cache, t.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("path")), 100).select("path")


@query(f"WITH {_HALVES} SELECT strong_hash, block_index FROM miss WHERE strong_hash NOT IN (SELECT strong_hash FROM new WHERE doc_id % 3 = 0)")
def journal_remaining(spark, d):
    old, new = _halves(spark, d)
    return client.remaining(store.missing_chunks(new, old), new.select("strong_hash", F.when(F.col("doc_id") % 3 == 0, "completed").otherwise("pending").alias("status")))


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN props END AS content_hash, CASE WHEN event_id % 5 = 0 THEN event_type END AS negotiation_id, event_id % 4 AS file_size, event_id % 3 AS total_chunks, event_id % 2 AS uploaded_chunks, event_type AS state FROM events)
SELECT user_id, arg_max(content_hash, event_id) FILTER (content_hash IS NOT NULL) AS content_hash, arg_max(negotiation_id, event_id) FILTER (negotiation_id IS NOT NULL) AS negotiation_id, coalesce(arg_max(file_size, event_id) FILTER (file_size > 0), 0) AS file_size,
  coalesce(arg_max(total_chunks, event_id) FILTER (total_chunks > 0), 0) AS total_chunks, coalesce(arg_max(uploaded_chunks, event_id) FILTER (uploaded_chunks > 0), 0) AS uploaded_chunks, arg_max(state, event_id) AS state FROM e GROUP BY 1""")
def session_fold(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select("user_id", "event_id", F.when(i % 3 == 0, F.col("props")).alias("content_hash"), F.when(i % 5 == 0, F.col("event_type")).alias("negotiation_id"), (i % 4).alias("file_size"), (i % 3).alias("total_chunks"), (i % 2).alias("uploaded_chunks"), F.col("event_type").alias("state"))
    return client.session_fold(e, ["user_id"], ["event_id"]).drop("event_id")


_DAY = 86_400_000


def _requests(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_millis("ts").alias("at"), (F.col("event_id") % 100).alias("n"))
    return e


def _window_sql(first: str, more: str, used: str) -> str:
    return f"""WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_ms(ts) AS t_ms, event_id % 100 AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT event_id, user_id, k, t_ms + {_DAY} AS expires, {first} AS used, true AS allowed FROM r WHERE k = 1
  UNION ALL
  SELECT r.event_id, r.user_id, r.k, CASE WHEN w.expires < r.t_ms THEN r.t_ms + {_DAY} ELSE w.expires END,
    CASE WHEN w.expires < r.t_ms THEN {first} WHEN {more} THEN w.used + {used} ELSE w.used END, w.expires < r.t_ms OR {more}
  FROM w JOIN r ON r.user_id = w.user_id AND r.k = w.k + 1)
SELECT event_id, allowed FROM w"""


@query(_window_sql("CAST(1 AS BIGINT)", "w.used < 2", "1"))
def rate_limit(spark, d):
    return limits.fold(_requests(spark, d), "user_id", ["at", "event_id"], "at", "n", lambda: limits.Requests(2, _DAY), "allowed", "boolean").select("event_id", "allowed")


@query(_window_sql("n", "w.used + r.n <= 120", "r.n"))
def byte_quota(spark, d):
    return limits.fold(_requests(spark, d), "user_id", ["at", "event_id"], "at", "n", lambda: limits.Bytes(120, _DAY), "allowed", "boolean").select("event_id", "allowed")


@query("""WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t, event_id % 100 AS n, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS last, CAST(120 AS DOUBLE) AS tokens, CAST(NULL AS BIGINT) AS departure FROM r WHERE k = 1
  UNION ALL
  SELECT user_id, k, event_id, CASE WHEN n <= 0 OR n > 120 THEN last ELSE come + wait END, CASE WHEN n <= 0 OR n > 120 THEN tokens ELSE least(120, have + wait * 60 / 1000) - n END, CASE WHEN n <= 0 THEN t WHEN n > 120 THEN NULL ELSE come + wait END
  FROM (SELECT *, CASE WHEN have < n THEN CAST(ceil((n - have) * 1000 / 60) AS BIGINT) ELSE 0 END AS wait FROM (
    SELECT r.user_id, r.k, r.event_id, r.n, r.t, s.last, s.tokens, greatest(r.t, coalesce(s.last, r.t)) AS come, least(120, s.tokens + (greatest(r.t, coalesce(s.last, r.t)) - coalesce(s.last, r.t)) * 60 / 1000) AS have FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1)))
SELECT event_id, departure AS departure_ms FROM s WHERE k > 0""")
def token_bucket(spark, d):
    return limits.fold(_requests(spark, d), "user_id", ["at", "event_id"], "at", "n", lambda: limits.TokenBucket(60), "departure_ms", "long").select("event_id", "departure_ms")


@query("""WITH RECURSIVE r AS (SELECT event_id, user_id, event_id * 37 % 500 AS latency, event_id % 19 = 0 AS refused, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(6 AS BIGINT) AS level, CAST(0 AS BIGINT) AS streak FROM r WHERE k = 1
  UNION ALL
  SELECT r.user_id, r.k, r.event_id, CASE WHEN refused THEN greatest(1, level - 1) WHEN latency < 400 AND streak >= 4 THEN least(6, level + 1) ELSE level END, CASE WHEN refused OR latency >= 400 OR streak >= 4 THEN 0 ELSE streak + 1 END
  FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1)
SELECT event_id, level FROM s WHERE k > 0""")
def upload_concurrency(spark, d):
    r = _requests(spark, d).withColumn("latency", F.col("event_id") * 37 % 500).withColumn("n", F.when(F.col("event_id") % 19 == 0, 503).otherwise(200).cast("long"))
    return limits.fold(r, "user_id", ["at", "event_id"], "latency", "n", lambda: limits.Concurrency(6), "level", "long").select("event_id", "level")


def _outbox(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(i.alias("id"), "event_type", (i % 7).cast("int").alias("attempts"), F.when(F.col("event_type") == "view", F.col("ts")).alias("processed_at"), F.lit(None).cast("string").alias("last_error"), F.col("ts").alias("created_at"))


@query("SELECT event_id AS id, CAST(event_id % 7 AS INTEGER) AS attempts FROM events WHERE event_type <> 'view' AND event_id % 7 <= 5 ORDER BY ts, event_id LIMIT 50")
def outbox_batch(spark, d):
    return client.outbox_batch(_outbox(spark, d)).select("id", "attempts")


@query(f"""WITH o AS (SELECT event_id AS id, CAST(event_id % 7 AS INTEGER) + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS attempts, event_id % 11 = 0 AS bad FROM events WHERE event_type <> 'view')
SELECT id, attempts, NOT bad OR attempts >= 5 AS processed, CASE WHEN bad AND attempts >= 5 THEN '[DLQ] Exceeded 5 attempts: poison' WHEN bad THEN 'poison' END AS last_error FROM o""")
def outbox_transition(spark, d):
    o = client.outbox_transition(_outbox(spark, d).where("processed_at is null"), F.col("id") % 11 != 0, F.lit("poison"), F.lit(AS_OF).cast("timestamp"))
    return o.select("id", "attempts", F.col("processed_at").isNotNull().alias("processed"), "last_error")


@query("SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'heavy' ELSE 'fast' END AS queue FROM documents")
def worker_routing(spark, d):
    return table(spark, d, "documents").select("doc_id", client.routing(F.col("n_chars")).alias("queue"))


@query(f"SELECT event_id FROM events WHERE event_id % 5 = 0 OR NOT (ts < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY)")
def job_cleanup(spark, d):
    j = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("finished_at"))
    return client.job_cleanup(j, F.lit(AS_OF).cast("timestamp"), 10).select("event_id")


# ---- scalars ----------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN n >= 1000000000 THEN printf('%.1f GB', n / 1e9) WHEN n >= 1000000 THEN printf('%.1f MB', n / 1e6) WHEN n >= 1000 THEN printf('%.1f KB', n / 1e3) ELSE n || ' B' END AS shown
FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 997) % 5000000000 // 10 * 10 + 1 AS n FROM orders)""")
def fmt_bytes(spark, d):
    n = F.floor((F.col("o_orderkey") * F.col("o_orderkey") * 997) % 5000000000 / 10) * 10 + 1
    return table(spark, d, "orders").select("o_orderkey", scalars.format_bytes(n).alias("shown"))


@query("""WITH s AS (SELECT p_partkey, p_size || CASE p_partkey % 8 WHEN 0 THEN 'kb' WHEN 1 THEN 'MB/s' WHEN 2 THEN ' g' WHEN 3 THEN 'b/s' WHEN 4 THEN '' WHEN 5 THEN '.5mb' WHEN 6 THEN 'tb' ELSE 'x' END AS s FROM part)
SELECT p_partkey, CAST(CASE WHEN p_partkey % 8 IN (6, 7) THEN 0 ELSE floor(CAST(regexp_extract(s, '^[0-9.]+') AS DOUBLE) * CASE p_partkey % 8 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 WHEN 2 THEN 1073741824 WHEN 5 THEN 1048576 ELSE 1 END + 0.5) END AS BIGINT) AS rate FROM s""")
def parse_bandwidth(spark, d):
    i = F.col("p_partkey") % 8
    unit = F.when(i == 0, "kb").when(i == 1, "MB/s").when(i == 2, " g").when(i == 3, "b/s").when(i == 4, "").when(i == 5, ".5mb").when(i == 6, "tb").otherwise("x")
    return table(spark, d, "part").select("p_partkey", scalars.parse_bandwidth(F.concat(F.col("p_size").cast("string"), unit)).alias("rate"))


_PATHS = "CASE page_id % 6 WHEN 0 THEN '/' || url WHEN 1 THEN '../' || page_id WHEN 2 THEN 'a./b' WHEN 3 THEN '' WHEN 4 THEN repeat('p', 1025) ELSE 'docs/' || page_id END"


@query(f"SELECT page_id, length(p) BETWEEN 1 AND 1024 AND NOT starts_with(p, '/') AND NOT contains(p, '../') AND NOT contains(p, './') AS valid FROM (SELECT page_id, {_PATHS} AS p FROM pages)")
def path_valid(spark, d):
    p = F.expr(_PATHS.replace("page_id THEN", "cast(page_id as string) THEN"))
    return table(spark, d, "pages").select("page_id", scalars.path_is_valid(p).alias("valid"))


def _headers():
    return F.concat(F.when(F.col("event_id") % 3 == 1, "01-").otherwise(" 00-"), F.md5("props"), F.when(F.col("event_id") % 3 == 2, "-0123-01").otherwise("-0123456789abcdef-00"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN md5(props) END AS trace_id, CASE WHEN event_id % 3 = 0 THEN '0123456789abcdef' END AS span_id, CASE WHEN event_id % 3 = 0 THEN '00' END AS flags,
  CASE WHEN event_id % 3 = 0 THEN '00-' || md5(props) || '-0123456789abcdef-00' END AS formatted FROM events""")
def traceparent(spark, d):
    t = scalars.trace_parent(_headers())
    return table(spark, d, "events").select("event_id", t["trace_id"].alias("trace_id"), t["span_id"].alias("span_id"), t["flags"].alias("flags"), scalars.format_trace(t).alias("formatted"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '00-' || md5(props) || '-0123456789abcdef-00' ELSE '00-' || substr(sha256('e' || event_id), 1, 32) || '-' || substr(sha256('e' || event_id), 33, 16) || '-01' END AS context FROM events""")
def trace_context(spark, d):
    fresh = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", scalars.format_trace(scalars.trace_context(_headers(), fresh)).alias("context"))


from siltstone.plans import state  # noqa: E402, F401  registers its queries
