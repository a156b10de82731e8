"""Kernels, deltas, codecs, stores, client state, limits, scalars and streams."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.functions import scalars
from siltstone.operators import chunking, client, codecs, delta, limits, store
from siltstone.sources import files


def congruential(n, seed):
    out = bytearray()
    for _ in range(n):
        seed = (seed * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append(seed & 255)
    return bytes(out)


def test_chunks_cover_and_agree():
    data = congruential(300 * 1024, 42)
    ends = chunking.cdc_ends(data, chunking.server_profile(2048))
    assert [b - a for a, b in zip([0, *ends], ends)] == [131072, 131072, 45056]
    r = random.Random(1)
    many = [bytes(r.randrange(256) for _ in range(r.choice((0, 1, 255, 256, 257, 3000, 20000)))) for _ in range(60)]
    for p in (chunking.web_profile(64), chunking.web_profile(1024), chunking.Profile(10, 64, 100)):
        assert chunking.cdc_ends_many(many, p) == [chunking.cdc_ends(x, p) for x in many]


def test_adaptive_size(spark):
    sizes = [0, 1024, 32767, 32768, 262143, 262144, 10485759, 10485760]
    got = spark.createDataFrame([(s,) for s in sizes], "s long").select(chunking.adaptive_size(F.col("s"))).collect()
    assert [r[0] for r in got] == [0, 0, 0, 4096, 4096, 16384, 16384, 65536]


def test_fixed_signatures(spark):
    df = spark.createDataFrame([(1, bytearray(b"a" * 1000)), (2, bytearray())], "id long, content binary")
    got = chunking.signatures(df, "content", "id", mode="fixed", size=256).orderBy("block_index").collect()
    assert [(r.offset, r.length) for r in got] == [(0, 256), (256, 256), (512, 256), (768, 232)]
    assert got[0].weak_hash == zlib.adler32(b"a" * 256)


def naive_fixed(new, old, size):
    blocks = [old[i : i + size] for i in range(0, len(old), size)]
    ops, at, start = [], 0, 0
    while at + size <= len(new):
        if new[at : at + size] in blocks:
            if at > start:
                ops.append(("literal", None, start, at - start))
            ops.append(("copy", blocks.index(new[at : at + size]), at, size))
            at = start = at + size
        else:
            at += 1
    if start < len(new) or not new:
        ops.append(("literal", None, start, len(new) - start))
    return ops


def test_fixed_delta():
    r = random.Random(3)
    for _ in range(60):
        old = bytes(r.randrange(3) for _ in range(r.randint(0, 400)))
        new = old[: r.randint(0, 200)] + bytes(r.randrange(3) for _ in range(r.randint(0, 9))) + old[r.randint(0, 200) :]
        assert delta.fixed_delta(new, old, 16) == naive_fixed(new, old, 16)
    assert delta.fixed_delta(b"", b"", 16, web=True) == []


def test_patch_rebuilds(spark):
    old, new = congruential(5000, 5), congruential(2000, 5) + b"MUTATED" + congruential(5000, 5)[2000:]
    df = spark.createDataFrame([(1, bytearray(old), bytearray(new))], "id long, old binary, new binary")
    for size in (64, 256):
        ops = delta.fixed_ops(df, "id", "new", "old", size)
        out = delta.patch(df, df, ops, chunking.with_fixed(df, "old", size, "id"), "id", "old", "new").first()
        assert bytes(out.content) == new
    sig = lambda c: chunking.signatures(df, c, "id", mode="cdc", size=256, profile="web")
    s = delta.stats(delta.chunk_ops(sig("new"), sig("old"), "id"), "id").first()
    assert s.total_new_bytes == len(new) == s.copied_bytes + s.literal_bytes


def test_manifest_codec():
    rows = [{"block_index": i, "offset": i * 4096, "length": 4096, "weak_hash": i, "strong_hash": f"{i:064x}"} for i in range(50)]
    data = codecs.manifest_encode(rows)
    assert len(data) == 8 + 44 * 50 and codecs.manifest_decode(data) == rows and codecs.manifest_decode(codecs.manifest_encode([])) == []
    with pytest.raises(ValueError, match="Invalid chunk manifest magic"):
        codecs.manifest_decode(b"nope" + data)
    with pytest.raises(ValueError, match="Truncated chunk manifest"):
        codecs.manifest_decode(data[:-1])


def test_op_codecs():
    ops = [codecs._op(0, 7, 0), codecs._op(1, 0, 4000000000), codecs._op(0, 0, 0)]
    one, two = codecs.ops1_encode(ops), codecs.ops2_encode(ops, 4096, "ab" * 32, 99)
    assert codecs.ops_decode(one) == ops == codecs.ops_decode(two)
    assert codecs.ops2_decode(two)["content_sha256"] == "ab" * 32 and codecs.ops2_decode(two)["new_size"] == 99
    for bad in (b"", one[:-1], one + b"x", b"DSO1\1\0\0\0\5", two[:70]):
        with pytest.raises(ValueError):
            codecs.ops_decode(bad)


def test_frames():
    raw = codecs.frame(codecs.DATA, b"Payload 1", bytes(range(32))) + codecs.frame(codecs.DATA, b"Payload 2 is slightly longer", bytes(32)) + codecs.frame(codecs.END)
    p, got = codecs.FrameParser(), []
    for i in range(0, len(raw), 7):
        got += p.push(raw[i : i + 7])
    assert [x[2] for x in got] == [b"Payload 1", b"Payload 2 is slightly longer", b""] and p.pending == b""


def test_reference_counts(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    cas = spark.createDataFrame([], "strong_hash string, ref_count long, byte_size long, first_seen_at timestamp, last_referenced_at timestamp")
    h = spark.createDataFrame([("h1", 4096), ("h2", 8192), ("h1", 4096)], "strong_hash string, byte_size long")
    cas = store.register(cas, h, at)
    assert {r.strong_hash: r.ref_count for r in cas.collect()} == {"h1": 2, "h2": 1}
    gone = store.dereference(cas, spark.createDataFrame([("h1",)] * 3, "strong_hash string"), at)
    assert {r.strong_hash: r.ref_count for r in gone.collect()} == {"h1": 0, "h2": 1}
    assert [r.strong_hash for r in store.sweepable(gone, F.lit("2024-01-03").cast("timestamp")).collect()] == ["h1"]
    assert store.sweepable(gone, F.lit("2024-01-01 12:00:00").cast("timestamp")).count() == 0


@pytest.mark.parametrize(("n", "keep", "current", "left"), [(5, 10, 5, [5, 4, 3, 2, 1]), (15, 10, 15, list(range(15, 5, -1))), (10, 3, 1, [10, 9, 8, 1]), (12, 5, None, [12, 11, 10, 9, 8])])
def test_retention(spark, n, keep, current, left):
    v = spark.createDataFrame([("f", i, i) for i in range(1, n + 1)], "file_id string, version_id long, version_no long")
    f = spark.createDataFrame([("f", current)], "file_id string, current_version_id long")
    gone = {r.version_no for r in store.prunable(v, f, keep).collect()}
    assert sorted(set(range(1, n + 1)) - gone, reverse=True) == left


def test_commit(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    f = spark.createDataFrame([("a", "v1", 5), ("b", "v9", 5)], "file_id string, current_version_id string, total_size long")
    v = spark.createDataFrame([("a", "v1", 1), ("b", "v9", 3)], "file_id string, version_id string, version_no int")
    n = spark.createDataFrame([("a", "v1", "v2", 7, "x"), ("b", "old", "v10", 7, "y"), ("c", None, "v0", 3, "z")], "file_id string, snapshot_version_id string, version_id string, size long, content_sha256 string")
    cas = spark.createDataFrame([], "strong_hash string, ref_count long, byte_size long, first_seen_at timestamp, last_referenced_at timestamp")
    c = spark.createDataFrame([("v2", "h", 7), ("v2", "h", 7), ("v10", "k", 7)], "version_id string, strong_hash string, length long")
    out = store.commit(f, v, cas, n, c, at)
    assert [r.file_id for r in out["rejected"].collect()] == ["b"]
    assert {(r.file_id, r.version_no) for r in out["versions"].collect()} == {("a", 1), ("b", 3), ("a", 2), ("c", 1)}
    assert {r.file_id: r.current_version_id for r in out["files"].collect()} == {"a": "v2", "b": "v9", "c": "v0"}
    assert {r.strong_hash: r.ref_count for r in out["cas"].collect()} == {"h": 2}
    assert out["jobs"].count() == out["events"].count() == 2


def test_version_chunks_and_inventory(spark, tmp_path):
    v = spark.createDataFrame([("v1", 10, 4), ("v2", 10, 4)], "version_id string, size long, block_size int")
    m = spark.createDataFrame([("v1", 0, 0, 10, 1, "a")], "version_id string, block_index int, offset long, length long, weak_hash long, strong_hash string")
    b = spark.createDataFrame([("v2", i, 1, "b") for i in range(3)] + [("v1", 0, 1, "z")], "version_id string, block_index int, weak_hash long, strong_hash string")
    got = {(r.version_id, r.offset, r.length) for r in store.version_chunks(v, m, b).collect()}
    assert got == {("v1", 0, 10), ("v2", 0, 4), ("v2", 4, 4), ("v2", 8, 2)}
    (tmp_path / "inv.csv").write_text('bucket,"ab/abc",1\nbucket,"temp-1",1\n\nbucket," cd/cde ",2\n')
    keys = files.read_inventory(spark, str(tmp_path / "inv.csv"))
    assert {r.key for r in keys.collect()} == {"ab/abc", "cd/cde"}
    refs = spark.createDataFrame([("abc",)], "strong_hash string")
    assert [r.strong_hash for r in store.orphans(keys, refs).collect()] == ["cde"]


def test_limits():
    def run(f, events):
        s, out = f.start(), []
        for e in events:
            s, x = f.step(s, *e)
            out.append(x)
        return out

    assert run(limits.Requests(60), [(0, 0)] * 61 + [(60_000, 0), (60_001, 0)]) == [True] * 60 + [False, False, True]
    assert run(limits.Bytes(500), [(0, 900), (1, 1), (60_001, 500), (60_002, 1)]) == [True, False, True, False]
    assert run(limits.TokenBucket(50 * 1024), [(0, 100 * 1024), (0, 10 * 1024), (0, 200 * 1024), (0, 0)]) == [0, 200, None, 0]
    assert run(limits.Concurrency(4), [(100, 503), (100, 200), (100, 200), (100, 200), (100, 200), (100, 200), (900, 200)]) == [3, 3, 3, 3, 3, 4, 4]


def test_scalars(spark):
    cases = {"": 0, None: 0, "1024": 1024, "500b": 500, "500b/s": 500, "64kb": 65536, "5MB/s": 5242880, "10m": 10485760, "1gb/s": 1073741824, "2.5mb": 2621440, "fast": 0, "MB/s": 0, "1.2.3k": 0}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", scalars.parse_bandwidth(F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in got} == cases
    ok = spark.createDataFrame([("a/b.txt",), ("/a",), ("../a",), ("a./b",), ("",), (None,)], "p string").select(scalars.path_is_valid(F.col("p"))).collect()
    assert [r[0] for r in ok] == [True, False, False, False, False, False]


def test_session_and_queue(spark):
    e = spark.createDataFrame([("f", 1, None, None, 50000, 0, 0, "pending"), ("f", 2, "h", "n", 0, 10, 3, "uploading"), ("f", 3, None, None, 0, 0, 10, "committed")], "path string, at long, content_hash string, negotiation_id string, file_size long, total_chunks long, uploaded_chunks long, state string")
    r = client.session_fold(e, ["path"], ["at"]).first()
    assert (r.content_hash, r.file_size, r.total_chunks, r.uploaded_chunks, r.state) == ("h", 50000, 10, 10, "committed")
    q = spark.createDataFrame([(1, 0, None, None), (2, 4, None, None)], "id long, attempts int, processed_at timestamp, last_error string")
    got = client.outbox_transition(q, F.lit(False), F.lit("bad"), F.lit("2024-01-01").cast("timestamp")).orderBy("id").collect()
    assert [(x.attempts, x.processed_at is not None, "[DLQ]" in x.last_error) for x in got] == [(1, False, False), (5, True, True)]


def test_streams(spark, tmp_path):
    from siltstone.streaming import stateful

    spark.createDataFrame([(1, i, 0, 0) for i in range(5)] + [(2, 9, 0, 0)], "user_id long, request_id long, at_ms long, bytes long").write.parquet(f"{tmp_path}/r")
    live = spark.readStream.schema("user_id long, request_id long, at_ms long, bytes long").parquet(f"{tmp_path}/r")
    q = stateful.limit_stream(live, limits.Requests(3)).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination(120)
    assert {(r.user_id, r.request_id): r.allowed for r in spark.table("limited").collect()} == {(1, 0): True, (1, 1): True, (1, 2): True, (1, 3): False, (1, 4): False, (2, 9): True}
    q = stateful.limit_stream(live, limits.Requests(3), 3_600_000).writeStream.format("memory").queryName("idle").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c3").start()
    q.awaitTermination(120)
    assert spark.table("idle").where("allowed").count() == 4
    raw = codecs.frame(codecs.DATA, b"hello", bytes(32)) + codecs.frame(codecs.END)
    spark.createDataFrame([("c", i, bytearray(raw[i : i + 7])) for i in range(0, len(raw), 7)], "connection string, seq long, data binary").write.parquet(f"{tmp_path}/f")
    live = spark.readStream.schema("connection string, seq long, data binary").parquet(f"{tmp_path}/f")
    q = stateful.parse_frames(live).writeStream.format("memory").queryName("frames").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.awaitTermination(120)
    assert [(r.kind, bytes(r.payload)) for r in spark.table("frames").collect()] == [(1, b"hello"), (3, b"")]


def test_dispatch(spark, tmp_path):
    from siltstone.streaming import stateful

    schema = "id long, processed_at timestamp, attempts int"
    spark.createDataFrame([(1, None, 0), (2, None, 6), (3, None, 5)], schema).write.parquet(f"{tmp_path}/e")
    seen = []
    q = stateful.dispatch(spark.readStream.schema(schema).parquet(f"{tmp_path}/e"), lambda df, i: seen.extend(r.id for r in df.collect()), f"{tmp_path}/c", once=True)
    q.awaitTermination(120)
    assert sorted(seen) == [1, 3]


def test_chunks_of_parts_and_wide_masks():
    r = random.Random(2)
    files_ = [r.randbytes(n) for n in (0, 1, 5000, 70000, 300000)]
    for p in (chunking.web_profile(64), chunking.server_profile(16384), chunking.server_profile(1 << 17), chunking.Profile(0, 64, 64)):
        assert chunking.cdc_ends_many(files_, p) == [chunking.cdc_ends(f, p) for f in files_]
        for f in files_:
            for size in (999, 65536):
                c, out = chunking.Cutter(p), []
                for i in range(0, len(f), size):
                    out += c.push(f[i : i + size])
                out += c.end()
                ends = [sum(map(len, out[: i + 1])) for i in range(len(out))]
                assert b"".join(out) == f and ends == chunking.cdc_ends(f, p)


def test_files_in_windows(spark, tmp_path):
    import hashlib

    data = bytes(i * 31 & 255 for i in range(256 * 1024)) + random.Random(4).randbytes(300_000)
    paths = []
    for i, d in enumerate((data, b"", data[:1000])):
        (tmp_path / f"f{i}").write_bytes(d)
        paths.append((f"{'file://' * (i % 2)}{tmp_path}/f{i}",))
    df = spark.createDataFrame(paths, "path string")
    got = {r.path: (r.bytes, r.sha256) for r in chunking.file_hashes(df).collect()}
    assert got == {p: (len(d), hashlib.sha256(d).hexdigest()) for (p,), d in zip(paths, (data, b"", data[:1000]))}
    for mode, size in (("cdc", 2048), ("fixed", 4096)):
        rows = sorted(chunking.file_signatures(df, mode, size, window=50_000).where(F.col("path") == paths[0][0]).collect(), key=lambda r: r.block_index)
        ends = chunking.cdc_ends(data, chunking.windowed_profile(size)) if mode == "cdc" else [*range(size, len(data), size), len(data)]
        assert [r.offset + r.length for r in rows] == ends and [r.offset for r in rows] == [0, *ends[:-1]]
        assert all(r.strong_hash == hashlib.sha256(data[r.offset : r.offset + r.length]).hexdigest() and r.weak_hash == zlib.adler32(data[r.offset : r.offset + r.length]) for r in rows)
    assert chunking.file_signatures(df, "cdc", 2048).where(F.col("path") == paths[1][0]).count() == 0
    whole = files.read_files(spark, str(tmp_path), "f*").select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    assert {r.name: r.bytes for r in chunking.scan_report(whole, "content", chunking.server_profile(2048), "name").collect()} == {"f0": len(data), "f2": 1000}  # Spark's reader leaves out files of no bytes


def test_files_written_in_order(spark, tmp_path):
    import hashlib

    rows = [("a/b", i, bytes([65 + i]) * 3) for i in range(9)] + [("c", 0, b"x"), (None, 0, b"y")]
    df = spark.createDataFrame(rows, "path string, i int, piece binary").repartition(3)
    got = {r.key: (r.bytes, r.sha256) for r in files.write_files(df, "path", "i", "piece", f"{tmp_path}/out").collect()}
    text = b"".join(x for _, _, x in rows[:9])
    assert got == {"a/b": (27, hashlib.sha256(text).hexdigest()), "c": (1, hashlib.sha256(b"x").hexdigest())}
    assert (tmp_path / "out/a/b").read_bytes() == text and (tmp_path / "out/c").read_bytes() == b"x"


def test_literals_keep_their_encoding(spark):
    import gzip

    small = gzip.compress(b"z" * 10)  # begins as gzip data does, and isn't to be unpacked
    df = spark.createDataFrame([(1, bytearray(b"q" * 2000)), (2, bytearray(small)), (3, None), (4, bytearray())], "id long, data binary").select("id", "data", files.compress_literals("data").alias("z"))
    got = {r.id: (r.e, r.same) for r in df.select("id", F.col("z.encoding").alias("e"), files.decompress_literals("z.data", "z.encoding").eqNullSafe(F.col("data")).alias("same")).collect()}
    assert got == {1: ("gzip", True), 2: (None, True), 3: (None, True), 4: (None, True)}


def test_codec_columns(spark):
    ops = [("copy", 3, None, None), ("literal", None, 0, 3_000_000_000), ("copy", 4_000_000_000, None, None)]
    df = spark.createDataFrame([(1, ops, 4096, "ab" * 32, 3_999_999_999), (2, [], 1, None, 0), (3, None, 1, None, 0)], "id long, ops array<struct<kind:string,block_index:long,literal_offset:long,literal_length:long>>, block_size long, digest string, new_size long")
    one = df.select("id", codecs.decode_ops(codecs.encode_ops1("ops")).alias("x"))
    two = df.select("id", codecs.decode_ops2(codecs.encode_ops2("ops", "block_size", "digest", "new_size")).alias("x"))
    assert [[tuple(o) for o in r.x] if r.x is not None else None for r in one.orderBy("id").collect()] == [ops, [], None]
    two = two.orderBy("id").collect()
    assert [tuple(o) for o in two[0].x.ops] == ops and (two[0].x.block_size, two[0].x.content_sha256, two[0].x.new_size) == (4096, "ab" * 32, 3_999_999_999) and two[1].x.content_sha256 == "00" * 32 and two[2].x is None
    chunk = [(0, 0, 4_000_000_000, 3_000_000_000, "cd" * 32)]
    m = spark.createDataFrame([(chunk,)], "c array<struct<block_index:int,offset:long,length:long,weak_hash:long,strong_hash:string>>")
    assert [tuple(x) for x in m.select(codecs.decode_manifest(codecs.encode_manifest("c")).alias("c")).first().c] == chunk
    bad = spark.createDataFrame([(bytearray(b"nope"),), (None,)], "b binary").select(codecs.ops_error("b").alias("o"), codecs.manifest_error("b").alias("m")).collect()
    assert (bad[0].o, bad[0].m, bad[1].o, bad[1].m) == ("Invalid ops magic", "Invalid chunk manifest magic", None, None)


def test_first_upload_is_one_literal(spark):
    new = congruential(5000, 9)
    df = spark.createDataFrame([(1, bytearray(new)), (2, bytearray()), (3, bytearray(b"abc"))], "id long, new binary")
    old = spark.createDataFrame([(3, bytearray(b"abc"))], "id long, old binary")
    sizes = df.select("id", F.octet_length("new").alias("size"))
    sig = lambda d, c: chunking.signatures(d, c, "id", mode="cdc", size=256, profile="web")
    for web in (False, True):
        got = sorted((r.id, r.op_index, r.kind, r.literal_offset, r.length) for r in delta.chunk_ops(sig(df, "new"), sig(old, "old"), "id", sizes, web).collect())
        assert got == [(1, 0, "literal", 0, 5000)] + ([] if web else [(2, 0, "literal", 0, 0)]) + [(3, 0, "copy", None, 3)]
    packed = {r.id: (codecs.ops_decode(bytes(r.ops)), bytes(r.literals)) for r in delta.pack_delta(df, chunking.signatures(old, "old", "id", size=1024), "id", "new", 1024).collect()}
    assert packed[1] == ([codecs._op(1, 0, 5000)], new) and packed[2] == ([codecs._op(1, 0, 0)], b"") and packed[3] == ([codecs._op(0, 0, 0)], b"")


def test_materialise(spark):
    import hashlib

    ops = spark.createDataFrame([("f", 0, "copy", 1, None, 4), ("f", 1, "literal", None, 0, 3), ("f", 2, "copy", 9, None, 4)], "id string, op_index int, kind string, copy_block int, literal_offset long, length long")
    prev = spark.createDataFrame([("f", 1, 4, 7, "h")], "id string, block_index int, length long, weak_hash long, strong_hash string")
    got = delta.materialise(ops, prev, spark.createDataFrame([("f", bytearray(b"abcd"))], "id string, blob binary"), "id").orderBy("block_index").collect()
    assert [(r.length, r.weak_hash, r.strong_hash, r.error) for r in got] == [(4, 7, "h", None), (3, zlib.adler32(b"abc"), hashlib.sha256(b"abc").hexdigest(), None), (None, None, None, "unknown block")]
    assert [r.offset for r in got][:2] == [0, 4]


def test_objects(spark, tmp_path):
    import hashlib

    h = lambda b: hashlib.sha256(b).hexdigest()
    new = spark.createDataFrame([(h(b"a"), bytearray(b"a")), (h(b"b"), bytearray(b"x")), (h(b"c"), bytearray(b"c")), (h(b"c"), bytearray(b"c"))], "strong_hash string, bytes binary")
    have = spark.createDataFrame([(h(b"a"),)], "strong_hash string")
    put = store.put_objects(have, new)
    assert [r.strong_hash for r in put.collect()] == [h(b"c")]
    files.write_objects(put, f"{tmp_path}/o")
    assert [(r.strong_hash, bytes(r.bytes)) for r in files.read_objects(spark, f"{tmp_path}/o").collect()] == [(h(b"c"), b"c")]
    chunks = spark.createDataFrame([("v", 0, h(b"c")), ("w", 0, h(b"none")), ("x", 0, h(b"b"))], "version_id string, block_index int, strong_hash string")
    got = {r.version_id: (r.content, r.error) for r in store.reconstruct(chunks, put.union(new.where(F.col("strong_hash") == h(b"b"))), "version_id").collect()}
    assert got == {"v": (b"c", None), "w": (None, "NOT_FOUND"), "x": (None, "CORRUPT_BLOCK")}
    files.write_json(chunks, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 3
    v = spark.createDataFrame([("f", "v1", 1), ("f", "v2", 2)], "file_id string, version_id string, version_no int")
    assert [r.version_no for r in store.current_version(spark.createDataFrame([("f", "v1")], "file_id string, current_version_id string"), v).collect()] == [1]
    state = spark.createDataFrame([("k", 1)], "key string, n int")
    assert [(r.key, r.n) for r in store.upsert(state, spark.createDataFrame([("k", 2), ("k", 3)], "key string, n int"), ["key"], "n").collect()] == [("k", 3)]


def test_collector_runs(spark):
    at = F.lit("2024-01-03").cast("timestamp")
    run = store.begin_run(F.lit(1), at, spark)
    assert [r.status for r in run.collect()] == ["running"]
    bad = store.failed_run(run, at, F.lit("lost"))
    assert [(r.status, r.error) for r in bad.collect()] == [("failed", "lost")]
    cas = spark.createDataFrame([("ab", 0, 1, None, None)], "strong_hash string, ref_count long, byte_size long, first_seen_at timestamp, last_referenced_at timestamp").withColumn("last_referenced_at", F.lit("2024-01-01").cast("timestamp"))
    out = store.collect_garbage(cas, at, F.lit(2))
    assert [r.key for r in out["deleted"].collect()] == ["ab/ab"] and out["cas"].count() == 0 and out["run"].first().deleted_count == 1


def test_sql_names(spark):
    scalars.register(spark)
    assert spark.sql("select adler32(cast('abc' as binary)) n").first().n == zlib.adler32(b"abc")
    data = codecs.manifest_encode([])
    assert spark.createDataFrame([(bytearray(data),)], "b binary").selectExpr("size(manifest_decode(b)) n").first().n == 0


def test_entry_has_sql_for_known_queries_only():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
