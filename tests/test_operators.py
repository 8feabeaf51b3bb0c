"""Known answers for operators on frames of our own, and random ranges against plain Python."""

import hashlib
import random

import pytest

from tallyport.functions.dialect import DUCK, SPARK
from tallyport.operators import images
from tallyport.plans import load, registry  # noqa: F401


def run(name, spark, **frames):
    return registry.run(name, spark, **frames)


def manifests(spark, rows):
    return spark.createDataFrame([(k, n, c, -(-n // c) if c else 0, "O", "A") for k, n, c in rows], "manifest_id long, total_bytes long, chunk_size long, total_chunks long, status string, transport string")


def test_plan_sizes_and_limits(spark):
    got = run("plan_chunks", spark, manifests=manifests(spark, [(1, 600 * 1024, 256 * 1024), (2, 10, 256 * 1024), (3, 0, 256 * 1024), (4, -1, 256 * 1024), (5, 100, 1024)])).collect()
    assert sorted((r.manifest_id, r.chunk_index, r.size_bytes // 1024) for r in got) == [(1, 0, 256), (1, 1, 256), (1, 2, 88), (2, 0, 0)]


def test_ranges_merge_like_a_loop(spark):
    rng = random.Random(1)
    rows = [(k, a := rng.randint(0, 30), a + rng.randint(-1, 5)) for k in range(60) for _ in range(rng.randint(1, 9))]
    got = {}
    for r in run("merge_ranges", spark, ranges=spark.createDataFrame(rows, "record_id long, start_index long, end_index long")).collect():
        got.setdefault(r.record_id, set()).update(range(r.start_index, r.end_index + 1))
        got.setdefault(("n", r.record_id), []).append((r.start_index, r.end_index))
    for k in range(60):
        want = {x for i, a, b in rows if i == k for x in range(a, b + 1)}
        assert got.get(k, set()) == want
        spans = sorted(got.get(("n", k), []))
        assert all(b + 1 < c for (_, b), (c, _) in zip(spans, spans[1:]))


def receipts(spark, rows):
    return spark.createDataFrame(rows, "manifest_id long, chunk_index long, position long, size_bytes long, transport string, part_number long, etag string")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(0, 0, 256), (1, 1, 256), (2, 2, 88)], (0, 0, 0, 0, True)),
        ([(0, 0, 256), (1, 1, 256)], (0, 0, 0, 1, False)),
        ([(0, 0, 256), (0, 1, 256), (1, 2, 256), (2, 3, 88)], (0, 1, 0, 0, False)),
        ([(0, 0, 256), (1, 1, 1), (2, 2, 88), (9, 3, 5)], (1, 0, 1, 0, False)),
    ],
)
def test_receipt_faults(spark, rows, want):
    frame = receipts(spark, [(1, c, p, n * 1024, "A", c + 1, "e") for c, p, n in rows])
    r = run("verify_receipts", spark, manifests=manifests(spark, [(1, 600 * 1024, 256 * 1024)]), receipts=frame).collect()[0]
    assert (r.outside, r.duplicates, r.wrong_size, r.missing, r.ok) == want


def test_next_chunk_and_remaining(spark):
    frames = {"manifests": manifests(spark, [(1, 4 * 262144, 262144)]), "receipts": receipts(spark, [(1, 0, 0, 262144, "A", 1, "e"), (1, 1, 1, 262144, "A", 2, "e")])}
    assert run("next_incomplete", spark, **frames).collect()[0].next_index == 2
    plan = run("plan_chunks", spark, manifests=frames["manifests"])
    assert sorted(r.chunk_index for r in run("remaining_chunks", spark, plan=plan, **frames).collect()) == [2, 3]


def test_upserts_take_every_change(spark):
    records = spark.createDataFrame([(f"r{k}", "active") for k in range(4)], "record_id string, status string")
    changes = spark.createDataFrame([("r0", 0, "paused"), ("r0", 1, None), ("r1", 1, "paused"), ("r1", 0, None), ("r9", 0, "paused")], "record_id string, position long, status string")
    assert sorted(tuple(r) for r in run("resume_upsert", spark, resume_records=records, changes=changes).collect()) == [("r1", "paused"), ("r2", "active"), ("r3", "active"), ("r9", "paused")]
    old = spark.createDataFrame([(1, "d0", 0), (1, "d1", 1)], "group_id long, derivative_id string, position long")
    new = spark.createDataFrame([(1, "d1", 0), (1, "d4", 1), (2, "d0", 2)], "group_id long, derivative_id string, position long")
    got = sorted((r.group_id, r.derivative_id, r.position, r.changed, r.error) for r in registry.run("derivative_upsert", spark, {"replace_existing": True}, derivatives=old, new=new).collect())
    assert got == [(1, "d0", 0, False, None), (1, "d1", 1, True, None), (1, "d4", 2, True, None), (2, "d0", 0, True, None)]


def test_change_feeds_cover_their_tables(spark, data):
    assert registry.frame(spark, data, "resume_changes").count() == registry.frame(spark, data, "lineitem").count()
    assert registry.frame(spark, data, "new_derivatives").count() == registry.frame(spark, data, "derivatives").count()


def test_legacy_receipts_follow_the_schema_version(spark):
    versions = {1: "v0.1", 4: "v9", 5: "v0.2", 8: "v0.1"}
    records = spark.createDataFrame(list(versions.items()), "manifest_id long, schema_version string")
    ranges = spark.createDataFrame([(k, 0, 1) for k in versions], "manifest_id long, start_index long, end_index long")
    plan = run("plan_chunks", spark, manifests=manifests(spark, [(k, 2 * 262144, 262144) for k in versions])).selectExpr("manifest_id", "chunk_index", "chunk_index * 262144 AS start_byte", "(chunk_index + 1) * 262144 AS end_byte")
    got = run("hydrate_legacy", spark, ranges=ranges, resume_records=records, plan=plan).collect()
    assert sorted((r.manifest_id, r.chunk_index) for r in got) == [(1, 0), (1, 1), (8, 0), (8, 1)]


def test_header_list_reads_the_whole_text(spark):
    headers = spark.createDataFrame([(1, " creation, ,a-text-of-more-than-20-characters , second ,termination,")], "header_id long, header string")
    assert run("header_list", spark, headers=headers).collect()[0].entries == "creation|a-text-of-more-than-20-characters|second|termination"


def test_digests(spark):
    files = spark.createDataFrame([(1, "a.tif", 3, "image/tiff", 5, "abc"), (2, "b", 0, "", None, "")], "file_id long, name string, size_bytes long, media_type string, last_modified long, content string")
    got = {r.file_id: r.sha256 for r in run("file_sha256", spark, files=files).collect()}
    assert got[1].startswith("ba7816bf") and got[2].startswith("e3b0c442")
    prints = {r.file_id: r.fingerprint for r in run("fingerprint", spark, files=files).collect()}
    assert prints == {1: hashlib.sha256(b"a.tif:3:image/tiff:5").hexdigest(), 2: hashlib.sha256(b"b:0::unknown").hexdigest()}

    def loop(text):
        h = 5381
        for c in text:
            h = ((h * 33) ^ ord(c)) & 0xFFFFFFFF
        return f"fast-{h:08x}"

    assert {r.file_id: r.fingerprint for r in run("fallback_hash", spark, files=files).collect()} == {1: loop("a.tif:3:image/tiff:5"), 2: loop("b:0::unknown")}


def test_extension(spark):
    names = ["x.TIF", "x.", "x", ".tif", "a.b.PnG"]
    files = spark.createDataFrame(list(enumerate(names)), "file_id long, name string")
    assert [r.extension for r in run("extension", spark, files=files).orderBy("file_id").collect()] == ["tif", None, None, "tif", "png"]


def test_safe_path(spark):
    paths = {"a/b": True, "../x": False, "a/../../x": False, "a/../b": True, "/abs": False, ".": False, "": False, "a/..": False, "./a": True}
    frame = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "session_id long, target string")
    assert {r.target: r.safe for r in run("safe_path", spark, sessions=frame).collect()} == paths


def test_sanitize(spark):
    rows = [(1, "see HTTPS://x/y"), (2, "Resume Token bad"), (3, "plain"), (4, "presigned url")]
    frame = spark.createDataFrame(rows, "event_id long, message string")
    assert [r.message for r in run("sanitize", spark, ingest_events=frame).orderBy("event_id").collect()] == ["Error details redacted."] * 2 + ["plain", "Error details redacted."]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_tiff_directories(order, big):
    data = images.made(640, 480, [8, 8, 16], order, big, copies=3, tiled=True)
    assert list(images.directories(data)) == [{"width": 640, "height": 480, "bits": 16, "tiled": True}] * 3
    for broken, why in ((data[:9], "truncated"), (b"PNG" + data, "header"), (data[:2] + b"\0\1" + data[4:], "header")):
        with pytest.raises(ValueError, match=why if not (big and why == "truncated") else "header"):
            list(images.directories(broken))


def test_tiff_loop_ends():
    data = bytearray(images.made(1, 1, [8], copies=1))
    data[-4:] = (8).to_bytes(4, "little")
    with pytest.raises(ValueError, match="directories"):
        list(images.directories(bytes(data)))


def test_dialects_agree_on_names():
    assert {n for n in dir(SPARK) if not n.startswith("_")} == {n for n in dir(DUCK) if not n.startswith("_")}
