"""Known answers of the rules, on frames of our own: what a manifest, a receipt, a record or a derivative is refused for."""

import base64
import hashlib

import pytest

from tallyport.operators.rules import Rules
from tallyport.plans import load, registry  # noqa: F401
from tallyport.sources.files import concat_chunks

KB = 1024
CHUNK = 256 * KB


def run(name, spark, parameters=None, **frames):
    return registry.run(name, spark, parameters, **frames).collect()


def frame(spark, schema, *rows):
    """Rows as dictionaries over defaults: ``schema`` gives name, type and default of each column."""
    names = [n for n, _, _ in schema]
    data = [tuple({n: d for n, _, d in schema}[n] if n not in r else r[n] for n in names) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{n} {t}" for n, t, _ in schema))


STORED = [
    ("manifest_id", "long", 1), ("version", "string", "v1"), ("kind", "string", "original"), ("name", "string", "a.tif"), ("size_bytes", "long", 600 * KB), ("media_type", "string", "image/tiff"), ("preserved", "boolean", True), ("scope", "string", None),
    ("strategy", "string", "fixed-size"), ("inlined", "boolean", False), ("chunk_total", "long", 600 * KB), ("chunk_size", "long", CHUNK), ("total_chunks", "long", 3), ("valid", "boolean", True), ("total_bytes", "long", 600 * KB), ("transport", "string", "nas"),
    ("has_file", "boolean", True), ("actual_name", "string", "a.tif"), ("actual_bytes", "long", 600 * KB), ("actual_type", "string", "image/tiff"), ("modified", "string", None), ("actual_modified", "string", None), ("algorithm", "string", None), ("expected", "string", None), ("actual", "string", "ab"),
]
RECEIPTS = [
    ("manifest_id", "long", 1), ("chunk_index", "long", 0), ("position", "long", 0), ("size_bytes", "long", CHUNK), ("transport", "string", "nas"), ("part_number", "long", None), ("etag", "string", None), ("checksum", "string", None), ("location", "string", None),
    ("opaque", "string", None), ("completed_at", "string", "2026-01-01T00:00:00.000Z"),
]
WHOLE = [{"chunk_index": 0, "position": 0}, {"chunk_index": 1, "position": 1}, {"chunk_index": 2, "position": 2, "size_bytes": 88 * KB}]


def changed(k, **values):
    """The three receipts of a whole upload, with one changed."""
    return [{**r, **(values if i == k else {})} for i, r in enumerate(WHOLE)]


def issues(spark, stored=None, receipts=WHOLE, **parameters):
    rows = run("verify_integrity", spark, parameters, stored=frame(spark, STORED, stored or {}), receipts=frame(spark, RECEIPTS, *receipts))
    return [(r.code.split(".")[1], r.path) for r in sorted(rows, key=lambda r: r.place)]


@pytest.mark.parametrize(
    ("receipts", "want"),
    [
        (WHOLE, []),
        (WHOLE[:2], [("receipt_missing", "receipts"), ("receipt_incomplete", "receipts")]),
        ([*WHOLE, {"chunk_index": 1, "position": 3}], [("receipt_duplicate", "receipts[3].chunkIndex")]),
        ([*WHOLE, {"chunk_index": 9, "position": 3}], [("receipt_invalid", "receipts[3].chunkIndex")]),
        ([*WHOLE, {"chunk_index": None, "position": 3}], [("receipt_invalid", "receipts[3].chunkIndex")]),
        (changed(1, size_bytes=1), [("receipt_invalid", "receipts[1].sizeBytes"), ("receipt_incomplete", "receipts")]),
        (changed(1, size_bytes=-1), [("receipt_invalid", "receipts[1].sizeBytes"), ("receipt_missing", "receipts"), ("receipt_incomplete", "receipts")]),
        ([{"chunk_index": 1, "position": 7, "size_bytes": None}, *[{**r, "position": r["position"] + 8} for r in WHOLE]], [("receipt_invalid", "receipts[7].sizeBytes")]),  # a receipt without a size takes no place
        (changed(0, transport=""), [("receipt_invalid", "receipts[0].transport.name")]),
        (changed(2, transport="s3"), [("transport_mismatch", "receipts[2].transport.name")]),
    ],
)
def test_receipts(spark, receipts, want):
    assert issues(spark, receipts=receipts) == want
    ok = run("verify_receipts", spark, manifests=frame(spark, STORED, {}), receipts=frame(spark, RECEIPTS, *receipts))[0].ok
    assert ok == (not want)


def test_receipt_flags(spark):
    assert issues(spark, receipts=WHOLE[:2], allow_partial=True) == []
    proven = [{**WHOLE[0], "checksum": "c"}, *WHOLE[1:]]
    assert issues(spark, receipts=proven, require_chunk_checksums=True) == [("checksum_missing", f"receipts[{k}].checksum") for k in (1, 2)]
    summary = lambda **p: run("verify_receipts", spark, p, manifests=frame(spark, STORED, {}), receipts=frame(spark, RECEIPTS, *proven[:2]))[0]
    assert not summary().ok and summary(allow_partial=True).ok and summary(require_chunk_checksums=True, allow_partial=True).no_checksum == 1


@pytest.mark.parametrize(
    ("stored", "policy", "want"),
    [
        ({"version": "v2", "name": ""}, "off", [("manifest_schema_unsupported", "schemaVersion"), ("manifest_invalid", "original.name"), ("original_mismatch", "original.name")]),
        ({"kind": None}, "required", [("manifest_invalid", "original"), ("manifest_invalid", "manifest")]),
        ({"strategy": None}, "off", [("manifest_invalid", "chunking"), ("manifest_invalid", "manifest")]),
        ({"chunk_size": 0}, "off", [("manifest_invalid", "chunking")]),
        ({"total_chunks": 4}, "off", [("manifest_invalid", "chunking.totalChunks"), ("receipt_missing", "receipts")]),
        ({"actual_name": "b.tif", "actual_bytes": 5, "actual_type": "", "modified": "x", "actual_modified": "y"}, "off", [("original_mismatch", f"original.{x}") for x in ("name", "sizeBytes", "mediaType", "lastModifiedAt")]),
        ({"modified": "x"}, "off", []),
        ({}, "required", [("checksum_missing", "original.checksum")]),
        ({}, "when-present", []),
        ({"algorithm": "md5", "expected": "x"}, "when-present", [("checksum_unsupported", "original.checksum.algorithm")]),
        ({"algorithm": "sha256", "expected": "AB"}, "required", []),
        ({"algorithm": "sha256", "expected": "cd"}, "when-present", [("checksum_mismatch", "original.checksum.value")]),
        ({"algorithm": "sha256", "expected": "cd"}, "off", []),
        ({"algorithm": "sha256", "expected": "cd", "has_file": False, "actual_name": None}, "required", []),
    ],
)
def test_manifest_identity_and_checksum(spark, stored, policy, want):
    assert issues(spark, stored, policy=policy) == want


def test_safe_verification_keeps_every_issue(spark):
    frames = {"stored": frame(spark, STORED, {}), "receipts": frame(spark, RECEIPTS, *changed(1, size_bytes=1))}
    shown = run("safe_verification", spark, **frames)
    assert [(r.code, r.path, r.severity) for r in sorted(shown, key=lambda r: r.place)] == [("verification.receipt_invalid", "receipts[1].sizeBytes", "error"), ("verification.receipt_incomplete", "receipts", "error")]


def test_checksum_policy_and_stored_files(spark):
    good = hashlib.sha256(b"abc").hexdigest()
    rows = [(1, "abc", "sha256", good.upper()), (2, "abc", "sha256", "00"), (3, None, "sha256", "00"), (4, "abc", None, None), (5, "abc", "md5", "x")]
    files = spark.createDataFrame(rows, "file_id long, content string, algorithm string, expected string")
    of = lambda policy: [r.verdict.split(".")[-1] for r in sorted(run("verify_checksum", spark, {"policy": policy}, files=files))]
    assert of("required") == ["ok", "checksum_mismatch", "ok", "checksum_missing", "checksum_unsupported"]
    assert of("when-present") == ["ok", "checksum_mismatch", "ok", "ok", "checksum_unsupported"] and set(of("off")) == {"ok"}
    pairs = spark.createDataFrame([(47, 3, 3, "abc", good, True), (94, 3, 3, "abc", good, False), (3, 3, 4, "abc", good, True), (4, 3, 3, "abc", "00", True)], "file_id long, size_bytes long, actual_bytes long, content string, expected string, found boolean")
    assert {r.file_id: r.verdict.split(".")[-1] for r in run("verify_stored", spark, pairs=pairs)} == {47: "ok", 94: "file_not_found", 3: "original_mismatch", 4: "checksum_mismatch"}
    headers = spark.createDataFrame([(1, None, "", "c", "d"), (2, "a", "b", None, None), (3, None, None, None, "")], "response_id long, sha256 string, crc64nvme string, crc32c string, crc32 string")
    assert {r.response_id: (r.algorithm, r.value) for r in run("s3_checksum_pick", spark, headers=headers)} == {1: ("crc32c", "c"), 2: ("sha256", "a"), 3: (None, None)}


def test_chunks_are_bytes(spark):
    text = "aé😀\n" * 5
    files = spark.createDataFrame([(1, text), (2, "")], "file_id long, content string")
    data = text.encode()
    want = [data[k : k + 3] for k in range(0, len(data), 3)]
    p = {"size": 3}
    assert [r.body_hex for r in sorted(run("chunk_slice", spark, p, files=files), key=lambda r: r.chunk_index)] == [w.hex() for w in want]
    assert [r.sha256 for r in sorted(run("chunk_sha256", spark, p, files=files), key=lambda r: r.chunk_index)] == [hashlib.sha256(w).hexdigest() for w in want]
    progress = sorted(run("checksum_progress", spark, {"size": 64 * KB}, files=spark.createDataFrame([(1, "x" * 150 * KB)], "file_id long, content string")), key=lambda r: r.chunk_index)
    assert [(r.loaded // KB, r.chunks) for r in progress] == [(64, 3), (128, 3), (150, 3)]


def test_fallback_hash_of_any_text(spark):
    def loop(text):
        h = 5381
        units = text.encode("utf-16-le")
        for k in range(0, len(units), 2):
            h = ((h * 33) ^ int.from_bytes(units[k : k + 2], "little")) & 0xFFFFFFFF
        return f"fast-{h:08x}"

    names = ["a.tif", "Größe.tif", "水😀.tif"]
    files = spark.createDataFrame([(k, n, 3, "", None) for k, n in enumerate(names)], "file_id long, name string, size_bytes long, media_type string, last_modified long")
    assert [r.fingerprint for r in sorted(run("fallback_hash", spark, files=files))] == [loop(f"{n}:3::unknown") for n in names]


def test_rules_on_files(spark):
    files = spark.createDataFrame([(1, "a.tif", 0, "", None, None, 5), (2, "b.EXE", 50, "image/tiff", "L", 10, 10)], "file_id long, name string, size_bytes long, media_type string, lot_id string, width long, height long")
    rules = Rules(max_bytes=40, types=("image/tiff",), extensions=("tif",), required=(("lot_id", "metadata.lotId"),), dimensions=True, min_width=20)
    got = [(r.file_id, r.code, r.path) for r in sorted(run("validate_files", spark, {"rules": rules}, files=files), key=lambda r: (r.file_id, r.ordinal))]
    assert got == [(1, "file.empty", "file.size"), (1, "file.mime_not_allowed", "file.type"), (1, "metadata.required_missing", "metadata.lotId"), (1, "image.dimensions_unavailable", "image"), (2, "file.too_large", "file.size"), (2, "file.extension_not_allowed", "file.name"), (2, "image.width_too_small", "image.width")]
    assert [(r.file_id, r.ok) for r in run("result_ok", spark, {"rules": Rules()}, files=files.filter("file_id = 2"))] == [(2, True)]


def test_upload_metadata(spark):
    rows = [(1, 0, "filename", "my scan.tif"), (1, 1, "lot", None), (1, 2, "scanner", "Größe"), (2, 0, "lot no", "x"), (3, 0, "lot no", None), (4, 0, "long", "y" * 300)]
    got = {r.file_id: (r.header, r.error) for r in run("tus_metadata", spark, entries=spark.createDataFrame(rows, "file_id long, position long, entry string, value string"))}
    code = lambda x: base64.b64encode(x.encode()).decode()
    assert got == {1: (f"filename {code('my scan.tif')},scanner {code('Größe')}", None), 2: (None, "transport.failed"), 3: (None, None), 4: (f"long {code('y' * 300)}", None)}


def test_upload_metadata_of_maps(spark):
    maps = ["map('filename', 'my scan.tif', 'lot', NULL, 'scanner', 'Größe')", "map('lot no', 'x')", "map('lot no', CAST(NULL AS STRING))", "CAST(map() AS MAP<STRING, STRING>)", "CAST(NULL AS MAP<STRING, STRING>)", "map('b', '1', 'a', '')"]
    uploads = spark.sql(" UNION ALL ".join(f"SELECT {k} AS file_id, {m} AS metadata" for k, m in enumerate(maps, 1)))
    got = {r.file_id: (r.header, r.error) for r in run("tus_metadata_map", spark, uploads=uploads)}
    code = lambda x: base64.b64encode(x.encode()).decode()
    assert got == {1: (f"filename {code('my scan.tif')},scanner {code('Größe')}", None), 2: (None, "transport.failed"), 3: (None, None), 4: (None, None), 5: (None, None), 6: (f"b {code('1')},a ", None)}


def test_retry_delay_and_policy(spark):
    rows = [(1, 1, 250.0, 2.0, 900.0, "none", 0.5), (2, 3, 250.0, 2.0, 900.0, "none", 0.5), (3, 3, 250.0, 2.0, 900.0, "full", 0.5), (4, 5, None, None, None, None, None)]
    retries = spark.createDataFrame(rows, "event_id long, attempt long, delay_ms double, backoff_factor double, max_delay_ms double, jitter string, draw double")
    assert {r.event_id: r.delay_ms for r in run("retry_delay", spark, retries=retries)} == {1: 250.0, 2: 900.0, 3: 450.0, 4: 0.0}
    rows = [(1, None, None, None, None, None, None), (2, None, 4.0, None, None, None, None), (3, 1.5, None, None, None, None, None), (4, 1.0, None, -1.0, None, None, None), (5, 1.0, None, 1.0, 0.5, None, None), (6, 1.0, None, 1.0, 1.0, float("inf"), "full")]
    policies = spark.createDataFrame(rows, "policy_id long, max_attempts double, legacy_retries double, delay_ms double, backoff_factor double, max_delay_ms double, jitter string")
    got = {r.policy_id: (r.max_attempts, r.invalid) for r in run("retry_policy", spark, policies=policies)}
    assert got == {1: (3.0, None), 2: (5.0, None), 3: (1.5, "retryPolicy.maxAttempts"), 4: (1.0, "retryPolicy.delayMs"), 5: (1.0, "retryPolicy.backoffFactor"), 6: (1.0, "retryPolicy.maxDelayMs")}


def checkpoints(spark, chunks):
    receipts = frame(spark, RECEIPTS, *[{"chunk_index": c, "position": p} for p, c in enumerate(chunks)])
    manifests = spark.createDataFrame([(1, 5 * CHUNK, CHUNK, 5)], "manifest_id long, total_bytes long, chunk_size long, total_chunks long")
    return [(r.uploaded_bytes // CHUNK, r.ranges, r.next_index) for r in sorted(run("resume_checkpoint", spark, receipts=receipts, manifests=manifests), key=lambda r: r.position)]


def test_checkpoints_follow_the_ranges(spark):
    import random

    assert checkpoints(spark, [2, 0]) == [(1, 1, 0), (2, 2, 1)]
    for seed in range(4):
        chunks = random.Random(seed).sample(range(5), 5)
        want = []
        for k in range(1, 6):
            done = sorted(chunks[:k])
            want.append((k, sum(c - 1 not in done for c in done), next(c for c in range(6) if c not in done)))
        assert checkpoints(spark, chunks) == want


RECORD = [
    ("record_id", "string", "resume_1"), ("manifest_id", "long", 1), ("schema_version", "string", "v0.2"), ("status", "string", "active"), ("expires_at", "string", None), ("upload_id", "string", "up"), ("transport_name", "string", "nas"), ("resume_token", "string", None), ("transport_data", "string", None),
    ("created_at", "string", "2026-01-01T00:00:00.000Z"), ("updated_at", "string", "2026-01-01T00:00:00.000Z"), ("total_bytes", "long", 600 * KB), ("chunk_size", "long", CHUNK), ("total_chunks", "long", 3), ("uploaded_bytes", "long", 600 * KB), ("next_index", "long", 3), ("strategy", "string", "fixed-size"),
    ("file_name", "string", "a.tif"), ("file_bytes", "long", 600 * KB), ("file_media_type", "string", "image/tiff"), ("file_fingerprint", "string", "fp"), ("file_last_modified", "long", 5), ("manifest_version", "string", "v1"), ("manifest_bytes", "long", 600 * KB), ("manifest_chunk_size", "long", CHUNK), ("manifest_chunks", "long", 3),
]
RANGES = [("record_id", "string", "resume_1"), ("place", "long", 0), ("start_index", "long", 0), ("end_index", "long", 2)]


@pytest.mark.parametrize(
    ("record", "ranges", "receipts", "want"),
    [
        ({}, [{}], WHOLE, None),
        ({"schema_version": "v9", "record_id": "resume_1"}, [{}], WHOLE, "schemaVersion"),
        ({"updated_at": "2026-02-30T00:00:00.000Z"}, [{}], WHOLE, "createdAt"),
        ({"manifest_version": "v0"}, [{}], WHOLE, "manifest"),
        ({"file_media_type": ""}, [{}], WHOLE, "file"),
        ({"file_last_modified": -1}, [{}], WHOLE, "file.lastModified"),
        ({"strategy": "other"}, [{}], WHOLE, "chunking"),
        ({"total_chunks": 4}, [{}], WHOLE, "chunking.totalChunks"),
        ({"file_bytes": 5}, [{}], WHOLE, "chunking"),
        ({"upload_id": ""}, [{}], WHOLE, "transport.uploadId"),
        ({"expires_at": "soon"}, [{}], WHOLE, "transport.expiresAt"),
        ({"status": "odd"}, [{}], WHOLE, "progress"),
        ({"next_index": 4}, [{}], WHOLE, "progress"),
        ({"next_index": 2}, [{}], WHOLE, "progress.nextChunkIndex"),
        ({}, [{"end_index": 3}], WHOLE, "progress.completedChunkRanges[0]"),
        ({}, [{"end_index": 0}, {"place": 1, "start_index": 1}], WHOLE, "progress.completedChunkRanges[1]"),
        ({}, [{}], [*WHOLE, {"chunk_index": 1, "position": 3}], "receipts"),
        ({}, [{}], changed(1, size_bytes=1), "receipts[1].sizeBytes"),
        ({}, [{}], changed(1, transport="s3"), "receipts[1].transport.name"),
        ({}, [{}], changed(1, part_number=-1), "receipts[1].transport.partNumber"),
        ({}, [{}], changed(1, chunk_index=9), "receipts[1]"),
        ({}, [{}], changed(1, completed_at="then"), "receipts[1]"),
        ({}, [{}], changed(1, chunk_index=0), "receipts[1].chunkIndex"),
        ({}, [{}], WHOLE[:2], "progress.completedChunkRanges"),
        ({"uploaded_bytes": 5}, [{}], WHOLE, "progress.uploadedBytes"),
        ({"schema_version": "v0.1"}, [{}], [], None),
        ({"schema_version": "v0.1", "uploaded_bytes": 5}, [{}], [], "progress.uploadedBytes"),
        ({"total_bytes": 0, "file_bytes": 0, "manifest_bytes": 0, "total_chunks": 0, "manifest_chunks": 0, "uploaded_bytes": 0, "next_index": 0}, [], [], None),
    ],
)
def test_record_validation(spark, record, ranges, receipts, want):
    frames = {"resume_records": frame(spark, RECORD, record), "stored_ranges": frame(spark, RANGES, *ranges), "receipts": frame(spark, RECEIPTS, *receipts)}
    r = run("resume_parse", spark, **frames)[0]
    assert (r.path, r.accepted) == (want, want is None)
    kind = None if want is None else "schema_unsupported" if want == "schemaVersion" else "receipt_invalid" if want.startswith("receipts") or want == "progress.completedChunkRanges" or want == "progress.uploadedBytes" and record.get("schema_version") != "v0.1" else "record_invalid"
    assert r.code == (kind and f"resume.{kind}")


def test_records_of_one_manifest_have_their_own_sums(spark):
    both = frame(spark, RECORD, {}, {"record_id": "resume_2"}, {"record_id": "resume_3", "transport_name": "s3"})
    ranges = frame(spark, RANGES, *[{"record_id": f"resume_{k}"} for k in (1, 2, 3)])
    found = {r.record_id: r.path for r in run("resume_parse", spark, resume_records=both, stored_ranges=ranges, receipts=frame(spark, RECEIPTS, *WHOLE))}
    assert found == {"resume_1": None, "resume_2": None, "resume_3": "receipts[0].transport.name"}


OFFER = [("manifest_id", "long", 1), ("name", "string", "a.tif"), ("size_bytes", "long", 600 * KB), ("chunk_size", "long", CHUNK), ("media_type", "string", "image/tiff"), ("fingerprint", "string", "fp"), ("last_modified", "long", 5)]
NOW = "TIMESTAMP '2026-06-01 00:00:00'"


@pytest.mark.parametrize(
    ("record", "offer", "want"),
    [
        ({}, {}, "compatible"), ({}, {"media_type": "image/png"}, "file_mismatch"), ({}, {"fingerprint": "other"}, "file_mismatch"), ({}, {"name": "b.tif"}, "file_mismatch"), ({}, {"last_modified": 6}, "file_mismatch"), ({}, {"last_modified": None}, "compatible"),
        ({}, {"chunk_size": 2 * CHUNK}, "chunking_mismatch"), ({"status": "completed"}, {}, "not_recoverable"), ({"status": "paused", "expires_at": "2026-06-01T00:00:00.000Z"}, {}, "expired"), ({"expires_at": "2026-06-01T00:00:00.001Z"}, {}, "compatible"),
    ],
)
def test_classify_and_gate(spark, record, offer, want):
    frames = {"resume_records": frame(spark, RECORD, record), "candidates": frame(spark, OFFER, offer)}
    assert run("resume_classify", spark, {"now": NOW}, **frames)[0].verdict == want
    can = spark.createDataFrame([("nas", True)], "name string, persistent boolean")
    gate = {"compatible": "ok", "not_recoverable": "resume.record_not_found"}.get(want, f"resume.{want}")
    assert run("resume_gate", spark, {"now": NOW}, capabilities=can, **frames)[0].verdict == gate
    assert len(run("recoverable", spark, {"now": NOW}, resume_records=frames["resume_records"])) == (want not in ("expired", "not_recoverable"))


def test_transport_state_keeps_its_name(spark):
    current = spark.createDataFrame([(1, "A", "up", "t0", None, None), (2, None, "up2", None, None, "d")], "manifest_id long, name string, upload_id string, resume_token string, expires_at string, data string")
    log = spark.createDataFrame([(1, 0, None, "t1", None, None), (1, 1, "again", None, "e", None), (1, 2, None, None, None, "x")], "manifest_id long, position long, upload_id string, resume_token string, expires_at string, data string")
    got = {r.manifest_id: tuple(r)[1:] for r in run("transport_merge", spark, current=current, log=log)}
    assert got == {1: ("A", "again", "t1", "e", "x"), 2: (None, "up2", None, None, "d")}


def test_store_lookups(spark):
    store = spark.createDataFrame([("resume:1", '{"id": "r1", "status": "paused"}'), ("resume:2", "{"), ("resume:3", None), ("other:4", "{}"), ("resume:5", '{"id": "r5", "status": "odd"}')], "entry string, stored string")
    assert {r.entry: r.verdict for r in run("resume_list", spark, {"prefix": "resume:"}, store=store)} == {"resume:1": "ok", "resume:2": "resume.record_invalid", "resume:3": "resume.record_invalid", "resume:5": "resume.record_invalid"}
    assert [r.record_id for r in run("resume_get", spark, {"key": "it's"}, resume_records=frame(spark, RECORD, {"record_id": "it's"}, {}))] == ["it's"]


def test_tus_resume(spark):
    records = frame(spark, RECORD, *[{"record_id": f"r{k}", "resume_token": None if k == 0 else "t", "uploaded_bytes": 10} for k in range(5)])
    remote = spark.createDataFrame([("r0", "10", 200), ("r1", "10", 200), ("r2", "9", 200), ("r3", "x", 200), ("r4", "10", 404)], "record_id string, offset_text string, http_status int")
    got = {r.record_id: r.verdict for r in run("tus_resume", spark, resume_records=records, remote=remote)}
    assert got == {"r0": "transport.resume_failed", "r1": "ok", "r2": "transport.offset_mismatch", "r3": "transport.receipt_invalid", "r4": "resume.expired"}


def test_multipart(spark):
    receipts = frame(spark, RECEIPTS, *[{"manifest_id": m, "chunk_index": c, "position": p, "part_number": c + 1, "etag": e} for m, c, p, e in ((1, 1, 0, "b"), (1, 0, 1, "a"), (2, 1, 0, "x"), (3, 0, 0, ""))])
    manifests = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "manifest_id long")
    assert {r.manifest_id: r.verdict.split(".")[-1] for r in run("s3_parts", spark, manifests=manifests, receipts=receipts)} == {1: "ok", 2: "receipt_invalid", 3: "receipt_invalid", 4: "receipt_missing"}
    assert sorted((r.part_number, r.etag) for r in run("s3_completed_parts", spark, receipts=receipts)) == [(1, "a"), (2, "b")]
    handles = spark.createDataFrame([(1, "u", "k", "https://h", None, False), (2, "", "k", "https://h", "PUT", False), (3, "u", None, None, None, True), (4, "u", "k", None, "POST", True), (5, "u", "k", "https://h", "POST", False)], "handle_id long, upload_id string, object_key string, url string, method string, persisted boolean")
    assert {r.handle_id: r.verdict.split(".")[-1] for r in run("s3_handles", spark, handles=handles)} == {1: "ok", 2: "failed", 3: "resume_failed", 4: "ok", 5: "failed"}


def test_redaction_takes_columns_out(spark):
    record = run("redact_resume", spark, resume_records=frame(spark, RECORD, {"resume_token": "secret", "transport_data": "{}"}), receipts=frame(spark, RECEIPTS, *WHOLE), ranges=spark.createDataFrame([(1, 4, 4), (1, 0, 2), (2, 0, 0)], "manifest_id long, start_index long, end_index long"))[0]
    assert not {"upload_id", "resume_token", "transport_data"} & set(record.asDict()) and "secret" not in str(record) and (record.file_fingerprint, record.chunk_size, record.next_index) == ("fp", CHUNK, 3)
    assert record.redactions == "resume.manifest,resume.transport.uploadId,resume.transport.resumeToken,resume.transport.data,resume.receipts"
    state = spark.createDataFrame([(1, "active", 5, "up", "nas", None, "tok", "vault", "r"), (2, "active", 5, "up", "nas", None, None, None, None)], "manifest_id long, status string, uploaded_bytes long, upload_id string, transport_name string, expires_at string, resume_token string, secrets_ref string, remote string")
    receipts = frame(spark, RECEIPTS, {"etag": "e", "opaque": "{}"}, {"position": 1, "location": "l"})
    shown = {r.manifest_id: r for r in run("redact_snapshot", spark, state=state, receipts=receipts)}
    assert shown[1].session_fields == "snapshot.transportSession.resumeToken,snapshot.transportSession.secretsRef,snapshot.transportSession.remote" and not {"resume_token", "secrets_ref", "remote"} & set(shown[1].asDict())
    assert shown[1].receipt_fields == ",".join(f"snapshot.completedChunks.transport.{x}" for x in ("etag", "location", "opaque")) and (shown[2].session_fields, shown[2].receipt_fields) == ("", "")
    assert {r.manifest_id: r.redactions for r in run("redact_session", spark, state=state)} == {1: "resumeToken,secretsRef,remote", 2: ""}
    rows = run("redact_receipts", spark, receipts=receipts)
    assert sorted(r.redactions for r in rows) == ["transport.etag,transport.opaque", "transport.location"] and not {"etag", "location", "opaque"} & set(rows[0].asDict())


def test_normalisers(spark):
    raw = spark.createDataFrame([("u", None, "nas", None, None, "e", None, "t", None, None, "d"), ("u", "own", "nas", "c", "x", "e", "y", "t", "s", "r", "d")], "upload_id string, session_transport string, transport_name string, created_at string, expires_at string, fallback_expires_at string, resume_token string, fallback_resume_token string, secrets_ref string, remote string, data string")
    assert sorted(tuple(r)[1:] for r in run("normalize_session", spark, {"now": "'now'"}, raw=raw)) == [("nas", "now", "e", "t", None, "d"), ("own", "c", "x", "y", "s", "r")]
    results = spark.createDataFrame([(1, 0, 5, "nas", None, None, None, None), (1, 1, 5, "nas", 1, 5, "s3", "then"), (1, 2, 5, "nas", 1, 5, "s3", "then"), (1, 3, 5, "nas", 3, 4, "s3", "then")], "manifest_id long, chunk_index long, size_bytes long, transport_name string, receipt_chunk_index long, receipt_size_bytes long, receipt_transport string, receipt_completed_at string")
    assert [(r.transport, r.completed_at, r.verdict.split(".")[-1]) for r in sorted(run("normalize_receipts", spark, {"now": "'now'"}, results=results))] == [("nas", "now", "ok"), ("s3", "then", "ok"), ("s3", "then", "receipt_invalid"), ("s3", "then", "receipt_invalid")]
    errors = spark.createDataFrame([(1, "E", True, "m"), (2, None, None, None), (3, "E", None, "n")], "event_id long, code string, retryable boolean, message string")
    assert {r.event_id: tuple(r)[1:] for r in run("snapshot_error", spark, errors=errors)} == {1: ("E", "m", True), 2: ("transport.failed", "Upload failed.", False), 3: ("transport.failed", "n", False)}


DERIVATIVE = [
    ("manifest_id", "long", 1), ("group_id", "long", 1), ("position", "long", 0), ("derivative_id", "string", "d0"), ("kind", "string", "preview"), ("status", "string", "created"), ("source", "string", "original"), ("source_manifest_id", "long", 1), ("source_version", "string", "v1"), ("manifest_version", "string", "v1"),
    ("source_bytes", "long", None), ("manifest_bytes", "long", 5), ("source_media_type", "string", None), ("manifest_media_type", "string", "image/tiff"), ("source_fingerprint", "string", None), ("manifest_fingerprint", "string", "fp"), ("source_checksum", "string", None), ("manifest_checksum", "string", None),
    ("location_hint", "string", "nas/1"), ("label", "string", None), ("storage_metadata", "string", None), ("metadata", "string", None), ("failure_code", "string", None), ("failure_message", "string", None), ("has_tiles", "boolean", False), ("tile_width", "long", None), ("tile_height", "long", None), ("levels", "long", 0), ("bad_levels", "int", 0),
]


@pytest.mark.parametrize(
    ("row", "want"),
    [
        ({}, []), ({"derivative_id": ""}, ["id.missing"]), ({"kind": None}, ["kind.unsupported"]), ({"status": "done"}, ["status.invalid"]), ({"source": None}, ["source.missing"]), ({"source_manifest_id": 2}, ["source.mismatch"]), ({"source_version": "v0"}, ["source.mismatch"]), ({"source_bytes": 6}, ["source.mismatch"]),
        ({"source_media_type": "x"}, ["source.mismatch"]), ({"source_fingerprint": "x"}, ["source.mismatch"]), ({"source_checksum": "x"}, []), ({"source_checksum": "x", "manifest_checksum": "y"}, ["source.mismatch"]), ({"source_manifest_id": None, "source_bytes": 6}, []), ({"label": "token=x"}, ["storage.unsafe"]),
        ({"storage_metadata": '{"a": {"sig=": 1}}'}, ["storage.unsafe"]), ({"storage_metadata": '{"a": {"Blob": 1}}'}, ["payload.embedded"]), ({"failure_code": "secret"}, ["failure.unsafe"]), ({"has_tiles": True}, ["tile.invalid"]), ({"has_tiles": True, "levels": 1}, []), ({"has_tiles": True, "levels": 1, "tile_height": 0}, ["tile.invalid"]), ({"has_tiles": True, "levels": 1, "bad_levels": 1}, ["tile.invalid"]),
    ],
)
def test_derivative_rules(spark, row, want):
    rows = run("derivative_validate", spark, derivatives=frame(spark, DERIVATIVE, row))
    assert [r.code.removeprefix("derivative.") for r in sorted(rows, key=lambda r: r.ordinal)] == want


def test_derivative_options_and_groups(spark):
    rows = frame(spark, DERIVATIVE, {"source_manifest_id": None, "label": "token=x"}, {"position": 1, "kind": None}, {"position": 2, "derivative_id": ""}, {"position": 3, "derivative_id": ""})
    assert [r.code for r in run("derivative_validate", spark, {"strict_source": True, "allow_unsafe_hints": True}, derivatives=rows.filter("position = 0"))] == ["derivative.source.missing"]
    got = sorted((r.position, r.code.removeprefix("derivative.")) for r in run("manifest_derivatives", spark, {"required": ("d0", "d7", "d8")}, derivatives=rows))
    assert got == [(-2, "required.missing"), (-1, "required.missing"), (0, "storage.unsafe"), (1, "id.duplicate"), (2, "id.missing"), (3, "id.missing")]
    levels = spark.createDataFrame([(1, 0, 4096, 4096, 16, 16, None), (1, 1, 0, 4096, 16, 16, None), (1, -1, 1, 1, 1, 1, 1.0), (1, 2, 1, 1, 1, 1, 0.0)], "manifest_id long, level long, width long, height long, columns long, tile_rows long, scale double")
    assert tuple(run("tile_levels", spark, pyramid=levels)[0]) == (1, 4, 3)
    fields = spark.createDataFrame([(1, "a", "b"), (1, "note", "X-Amz-Date"), (2, "a", None), (3, "password=", "x")], "object_id long, field string, value string")
    assert {r.object_id: r.unsafe for r in run("unsafe_value", spark, fields=fields)} == {1: True, 2: False, 3: True}


def test_gateway_sessions(spark):
    now = "TIMESTAMP '1998-06-01 00:00:00'"
    requests = spark.createDataFrame([("new", "a/b", 3, 5), ("old", "a/b", 3, 5), ("x/y", "a", 3, 5), ("n2", "../a", 3, 5), ("n3", "a", 0, 5), ("n4", "a", 3, -1)], "folder string, target string, expected_chunks long, total_bytes long").selectExpr("*", "CAST(NULL AS TIMESTAMP) AS expires_at")
    raw = spark.sql("SELECT 1 AS session_id, 'old' AS folder, 'staging' AS status, 'nas.v0.1' AS schema_version, CAST(NULL AS TIMESTAMP) AS expires_at UNION ALL SELECT 2, 'b', 'finalized', 'nas.v0.1', NULL UNION ALL SELECT 3, 'c', 'staging', 'nas.v0.1', TIMESTAMP '1998-06-01 00:00:00'")
    got = {r.folder: (r.verdict, r.status, r.expires_at) for r in run("nas_create", spark, {"now": now, "lives_ms": 1000}, requests=requests, raw=raw)}
    assert got.pop("new") == ("ok", "staging", "1998-06-01T00:00:01.000Z")
    assert {k: v[0] for k, v in got.items()} == {"old": "nas.invalid_session", "x/y": "nas.invalid_session", "n2": "nas.unsafe_path", "n3": "nas.invalid_session", "n4": "nas.invalid_session"}
    assert {r.session_id: (r.status, r.verdict) for r in run("nas_cancel", spark, {"now": now}, raw=raw)} == {1: ("canceled", "ok"), 2: ("finalized", "nas.session_closed"), 3: ("canceled", "ok")}
    locks = spark.sql("SELECT 1 AS lock_id, TIMESTAMP '1998-05-31 23:59:59' AS acquired_at UNION ALL SELECT 2, TIMESTAMP '1998-05-31 23:59:59.001'")
    assert {r.lock_id: r.stale for r in run("lock_stale", spark, {"now": now, "stale_ms": 1000}, locks=locks)} == {1: True, 2: False}
    staged = spark.createDataFrame([("s", 0, 1, "x"), ("s", 0, 2, "hello"), ("s", 1, 1, " "), ("s", 2, 1, "world")], "session_id string, chunk_index long, generation long, body string").selectExpr("*", "5L AS size_bytes", "'' AS sha256", "1L AS n")
    assert {r.generation: r.name for r in run("staged_name", spark, staged=staged.filter("chunk_index = 0"))} == {1: "00000000-1.part", 2: "00000000-2.part"}
    whole = concat_chunks(staged.withColumn("session_id", staged["n"])).collect()[0]
    assert (whole.sha256, whole.size_bytes) == (hashlib.sha256(b"hello world").hexdigest(), 11)


def test_finalize_looks_at_each_chunk(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(1, 0, 1, "hello", 5, sha("hello")), (1, 1, 1, " world", 6, sha(" world")), (2, 0, 1, "hello", 4, sha("hello")), (3, 0, 1, "hello", 5, "ff"), (4, 1, 1, "hello", 5, sha("hello")), (5, 0, 1, "hello", 5, sha("hello"))]
    staged = spark.createDataFrame(rows, "session_id long, chunk_index long, generation long, body string, size_bytes long, sha256 string")
    raw = spark.createDataFrame([(1, 2, 11), (2, 1, 4), (3, 1, 5), (4, 1, 5), (5, 1, 6)], "session_id long, expected_chunks long, total_bytes long")
    assert {r.session_id: r.verdict for r in run("nas_finalize_check", spark, staged=staged, raw=raw)} == {1: "ok", 2: "nas.invalid_chunk", 3: "nas.checksum_mismatch", 4: "nas.chunk_missing", 5: "nas.invalid_chunk"}


def test_paths_below_their_root(spark):
    """NUL characters, no path, and ways that end above or at the root are refused."""
    targets = ["a/b.tif", "a/../b", "./a", "a//b", "", ".", "..", "../x", "a/../../x", "/abs", "a\0b", "\0", None, "a/..", "x/.."]
    rows = spark.createDataFrame(list(enumerate(targets)), "session_id long, target string")
    assert [r.safe for r in sorted(run("safe_path", spark, sessions=rows))] == [True] * 4 + [False] * 11


def test_gateway_answers(spark):
    """A session without chunks, the first faulty chunk, expired sessions that are canceled, and no default of expiry."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(2, 0, 1, "hello", 5, "ff"), (2, 1, 1, "world", 4, None), (3, 0, 1, "hello", 4, None), (3, 1, 1, "world", 5, "ff"), (4, 0, 1, "old", 9, "ff"), (4, 0, 2, "hello", 5, None), (5, 1, 1, "a", 1, None), (5, 2, 1, "b", 1, None), (7, 0, 1, "hello", 5, sha("hello")), (9, 0, 1, "x", 1, None)]
    staged = spark.createDataFrame(rows, "session_id long, chunk_index long, generation long, body string, size_bytes long, sha256 string")
    raw = spark.createDataFrame([(1, 3, 11), (2, 2, 10), (3, 2, 10), (4, 1, 5), (5, 2, 2), (6, 0, 0), (7, 1, 6)], "session_id long, expected_chunks long, total_bytes long")
    got = {r.session_id: (r.chunks, r.bytes, r.verdict) for r in run("nas_finalize_check", spark, staged=staged, raw=raw)}
    assert got == {1: (0, 0, "nas.chunk_missing"), 2: (2, 9, "nas.checksum_mismatch"), 3: (2, 9, "nas.invalid_chunk"), 4: (1, 5, "ok"), 5: (2, 2, "nas.chunk_missing"), 6: (0, 0, "ok"), 7: (1, 5, "nas.invalid_chunk")}
    made = spark.sql("SELECT 1 AS session_id, CAST(NULL AS TIMESTAMP) AS expires_at, TIMESTAMP '1998-01-01 00:00:00' AS created_at UNION ALL SELECT 2, TIMESTAMP '1998-02-01 00:00:00', TIMESTAMP '1998-01-01 00:00:00'")
    for lives, want in ((None, None), (1500, "1998-01-01T00:00:01.500Z")):
        assert {r.session_id: r.expires_at for r in run("nas_expiry", spark, {"lives_ms": lives}, raw=made)} == {1: want, 2: "1998-02-01T00:00:00.000Z"}
    requests = spark.sql("SELECT 'n' AS folder, 'a' AS target, CAST(NULL AS TIMESTAMP) AS expires_at, 1L AS expected_chunks, 1L AS total_bytes")
    assert [r.expires_at for r in run("nas_create", spark, {"now": "TIMESTAMP '1998-06-01 00:00:00'"}, requests=requests, raw=spark.sql("SELECT 'x' AS folder"))] == [None]
    listing = spark.createDataFrame([(1, p) for p in ("00000000-1.part", "00000001.part", "00000000-1.part.x.tmp", "metadata.json.candidate-1a.tmp", "metadata.json", "notes.txt", "xmetadata.json.candidate-1.tmp")], "session_id long, path string")
    assert {r.path for r in run("orphan_chunks", spark, listing=listing, recorded=spark.createDataFrame([(1, "00000001.part")], "session_id long, path string"))} == {"00000000-1.part", "00000000-1.part.x.tmp", "metadata.json.candidate-1a.tmp"}
    locks = spark.createDataFrame([(1, "a"), (2, "b")], "lock_id long, owner_id string")
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "lock_id long, owner_id string")
    assert {r.lock_id: r.outcome for r in run("lock_release", spark, locks=locks, releases=asked)} == {1: "released", 2: "held", 3: "absent"}


def test_expiry_query_has_its_default(spark, data):
    """Sessions that name no expiry have a day from when they were made; the others keep what they say."""
    got = {r.session_id: r.expires_at for r in registry.QUERIES["nas_expiry"](spark, data).collect()}
    assert None not in got.values() and {k: got[k] for k in (4, 5)} == {4: "1998-01-02T00:00:04.000Z", 5: "1998-05-01T10:00:00.000Z"}


def test_derivatives_are_attached(spark):
    """Without leave to replace, an id that the group has is refused and stays; with it, the derivative is replaced in place."""
    old = spark.createDataFrame([(1, "d0", 0), (1, "d1", 150_000), (3, "d0", 0)], "group_id long, derivative_id string, position long")
    new = spark.createDataFrame([(1, "d1", 0), (1, "d5", 1), (1, "d4", 2), (2, "x", 7), (2, "x", 8)], "group_id long, derivative_id string, position long")
    rows = lambda name, **given: sorted((r.group_id, r.position, r.derivative_id, r.changed, r.error) for r in run(name, spark, given, derivatives=old, new=new))
    double = "derivative.id.duplicate"
    assert rows("derivative_attach") == [(1, 0, "d0", False, None), (1, 150_000, "d1", False, double), (1, 150_001, "d5", True, None), (1, 150_002, "d4", True, None), (2, 0, "x", True, double), (3, 0, "d0", False, None)]
    assert rows("derivative_upsert", replace_existing=True) == [(1, 0, "d0", False, None), (1, 150_000, "d1", True, None), (1, 150_001, "d5", True, None), (1, 150_002, "d4", True, None), (2, 0, "x", True, None), (3, 0, "d0", False, None)]


TREES = [
    ('{"a": {"b": [1, {"Blob": null}]}}', True, False), ('{"\\u0062lob": 1}', True, False), ('{"note": "bytes"}', False, False), ('{"note": "\\"data\\": 1"}', False, False), ('[[{"FILE": {}}]]', True, False), ('{"bytes_read": 1}', False, False),
    ('{"a": [{"l": ["x", "pass\\u0077ord=1"]}]}', False, True), ('{"x-amz-date": 1}', False, True), ('{"p": "c:\\\\dir"}', False, True), ('{"p": "see c:\\\\dir"}', False, False), ('{"p": "design=1", "q": ["..", "a..b"]}', False, False), ("my secret", False, True), ("plain", False, False),
    ('"../up"', False, True), ("", False, False), (None, False, False), ('{"k": 1, "k": {"body": 2}}', True, False), ("[1, true, null]", False, False),
]


def test_trees_are_looked_through(spark):
    """Keys and strings at any depth, escapes decoded; a key's name as a value is none; text that is not JSON is one string."""
    rows = spark.createDataFrame([(k, x, "f") for k, (x, _, _) in enumerate(TREES)], "manifest_id long, metadata string, field string")
    assert [r.embedded for r in sorted(run("embedded_payload", spark, derivatives=rows))] == [e for _, e, _ in TREES]
    assert [r.unsafe for r in sorted(run("unsafe_value", spark, fields=rows.selectExpr("manifest_id AS object_id", "field", "metadata AS value")))] == [u for *_, u in TREES]


def test_redacted_records_keep_their_ranges(spark):
    ranges = spark.createDataFrame([(1, 4, 4), (1, 0, 2), (2, 0, 0)], "manifest_id long, start_index long, end_index long")
    assert run("redact_resume", spark, resume_records=frame(spark, RECORD, {}), receipts=frame(spark, RECEIPTS), ranges=ranges)[0].completed_ranges == "0-2,4-4"


def test_session_documents(spark):
    """JSON with the fields that are there, in order and indented; texts are escaped."""
    import json

    raw = spark.sql("""SELECT 1 AS session_id, 's_1' AS folder, 'nas.v0.1' AS schema_version, 'staging' AS status, TIMESTAMP '1998-01-01 00:00:00' AS created_at, TIMESTAMP '1998-01-02 00:00:00' AS expires_at, 'a "b"/c.tif' AS target, 11L AS total_bytes, 2L AS expected_chunks
        UNION ALL SELECT 2, 's_2', 'nas.v0.1', 'staging', TIMESTAMP '1998-01-01 00:00:00', NULL, 'é', 0L, 1L UNION ALL SELECT 3, 's_3', 'nas.v9', 'staging', NULL, NULL, 'x', 0L, 1L""")
    staged = spark.createDataFrame([(1, 1, 1, "00000001-1.part", 6, None), (1, 0, 1, "old", 5, "aa"), (1, 0, 2, "00000000-2.part", 5, "bb")], "session_id long, chunk_index long, generation long, path string, size_bytes long, sha256 string")
    got = {r.folder: r.document for r in run("nas_metadata", spark, {"now": "TIMESTAMP '1998-06-01 00:00:00'"}, raw=raw, staged=staged)}
    first = {
        "schemaVersion": "nas.v0.1", "sessionId": "s_1", "status": "staging", "createdAt": "1998-01-01T00:00:00.000Z", "updatedAt": "1998-06-01T00:00:00.000Z", "expiresAt": "1998-01-02T00:00:00.000Z", "targetRelativePath": 'a "b"/c.tif', "totalBytes": 11, "expectedChunks": 2,
        "chunks": [{"index": 0, "path": "00000000-2.part", "sizeBytes": 5, "checksum": {"algorithm": "sha256", "value": "bb"}}, {"index": 1, "path": "00000001-1.part", "sizeBytes": 6}],
    }
    second = {**{k: v for k, v in first.items() if k != "expiresAt"}, "sessionId": "s_2", "targetRelativePath": "é", "totalBytes": 0, "expectedChunks": 1, "chunks": []}
    assert got == {x["sessionId"]: json.dumps(x, indent=2, ensure_ascii=False) + "\n" for x in (first, second)}


def test_stored_files_must_be_regular(spark):
    pairs = spark.sql("SELECT 1 AS file_id, true AS found, false AS regular, 1L AS size_bytes, 2L AS actual_bytes, 'x' AS expected, 'c' AS content UNION ALL SELECT 2, false, NULL, 1L, 1L, 'x', 'c' UNION ALL SELECT 3, true, NULL, 1L, 1L, 'x', 'c'")
    assert {r.file_id: r.verdict for r in run("verify_stored", spark, {"regular": "regular"}, pairs=pairs)} == {1: "verification.file_unreadable", 2: "verification.file_not_found", 3: "verification.file_unreadable"}
