"""File sources, the staged sink and the session stream."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tallyport.plans import load, registry  # noqa: F401
from tallyport.sources.files import FileChunkSource, chunked_sha256, scan_files
from tallyport.sources.fixtures import fixture_chunks
from tallyport.sources.sinks import save_documents, save_uploads
from tallyport.sources.stores import Conflict, JsonStore
from tallyport.streaming.sessions import session_status


def test_scan_and_chunks(spark, tmp_path):
    content = {f"f{k}": os.urandom(1000 * k) for k in range(4)}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    want = {n: hashlib.sha256(d).hexdigest() for n, d in content.items()}
    assert {os.path.basename(r.path): r.sha256 for r in scan_files(spark, str(tmp_path), "f*").collect()} == want
    spark.dataSource.register(FileChunkSource)
    chunks = spark.read.format("file_chunks").option("chunk", 700).option("chunksPerTask", 2).load(str(tmp_path))
    got = {os.path.basename(r.file): (r.sha256, r.size_bytes) for r in chunked_sha256(chunks, "path", "chunk_index", "body").collect()}
    assert got == {n: (want[n], len(d)) for n, d in content.items() if d}


def test_scan_query_reads_the_whole_folder(spark, data):
    files = [os.path.join(folder, name) for folder, _, names in os.walk(data) for name in names]
    want = {os.path.relpath(f, data): hashlib.sha256(open(f, "rb").read()).hexdigest() for f in files if os.path.getsize(f) and not os.path.basename(f).startswith(("_", "."))}
    got = {r.path.split(f"{data}/")[1]: r.sha256 for r in registry.QUERIES["scan_files"](spark, data).collect()}
    assert got == want and len(want) > 5


def test_staged_sink(spark, tmp_path):
    rows = spark.createDataFrame([("s1", 1, b"world"), ("s1", 0, b"hello "), ("s2", 0, b"x")], "session string, chunk_index long, body binary")
    save_uploads(rows.repartition(3), str(tmp_path))
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"s1": b"hello world", "s2": b"x"}
    with pytest.raises(Exception, match="missing"):
        save_uploads(rows.filter("chunk_index = 1"), str(tmp_path))
    with pytest.raises(Exception, match="missing|spread"):  # not dealt by session
        rows.repartition(3, "chunk_index").write.format("staged_files").mode("append").save(str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == {"s1", "s2"}


def test_sink_refuses_names_and_gaps(spark, tmp_path):
    """Names that leave the folder, taken names and missing last chunks: nothing is written, and what was there stays."""
    folder = tmp_path / "uploads"
    folder.mkdir()
    rows = lambda *r: spark.createDataFrame(r, "session string, chunk_index long, body binary")
    for name in ("../escaped", "e/f", "", "..", ".hidden", "_staging", "a\0b", "a\\b"):
        with pytest.raises(Exception, match="not a name"):
            save_uploads(rows(("ok", 0, b"1"), (name, 0, b"2")), str(folder))
    save_uploads(rows(("b", 0, b"first")), str(folder))
    with pytest.raises(Exception, match="exists"):
        save_uploads(rows(("a", 0, b"1"), ("b", 0, b"2"), ("c", 0, b"3")), str(folder))
    expected = spark.createDataFrame([("x", 2), ("y", 1)], "session string, chunks long")
    for chunks in ([("x", 0, b"1"), ("y", 0, b"2")], [("x", 0, b"1"), ("x", 1, b"1")], [("x", 0, b"1"), ("x", 1, b"1"), ("x", 2, b"1"), ("y", 0, b"2")]):
        with pytest.raises(Exception, match="missing"):
            save_uploads(rows(*chunks), str(folder), expected)
    assert {p.name: p.read_bytes() for p in folder.iterdir()} == {"b": b"first"} and [p.name for p in tmp_path.iterdir()] == ["uploads"]
    save_uploads(rows(("x", 0, b"1"), ("x", 1, None), ("y", 0, b"2")), str(folder), expected)
    assert {p.name: p.read_bytes() for p in folder.iterdir()} == {"b": b"first", "x": b"1", "y": b"2"}


def test_store_keeps_what_others_write(spark, tmp_path):
    store, other = (JsonStore(spark, f"file://{tmp_path}/store") for _ in range(2))
    put = lambda k: spark.createDataFrame([(k, 0, "{}")], "entry string, position long, stored string")
    store.apply(put("a"))
    (tmp_path / "store" / "version-ofanother").mkdir()  # written and not yet named
    before = other._named()
    for k in "bcd":
        store.apply(put(k))
    assert (tmp_path / "store" / "version-ofanother").exists()
    with pytest.raises(Conflict):
        other._replace(put("lost").select("entry", "stored"), before)
    assert sorted(r.entry for r in other.read().collect()) == ["a", "b", "c", "d"]
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("version-")]) == 3


def test_documents_take_each_others_place(spark, tmp_path):
    docs = lambda *r: spark.createDataFrame(r, "folder string, document string")
    assert sorted(tuple(r) for r in save_documents(docs(("s_1", "{}"), ("s_2", "é")), str(tmp_path)).collect()) == [("s_1", 2), ("s_2", 2)]
    save_documents(docs(("s_1", "new"), ("s_3", "")), str(tmp_path)).collect()
    assert {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()} == {"s_1/metadata.json": "new", "s_2/metadata.json": "é", "s_3/metadata.json": ""}
    with pytest.raises(Exception, match="not a name"):
        save_documents(docs(("../s", "{}")), str(tmp_path)).collect()
    assert len(list(tmp_path.parent.glob("s*/metadata.json"))) == 0


def test_fixtures_round_trip(spark, tmp_path):
    sizes = {"a": 100_000, "b": 31, "c": 64, "none": 0}
    chunks = fixture_chunks(spark, sizes, chunk=4096)
    save_uploads(chunks, str(tmp_path))
    want = {n: b"".join(hashlib.sha256(f"fixture:{n}:{k}".encode()).digest() for k in range(-(-size // 32)))[:size] for n, size in sizes.items() if size}
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == want
    got = {r.file: (r.sha256, r.size_bytes) for r in chunked_sha256(chunks, "session", "chunk_index", "body").collect()}
    assert got == {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in want.items()}


def test_json_store(spark, tmp_path):
    store = JsonStore(spark, f"file://{tmp_path}/store")
    assert store.read().count() == 0 and store.version() is None
    changes = lambda *rows: spark.createDataFrame(rows, "entry string, position long, stored string")
    store.apply(changes(("resume:1", 0, '{"id": 1}'), ("resume:2", 0, '{"id": 2}'), ("other:3", 0, '{"x": "\\n\u00fc"}')))
    first = store.version()
    held = store.read()
    store.apply(changes(("resume:1", 0, "{}"), ("resume:1", 1, None), ("resume:4", 0, '{"id": 4}')))
    assert sorted(tuple(r) for r in store.read().collect()) == [("other:3", '{"x": "\\n\u00fc"}'), ("resume:2", '{"id": 2}'), ("resume:4", '{"id": 4}')]
    assert held.count() == 3 and store.version() != first  # readers of the version before are not disturbed
    assert [r.entry for r in store.get("resume:2").collect()] == ["resume:2"] and sorted(r.entry for r in store.scan("resume:").collect()) == ["resume:2", "resume:4"]
    store.replace(store.read().filter("false"))
    assert store.read().count() == 0 and first not in {p.name for p in (tmp_path / "store").iterdir()}


def test_session_stream(spark, data, tmp_path):
    events = registry.frame(spark, data, "ingest_events").select("session_id", "event_id", F.col("event_time").cast("timestamp").alias("event_time"), "type")
    for k in range(3):  # three batches, and the last one again
        events.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = session_status(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "3650 days")
    query = stream.writeStream.outputMode("update").format("memory").queryName("session_status_out").option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    seen = {}
    for r in spark.sql("select * from session_status_out").collect():
        if r.events >= seen.get(r.session_id, (None, 0))[1]:
            seen[r.session_id] = (r.status, r.events)
    batch = {r.session_id: r.status for r in registry.QUERIES["session_status"](spark, data).collect()}
    assert set(seen) == set(batch)
    terminal = [k for k, v in batch.items() if v in ("completed", "canceled")]
    assert all(seen[k][0] in ("completed", "canceled") for k in terminal)
    assert all(seen[k][0] == v for k, v in batch.items() if k not in terminal)


def test_silent_sessions_are_forgotten(spark, tmp_path):
    """State goes once a session has been silent for long enough behind the watermark."""
    days = lambda d: f"2026-01-{d:02d} 00:00:00"
    batches = [[(1, 1, days(1), "started"), (2, 2, days(1), "completed")], [(3, 3, days(20), "started")], [(3, 4, days(21), "upload:paused")], [(3, 5, days(22), "resume:started"), (1, 6, days(22), "upload:paused")]]
    schema = "session_id long, event_id long, event_time timestamp, type string"
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "session_id long, event_id long, event_time string, type string").withColumn("event_time", F.col("event_time").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    (tmp_path / "in").mkdir()
    stream = session_status(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "1 hour", idle_ms=5 * 86_400_000)
    query = stream.writeStream.outputMode("update").format("memory").queryName("forgotten").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        for k in range(len(batches)):
            part = next((tmp_path / f"in{k}").glob("part-*"))
            part.rename(tmp_path / "in" / f"{k}.parquet")
            query.processAllAvailable()
    finally:
        query.stop()
    rows = [tuple(r) for r in spark.sql("select * from forgotten").collect()]
    assert (1, "paused", 1) in rows and (1, "uploading", 1) in rows and (3, "resuming", 3) in rows
