"""Streams: checkpoints that equal the batch operator's, restarts, and observers that fail."""

import random

import pytest
from pyspark.sql import functions as F

from tallyport.plans import load, registry  # noqa: F401
from tallyport.streaming import checkpoints
from tallyport.streaming.observers import Observers

ACK = "manifest_id long, position long, chunk_index long, chunk_size long, total_bytes long, total_chunks long"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, checkpoints.PROVIDER)
    yield spark
    spark.conf.unset(name)


def started(spark, folder, idle_ms=None):
    stream = spark.readStream.schema(ACK).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    out = checkpoints.resume_checkpoints(stream, idle_ms).writeStream.outputMode("append").format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "check"))
    return out.start()


def put(df, folder, k):
    df.coalesce(1).write.parquet(str(folder / f"part{k}"))
    (folder / "in").mkdir(exist_ok=True)
    next((folder / f"part{k}").glob("part-*")).rename(folder / "in" / f"{k}.parquet")


def test_stream_equals_batch_and_survives_a_restart(rocks, tmp_path):
    """Chunks out of order, repeated, out of bounds and far apart; the query is stopped and started again between the files."""
    spark, rng = rocks, random.Random(12)
    manifests = [(1, 10 * 100 + 7, 100, 11), (2, 5000 * 10 - 3, 10, 5000), (3, 100, 100, 1), (4, 3000 * 10, 10, 3000)]
    acks = [(m, rng.randrange(-1, n + 2)) for m, _, _, n in manifests[:3] for _ in range(400)] + [(4, k) for k in [*range(1, 1500), 0, *range(2999, 1499, -1)]]
    position, rows = {}, []
    for m, chunk in acks:
        position[m] = position.get(m, -1) + 1
        rows.append((m, position[m], chunk))
    plan = spark.createDataFrame(manifests, "manifest_id long, total_bytes long, chunk_size long, total_chunks long")
    received = spark.createDataFrame(rows, "manifest_id long, position long, chunk_index long")
    full = received.join(plan, "manifest_id").select(*[c.split()[0] for c in ACK.split(", ")])
    for k in range(3):
        put(full.filter(F.col("position").between(k * 150, k * 150 + 149) if k < 2 else F.col("position") >= 300), tmp_path, k)
        query = started(spark, tmp_path)
        query.processAllAvailable()
        query.stop()
    columns = [c.split()[0] for c in checkpoints.OUTPUT.split(", ")]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(columns).collect())
    batch = registry.run("resume_checkpoint", spark, receipts=received.withColumn("size_bytes", F.lit(1).cast("long")), manifests=plan)
    assert got == sorted(tuple(r) for r in batch.select(columns).collect()) and len(got) > 3300
    assert [r for r in got if r[0] == 4][-1][3:] == (30_000, 1, 3000)


def test_stream_asks_for_its_store(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        checkpoints.resume_checkpoints(spark.createDataFrame([], ACK))


def test_observers_that_fail_are_counted(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "in"))
    observers, seen = Observers(), []

    def bad(kind, event):
        raise RuntimeError("not my day")

    observers.add(bad)
    observers.add(lambda kind, event: seen.append(kind))
    gone = observers.add(lambda kind, event: seen.append("gone"))
    gone()
    spark.streams.addListener(observers)
    try:
        query = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(observers)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50 and query.exception() is None
    assert {"started", "progress"} <= set(seen) and "gone" not in seen
    assert observers.failures[0, "started"] == 1 and sum(observers.failures.values()) == len(seen)


def test_attempts_end_as_the_upload_decides(spark):
    row = lambda chunk, position, error=None, lifecycle=None, retryable=None, allows=None: (1, chunk, position, error, lifecycle, retryable, allows)
    rows = [
        row(0, 0), row(1, 0, "e"), row(1, 1, "f"), row(1, 2), row(2, 0, "e"), row(2, 1, "e"), row(2, 2, "last"), row(2, 3), row(3, 0, "e", None, False), row(3, 1), row(4, 0, "e"), row(4, 1, "e", "pause", False), row(5, 0, "e", "cancel"), row(6, 0, "e", "abort"), row(7, 1, "late"), row(7, 0, "e", None, True),
        row(8, 0, "e", None, True, False), row(9, 0, None, "cancel"),
    ]
    attempts = spark.createDataFrame(rows, "manifest_id long, chunk_index long, position long, error_code string, lifecycle string, retryable boolean, policy_allows boolean")
    got = {r.chunk_index: (r.outcome, r.retries, r.error_code) for r in registry.run("retry_outcome", spark, attempts=attempts).collect()}
    assert got == {
        0: ("completed", 0, None), 1: ("completed", 2, None), 2: ("exhausted", 2, "last"), 3: ("refused", 0, "e"), 4: ("paused", 1, "e"), 5: ("canceled", 0, "e"), 6: ("aborted", 0, "e"), 7: ("waiting", 2, "late"), 8: ("declined", 0, "e"), 9: ("completed", 0, None),
    }
