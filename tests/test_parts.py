"""Multipart uploads with a broker that keeps parts as files."""

import hashlib
import os
import uuid

import pytest
from pyspark.sql import functions as F

from tallyport.sources import parts

SCHEMA = "key string, chunk_index long, body binary"


class Files:
    """Parts are files named by number and ETag; keys say how the store behaves."""

    def __init__(self, folder):
        self.folder = folder

    def path(self, *names):
        path = os.path.join(self.folder, *names)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return path

    def create(self, key):
        return "" if key == "nameless" else f"{key}-{uuid.uuid4().hex}"

    def put(self, key, upload_id, part_number, body):
        tries = self.path("tries", f"{upload_id}-{part_number}")
        with open(tries, "a") as f:
            f.write("x")
        n = os.path.getsize(tries)
        if key == "slow" and part_number == 2 and n < 3:
            raise parts.PartRejected(503)
        if key == "busy" and part_number == 1:
            raise parts.PartRejected(429)
        if key == "forbidden" and part_number == 2:
            raise parts.PartRejected(403)
        if key == "untagged" and part_number == 1:
            return None
        etag = hashlib.sha256(body + str(n).encode()).hexdigest()[:16]
        with open(self.path("parts", upload_id, f"{part_number}-{etag}"), "wb") as f:
            f.write(body)
        return etag

    def complete(self, key, upload_id, listed):
        data = b"".join(open(self.path("parts", upload_id, f"{n}-{etag}"), "rb").read() for n, etag in listed)
        with open(self.path("done", key), "wb") as f:
            f.write(data)

    def abort(self, key, upload_id):
        if key == "forbidden":
            raise OSError("no")
        open(self.path("aborted", upload_id), "w").close()


@pytest.fixture
def broker(tmp_path):
    return Files(str(tmp_path / "store"))


def chunks(spark, sizes):
    return spark.createDataFrame([(key, k, f"{key}:{k};".encode()) for key, n in sizes.items() for k in range(n)], SCHEMA).repartition(5)


def tried(broker, key):
    return {n.rsplit("-", 1)[1]: os.path.getsize(os.path.join(broker.folder, "tries", n)) for n in os.listdir(os.path.join(broker.folder, "tries")) if n.startswith(f"{key}-")}


def test_uploads_end_whole_or_aborted(spark, broker, tmp_path):
    rows = chunks(spark, {"plain": 12, "one": 1, "slow": 3, "busy": 2, "forbidden": 3, "untagged": 2, "nameless": 2})
    rows = rows.unionByName(spark.createDataFrame([("gap", 0, b"a"), ("gap", 2, b"c"), ("empty", 0, None), ("twice", 0, b"a"), ("twice", 0, b"a")], SCHEMA))
    got = {r.key: (r.parts, r.size_bytes, r.outcome) for r in parts.upload(rows, broker, f"file://{tmp_path}/run").collect()}
    size = lambda key, n: sum(len(f"{key}:{k};") for k in range(n))
    assert got == {
        "plain": (12, size("plain", 12), "completed"), "one": (1, 6, "completed"), "slow": (3, 21, "completed"), "busy": (2, 14, "transport.part_rejected"), "forbidden": (3, size("forbidden", 3), "transport.part_rejected, transport.abort_failed"),
        "untagged": (2, 22, "transport.receipt_missing"), "nameless": (0, 0, "transport.failed"), "gap": (2, 2, "transport.receipt_missing"), "empty": (1, 0, "completed"), "twice": (2, 2, "transport.receipt_missing"),
    }
    done = {n: open(os.path.join(broker.folder, "done", n), "rb").read() for n in os.listdir(os.path.join(broker.folder, "done"))}
    assert done == {**{k: "".join(f"{k}:{i};" for i in range(n)).encode() for k, n in (("plain", 12), ("one", 1), ("slow", 3))}, "empty": b""}
    assert {n.split("-")[0] for n in os.listdir(os.path.join(broker.folder, "aborted"))} == {"busy", "untagged", "gap", "twice"}
    assert tried(broker, "slow") == {"1": 1, "2": 3, "3": 1} and tried(broker, "busy")["1"] == 3 and tried(broker, "forbidden")["2"] == 1 and tried(broker, "untagged")["1"] == 1


def test_an_attempt_that_is_not_committed_leaves_no_part(spark, broker, tmp_path):
    """The parts of another attempt, as of a lost executor or a speculative task, have other ETags and are in no list."""
    rows = chunks(spark, {"a": 4, "b": 2})
    uploads = spark.createDataFrame(parts.create_uploads(rows, broker).collect(), parts.UPLOADS)
    parts.put_parts(rows.filter("chunk_index < 3"), uploads, broker).collect()  # lost
    receipts = parts.put_parts(rows, uploads, broker)
    receipts.write.parquet(f"{tmp_path}/receipts")
    kept = spark.read.parquet(f"{tmp_path}/receipts")
    assert {r.outcome for r in parts.finish_uploads(uploads, kept, broker).collect()} == {"completed"}
    assert open(os.path.join(broker.folder, "done", "a"), "rb").read() == b"a:0;a:1;a:2;a:3;"
    again = parts.finish_uploads(uploads, kept.filter(F.col("key") == "b"), broker).collect()  # what is left of a run that broke off
    assert {r.key: r.outcome for r in again} == {"a": "transport.receipt_missing", "b": "completed"}
