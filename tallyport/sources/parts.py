"""Multipart uploads through a broker: parts are put by many tasks, and what Spark commits of their receipts decides what is completed.

Each step is a table in a shared folder, so a lost executor costs its tasks only: an attempt whose rows are not committed leaves a
part that no list names, and its repetition puts the part again.  Nothing passes through the driver but the call.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPLOADS = "key string, upload_id string, error_code string"
RECEIPTS = "key string, upload_id string, chunk_index long, part_number long, size_bytes long, etag string, attempts long, error_code string"
OUTCOMES = "key string, upload_id string, parts long, size_bytes long, outcome string"
#: Answers after which a part may be put again.
RETRYABLE = frozenset({408, 425, 429}) | frozenset(range(500, 600))
MAX_PARTS = 10_000


class PartRejected(Exception):
    """The answer to a part was not a success."""

    def __init__(self, status: int) -> None:
        super().__init__(f"HTTP {status}")
        self.status = status


class Broker(Protocol):
    """What knows the store; it is sent to tasks, so it must be picklable.  ``complete`` and ``abort`` may be called again after they succeeded."""

    def create(self, key: str) -> str: ...

    def put(self, key: str, upload_id: str, part_number: int, body: bytes) -> str | None:
        """The part's ETag; raises :class:`PartRejected`."""

    def complete(self, key: str, upload_id: str, parts: list[tuple[int, str]]) -> None: ...

    def abort(self, key: str, upload_id: str) -> None: ...


def _each(df: DataFrame, schema: str, of) -> DataFrame:  # noqa: ANN001
    """One row of ``schema`` for each row, made as the rows come."""
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [x.split() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                made = of(**{n: batch.column(n)[k].as_py() for n in batch.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array([made[n]], type=kinds[t]) for n, t in fields], names=[n for n, _ in fields])

    return df.mapInArrow(run, schema)


def create_uploads(keys: DataFrame, broker: Broker) -> DataFrame:
    """``key, upload_id`` of a new upload for each ``key``; a broker that names none is an error of that key."""

    def of(key: str) -> dict:
        upload = broker.create(key)
        return {"key": key, "upload_id": upload or None, "error_code": None if upload else "transport.failed"}

    return _each(keys.select("key").distinct(), UPLOADS, of)


def put_parts(chunks: DataFrame, uploads: DataFrame, broker: Broker, max_attempts: int = 3) -> DataFrame:
    """A receipt for each of ``chunks (key, chunk_index, body)``; part numbers begin at 1.

    An answer that allows it is followed by another attempt, up to ``max_attempts``; a part without ETag is an error at once.
    """

    def of(key: str, upload_id: str, chunk_index: int, body: bytes | None) -> dict:
        etag, error, attempt = None, None, 0
        while True:
            attempt += 1
            try:
                etag = broker.put(key, upload_id, chunk_index + 1, body or b"")
                error = None if etag else "transport.receipt_missing"
            except PartRejected as rejected:
                if rejected.status in RETRYABLE and attempt < max_attempts:
                    continue
                error = "transport.part_rejected"
            return {"key": key, "upload_id": upload_id, "chunk_index": chunk_index, "part_number": chunk_index + 1, "size_bytes": len(body or b""), "etag": etag or None, "attempts": attempt, "error_code": error}

    rows = chunks.select("key", "chunk_index", "body").join(uploads.filter("error_code IS NULL").select("key", "upload_id"), "key")
    return _each(rows.select("key", "upload_id", "chunk_index", F.col("body").cast("binary").alias("body")).repartition(F.col("key"), F.col("chunk_index")), RECEIPTS, of)


def finish_uploads(uploads: DataFrame, receipts: DataFrame, broker: Broker) -> DataFrame:
    """Completes each upload whose parts are 1 to n, each once and with an ETag; aborts the others, and says why.

    The parts of an upload meet in one row; a store allows ``MAX_PARTS``, and an upload with more is refused before they do.
    """
    sums = receipts.groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("size_bytes").alias("size_bytes"), F.min("part_number").alias("low"), F.max("part_number").alias("high"), F.count_distinct("part_number").alias("different"), F.min("error_code").alias("refused"),
    )
    whole = (F.col("low") == 1) & (F.col("high") == F.col("parts")) & (F.col("different") == F.col("parts"))
    state = uploads.join(sums, "upload_id", "left")
    verdict = F.when(F.col("error_code").isNotNull(), F.col("error_code")).when(F.col("refused").isNotNull(), F.col("refused")).when(F.col("parts") > MAX_PARTS, "transport.failed").when(F.coalesce(whole, F.lit(False)), "completed").otherwise("transport.receipt_missing")
    state = state.select("key", "upload_id", F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), verdict.alias("outcome"))
    good = state.filter("outcome = 'completed'").select("upload_id")
    lists = receipts.join(good, "upload_id", "left_semi").groupBy("upload_id").agg(F.sort_array(F.collect_list(F.struct("part_number", "etag"))).alias("list"))

    def of(key: str, upload_id: str | None, parts: int, size_bytes: int, outcome: str, list: list[dict] | None) -> dict:  # noqa: A002
        if outcome == "completed":
            broker.complete(key, upload_id, [(p["part_number"], p["etag"]) for p in list])
        elif upload_id:
            try:
                broker.abort(key, upload_id)
            except Exception:  # noqa: BLE001  the first failure is what counts, and this one is told beside it
                outcome += ", transport.abort_failed"
        return {"key": key, "upload_id": upload_id, "parts": parts, "size_bytes": size_bytes, "outcome": outcome}

    return _each(state.join(lists, "upload_id", "left").select("key", "upload_id", "parts", "size_bytes", "outcome", "list"), OUTCOMES, of)


def upload(chunks: DataFrame, broker: Broker, folder: str, max_attempts: int = 3) -> DataFrame:
    """Uploads the objects of ``chunks (key, chunk_index, body)``: what became of each.

    ``folder`` is a new one that driver and executors share; it keeps the tables of uploads, receipts and outcomes.  A run that is broken off
    can go on from them: ``finish_uploads`` on the first two aborts what is not whole.
    """
    spark = chunks.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    uploads = kept(create_uploads(chunks, broker), "uploads")
    receipts = kept(put_parts(chunks, uploads, broker, max_attempts), "receipts")
    return kept(finish_uploads(uploads, receipts, broker), "outcomes")
