"""Files as tables: whole small files, and ranges of large ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyport.functions.workers import reachable
from tallyport.plans.registry import _ORACLES, QUERIES, frame, oracle
from tallyport.sources.ranges import file_ranges, list_files, names, openable, opened

CHUNK = 8 << 20


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Path, size, time of change and digest of each file, on any file system that Spark lists; empty files have no time of change.

    Files of any size are read in ranges by many tasks; where tasks cannot open the file system, whole by Spark's reader (up to 2 GiB each).
    """
    files = list_files(spark, path, glob)
    if not openable(path):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        whole = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", F.sha2("content", 256).alias("sha256"))
        return files.join(whole, "path", "left").withColumn("sha256", F.coalesce("sha256", F.sha2(F.lit(b""), 256)))
    digests = chunked_sha256(file_ranges(files), "path", "chunk_index", "body").select(F.col("file").alias("path"), "sha256")
    return files.join(digests, "path")


class FileRange(InputPartition):
    """Bytes of one file that one task reads."""

    def __init__(self, path: str, first: int, stop: int) -> None:
        self.path, self.first, self.stop = path, first, stop


class FileChunkSource(DataSource):
    """``spark.read.format("file_chunks").load(folder)``: a row for each chunk of each file, whatever its size.

    The folder must be one that driver and executors can open (see :mod:`tallyport.sources.ranges`); options ``chunk`` (bytes) and ``chunksPerTask``.
    """

    @classmethod
    def name(cls) -> str:
        return "file_chunks"

    def schema(self) -> str:
        return "path string, chunk_index long, start_byte long, body binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return FileChunkReader(self.options["path"], int(self.options.get("chunk", CHUNK)), int(self.options.get("chunkspertask", 8)))


class FileChunkReader(DataSourceReader):
    def __init__(self, path: str, chunk: int, per_task: int) -> None:
        self.path, self.chunk, self.per_task = path, chunk, per_task

    def partitions(self) -> list[FileRange]:
        step = self.chunk * self.per_task
        out = [FileRange(name, at, min(at + step, size)) for name, size in names(self.path) for at in range(0, size, step)]
        return out or [FileRange("", 0, 0)]

    def read(self, partition: FileRange) -> Iterator[tuple]:
        if partition.path:
            with opened(partition.path) as f:
                for at in range(partition.first, partition.stop, self.chunk):
                    yield partition.path, at // self.chunk, at, f.read_at(min(self.chunk, partition.stop - at), at)


def chunked_sha256(chunks: DataFrame, key: str, index: str, body: str) -> DataFrame:
    """Digest and size of each file from its chunks.

    The digest is a fold in order, which cannot be merged: chunks are dealt by file and sorted, and a task streams through
    them with one running digest, so that neither a file nor its chunks are ever held together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["file", "sha256", "size_bytes"])
        state, done = None, []
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if state is None or state[0] != file:
                    if state:
                        done.append((state[0], state[1].hexdigest(), state[2]))
                    state = [file, hashlib.sha256(), 0]
                state[1].update(content or b"")
                state[2] += len(content or b"")
            if len(done) > 1000:
                yield pack(done)
                done = []
        if state:
            done.append((state[0], state[1].hexdigest(), state[2]))
        if done:
            yield pack(done)

    rows = chunks.select(F.col(key).cast("string").alias("file"), F.col(index).alias("at"), F.col(body).cast("binary").alias("body"))
    return rows.repartition("file").sortWithinPartitions("file", "at").mapInArrow(run, "file string, sha256 string, size_bytes long")


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in chunks of 1000 bytes, each made on the file's own row."""
    files = frame(spark, sf_dir, "files").filter("content <> ''").select("file_id", F.col("content").cast("binary").alias("content"))
    chunks = files.select("file_id", "content", F.explode(F.expr("sequence(0L, (octet_length(content) - 1) div 1000)")).alias("chunk_index"))
    body = F.expr("substring(content, cast(chunk_index * 1000 + 1 as int), 1000)")
    return chunked_sha256(chunks.select("file_id", "chunk_index", body.alias("body")), "file_id", "chunk_index", "body").select(F.col("file").cast("long").alias("file_id"), "sha256", "size_bytes")


def concat_chunks(staged: DataFrame) -> DataFrame:
    """Digest and size of each session's chunks, the last generation of each, one after the other; no session is held whole."""
    place = Window.partitionBy("session_id", "chunk_index").orderBy(F.desc("generation"))
    last = staged.withColumn("place", F.row_number().over(place)).filter("place = 1")
    return chunked_sha256(last, "session_id", "chunk_index", "body").select(F.col("file").cast("long").alias("session_id"), "sha256", "size_bytes")


QUERIES["chunked_sha256"] = _chunked
_ORACLES["chunked_sha256"] = lambda: "SELECT doc_id AS file_id, sha256(text) AS sha256, strlen(text)::BIGINT AS size_bytes FROM documents WHERE text <> ''"
QUERIES["concat_chunks"] = lambda spark, sf_dir: concat_chunks(frame(reachable(spark), sf_dir, "staged"))
_ORACLES["concat_chunks"] = lambda: oracle(
    "SELECT session_id, sha256(whole) AS sha256, strlen(whole)::BIGINT AS size_bytes FROM (SELECT session_id, string_agg(body, '' ORDER BY chunk_index) AS whole FROM (SELECT *, row_number() OVER (PARTITION BY session_id, chunk_index ORDER BY generation DESC) AS place FROM {staged}) q WHERE place = 1 GROUP BY session_id) t", {}
)
QUERIES["scan_files"] = lambda spark, sf_dir: scan_files(reachable(spark), sf_dir)
