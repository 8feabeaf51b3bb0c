"""Files on any file system, by listing and by ranges: Spark lists, tasks read only the bytes that they need."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyport.functions.workers import reachable

#: Bytes of a chunk, and of what a positional read fetches at least.
CHUNK, BLOCK = 8 << 20, 4096
#: Schemes that tasks can open, by the name that Arrow has for them; of others Spark's own reader takes whole files.
_SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
_URI = re.compile(r"([a-zA-Z][a-zA-Z0-9+.-]*):(?://([^/]*))?(/.*)")


@lru_cache(maxsize=64)
def _system(scheme: str, authority: str) -> fs.FileSystem:
    return fs.LocalFileSystem() if scheme == "file" else fs.FileSystem.from_uri(f"{scheme}://{authority}/")[0]


def opened(path: str) -> pa.NativeFile:
    """A file for positional reads, by its full name; names are taken as they are, without decoding."""
    m = _URI.fullmatch(path)
    scheme, authority, name = (_SCHEMES.get(m[1].lower(), m[1].lower()), m[2] or "", m[3]) if m else ("file", "", path)
    system = _system(scheme, authority)
    return system.open_input_file(f"{authority}{name}" if system.type_name in ("s3", "gcs") else name)


def names(path: str) -> list[tuple[str, int]]:
    """Name and size of each file below a folder, in order."""
    m = _URI.fullmatch(path)
    head = path[: m.start(3)] if m else ""
    scheme, authority, name = (_SCHEMES.get(m[1].lower(), m[1].lower()), m[2] or "", m[3]) if m else ("file", "", path)
    system = _system(scheme, authority)
    bucket = authority if system.type_name in ("s3", "gcs") else ""
    found = system.get_file_info(fs.FileSelector(f"{bucket}{name}", recursive=True))
    return sorted((head + f.path.removeprefix(bucket), f.size) for f in found if f.type == fs.FileType.File)


def openable(path: str) -> bool:
    """Whether tasks can read ranges of this path."""
    m = _URI.fullmatch(path)
    return m is None or m[1].lower() in _SCHEMES


class Ranges:
    """Bytes of a file by place, fetched in blocks of which the last few are kept; ``fetched`` counts what was read."""

    def __init__(self, file: pa.NativeFile, block: int = BLOCK, kept: int = 8) -> None:
        self.file, self.size, self.block, self.kept, self.fetched = file, file.size(), block, kept, 0
        self._blocks: dict[int, bytes] = {}

    def __call__(self, at: int, n: int) -> bytes:
        """``n`` bytes from place ``at``; fewer at the end of the file."""
        n = max(0, min(n, self.size - at))
        parts = [self._block(k) for k in range(at // self.block, (at + n - 1) // self.block + 1)] if n else []
        skip = at % self.block
        return b"".join(parts)[skip : skip + n]

    def _block(self, k: int) -> bytes:
        if k not in self._blocks:
            while len(self._blocks) >= self.kept:
                self._blocks.pop(next(iter(self._blocks)))
            self._blocks[k] = self.file.read_at(min(self.block, self.size - k * self.block), k * self.block)
            self.fetched += len(self._blocks[k])
        return self._blocks[k]


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, size_bytes, modified_at`` of each file below ``path`` on any file system that Spark reaches, empty ones too (without time of change).

    Spark's own listing, of which nothing is opened; it skips names that begin with a dot or underscore.  Like it, the driver holds
    the names, and no more.
    """
    spark = reachable(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    files = listed.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    names = spark.createDataFrame([(_plain(name),) for name in listed.inputFiles()], "path string")
    empty = names.join(files, "path", "left_anti").select("path", F.lit(0).cast("long").alias("size_bytes"), F.lit(None).cast("timestamp").alias("modified_at"))
    return files.unionByName(empty)


def _plain(uri: str) -> str:
    """A name as Hadoop's paths show it: one slash after the scheme if there is no authority, and nothing encoded."""
    from urllib.parse import unquote

    return unquote(re.sub(r"^([a-zA-Z][a-zA-Z0-9+.-]*):///", r"\1:/", uri))


def file_ranges(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``path, chunk_index, start_byte, body`` of each chunk of ``files (path, size_bytes)``; a file of any size is read by many tasks.

    An empty file is one chunk without bytes.
    """
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("size_bytes") - 1) / chunk))
    wanted = files.select("path", "size_bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_index"))
    wanted = wanted.select("path", "chunk_index", (F.col("chunk_index") * chunk).alias("start_byte"), F.least(F.lit(chunk), F.col("size_bytes") - F.col("chunk_index") * chunk).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index, start, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                with opened(path) as file:
                    body = file.read_at(n, start) if n else b""
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([index]), pa.array([start]), pa.array([body], type=pa.binary())], names=["path", "chunk_index", "start_byte", "body"])

    return wanted.repartition(F.col("path"), F.col("chunk_index")).mapInArrow(run, "path string, chunk_index long, start_byte long, body binary")
