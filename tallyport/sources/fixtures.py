"""Files of any size with known bytes, for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = 32


def fixture_chunks(spark: SparkSession, sizes: dict[str, int], chunk: int = 8 << 20, seed: str = "fixture") -> DataFrame:
    """``session, chunk_index, body`` of a file of each size: 32-byte blocks that are digests of seed, name and number.

    Chunks are made where they are used, by built-in functions; ``chunk`` is a multiple of 32.
    """
    if chunk % _BLOCK:
        raise ValueError("chunk must be a multiple of 32")
    files = spark.createDataFrame(list(sizes.items()), "session string, size_bytes long").filter("size_bytes > 0")
    rows = files.select("*", F.explode(F.expr(f"sequence(0L, (size_bytes - 1) div {chunk})")).alias("chunk_index"))
    first = f"chunk_index * {chunk // _BLOCK}"
    last = f"(least((chunk_index + 1) * {chunk}, size_bytes) - 1) div {_BLOCK}"
    blocks = F.expr(f"unhex(array_join(transform(sequence({first}, {last}), k -> sha2(concat_ws(':', '{seed}', session, k), 256)), ''))")
    body = F.expr(f"substring(blocks, 1, cast(least({chunk}, size_bytes - chunk_index * {chunk}) as int))")
    return rows.repartition("session", "chunk_index").select("session", "chunk_index", blocks.alias("blocks"), "size_bytes").select("session", "chunk_index", body.alias("body"))
