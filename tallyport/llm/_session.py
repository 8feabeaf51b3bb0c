"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyport.functions.workers import reachable

_OWN: dict[str, str] = {}
#: Paths of the tables that are made while :func:`settled` runs.
_MADE: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader."""
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it.

    Only a local session without that setting gets a temporary folder; on a cluster its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: a folder shared by driver and executors is needed")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='tallyport-')}"
    return _OWN[context.applicationId]


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/tallyport/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str = "table") -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends there, and any executor may be lost."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    if _MADE:
        _MADE[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._tallyport_path = path
    return again


def settled(make: Callable[[], DataFrame], kind: str, *more: DataFrame) -> DataFrame:
    """What ``make`` gives, as a table; the tables that it made on the way, and ``more``, are deleted when that is written."""
    _MADE.append([])
    try:
        out = make()
    finally:
        made = _MADE.pop()
    out = materialize(out, kind)
    for path in made:
        drop_path(out.sparkSession, path)
    discard(*more)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for df in tables:
        drop_path(df.sparkSession, df._tallyport_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system, wherever it is."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def salted_join(left: DataFrame, right: DataFrame, on: str, how: str = "left", salts: int = 16) -> DataFrame:
    """Join with a ``right`` side that has one row a key: its rows are repeated per salt, so that a hot key of ``left``
    is dealt over ``salts`` tasks."""
    from pyspark.sql import functions as F

    spread = left.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in left.dtypes if c != on and "map<" not in kind and "variant" not in kind]), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.array(*[F.lit(k) for k in range(salts)])))
    return spread.join(copies, [on, "__salt"], how).drop("__salt")
