"""A store of JSON values by key, kept as versions: a write is a new version, and one rename makes it the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "entry string, stored string"
_CURRENT = "CURRENT"


class Conflict(RuntimeError):
    """Another writer was faster."""


class JsonStore:
    """``entry, stored`` rows below ``path``, on any file system that Spark reaches.

    Readers see one version or the next, never part of one.  The current one is named together with the one before it, for
    readers that still use that; a writer deletes only the one that was named before, never what another is writing.  A writer that
    finds another's version named when it is done fails with ``Conflict``, and its own is gone; between that look and the
    rename there is a moment in which two writers could both succeed, so writers that must not lose anything need a lock.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _hadoop(self, name: str):  # noqa: ANN202
        return self._fs.Path(f"{self.path}/{name}")

    def _named(self) -> list[str]:
        """The names of the current version and of the one before, as far as there are."""
        if not self._hadoop(_CURRENT).getFileSystem(self._conf).exists(self._hadoop(_CURRENT)):
            return []
        return [r[0] for r in self.spark.read.text(f"{self.path}/{_CURRENT}").collect()]

    def version(self) -> str | None:
        """The name of the current version, if there is one."""
        return next(iter(self._named()), None)

    def read(self) -> DataFrame:
        """All entries."""
        return self._read(self._named())

    def _read(self, named: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).json(f"{self.path}/{named[0]}") if named else self.spark.createDataFrame([], SCHEMA)

    def get(self, key: str) -> DataFrame:
        return self.read().filter(F.col("entry") == key)

    def scan(self, prefix: str) -> DataFrame:
        return self.read().filter(F.col("entry").startswith(prefix))

    def replace(self, entries: DataFrame) -> None:
        """Makes ``entries`` all that the store holds."""
        self._replace(entries, self._named())

    def _replace(self, entries: DataFrame, before: list[str]) -> None:
        name = f"version-{uuid.uuid4().hex}"
        entries.select("entry", "stored").write.option("compression", "gzip").json(f"{self.path}/{name}")
        files = self._hadoop(_CURRENT).getFileSystem(self._conf)
        if self._named() != before:
            files.delete(self._hadoop(name), True)
            raise Conflict(f"{self.path} has been changed meanwhile")
        out = files.create(self._hadoop(f"{_CURRENT}.{name}"), True)
        out.write(bytearray("\n".join([name, *before[:1]]).encode()))
        out.close()
        rename = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self._fs.FileContext.getFileContext(self._hadoop(_CURRENT).getFileSystem(self._conf).getUri(), self._conf)
        context.rename(context.makeQualified(self._hadoop(f"{_CURRENT}.{name}")), context.makeQualified(self._hadoop(_CURRENT)), rename)
        for old in before[1:]:
            files.delete(self._hadoop(old), True)

    def apply(self, changes: DataFrame) -> None:
        """Puts and deletes (a null ``stored``) of ``entry, position, stored``; of each key the last counts."""
        before = self._named()
        last = changes.withColumn("place", F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("position")))).filter("place = 1")
        stays = self._read(before).join(last, "entry", "left_anti")
        self._replace(stays.unionByName(last.filter("stored is not null").select("entry", "stored")), before)
