"""Writing uploads: each is put together by one task and becomes visible at commit, or none does."""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tallyport.functions.workers import reachable


@dataclass
class StagedUploads(WriterCommitMessage):
    """What a task has staged: (session, path)."""

    files: list[tuple[str, str]]


class StagedFileSink(DataSource):
    """``staged_files``: rows ``session string, chunk_index long, body binary, chunks long``, each session in one task and in order.

    The folder is a share that driver and executors mount.  A task appends the chunks of a session to a file of its own attempt;
    the driver only names them, when all tasks have ended.  :func:`save_uploads` deals the rows as this needs.
    """

    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def schema(self) -> str:
        return "session string, chunk_index long, body binary, chunks long"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return StagedFileWriter(self.options["path"])


def save_uploads(chunks: DataFrame, folder: str, expected: DataFrame | None = None) -> None:
    """Writes every session's chunks, in order, as one file of ``folder`` with the session's name.

    Fails, and leaves nothing, if a chunk is missing, a name is no plain file name, or one is taken.  ``expected (session, chunks)``
    says how many chunks each session has; without it a missing last chunk cannot be noticed.  Names appear one after the other:
    a reader may see some before all are there.
    """
    reachable(chunks.sparkSession).dataSource.register(StagedFileSink)
    rows = chunks.select("session", "chunk_index", "body")
    if expected is None:
        rows = rows.withColumn("chunks", F.lit(None).cast("long"))
    else:
        rows = rows.join(expected.select("session", F.col("chunks").cast("long").alias("chunks")), "session", "full_outer")
    rows.repartition("session").sortWithinPartitions("session", "chunk_index").write.format("staged_files").mode("append").save(folder)


def plain_name(name: str | None) -> bool:
    """Whether a session can name a file of its folder: one step, not hidden, and not among those that are staged."""
    return bool(name) and name[0] not in "._" and not set(name) & {"/", "\\", "\0"}


def save_documents(documents: DataFrame, root: str) -> DataFrame:
    """Writes ``documents (folder, document)`` as ``metadata.json`` of each folder below ``root``, a share that executors mount: ``folder, written``.

    A document is written under a name of its own and then takes the place of the one before, so a reader sees either; a task that runs
    again writes the same.  Nothing is written until the result is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folders, texts = batch.column("folder").to_pylist(), batch.column("document").to_pylist()
            for folder, text in zip(folders, texts, strict=True):
                if not plain_name(folder):
                    raise ValueError(f"not a name for a session: {folder!r}")
                os.makedirs(os.path.join(root, folder), exist_ok=True)
                candidate = os.path.join(root, folder, f"metadata.json.candidate-{uuid.uuid4()}.tmp")
                try:
                    with open(candidate, "x", encoding="utf-8") as out:
                        out.write(text)
                    os.replace(candidate, os.path.join(root, folder, "metadata.json"))
                finally:
                    if os.path.exists(candidate):
                        os.unlink(candidate)
            yield pa.RecordBatch.from_arrays([pa.array(folders, type=pa.string()), pa.array([len(t.encode()) for t in texts], type=pa.int64())], names=["folder", "written"])

    return documents.select("folder", "document").mapInArrow(run, "folder string, written long")


class StagedFileWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path, self.staging = path, os.path.join(path, f"_staging-{uuid.uuid4().hex}")
        os.makedirs(self.staging)  # by the driver alone: a task that outlives an abort cannot bring it back

    def write(self, rows: Iterator) -> StagedUploads:
        attempt, files = TaskContext.get().taskAttemptId(), []
        session, upcoming, chunks, out = None, 0, None, None

        def close() -> None:
            if out:
                out.close()
                if chunks is not None and upcoming != chunks:
                    raise ValueError(f"chunks of {session} are missing: {upcoming} of {chunks}")

        try:
            for row in rows:
                if out is None or row.session != session:
                    close()
                    if not plain_name(row.session):
                        raise ValueError(f"not a name for an upload: {row.session!r}")
                    session, upcoming, chunks = row.session, 0, getattr(row, "chunks", None)
                    files.append((session, os.path.join(self.staging, f"{uuid.uuid5(uuid.NAMESPACE_URL, session).hex}-{attempt}.part")))
                    out = open(files[-1][1], "wb")  # noqa: SIM115
                if row.chunk_index is None and row.body is None and chunks is not None:
                    continue  # a session that is expected and has no chunk at all
                if row.chunk_index != upcoming:
                    raise ValueError(f"chunks of {session} are missing or out of order: {row.chunk_index} came for {upcoming}")
                upcoming += 1
                out.write(row.body or b"")
            close()
        finally:
            if out:
                out.close()
        return StagedUploads(files)

    def commit(self, messages: list[StagedUploads | None]) -> None:
        files = [f for message in messages if message for f in message.files]
        if len({session for session, _ in files}) < len(files):
            self.abort(messages)
            raise ValueError("chunks of a session are spread over tasks")
        named: list[str] = []
        try:
            for session, staged in files:
                target = os.path.join(self.path, session)
                os.link(staged, target)  # unlike a rename it fails if the name is taken
                named.append(target)
        except OSError:
            for target in named:
                os.unlink(target)
            raise
        finally:
            self.abort(messages)

    def abort(self, messages: list[StagedUploads | None]) -> None:
        for _ in range(10):  # tasks may still be writing
            shutil.rmtree(self.staging, ignore_errors=True)
            if not os.path.exists(self.staging):
                return
            time.sleep(0.2)
