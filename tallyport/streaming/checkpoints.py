"""Completed chunks of uploads as a stream: keyed state of bitmaps into which each acknowledgement is merged."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Chunks of one entry of the state.
SPAN = 1024
OUTPUT = "manifest_id long, position long, chunk_index long, uploaded_bytes long, ranges long, next_index long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Checkpoint(StatefulProcessor):
    """Per upload: a bit for each completed chunk, in entries of ``SPAN``; bytes, ranges and the first missing chunk as they are now.

    An acknowledgement looks at its own bit and the two beside it, however many ranges there are.
    """

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bits = handle.getMapState("bits", "span long", "bits binary", self.idle_ms)
        self.sums = handle.getValueState("sums", "uploaded_bytes long, ranges long, next_index long", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        spans: dict[int, int] = {}
        changed: set[int] = set()

        def span(k: int) -> int:
            if k not in spans:
                held = self.bits.getValue((k,)) if self.bits.containsKey((k,)) else None
                spans[k] = int.from_bytes(held[0], "little") if held else 0
            return spans[k]

        def done(chunk: int) -> bool:
            return chunk >= 0 and bool(span(chunk // SPAN) >> chunk % SPAN & 1)

        held = self.sums.get() if self.sums.exists() else None
        uploaded, ranges, upcoming = tuple(held) if held else (0, 0, 0)
        for r in sorted(rows, key=lambda r: r.position):
            chunk = r.chunk_index
            if chunk is None or not 0 <= chunk < r.total_chunks or done(chunk):
                continue
            spans[chunk // SPAN] = span(chunk // SPAN) | 1 << chunk % SPAN
            changed.add(chunk // SPAN)
            uploaded += min(r.chunk_size, r.total_bytes - chunk * r.chunk_size)
            ranges += 1 - done(chunk - 1) - done(chunk + 1)
            while done(upcoming):  # whole spans at a time
                rest = ~span(upcoming // SPAN) >> upcoming % SPAN & (1 << SPAN - upcoming % SPAN) - 1
                upcoming += (rest & -rest).bit_length() - 1 if rest else SPAN - upcoming % SPAN
            yield Row(manifest_id=key[0], position=r.position, chunk_index=chunk, uploaded_bytes=uploaded, ranges=ranges, next_index=upcoming)
        for k in changed:
            self.bits.updateValue((k,), (spans[k].to_bytes(SPAN // 8, "little"),))
        if changed:
            self.sums.update((uploaded, ranges, upcoming))

    def close(self) -> None:
        pass


def resume_checkpoints(acks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """After each first acknowledgement of a chunk: planned bytes of what is complete, how many ranges that is, and the first missing chunk.

    ``acks (manifest_id, position, chunk_index, chunk_size, total_bytes, total_chunks)`` come in the order of ``position`` from batch to
    batch; within one they are sorted.  The same as the operator ``resume_checkpoint`` says of a table.  An upload that is silent for
    ``idle_ms`` is forgotten.  Needs the RocksDB state store.
    """
    if acks.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {PROVIDER}")
    rows = acks.select("manifest_id", "position", "chunk_index", "chunk_size", "total_bytes", "total_chunks")
    return rows.groupBy("manifest_id").transformWithState(_Checkpoint(idle_ms), OUTPUT, "Append", "ProcessingTime" if idle_ms else "None")
