"""Unions of ranges that are put together before they are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyport.functions.workers import reachable
from tallyport.plans import registry

#: Ranges that a task unites at a time.
ROWS = 200_000


def _united(keys: pa.Array, start: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ranges of each key that touch or overlap, united."""
    coded = pc.dictionary_encode(keys, null_encoding="encode")
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((start, code))
    code, start, end = code[order], start[order], end[order]
    # The farthest end so far, within each key: keys are lifted above each other, which stays below 2**63 by ranks of the ends.
    values, rank = np.unique(end, return_inverse=True)
    reach = values[np.maximum.accumulate(code.astype(np.int64) * len(values) + rank) - code.astype(np.int64) * len(values)]
    new = np.concatenate(([True], (code[1:] != code[:-1]) | (start[1:] - 1 > reach[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(code)])) - 1
    return coded.dictionary.take(pa.array(code[first])), start[first], reach[last]


def premerged(ranges: DataFrame, key: str = "record_id", start: str = "start_index", end: str = "end_index") -> DataFrame:
    """``ranges`` with those of a task and key united, as far as the task has them together: fewer rows with the same union.

    Ranges that end before they begin, or lack an end, are none.
    """
    kind = ranges.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def united() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            keys, first, last = _united(pa.concat_arrays(table.column(0).chunks), table.column(1).to_numpy(), table.column(2).to_numpy())
            return pa.RecordBatch.from_arrays([keys, pa.array(first), pa.array(last)], schema=held[0].schema)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                held = [united()]
                if held[0].num_rows * 2 > ROWS:  # little to unite: on with it
                    yield held.pop()
        if held:
            yield united()

    rows = ranges.select(F.col(key), F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end)).filter(F.col(start) <= F.col(end))
    return rows.mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField(start, T.LongType()), T.StructField(end, T.LongType())]))


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """The union of the ranges of each record, as the operator ``merge_ranges`` gives it; hot records shuffle what their ranges cover, not each of them."""
    return registry.run("merge_ranges", ranges.sparkSession, ranges=premerged(ranges))


registry.QUERIES["merge_ranges_combined"] = lambda spark, sf_dir: merge_ranges(registry.frame(reachable(spark), sf_dir, "ranges"))
registry._ORACLES["merge_ranges_combined"] = lambda: registry._ORACLES["merge_ranges"]()
