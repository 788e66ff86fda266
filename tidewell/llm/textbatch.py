"""Arrow batches of rows with texts, cut so that a Python worker holds a bounded amount of text at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialise

#: Bytes of text that are worked on at once; one longer text is worked on alone.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most so many bytes in a string column, one row at least."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def gathered(batches: Iterable[pa.RecordBatch], column: str, least: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches put together until they have so many bytes in a string column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def over_slices(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow by slices. make() is called once in each task and returns what maps a slice to its result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, column, most):
                yield step(part)

    return df.mapInArrow(run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """docs with `_row`, a number that each row has for itself: doc_id if no row lacks or shares it, else one given as the rows are written."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("_many")).filter("doc_id is null or _many > 1").isEmpty():
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    return materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "identified")


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with `_row`, a number of each row in order of doc_id (none last), then text; and whether that is doc_id itself, which no row lacks or shares then.

    Of rows that agree in both, either may come first.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("_many")).filter("doc_id is null or _many > 1").isEmpty():
        return docs.withColumn("_row", F.col("doc_id").cast("long")), True
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), "text")
    return materialise(ordered.withColumn("_row", F.monotonically_increasing_id()), "numbered"), False
