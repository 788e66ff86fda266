"""Several token buckets that must all let a request pass, with the time to wait; keys are cut where every bucket is full again.

A limit is (capacity, window): a bucket of `capacity` requests that fills up evenly within `window` seconds. A request asks the buckets in order and is
refused by the first that is empty; those before it have given a token all the same. Tokens are whole numbers of 1 / window parts, so nothing is rounded.

After a pause as long as the widest window every bucket is full, whatever came before. Events are counted by key and window of time first; only between
two such windows can there be a pause so long, and so keys fall into stretches that know nothing of each other, each of them a group of its own. A stretch of no
more requests than the least capacity passes as a whole, without leaving the JVM. Longer ones go, sorted by Spark, through Arrow batches one after the
other with a few numbers of state, so that even a key that never pauses needs no more memory than a batch.

Defined results: events without a time have a null `ok` and `wait`; a null key is a key; of one time the lesser id is first, null ids before all; repeated rows are
requests of their own. Empty tables give empty results. Columns besides the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000


def take(held: list[int], since: int | None, at: int, limits: Sequence[tuple[int, int]]) -> int:
    """Seconds to wait (0: the request passes) at a time in microseconds; `held`, what each bucket held at `since`, becomes what it holds now.

    limits: capacities and windows in microseconds. A bucket of full capacity holds capacity * window, and a request takes window of it.
    """
    passed = 0 if since is None else at - since
    for i, (capacity, window) in enumerate(limits):
        held[i] = min(capacity * window, held[i] + passed * capacity)
    for i, (capacity, window) in enumerate(limits):
        if held[i] < window:
            return max(1, -((held[i] - window) // (capacity * SECOND)))
        held[i] -= window
    return 0


def _folded(limits: Sequence[tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of id, key, _stretch and _t, sorted by stretch and time, to id, key, ok and wait."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, since = None, [], None
        for batch in batches:
            waits = []
            for key, stretch, at in zip(*(batch[c].to_pylist() for c in ("key", "_stretch", "_t")), strict=True):
                if (key, stretch) != of:
                    of, held, since = (key, stretch), [capacity * window for capacity, window in limits], None
                waits.append(take(held, since, at, limits))
                since = at
            yield pa.RecordBatch.from_arrays([batch["id"], batch["key"], pa.array([w == 0 for w in waits], pa.bool_()), pa.array(waits, pa.int64())], names=["id", "key", "ok", "wait"])

    return fold


def limited(events: DataFrame, key: str, at: str, id: str, limits: Sequence[tuple[int, float]]) -> DataFrame:
    """id, key, ok and wait (seconds until the refusing bucket has a token again; 0 if ok) of every event. limits: capacities and windows in seconds."""
    if not limits or any(capacity < 1 or window <= 0 for capacity, window in limits):
        raise ValueError("a limit needs a capacity of one at least and a window")
    exact = [(int(capacity), round(window * SECOND)) for capacity, window in limits]
    widest = max(window for _, window in exact)
    read = events.select(F.col(id).alias("id"), F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("_t"))
    timed = read.filter("_t is not null").withColumn("_window", F.expr(f"_t div {widest}"))
    by_time = Window.partitionBy("key").orderBy("_window")
    spans = timed.groupBy("key", "_window").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count("*").alias("_n"))
    paused = F.coalesce(F.col("_lo") - F.lag("_hi").over(by_time) >= widest, F.lit(True))
    cut = spans.withColumn("_new", paused.cast("long")).withColumn("_stretch", F.sum("_new").over(by_time))
    sized = cut.withColumn("_many", F.sum("_n").over(Window.partitionBy("key", "_stretch"))).select(F.col("key").alias("_key"), F.col("_window").alias("_at"), "_stretch", "_many")
    placed = timed.join(sized, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_window") == F.col("_at"))).select("id", "key", "_t", "_stretch", "_many")
    least = min(capacity for capacity, _ in exact)
    easy = placed.filter(F.col("_many") <= least).select("id", "key", F.lit(True).alias("ok"), F.lit(0).cast("long").alias("wait"))
    shape = T.StructType([*read.select("id", "key").schema.fields, T.StructField("ok", T.BooleanType()), T.StructField("wait", T.LongType())])
    ordered = placed.filter(F.col("_many") > least).repartition("key", "_stretch").sortWithinPartitions("key", "_stretch", "_t", "id")
    untimed = read.filter("_t is null").select("id", "key", F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("long").alias("wait"))
    return easy.unionByName(ordered.mapInArrow(_folded(exact), shape)).unionByName(untimed)
