"""Near-duplicate embeddings by a pivot-permutation index.

Pivots are vectors of the table, drawn by a hash of their ids; a vector is described by its NEAREST pivots in order of cosine.
An inverted list belongs to each set of SHARED pivots; a vector is in the lists of all such sets among its nearest, so two vectors
meet in a list if and only if they have that many near pivots in common. Pivots are as many as keep the lists' mean length,
(LOAD * rows)^(1/3).

Vectors that are equal are one node. Nodes with the same first pivots in order are gathered into balls around hubs, of half
the threshold's angle, so that any two members are linked for certain: a crowd of near copies costs its size times
a few hubs, not its pairs. What meets in the lists are balls. A pair of balls is settled by its centres' angle and radii where these
decide for all members; else each member is compared with the other centre, and where that leaves it open too, with each member
there. So counts of links are exact for all that meet.

Defined results: vectors that are null, zero, empty or hold null or non-finite components are linked with nothing (n_links 0, their own
component), as are vectors of another length. Repeated vec_ids are nodes by their vectors; a null vec_id has a null component of its own.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.components import components
from tidewell.llm.minhash import mix
from tidewell.session import materialise

#: Near pivots of a vector, how many two vectors must share, first pivots of vectors that gather around hubs.
NEAREST, SHARED, FIRST = 7, 3, 2
#: Rows times this is the cube of the number of pivots.
LOAD = 60
#: Hubs of a bucket in each round of gathering.
HUBS = (1, 8)
#: Slack for angles where these decide for many pairs at once.
SLACK = 1e-7


def usable(embedding: str = "embedding") -> Column:
    """Whether a vector can have a cosine."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))


def unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, scaled to unit length in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def describe(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unit vectors: the bucket of their first pivots in order, and the numbers of their inverted lists."""
    near = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :NEAREST].astype(np.uint64)
    bucket = np.full(len(x), np.uint64(x.shape[1]))
    for i in range(min(FIRST, near.shape[1])):
        bucket = mix(bucket * np.uint64(0x9E3779B97F4A7C15) + near[:, i] + np.uint64(1))
    near = np.sort(near, axis=1)
    lists = []
    for some in combinations(range(near.shape[1]), min(SHARED, near.shape[1])):
        key = np.full(len(x), np.uint64(x.shape[1]))
        for i in some:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + near[:, i] + np.uint64(1))
        lists.append(key)
    return bucket.view(np.int64), np.stack(lists, 1).view(np.int64)


def _angles(df: DataFrame, a: str, b: str) -> DataFrame:
    """df without its list columns a and b, and with the cosine of their unit vectors."""
    kept = [c for c in df.columns if c not in (a, b)]

    def run(batches):
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (a, b))
            sizes = pc.list_value_length(batch.column(a)).to_numpy(zero_copy_only=False)  # vectors of several lengths may come together
            cos = np.add.reduceat(x * y, np.cumsum(sizes) - sizes) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(cos, pa.float64())], [*kept, "cos"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in kept)
    return df.mapInArrow(run, f"{schema}, cos double")


def index(nodes: DataFrame) -> DataFrame:
    """nodes (id, copies, embedding) with unit vectors x, their bucket and inverted lists."""
    spark = nodes.sparkSession
    pivots = {}
    for r in nodes.groupBy(F.size("embedding").alias("d")).count().collect():
        many = max(NEAREST, math.ceil((LOAD * r["count"]) ** (1 / 3)))
        drawn = nodes.filter(F.size("embedding") == r["d"]).select("embedding").orderBy(F.xxhash64("id"), "id").limit(many).toArrow()
        pivots[r["d"]] = unit(drawn["embedding"].combine_chunks())
    shipped = spark.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                x = unit(part.column("embedding"))
                bucket, lists = describe(x, shipped.value[int(d)])
                rows = lambda m, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind))
                yield pa.record_batch({"id": part.column("id"), "copies": part.column("copies"), "x": rows(x, pa.float64()), "bucket": bucket, "lists": rows(lists, pa.int64())})

    return nodes.mapInArrow(run, "id long, copies long, x array<double>, bucket long, lists array<long>")


def gather(points: DataFrame, angle: float) -> DataFrame:
    """points with the hub they are within the angle of (id, copies, hub, away); each point without one is its own hub."""
    left, found = points.select("id", "copies", "x", "bucket"), None
    for hubs in HUBS:
        slot = F.pmod(F.xxhash64("id"), F.lit(hubs))
        chosen = left.groupBy("bucket", slot.alias("_slot")).agg(F.min("id").alias("hub")).join(left.select(F.col("id").alias("hub"), F.col("x").alias("y")), "hub").select("bucket", "hub", "y")
        near = _angles(left.join(chosen, "bucket").select("id", "hub", "x", "y"), "x", "y").filter(F.col("cos") >= math.cos(angle))
        # a hub stays with itself; other points go to their nearest hub
        best = near.groupBy("id").agg(F.max(F.struct(F.when(F.col("id") == F.col("hub"), 2.0).otherwise(F.least("cos", F.lit(1.0))).alias("cos"), "hub")).alias("best"))
        near = materialise(best.select("id", "best.hub", F.acos(F.least("best.cos", F.lit(1.0))).alias("away")), "near")
        hubs_taken = near.filter("hub <> id").select("hub").distinct()
        settled = near.join(hubs_taken, "hub", "left_semi")
        found = settled if found is None else found.unionByName(settled)
        left = materialise(left.join(settled.select("id"), "id", "left_anti"), "left")
    alone = left.select("id", F.col("id").alias("hub"), F.lit(0.0).alias("away"))
    return found.select("id", "hub", "away").unionByName(alone)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (the least vec_id that links reach), kept."""
    limit = math.acos(threshold)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable(), F.col("embedding")).alias("embedding"))
    nodes = rows.filter("embedding is not null and vec_id is not null").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    # ids of nodes must differ even where vec_ids repeat
    nodes = materialise(nodes.groupBy("id").agg(F.collect_list(F.struct("embedding", "copies")).alias("_all")).select("id", F.posexplode("_all").alias("_n", "_v")).select(F.when(F.col("_n") == 0, F.col("id")).otherwise(F.xxhash64("id", "_n")).alias("id"), F.col("id").alias("vec_id"), "_v.copies", "_v.embedding"), "nodes")
    points = materialise(index(nodes.select("id", "copies", "embedding")), "points")
    member = materialise(gather(points, limit / 2 - SLACK), "members").join(points.select("id", "copies", "x", "lists"), "id")
    member = materialise(member, "balls")
    balls = member.groupBy("hub").agg(F.sum("copies").alias("weight"), F.max("away").alias("radius"))
    centres = materialise(balls.join(points.select(F.col("id").alias("hub"), "x"), "hub"), "centres")

    listed = member.select("hub", F.explode("lists").alias("list")).distinct()
    pairs = listed.join(listed.select("list", F.col("hub").alias("other")), "list").filter("hub < other").groupBy("hub", "other").agg(F.lit(1).alias("_")).drop("_")
    side = centres.select(F.col("hub").alias("other"), F.col("weight").alias("other_weight"), F.col("radius").alias("other_radius"), F.col("x").alias("y"))
    pairs = _angles(pairs.join(centres, "hub").join(side, "other"), "x", "y").withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cos"))))
    pairs = pairs.filter(F.col("angle") <= limit + F.col("radius") + F.col("other_radius") + SLACK)
    both = ["hub", "other", "weight", "other_weight", "radius", "other_radius", "angle", "cos"]
    turned = pairs.select(*[F.col({"hub": "other", "other": "hub"}.get(c, c[6:] if c.startswith("other_") else f"other_{c}" if c in ("weight", "radius") else c)).alias(c) for c in both])
    pairs = materialise(pairs.select(*both).unionByName(turned), "pairs")
    single = (F.col("radius") == 0) & (F.col("other_radius") == 0)
    reach = F.col("radius") + F.col("other_radius")
    sure = F.when(single, F.col("cos") >= threshold).otherwise(F.col("angle") <= limit - reach - SLACK)
    whole = pairs.filter(sure)
    # each member of a ball that isn't settled against the other ball's centre
    open_ = pairs.filter(~sure & ~single)
    against = open_.select("hub", "other", "other_weight", "other_radius").join(side.select("other", "y"), "other").join(member.select("hub", "id", "x"), "hub")
    against = _angles(against.select("hub", "other", "other_weight", "other_radius", "id", "x", "y"), "x", "y").withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cos"))))
    against = materialise(against.filter(F.when(F.col("other_radius") == 0, F.col("cos") >= threshold).otherwise(F.col("angle") <= limit + F.col("other_radius") + SLACK)), "against")
    all_of = F.when(F.col("other_radius") == 0, F.lit(True)).otherwise(F.col("angle") <= limit - F.col("other_radius") - SLACK)
    one = against.filter(~all_of).select("hub", "other", "id").join(member.select("id", "x"), "id")
    one = one.join(member.select(F.col("hub").alias("other"), F.col("copies").alias("other_weight"), F.col("x").alias("y")), "other")
    one = _angles(one, "x", "y").filter(F.col("cos") >= threshold)
    by_member = materialise(against.filter(all_of).select("hub", "other", "id", "other_weight").unionByName(one.select("hub", "other", "id", "other_weight")), "by_member")

    edges = whole.select("hub", "other").unionByName(by_member.select("hub", "other")).filter("hub < other")
    labels = components(edges)
    by_ball = whole.groupBy("hub").agg(F.sum("other_weight").alias("_across"))
    by_id = by_member.groupBy("id").agg(F.sum("other_weight").alias("_own"))
    linked = member.select("id", "hub").join(balls.select("hub", "weight"), "hub").join(by_ball, "hub", "left").join(by_id, "id", "left").join(labels.withColumnRenamed("id", "hub"), "hub", "left")
    linked = linked.select("id", (F.col("weight") - 1 + F.coalesce("_across", F.lit(0)) + F.coalesce("_own", F.lit(0))).alias("n_links"), F.coalesce("component", "hub").alias("part"))
    linked = materialise(linked.join(nodes.select("id", "vec_id", "embedding"), "id"), "linked")
    least = linked.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    linked = linked.join(least, "part").select("embedding", "n_links", "component_id")
    out = rows.join(linked, "embedding", "left")
    component = F.coalesce("component_id", "vec_id")
    usable_id = F.col("vec_id").isNotNull()
    return out.select("vec_id", F.when(usable_id, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(usable_id, component).alias("component_id"), (F.col("vec_id").eqNullSafe(F.when(usable_id, component))).alias("kept"))
