"""Near-duplicate documents by one-permutation MinHash with optimal densification.

A document's set is that of its distinct word shingles, as 64-bit hashes. One hash of each shingle both deals it
into one of BINS bins and is its value there; a bin's value is the least of them. An empty bin takes the value of a
bin that isn't empty, found by a sequence of bins that depends on the empty bin's number alone, which keeps bins
independent even for short documents. Bins are put together into bands; documents that agree in a band share a bucket.

Equal sets are one node from the start (the least doc_id stands for all). Candidates within a bucket are stars: its hub, the
node with most company in all its buckets, is compared with the others, on full sets. Nodes that are linked with
their hub need no more. Where nodes of a hub aren't in one component yet, the rest is found exactly, without all pairs:

- Nodes x and y can be compared by their differences from any hub h: with D(x) the shingles that only one of x and h has, x ^ y = D(x) ^ D(y), and they
  are linked if and only if (100 + percent) * |D(x) ^ D(y)| <= (100 - percent) * (|x| + |y|). So full sets are read for the first stars alone.
- So |D(x) & D(y)| is half of A(x) + A(y) at least, where A(x) = |D(x)| - (100 - percent) / (100 + percent) * |x|, and that is above 0
  whenever x or y isn't linked with h: linked pairs share differences from their hub.
- So such pairs meet in one of their rarest shared differences: a node's differences that no node of another component has, or only
  nodes linked with the hub, are put aside (no pair of interest shares them), the others ordered by how many nodes have them, and the node goes into the groups of the first of them, as many as are left over
  when the least overlap with any partner is taken away. A partner y can only be met in differences whose nodes have A(y) or less as their least A, and in as many as the overlap
  with y asks for: that gives the least A that a partner can have, and nodes without such a partner go.
- Groups of FEW nodes or fewer are compared as pairs, if the places of the shared difference leave room for the overlap. Larger groups are
  stars again, around a hub of their own, and so on; each round takes its hubs out, so rounds end.

Defined results: null and empty texts, and texts without words, have the empty set and are linked with nothing. Each row is a
document of its own by its text, whatever its doc_id; equal rows are exact copies of each other. component_id is the least doc_id of the rows that
links reach; rows without a doc_id come after all others, and a component of such rows alone has none. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.textbatch import numbered, over_slices
from tidewell.operators.components import components
from tidewell.session import discard, materialise

#: Bins of the permutation. With bands of 5 rows a pair at 0.85 is missed about once in a million, with 4 at 0.8 once in seven million.
BINS = 120
#: Nodes of a group with one difference from their hub up to which all pairs are compared.
FEW = 64
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
#: Stands for a word that isn't there, in texts shorter than a shingle.
ABSENT = np.uint64(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (a finaliser of shifts and odd factors)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _C[1]
    x = x ^ (x >> np.uint64(27))
    x = x * _C[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Words are separated by ASCII white space; A-Z count as a-z."""
    split = [t.encode().lower().split() if t else [] for t in texts]
    counts = [len(s) for s in split]
    hashes = np.fromiter((h for s in split for h in map(xxhash.xxh3_64_intdigest, s)), np.uint64, sum(counts))
    hashes = np.append(hashes, np.full(words - 1, ABSENT))
    mixed = np.zeros(len(hashes) - words + 1, np.uint64)
    for i in range(words):
        mixed = mix(mixed * _C[i % len(_C)] + hashes[i : len(hashes) - words + 1 + i] + _C[0])
    sets, at = [], 0
    for n in counts:
        if n >= words:
            sets.append(np.unique(mixed[at : at + n - words + 1]))
        elif n:
            own = np.append(hashes[at : at + n], np.full(words - n, ABSENT))
            value = np.zeros(1, np.uint64)
            for i in range(words):
                value = mix(value * _C[i % len(_C)] + own[i : i + 1] + _C[0])
            sets.append(value)
        else:
            sets.append(np.zeros(0, np.uint64))
        at += n
    return sets


_EDGES = np.array([(i << 64) // BINS for i in range(BINS)], object).astype(np.uint64)


def band_keys(sets: list[np.ndarray], rows: int) -> np.ndarray:
    """A row of BINS // rows bucket keys for each set that isn't empty."""
    n = len(sets)
    values, full = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
    for i, own in enumerate(sets):  # sorted sets lie bin by bin
        first = np.searchsorted(own, _EDGES)
        full[i] = np.append(first[1:], len(own)) > first
        values[i] = own[np.minimum(first, len(own) - 1)]
    empty, attempt = ~full, 0
    r, c = np.nonzero(empty)
    while len(r):
        source = (mix(c.astype(np.uint64) * _C[3] + mix(np.array([attempt], np.uint64) + _C[4])) % np.uint64(BINS)).astype(np.int64)
        hit = full[r, source]
        values[r[hit], c[hit]] = values[r[hit], source[hit]]
        r, c, attempt = r[~hit], c[~hit], attempt + 1
    bands = BINS // rows
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _C[5], (n, bands)).copy()
    for i in range(rows):
        keys = mix(keys * _C[0] + values[:, i : bands * rows : rows])
    return keys


def sketches(docs: DataFrame, words: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), band keys (null if empty)."""

    def make():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(part.column(1).to_pylist(), words)
            some = [s for s in sets if len(s)]
            keys = iter(band_keys(some, rows).view(np.int64))
            return pa.record_batch(
                {
                    "doc_id": part.column(0),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    "bands": pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                }
            )

        return step

    return over_slices(docs.select(F.col("doc_id").cast("long"), "text"), "text", make, "doc_id long, n_shingles long, digest binary, bands array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """id and the whole set of shingle hashes of every document."""

    def make():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            sets = [s.view(np.int64) for s in shingle_sets(part.column(1).to_pylist(), words)]
            return pa.record_batch({"id": part.column(0), "shingles": pa.array(sets, pa.list_(pa.int64()))})

        return step

    return over_slices(docs.select(F.col("doc_id").cast("long"), "text"), "text", make, "id long, shingles array<long>")


def overlap(one: Column, other: Column, percent: int) -> Column:
    """How many differences from their hub two nodes with these A must share to be linked, A being in units of 1 / (100 + percent)."""
    return F.greatest(F.lit(1), F.ceil((one + other) / (2 * (100 + percent))))


def fits(x: str, y: str, percent: int) -> Column:
    """Whether nodes x and y of one group can be linked: one isn't linked with the hub, and behind the group's difference (the pos-th of s) enough may be shared."""
    room = 1 + F.least(F.col(f"{x}.s") - F.col(f"{x}.pos"), F.col(f"{y}.s") - F.col(f"{y}.pos"))
    return (F.col(f"{x}.apart") | F.col(f"{y}.apart")) & (room >= overlap(F.col(f"{x}.A"), F.col(f"{y}.A"), percent))


def compared(groups: DataFrame, nodes: DataFrame, few: int, percent: int) -> DataFrame:
    """Pairs (root, hub, node, star, n, apart, differ): of small groups (root, g, many, node) all pairs that may be linked, of larger ones stars.

    nodes: root, id, n (size of the set) and differ (differences from the root's hub; at first the set itself). A pair's differ is empty unless it is of a star.
    """
    small, large = groups.filter(F.col("many") <= few), groups.filter(F.col("many") > few)
    hubs = large.groupBy("g").agg(F.max("node").alias("hub"))
    stars = large.join(hubs, "g").filter("hub.id <> node.id").select("root", "hub", "node", F.lit(True).alias("star"))
    pairs = small.select("g", F.col("node").alias("hub")).join(small.select("g", "root", "node"), "g").filter("hub.id < node.id").select("root", "hub", "node", F.lit(False).alias("star"))
    both = stars.unionByName(pairs.filter((F.col("hub.label") != F.col("node.label")) & fits("hub", "node", percent)))
    both = both.groupBy("root", F.col("hub.id").alias("hub"), F.col("node.id").alias("id")).agg(F.max("node.company").alias("company"), F.bool_or("star").alias("star"))
    own = both.join(nodes.select("root", "id", "n", "differ"), ["root", "id"])
    full = own.join(nodes.select("root", F.col("id").alias("hub"), F.col("n").alias("_n"), F.col("differ").alias("_hub")), ["root", "hub"])
    shared = F.size(F.array_intersect("differ", "_hub"))
    full = full.withColumn("_apart", (100 + percent) * (F.size("differ") + F.size("_hub") - 2 * shared) > (100 - percent) * (F.col("n") + F.col("_n")))
    differ = F.when(F.col("star"), F.concat(F.array_except("differ", "_hub"), F.array_except("_hub", "differ"))).otherwise(F.array().cast("array<long>"))
    return full.select("root", "hub", "id", "company", "star", "n", F.col("_apart").alias("apart"), differ.alias("differ"))


def by_differences(stars: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Groups (root, g, node) of the nodes of stars that aren't one component, by the rarest differences from their hub, and these nodes (root, id, n, differ)."""
    named = stars.withColumn("root", F.xxhash64("root", "hub")).drop("hub", "star").join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    a = (100 + percent) * F.size("differ") - (100 - percent) * F.col("n")
    sized = named.withColumn("A", a.cast("long"))
    mixed = sized.groupBy("root").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.bool_or("apart").alias("_open")).filter("_lo <> _hi and _open")
    nodes = materialise(sized.join(mixed.select("root"), "root"), "nodes")
    keys = ["root", "id", "company", "label", "A", "apart"]
    each = nodes.select(*keys, F.explode("differ").alias("_d")).withColumn("g", F.xxhash64("root", "_d")).drop("_d")
    # a pair of interest has two components and one node at least that isn't linked with the hub: so has every difference that it shares
    of_g = each.groupBy("g").agg(
        F.count("*").alias("_many"), F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.min("A").alias("_all"), F.min(F.when(F.col("apart"), F.col("A"))).alias("_apart")
    )
    often = of_g.filter("_lo <> _hi and _apart is not null").select("g", "_many", "_all", "_apart")
    # a node's differences with other nodes: no more than its and its hub's shingles
    least = F.when(F.col("apart"), F.col("_all")).otherwise(F.col("_apart")).alias("least")
    ordered = each.join(often, "g").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_many", "g", least))).alias("order")).withColumn("s", F.size("order"))
    # a partner of A(y) is met in differences whose least A is A(y) at most alone, so these must be as many as the two must share
    sizes = F.transform(F.sort_array(F.col("order.least")), lambda a, i: F.when(i + 1 >= overlap(F.col("A"), a, percent), a))
    partner = ordered.withColumn("_least", F.array_min(sizes)).filter("_least is not null")
    first = F.col("s") - overlap(F.col("A"), F.col("_least"), percent) + 1
    placed = partner.withColumn("_first", first.cast("int")).select("*", F.posexplode(F.slice("order", F.lit(1), F.col("_first"))).alias("_at", "_g"))
    node = F.struct("company", "id", "label", "A", "apart", "s", (F.col("_at") + 1).alias("pos"))
    return materialise(placed.select("root", F.col("_g.g").alias("g"), node.alias("node")), "groups"), nodes


def link(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Labels (id, component) of nodes that links between nodes of one bucket connect; nodes without links may be missing.

    members: (bucket, id, company), company being the same in all rows of an id. sets: (id, shingles).
    """
    # at first the hub is the empty set, from which every node is apart, and the bucket says nothing about differences
    node = F.struct("company", "id", F.col("id").alias("label"), F.lit(0).cast("long").alias("A"), F.lit(True).alias("apart"), F.lit(1).alias("s"), F.lit(1).alias("pos"))
    groups, few = members.select(F.lit(0).cast("long").alias("root"), F.col("bucket").alias("g"), node.alias("node")), 1
    nodes, labels = sets.select(F.lit(0).cast("long").alias("root"), "id", F.size("shingles").alias("n"), F.col("shingles").alias("differ")), None
    while True:
        mixed = groups.groupBy("g").agg(F.count("*").alias("many"), F.min("node.label").alias("_lo"), F.max("node.label").alias("_hi"), F.bool_or("node.apart").alias("_apart"))
        open_ = materialise(groups.join(mixed.filter("_lo <> _hi and _apart").select("g", "many"), "g"), "open")
        if labels is not None and open_.isEmpty():
            discard(open_, groups, nodes)
            return labels
        pairs = materialise(compared(open_, nodes, few, percent), "pairs")
        discard(open_, groups, nodes)
        found = pairs.filter("not apart").select(F.col("hub").alias("a"), F.col("id").alias("b"))
        if labels is None:
            labels = materialise(components(found), "labels")
        elif not found.isEmpty():
            of = lambda end, name: labels.select(F.col("id").alias(end), F.col("component").alias(name))  # noqa: B023, E731
            ends = found.join(of("a", "_a"), "a", "left").join(of("b", "_b"), "b", "left")
            moved = materialise(components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))), "moved")
            of_labels = labels.join(moved.select(F.col("id").alias("component"), F.col("component").alias("_to")), "component", "left")
            joined = of_labels.select("id", F.coalesce("_to", "component").alias("component"))
            # nodes whose first link this is
            before, labels = labels, materialise(joined.unionByName(moved.join(labels, "id", "left_anti").select("id", "component")), "labels")
            discard(before, moved)
        (groups, nodes), few = by_differences(pairs.filter("star"), labels, percent), FEW
        discard(pairs)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), kept (whether that is the document itself)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows_, plain = numbered(docs)
    found = of_rows(rows_.select(F.col("_row").alias("doc_id"), "text"), words, percent, rows)
    if not plain:
        own = rows_.select("_row", F.col("doc_id").alias("_id"))
        found = found.join(own.withColumnRenamed("_row", "doc_id"), "doc_id").drop("doc_id").withColumnRenamed("_id", "doc_id")
        found = found.join(own.withColumnRenamed("_row", "component_id"), "component_id").drop("component_id").withColumnRenamed("_id", "component_id")
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def of_rows(docs: DataFrame, words: int, percent: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, component_id of documents that each have a doc_id of their own."""
    found = materialise(sketches(docs, words, rows), "sketches")
    nodes = materialise(found.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "nodes")
    banded = found.join(nodes, ["digest", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("_many")).filter("_many > 1")
    met = materialise(banded.join(shared, "bucket").select("bucket", "id", "_many"), "met")
    members = materialise(met.join(met.groupBy("id").agg(F.sum("_many").alias("company")), "id").select("bucket", "id", "company"), "members")
    active = members.select(F.col("id").alias("doc_id")).distinct()
    # the ids grow with the documents: not broadcast at any size
    sets = materialise(full_sets(docs.join(active.hint("merge"), "doc_id", "left_semi"), words), "sets")
    discard(met)
    labels = link(members, sets, percent)
    discard(members, sets)
    named = nodes.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("digest", F.coalesce("component", "doc_id").alias("component_id"))
    # documents without words share the null digest, which joins with nothing: they stay where they are
    some = found.filter("digest is not null").select("doc_id", "n_shingles", "digest").join(named, "digest").drop("digest")
    return some.unionByName(found.filter("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
