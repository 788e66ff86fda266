"""First arrivals: which items of a run are new when three keys decide at once, in order of arrival.

An item is a copy if its address is known, if its source used its guid before, or if the last accepted item under its source's
title is less than some days away. Only accepted items make their keys known, so an item that is refused hides nothing: what
is accepted is the lexicographically first independent set of the items' conflicts. It is found in rounds. In each, items that conflict with
what was accepted leave, and an item is accepted if it comes first among the undecided under each of its keys. The first undecided item is always decided; usually all
are within a few rounds, as one accepted item settles all later ones with its address or guid and all of its title up to the first outside its days.

Heads of keys are found by aggregation and meet by `ord`, which no two items share, so a key that a third of the items hold makes no large group; items
leave by joins against one row a key, whose skewed side Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.session import discard, materialise

DAY_MS = 86_400_000


def _slim(rows: DataFrame, *more: str) -> DataFrame:
    """ord, the three keys and the time in ms; a null or empty guid is no key, without a title the empty one counts."""
    key = lambda c: F.to_json(F.struct("source_id", c.alias("k")))
    guid = F.when(F.coalesce(F.col("guid"), F.lit("")) != "", key(F.col("guid")))
    return rows.select("ord", "article_id", guid.alias("g"), key(T.normalise_title(F.col("title"))).alias("k"), F.unix_millis(F.col("published_at").cast("timestamp")).alias("t"), *more)


def _accepted(items: DataFrame, queue: DataFrame, span: int) -> DataFrame:
    """The items (ord, article_id, g, k, t) that are accepted after those of the queue, written round by round."""
    undecided, fresh, accepted, rounds = items, queue, [], []
    latest = queue.groupBy("k").agg(F.max_by("t", "ord").alias("last"))
    while True:
        left = undecided.join(fresh.select("article_id").distinct(), "article_id", "left_anti").join(fresh.select("g").distinct(), "g", "left_anti")
        left = left.join(latest, "k", "left").withColumn("near", F.coalesce(F.abs(F.col("t") - F.col("last")) < span, F.lit(False))).drop("last")
        left = materialise(left.select("ord", "article_id", "g", "k", "t", "near"), "undecided")
        # copies of the last accepted item of a title are all up to the first that is too far from it
        far = materialise(left.filter("not near").groupBy("k").agg(F.min("ord").alias("far")), "far")
        here = left.join(far, "k", "left").filter("not near or ord > far").select("ord", "article_id", "g", "k", "t")
        here = materialise(here, "undecided")
        discard(left, *rounds)
        first = lambda key: here.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("ord").alias("ord")).select("ord")  # noqa: B023, E731
        heads = here.join(first("article_id"), "ord", "left_semi").join(far.select(F.col("far").alias("ord")), "ord", "left_semi")
        new = heads.filter("g is null").unionByName(heads.filter("g is not null").join(first("g"), "ord", "left_semi"))
        fresh = materialise(new, "accepted")
        if fresh.isEmpty():
            break
        accepted.append(fresh)
        # the last accepted item of a title is the newest: those accepted later come later
        recent = fresh.groupBy("k").agg(F.max_by("t", "ord").alias("newer"))
        latest = materialise(latest.join(recent, "k", "full").select("k", F.coalesce("newer", "last").alias("last")), "latest")
        undecided, rounds = here.join(fresh, "ord", "left_anti"), [here, far]
    found = accepted[0] if accepted else items.limit(0)
    for more in accepted[1:]:
        found = found.unionByName(more)
    return found


def first_arrivals(items: DataFrame, queue: DataFrame, days: int = 7) -> DataFrame:
    """items with `status` (new, duplicate or unwanted) and `doc`, the queued story that a duplicate was found in, if any.

    items: (ord, source_id, article_id, guid, title, published_at, wanted), ord a number that no two share; queue: the same without wanted but with doc,
    its members in an order of their own. An item that isn't wanted may be a duplicate but makes no key known.
    """
    span = days * DAY_MS
    slim = materialise(_slim(items, "wanted"), "items")
    # members of the queue come before all items, in their order
    held = _slim(queue, "doc")
    start = F.lit(-(1 << 62))
    held = materialise(held.withColumn("ord", start + F.col("ord")), "queue")
    new = _accepted(slim.filter("wanted").drop("wanted"), held.drop("doc"), span)
    every = materialise(held.unionByName(new.withColumn("doc", F.lit(None).cast(held.schema["doc"].dataType))), "known")
    rest = slim.join(new.select("ord"), "ord", "left_anti")
    # what each remaining item met: of several entries under one key the last before it
    pick = F.max(F.struct(F.col("e.ord").alias("o"), F.col("e.t").alias("t"), F.col("e.doc").alias("doc")))

    def met(key: str, name: str) -> DataFrame:
        pairs = rest.alias("i").join(every.filter(F.col(key).isNotNull()).alias("e"), F.col(f"i.{key}") == F.col(f"e.{key}")).filter("e.ord < i.ord")
        return pairs.groupBy(F.col("i.ord").alias("ord")).agg(pick.alias(name))

    found = rest.join(met("article_id", "_a"), "ord", "left").join(met("g", "_g"), "ord", "left").join(met("k", "_k"), "ord", "left")
    close = F.coalesce(F.abs(F.col("_k.t") - F.col("t")) < span, F.lit(False))
    is_copy = F.col("_a").isNotNull() | F.col("_g").isNotNull() | close
    doc = F.when(is_copy, F.coalesce("_a.doc", "_g.doc", F.when(close, F.col("_k.doc"))))
    decided = found.select("ord", F.when(is_copy, "duplicate").otherwise("unwanted").alias("status"), doc.alias("doc"))
    return items.join(decided, "ord", "left").withColumn("status", F.coalesce("status", F.lit("new")))
