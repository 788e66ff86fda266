"""Writes to the queue of stories: a guard on what an importer may do, ordered mutations replayed by key, and batches that are written once, whole.

Documents are (id, fields), fields a map of texts (nested values as JSON); a field that isn't in the map is missing, one with an empty text isn't.
Mutations are (seq, kind, id, fields, sets, fills, other, pending_before, rejected_before): kind createIfNotExists or createOrReplace with fields, patch with sets
and fills (set if missing; other: names of further operations that it asks for), delete with the two times of the prune rule. seq orders them and no two share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import discard, materialise

# What an importer may create, change and keep of itself, and the longest text it may take from a publisher.
TYPE, STATE_ID = "newsArticle", "newsAggregatorState"
INGEST = (
    "articleId", "storyId", "originalHeadline", "originalUrl", "canonicalUrl", "guid", "source", "sourceId", "sourceName",
    "sourcePublishedAt", "dateEstimated", "importedAt", "lastSeenAt", "excerpt", "sourceImageUrl", "topic", "topics",
    "category", "uaeScore", "relevanceScore", "isPressRelease", "classification", "priority", "dedupeKey", "otherSources",
)
PATCHED = ("lastSeenAt", "excerpt", "sourceImageUrl", "otherSources")
PREFILLED = ("headline", "slug", "summary", "summarySource", "capitalTypes", "assetClasses", "geography", "transactionType")
STATE = ("_id", "_type", "updatedAt", "lastRun", "sources", "documents")
MOST_TEXT = 280
REVIEW_ID = r"^queue\.a_[0-9a-f]{16}$"

DOCUMENT = "id string, fields map<string,string>"
MUTATION = "seq long, kind string, id string, fields map<string,string>, sets map<string,string>, fills map<string,string>, other array<string>, pending_before timestamp, rejected_before timestamp"


def _roots(m: Column) -> Column:
    """The fields that a map's paths begin with."""
    return F.transform(F.map_keys(m), lambda path: F.regexp_extract(path, r"^[^.\[]*", 0))


def _strange(m: Column, allowed: tuple[str, ...]) -> Column:
    """The first of a map's fields that isn't allowed."""
    return F.get(F.filter(_roots(m), lambda f: ~f.isin(list(allowed))), F.lit(0))


def _too_long(m: Column) -> Column:
    longest = lambda c: F.coalesce(F.length(c) > MOST_TEXT, F.lit(False))
    return longest(m["excerpt"]) | longest(m["summary"]) | longest(F.get_json_object(m["classification"], "$.suggestedSummary"))


def refusal() -> Column:
    """Why a mutation is refused, null if it isn't; of several reasons the first."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    fields = F.coalesce("fields", F.create_map().cast("map<string,string>"))
    plain = F.regexp_replace(F.coalesce("id", F.lit("")), r"^drafts\.", "")
    say = lambda text, c: F.concat(F.lit(text), F.lit(' "'), F.coalesce(c, F.lit("")), F.lit('"'))
    create = (
        F.when(~F.coalesce(F.col("id").rlike(REVIEW_ID), F.lit(False)), say("not a queue id:", F.col("id")))
        .when(F.coalesce(fields["_type"], F.lit("")) != TYPE, F.lit(f"type must be {TYPE}"))
        .when(F.coalesce(fields["status"], F.lit("")) != "pending_review", say("must be pending_review, not", fields["status"]))
        .when(_strange(fields, ("_id", "_type", "status", "statusChangedAt", *INGEST, *PREFILLED)).isNotNull(), say("may not write", _strange(fields, ("_id", "_type", "status", "statusChangedAt", *INGEST, *PREFILLED))))
        .when(_too_long(fields), F.lit("text too long"))
    )
    both = F.array_union(F.coalesce(F.map_keys("sets"), F.array().cast("array<string>")), F.coalesce(F.map_keys("fills"), F.array().cast("array<string>")))
    asked = F.map_from_arrays(both, F.transform(both, lambda _: F.lit("")))
    patch = (
        F.when(~plain.rlike(REVIEW_ID), say("cannot patch", F.col("id")))
        .when(~empty("other"), say("operation not allowed:", F.get("other", F.lit(0))))
        .when(empty("sets") & empty("fills"), F.lit("empty patch"))
        .when(_strange(asked, PATCHED).isNotNull(), say("may not change", _strange(asked, PATCHED)))
        .when((~empty("sets") & _too_long(F.col("sets"))) | (~empty("fills") & _too_long(F.col("fills"))), F.lit("text too long"))
    )
    prune = F.when(F.col("id").isNotNull() | F.col("pending_before").isNull() | F.col("rejected_before").isNull(), F.lit("only allowed through the prune rule"))
    replace = F.when((F.coalesce("id", F.lit("")) != STATE_ID) | (F.coalesce(fields["_type"], F.lit("")) != STATE_ID), F.lit("only the aggregator state can be replaced")).when(
        _strange(fields, STATE).isNotNull(), say("state may not hold", _strange(fields, STATE))
    )
    kind = F.coalesce("kind", F.lit(""))
    unknown = F.when(~kind.isin("createIfNotExists", "patch", "delete", "createOrReplace"), say("not allowed:", F.col("kind")))
    return F.coalesce(unknown, F.when(kind == "createIfNotExists", create).when(kind == "patch", patch).when(kind == "delete", prune).when(kind == "createOrReplace", replace))


def pruned(pending_before: Column, rejected_before: Column) -> Column:
    """Whether the prune rule deletes a document (id, fields): stale pending and rejected stories of the queue and their drafts, nothing decided."""
    f, time = F.col("fields"), lambda c: F.try_to_timestamp(c)
    ours = (f["_type"] == TYPE) & F.regexp_replace("id", r"^drafts\.", "").rlike(REVIEW_ID)
    pending = (f["status"] == "pending_review") & (time(f["lastSeenAt"]) < pending_before)
    rejected = (f["status"] == "rejected") & (time(F.coalesce(F.nullif(f["statusChangedAt"], F.lit("")), f["lastSeenAt"])) < rejected_before)
    return F.coalesce(ours & (pending | rejected), F.lit(False))


def _segment(docs: DataFrame, ops: DataFrame) -> tuple[DataFrame, int, int, str | None]:
    """Documents after creates, replaces and patches without a delete between them; how many were created and patched; an id that was patched but isn't there.

    Each field's last set counts, else what the document held, else the first fill; all of it found by aggregates over (id, field), so that any number of
    mutations of one document meet in partial sums before they move. A document that nothing touches isn't moved.
    """
    creating = F.col("kind") == "createIfNotExists"
    whole = F.struct("seq", F.to_json("fields").alias("fields"))
    patching = F.col("kind") == "patch"
    made = ops.groupBy("id").agg(
        F.max(F.when(F.col("kind") == "createOrReplace", whole)).alias("replaced"), F.min(F.when(creating, whole)).alias("created"),
        F.min(F.when(patching, F.col("seq"))).alias("patched"), F.count_if(patching).alias("patches"),
    )
    there = made.join(docs, "id", "left").withColumnRenamed("fields", "old")
    text = "map<string,string>"
    base = F.coalesce(F.from_json("replaced.fields", text), "old", F.from_json("created.fields", text))
    # what comes before a replacement has no effect; a patch needs something before it
    began = F.least("created.seq", F.col("replaced.seq"))
    keys = there.select("id", base.alias("base"), F.coalesce("replaced.seq", F.lit(-1)).alias("since"), "patches", F.col("old").isNull().alias("absent"), (F.col("old").isNull() & F.col("created").isNotNull() & (F.col("replaced").isNull() | (F.col("created.seq") < F.col("replaced.seq")))).alias("is_new"),
                        (F.col("old").isNull() & F.col("patched").isNotNull() & (began.isNull() | (F.col("patched") < began))).alias("lost"))
    keys = materialise(keys, "keys")
    totals = keys.agg(F.count_if("is_new"), F.sum("patches"), F.min(F.when(F.col("lost"), F.col("id")))).first()
    if totals[2] is not None:
        discard(keys)
        return docs, 0, 0, totals[2]
    patches = ops.filter("kind = 'patch'").select("id", "seq", "sets", "fills")
    each = lambda c, sets: patches.select("id", "seq", F.explode(c).alias("field", "value"), F.lit(sets).alias("sets"))
    held = keys.filter("base is not null").select("id", F.lit(-1).cast("long").alias("seq"), F.explode("base").alias("field", "value"), F.lit(False).alias("sets"), F.lit(-1).cast("long").alias("since"))
    asked = each("sets", True).unionByName(each("fills", False)).join(keys.select("id", "since"), "id").filter("seq > since")
    entries = held.unionByName(asked)
    is_set = F.col("sets")
    values = entries.groupBy("id", "field").agg(F.max_by("value", F.when(is_set, F.col("seq"))).alias("set"), F.min_by("value", F.when(~is_set, F.col("seq"))).alias("held"), F.bool_or("sets").alias("any"))
    # a document's fields are few
    built = values.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.when(F.col("any"), F.col("set")).otherwise(F.col("held"))))).alias("fields"))
    made_docs = keys.filter("base is not null").select("id").join(built, "id", "left").select("id", F.coalesce("fields", F.create_map().cast(text)).alias("fields"))
    after = materialise(docs.join(keys.select("id"), "id", "left_anti").unionByName(made_docs), "documents")
    discard(keys)
    return after, totals[0], totals[1] or 0, None


def replay(docs: DataFrame, mutations: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Documents after all mutations in order, and how many were created, patched, deleted. Refused as a whole (ValueError) if one may not be made or patches what isn't there.

    Deletes look at the whole table, so they part the mutations into segments, one more than there are deletes; within one, keys are worked on at once.
    """
    mutations = materialise(mutations, "mutations")
    bad = mutations.withColumn("reason", refusal()).filter("reason is not null").agg(F.min(F.struct("seq", "reason"))).first()[0]
    if bad:
        raise ValueError(f"refused mutation {bad['seq']}: {bad['reason']}")
    # a batch's deletes are a few words of its writer's, one as a rule
    cuts = [tuple(r) for r in mutations.filter("kind = 'delete'").orderBy("seq").select("seq", "pending_before", "rejected_before").collect()]
    counts = {"created": 0, "patched": 0, "deleted": 0}
    now, since = docs.select("id", "fields"), None
    for at, pending, rejected in [*cuts, (None, None, None)]:
        ops = mutations.filter("kind <> 'delete'")
        ops = ops.filter(F.col("seq") > since) if since is not None else ops
        ops = ops.filter(F.col("seq") < at) if at is not None else ops
        after, created, patched, lost = _segment(now, ops)
        if lost is not None:
            raise ValueError(f"document {lost!r} not found")
        counts["created"] += created
        counts["patched"] += patched
        if at is not None:
            doomed = pruned(F.lit(pending), F.lit(rejected))
            counts["deleted"] += after.filter(doomed).count()
            after = after.filter(~doomed)
        now, since = after, at
    discard(mutations)
    return now, counts


def _batches(spark: SparkSession, path: str) -> list[int]:
    """The batches whose documents were written whole."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(root) if fs.exists(root) else []
    names = [s.getPath().getName() for s in found if s.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-"))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The documents after the last batch that was written whole; none before the first."""
    done = _batches(spark, path)
    return spark.read.schema(DOCUMENT).parquet(f"{path}/batch-{done[-1]}") if done else spark.createDataFrame([], DOCUMENT)


def commit(mutations: DataFrame, batch: int, path: str) -> dict[str, int] | None:
    """Replay a batch on the stored documents and store the outcome; None if that batch, or a later one, is stored already.

    For foreachBatch, which may bring a batch again: lambda rows, batch: commit(rows, batch, path). A batch is a folder of its own, which readers take up when Spark has
    marked it as whole; a batch that is refused or fails leaves the one before as it is. Batches before the last two are deleted.
    """
    spark = mutations.sparkSession
    done = _batches(spark, path)
    if done and batch <= done[-1]:
        return None
    after, counts = replay(stored(spark, path), mutations)
    after.write.mode("overwrite").parquet(f"{path}/batch-{batch}")
    for old in done[:-1]:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch-{old}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return counts
