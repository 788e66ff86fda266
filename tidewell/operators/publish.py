"""What goes on a site: checks before publication, public shapes of stories, jobs, employers and events, envelopes and files of views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import views

# Licences that allow stories, and summaries by a model; lengths of a story's fields; page names.
CLEARED = ("public_sector", "wire", "terms_reviewed", "permission_granted")
AI_CLEARED = ("terms_reviewed", "permission_granted")
LENGTHS = {"headline": (12, 160), "summary": (20, 280), "excerpt": (0, 280), "slug": (3, 96), "image_credit": (2, 120)}
SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _sized(c: Column, name: str) -> Column:
    return F.length(_text(c)).between(*LENGTHS[name])


def blockers(headline: Column, summary: Column, excerpt: Column, slug: Column, link: Column, source: Column, licence: Column, image: Column, rights: Column, credit: Column, duplicate_of: Column) -> dict[str, Column]:
    """What a story must fulfil to be published, by the name of what it lacks; for rules.hold_reasons."""
    return {
        "headline": _sized(headline, "headline"),
        "summary": _sized(summary, "summary"),
        "excerpt": _sized(excerpt, "excerpt"),
        "slug": _text(slug).rlike(SLUG) & _sized(slug, "slug"),
        "link": _text(link).rlike("(?i)^https?://"),
        "source": _text(source) != "",
        "licence": licence.isin(list(CLEARED)),
        "rights": image.isNull() | F.coalesce(rights, F.lit(False)),
        "credit": image.isNull() | _sized(credit, "image_credit"),
        "duplicate": duplicate_of.isNull(),
    }


def approval(approved_by: Column, approved_at: Column, approvers: Sequence[str], approved_hash: Column, content_hash: Column) -> dict[str, Column]:
    """What an approval must fulfil: given by a listed approver, for what the document holds now. Of the first three only the first is told."""
    given, listed = approved_by.isNotNull() & approved_at.isNotNull(), F.lit(bool(approvers))
    return {
        "no approval": given,
        "no approvers": ~given | listed,
        "not an approver": ~given | ~listed | approved_by.isin(list(approvers) or [""]),
        "changed": approved_hash == content_hash,
    }


def permissions(summary: Column, excerpt: Column, suggested: Column, by: Column, excerpt_allowed: Column, ai_allowed: Column) -> dict[str, Column]:
    """Whether a summary may be shown that is the publisher's excerpt, or a model's."""
    same = lambda other: F.coalesce((summary != "") & (summary == other), F.lit(False))
    from_excerpt, from_model = F.coalesce(by == "excerpt", F.lit(False)) | same(excerpt), F.coalesce(by == "ai", F.lit(False)) | same(suggested)
    return {"excerpt not allowed": ~from_excerpt | F.coalesce(excerpt_allowed, F.lit(True)), "ai not allowed": ~from_model | F.coalesce(ai_allowed, F.lit(False))}


def held(id_ok: Column, status: Column, published: Column, now: Column, checks: Column) -> Column:
    """All reasons why a document isn't public: what it is and its status alone, if these fail, else its time and the reasons of its checks."""
    time = F.when(published.isNull(), "no publication time").when(published > now, "scheduled")
    rest = F.array_compact(F.concat(F.array(time), checks))
    return F.when(~F.coalesce(id_ok, F.lit(False)), F.array(F.lit("not a queue document"))).when(F.coalesce(status, F.lit("missing")) != "published", F.array(F.concat(F.lit("status is "), F.coalesce(status, F.lit("missing"))))).otherwise(rest)


def category(geography: Column, importer: Column) -> Column:
    """uae or world: the editor's places decide, if there are any."""
    by_editor = F.when(F.array_contains(geography, "uae"), "uae").otherwise("world")
    return F.when(F.coalesce(F.size(geography), F.lit(0)) > 0, by_editor).otherwise(F.when(importer == "uae", "uae").otherwise("world"))


def story(docs: DataFrame) -> DataFrame:
    """Public stories.

    docs: story_id, headline, summary, url, source, source_id, published_at of the lead, approved_at, geography, category, featured, slug and
    others: array of structs (source, source_id, url, published_at, attached_at, cleared). Outlets count if they were attached before the approval and are cleared.
    """
    lead = F.struct("source", "source_id", "url", "published_at")
    shown = F.filter("others", lambda o: F.coalesce(o["cleared"] & (o["attached_at"] <= F.col("approved_at")) & o["url"].isNotNull() & o["source"].isNotNull(), F.lit(False)))
    sources = F.concat(F.array(lead), F.transform(shown, lambda o: F.struct(o["source"].alias("source"), o["source_id"].alias("source_id"), o["url"].alias("url"), o["published_at"].alias("published_at"))))
    named = docs.filter("story_id is not null and url is not null and source is not null").withColumn("sources", sources)
    times = F.transform("sources", lambda s: s["published_at"])
    return named.select(
        F.col("story_id").alias("id"), F.trim("headline").alias("headline"), T.nullable(F.col("summary")).alias("summary"), "url", "source", "source_id",
        F.array_min(times).alias("published_at"), F.array_max(times).alias("updated_at"), category(F.col("geography"), F.col("category")).alias("category"),
        F.size(F.array_distinct(F.transform("sources", lambda s: s["source_id"]))).alias("source_count"), "sources", T.nullable(F.col("slug")).alias("slug"), F.coalesce("featured", F.lit(False)).alias("featured"),
    )


def in_section(topic: Column, topics: Column, assets: Column, category: Column, section_topics: Sequence[str], section_assets: Sequence[str], section_category: str | None = None) -> Column:
    """Whether a story belongs to a section: by topic or asset class, and its category if the section has one."""
    found = F.lit(False)
    if section_topics:
        found = found | F.coalesce(topic.isin(list(section_topics)), F.lit(False)) | views.any_of(section_topics, topics)
    if section_assets:
        found = found | views.any_of(section_assets, assets)
    return found & (category == section_category) if section_category else found


def filed(stories: DataFrame, memberships: Column, order: Sequence[Column], most: int) -> DataFrame:
    """All views in one pass: a row for each view (an entry of memberships) that a story is among the first `most` of, with its rank there."""
    each = stories.withColumn("view", F.explode(F.array_distinct(F.array_compact(memberships))))
    return views.top_n(each, "view", order, most)


def envelope(rows: DataFrame, order: Sequence[Column], mode: str, generated_at: str, notice: str, most: int = 200) -> DataFrame:
    """One row, json: the first rows of a view (a bounded number) with what an API says about them."""
    ranked = rows.orderBy(*order).limit(most).withColumn("_at", F.monotonically_increasing_id())
    items = F.transform(F.array_sort(F.collect_list(F.struct("_at", F.struct(*rows.columns).alias("item")))), lambda s: s["item"])
    listed = ranked.agg(F.coalesce(items, F.array()).alias("items"))
    shape = F.struct(F.lit("v1").alias("apiVersion"), F.lit(mode).alias("mode"), F.lit(generated_at).alias("generatedAt"), F.lit(notice).alias("notice"), F.size("items").alias("count"), "items")
    return listed.select(F.to_json(shape, {"ignoreNullFields": "false"}).alias("json"))


def save(table: DataFrame, path: str, version: int) -> None:
    """Write a table as JSON lines with its schema's version. What stood there goes first, so a job that fails loses both: commits.commit keeps the one before."""
    table.withColumn("schema_version", F.lit(version)).write.mode("overwrite").json(path)


def load(spark, path: str, schema: str, version: int, defaults: dict | None = None) -> DataFrame:
    """A saved table with defaults for what is missing; a newer version than the reader's is refused, corrupt lines are skipped."""
    read = spark.read.schema(f"{schema}, schema_version int").option("mode", "DROPMALFORMED").json(path)
    if not read.filter(F.col("schema_version") > version).isEmpty():
        raise ValueError(f"{path} was written by a newer version")
    return read.drop("schema_version").fillna(defaults or {})


def merged(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Entries (name, value) of a meta view: new ones win, others stay."""
    both = previous.select("name", F.col("value").alias("_old")).join(new.select("name", F.col("value").alias("_new")), "name", "full_outer")
    return both.select("name", F.coalesce("_new", "_old").alias("value"))


def history(runs: DataFrame, run: DataFrame, at: str, keep: int) -> DataFrame:
    """The newest runs, with a new one; of those of one time, in order of a hash of the row."""
    return runs.unionByName(run).orderBy(F.desc(at), F.xxhash64(*runs.columns)).limit(keep)


def appended(submissions: DataFrame, new: DataFrame, cap: int) -> DataFrame:
    """The new rows (kind, at, email, ...) that are stored: one newsletter address once, as many rows of a kind as the cap leaves room for, in order of time
    (of one time, in order of a hash of the row). Rows without an address are no copies of each other."""
    order = ["at", F.xxhash64(*new.columns)]
    key = F.sha2(F.lower(F.trim("email")), 256)
    known = submissions.filter("kind = 'newsletter'").select(key.alias("_key")).distinct()
    w = Window.partitionBy("kind", F.coalesce(F.when(F.col("kind") == "newsletter", F.col("_key")), F.monotonically_increasing_id().cast("string"))).orderBy(*order)
    fresh = new.withColumn("_key", key).join(known.withColumn("_known", F.lit(True)), "_key", "left").filter("kind <> 'newsletter' or _known is null")
    once = fresh.withColumn("_n", F.row_number().over(w)).filter("kind <> 'newsletter' or _n = 1")
    room = submissions.groupBy("kind").agg(F.count("*").alias("_held"))
    # tasks keep the first `cap` of a kind before the shuffle
    first = once.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).filter(F.col("_n") <= cap)
    placed = first.join(room, "kind", "left")
    return placed.filter(F.col("_n") + F.coalesce("_held", F.lit(0)) <= cap).select(*new.columns)
