"""Jobs: which listings are taken, their life from open to forgotten, employers and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import url as U


def in_uae(location: Column, terms: Sequence[str], remote: Sequence[str]) -> Column:
    """Whether a location has one of the terms as words, or one of the phrases for remote work anywhere in it."""
    at, found = F.lower(F.coalesce(location, F.lit(""))), F.lit(False)
    for term in terms:
        found = found | T.has_term(at, term)
    for phrase in remote:
        found = found | F.contains(at, F.lit(phrase.lower()))
    return found


def is_finance(title: Column, department: Column, terms: Sequence[str]) -> Column:
    text, found = F.lower(F.concat_ws(" ", title, department)), F.lit(False)
    for term in terms:
        found = found | T.has_term(text, term)
    return found


def reject_reason(job: dict[str, Column], now: Column, uae: Column, finance: Column, manual: Column, max_age_days: int = 45) -> Column:
    """The first rule that a listing (title, company, url, posted_at, expires_at) fails, null if none. What was posted by hand needn't be in the UAE or about finance, and may be old until it expires."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    old = F.coalesce(job["posted_at"], now) < now - F.expr(f"interval {max_age_days} days")
    return (
        F.when(empty(job["title"]) | empty(job["company"]), "missing-fields").when(~U.is_http(job["url"]), "invalid-link").when(job["expires_at"] < now, "expired")
        .when(~(manual & job["expires_at"].isNotNull()) & old, "too-old").when(~manual & ~uae, "not-uae").when(~manual & ~finance, "not-finance")
    )


#: Text fields that a job loses when it is closed.
DROPPED = ("description", "requirements", "company_url", "logo_url")


def lifecycle(known: DataFrame, seen: DataFrame, now: Column, max_age_days: int = 45, forget_days: int = 90, read: DataFrame | None = None) -> DataFrame:
    """The jobs after a run: known ones (job_id, source_id, status, posted_at, expires_at, closed_at, ...) and those that the run has seen, of sources that it read.

    Seen again, a job is open; one that its source no longer has is closed, an old or ended one expired; closed ones lose their texts and are forgotten in time.
    read: source_id of all sources that were read, also of those that have no job left; without it, those that seen has jobs of.
    A listing with the key (`key`) of another open job of the run before is a duplicate and left out; where there is none, the first new job of the run (by `ord`, else job_id)
    takes the key, and other listings after it are duplicates. Of several listings of one job the first counts. A listing posted by hand (source manual) is dated by its new row.
    """
    arrival = "ord" if "ord" in seen.columns else "job_id"
    once = F.min(F.struct(arrival, F.struct(*seen.columns).alias("row"))).alias("_first")
    listed = seen.groupBy("job_id").agg(once).select("_first.row.*")
    open_keys = known.filter("status = 'open'").select("key", F.col("job_id").alias("_other")).groupBy("key").agg(F.min("_other").alias("_other"))
    taken = listed.join(known.select("job_id"), "job_id", "left_anti").groupBy("key").agg(F.min(arrival).alias("_at"), F.min_by("job_id", arrival).alias("_own"))
    own = F.when(F.col("_other").isNotNull(), F.col("_other") == F.col("job_id")).otherwise(F.col("_own").isNull() | (F.col(arrival) < F.col("_at")) | (F.col("_own") == F.col("job_id")))
    fresh = listed.join(open_keys, "key", "left").join(taken, "key", "left").filter(own).drop("_other", "_own", "_at")
    sources = (seen if read is None else read).select("source_id").distinct().withColumn("_read", F.lit(True))
    rest = [c for c in known.columns if c != "job_id"]
    n = fresh.select("job_id", F.lit(True).alias("_seen"), *[F.col(c).alias(f"_n_{c}") if c in fresh.columns else F.lit(None).alias(f"_n_{c}") for c in rest])
    # a duplicate, too, shows that its own listing is still there
    noted = seen.select("job_id").distinct().withColumn("_there", F.lit(True))
    both = known.withColumn("_known", F.lit(True)).join(n, "job_id", "full_outer").join(noted, "job_id", "left")
    # a known job keeps the day on which it was posted, unless it was posted by hand
    kept = [c for c in rest if c not in ("status", "closed_at", "posted_at", "source_id")]
    merged = both.select("job_id", "_seen", "_there", F.col("status").alias("_status"), F.col("closed_at").alias("_closed"), F.when((F.coalesce("source_id", "_n_source_id") == "manual") & F.col("_seen"), F.col("_n_posted_at")).otherwise(F.coalesce("posted_at", "_n_posted_at")).alias("posted_at"), F.coalesce("source_id", "_n_source_id").alias("source_id"),
                         *[F.when(F.col("_seen"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in kept])
    merged = merged.join(sources, "source_id", "left")
    gone = (F.col("_status") == "open") & F.col("_read") & F.col("_there").isNull()
    status = F.when(F.col("_seen"), "open").when(gone, "closed").otherwise(F.col("_status"))
    closed = F.when(F.col("_seen"), F.lit(None)).when(gone, now).otherwise(F.col("_closed"))
    by_hand = (F.col("source_id") == "manual") & F.col("expires_at").isNotNull()
    over = (~by_hand & (F.col("posted_at") < now - F.expr(f"interval {max_age_days} days"))) | F.coalesce(F.col("expires_at") < now, F.lit(False))
    staged = merged.withColumns({"status": status, "closed_at": closed})
    ended = (F.col("status") == "open") & over
    staged = staged.withColumns({"closed_at": F.when(ended, now).otherwise(F.col("closed_at")), "status": F.when(ended, "expired").otherwise(F.col("status"))})
    staged = staged.withColumns({c: F.when(F.col("status") == "open", F.col(c)) for c in DROPPED if c in staged.columns})
    forgotten = (F.col("status") != "open") & F.coalesce(F.col("closed_at") < now - F.expr(f"interval {forget_days} days"), F.lit(False))
    return staged.filter(~forgotten).select(*known.columns)


def picked(rows: DataFrame, key: str, ids: Sequence, automatic: Sequence[Column], most: int) -> DataFrame:
    """The rows that editors picked, in their order, or the first `most` in automatic order if none of the picks is there; with their rank."""
    at = F.when(F.col(key).isin(list(ids) or [None]), F.array_position(F.array(*map(F.lit, ids)), F.col(key))) if ids else F.lit(None).cast("long")
    # a pick is one of a short list: marked rows are few, and a row of the automatic list is among the first
    marked = rows.withColumn("_pick", at)
    picks = marked.filter("_pick is not null").withColumn("rank", F.row_number().over(Window.orderBy("_pick")))
    first = rows.orderBy(*automatic).limit(most).withColumn("_pick", F.lit(None).cast("long")).withColumn("rank", F.row_number().over(Window.orderBy(*automatic)))
    any_pick = picks.limit(1).select(F.lit(True).alias("_any"))
    return picks.unionByName(first.join(any_pick, F.lit(True), "left_anti")).drop("_pick")


def employers(jobs: DataFrame, most: int) -> DataFrame:
    """id, name (of the first listing), initials, open_jobs, featured of open jobs' (employer_id, company, featured, ord) employers; the first `most`.

    Of equal employers names decide, in the order of a dictionary: accents and case count only where all else is the same.
    """
    by = jobs.filter("company <> ''").groupBy(F.coalesce("employer_id", U.employer_id(F.col("company"))).alias("id"))
    found = by.agg(F.min_by("company", "ord").alias("name"), F.count("*").alias("open_jobs"), F.bool_or(F.coalesce("featured", F.lit(False))).alias("featured"))
    return found.withColumn("initials", T.initials(F.col("name"))).orderBy(F.desc("featured"), F.desc("open_jobs"), F.collate("name", "UNICODE"), "name", "id").limit(most)


def enriched(employers: DataFrame, profiles: DataFrame, linked: DataFrame) -> DataFrame:
    """Employers with the profile (key, name, website) that one of their jobs links to (linked: id, key), else the one of their name."""
    by_key = linked.join(profiles, "key").groupBy("id").agg(F.min_by(F.struct("key", "website"), "key").alias("_by_key"))
    by_name = profiles.groupBy(U.employer_id(F.col("name")).alias("id")).agg(F.min_by(F.struct("key", "website"), "key").alias("_by_name"))
    found = employers.join(by_key, "id", "left").join(by_name, "id", "left").withColumn("_p", F.coalesce("_by_key", "_by_name"))
    return found.select(*employers.columns, F.col("_p.key").alias("profile"), U.https_only(F.col("_p.website")).alias("website"))


def with_top(employers: DataFrame, top: DataFrame) -> DataFrame:
    """Employers, and those of a hand-picked list (id, name) that have no open jobs."""
    missing = top.join(employers, "id", "left_anti").select("id", "name", F.lit(0).cast("long").alias("open_jobs"), F.lit(False).alias("featured"), T.initials(F.col("name")).alias("initials"))
    return employers.select("id", "name", "open_jobs", "featured", "initials").unionByName(missing)
