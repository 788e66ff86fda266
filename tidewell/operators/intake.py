"""Items of feeds on their way into a queue: normal form, known ones, links, budgets, and what is written for those seen again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import url as U


def normalised(items: DataFrame, now: Column, excerpt: int = 280) -> DataFrame:
    """Items with title, link, guid, summary, image_url, published_at, date_estimated in their final form, and canonical, article_id.

    items: ord and the columns of feeds.items, with their source's source_id, source_name, homepage, allow_excerpt, allow_images and images.
    """
    quoted = F.regexp_replace("source_name", r"([.*+?^${}()|\[\]\\])", r"\\$1")
    title = F.trim(F.regexp_replace(T.html_to_text(F.col("title")), F.concat(F.lit(r"(?i)\s+[-|–—]\s+"), quoted, F.lit(r"\s*$")), F.lit("")))
    raw = F.trim(F.coalesce("link", F.lit("")))
    origin = F.regexp_extract("homepage", r"^(https?://[^/?#]+)", 1)
    link = F.when(U.is_http(raw) | (raw == "") | (origin == ""), raw).when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(raw.startswith("/"), F.concat(origin, raw)).otherwise(F.concat(origin, F.lit("/"), raw))
    found = F.coalesce(F.nullif(T.clean_excerpt(T.html_to_text(F.col("summary_html"))), F.lit("")), T.clean_excerpt(T.html_to_text(F.col("content_html"))))
    read = items.withColumns({"title": title, "link": link, "_summary": T.truncate(found, excerpt)})
    same = T.normalise_title(F.col("_summary")) == T.normalise_title(F.col("title"))
    shown = F.coalesce("allow_excerpt", F.lit(True)) & ~same
    estimated = F.col("published_at").isNull() | (F.col("published_at") > now + F.expr("interval 1 hour"))
    image = F.when(F.coalesce("allow_images", F.lit(False)), U.https_only(F.get("images", F.lit(0))))
    out = read.withColumns({
        "summary": F.when(shown, F.col("_summary")).otherwise(""), "image_url": image, "date_estimated": estimated, "published_at": F.when(estimated, now).otherwise(F.col("published_at")),
        "guid": F.trim(F.coalesce(F.nullif("guid", F.lit("")), "link", F.lit(""))), "canonical": U.canonical(F.col("link")),
    })
    return out.drop("_summary").withColumn("article_id", U.article_id(F.col("canonical")))


def known(items: DataFrame, queue: DataFrame, days: int = 7) -> DataFrame:
    """Items with `duplicate`: the queue (article_id, source_id, guid, title, published_at) has their address, their guid of that source, or their title of that source within so many days.

    Three joins on equal keys, of which the last has a band of time; each finds at most one row for an item.
    """
    ids = queue.select("article_id").distinct().withColumn("_a", F.lit(True))
    guids = queue.select("source_id", "guid").distinct().withColumn("_g", F.lit(True))
    titled = queue.select("source_id", T.normalise_title(F.col("title")).alias("_title"), F.unix_millis(F.col("published_at").cast("timestamp")).alias("_t"))
    # a band of so many days lies in two buckets of that length at most on either side
    span = days * 86_400_000
    times = titled.select("source_id", "_title", "_t", F.explode(F.array(*[F.floor(F.col("_t") / span) + i for i in (-1, 0, 1)])).alias("_b"))
    mine = items.withColumn("_item", F.monotonically_increasing_id()).withColumns({"_title": T.normalise_title(F.col("title")), "_at": F.unix_millis(F.col("published_at").cast("timestamp"))}).withColumn("_b", F.floor(F.col("_at") / span))
    near = times.groupBy("source_id", "_title", "_b").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.array_sort(F.collect_set("_t")).alias("_times"))
    marked = mine.join(ids, "article_id", "left").join(guids, ["source_id", "guid"], "left").join(near, ["source_id", "_title", "_b"], "left")
    close = F.coalesce(F.exists("_times", lambda t: F.abs(t - F.col("_at")) < span), F.lit(False))
    return marked.withColumn("duplicate", F.col("_a").isNotNull() | F.col("_g").isNotNull() | close).select(*items.columns, "duplicate")


def without_broken(items: DataFrame, statuses: DataFrame, link: str = "link") -> DataFrame:
    """Items whose link (statuses: link, status) isn't known to be broken; what is unknown stays."""
    return items.join(statuses.filter("status = 'broken'").select(link).distinct(), link, "left_anti")


def touched(stories: DataFrame, seen: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    """Changes of stories (id, status, last_seen_at, excerpt, image) that were seen again (seen: id, excerpt, image): last_seen_at if it is that old, missing texts while they are pending."""
    found = seen.groupBy("id").agg(F.max("excerpt").alias("_excerpt"), F.max("image").alias("_image"))
    both = stories.join(found, "id")
    pending = F.col("status") == "pending_review"
    fill = lambda c: F.when(pending & (F.coalesce(c, F.lit("")) == ""), F.nullif(f"_{c}", F.lit("")))
    old = F.coalesce("last_seen_at", F.lit("1970-01-01").cast("timestamp_ntz")) <= now - F.expr(f"interval {hours} hours")
    return both.select("id", F.when(old, now).alias("last_seen_at"), fill("excerpt").alias("excerpt"), fill("image").alias("image")).filter("coalesce(last_seen_at is not null or excerpt is not null or image is not null, false)")


def within_budget(new: DataFrame, documents: int, stop_at: int, priority: str, ord: str) -> DataFrame:
    """As many of the new documents as there is room for, the most important first."""
    return new.orderBy(F.desc(F.coalesce(priority, F.lit(0))), ord).limit(max(0, stop_at - documents))


def members(stories: DataFrame) -> DataFrame:
    """A row for each article of stories: the lead (article_id, title, source_id, guid, published_at) and others, an array of such structs; those without id, title or time are left out."""
    fields = ("article_id", "title", "source_id", "guid", "published_at")
    each = F.concat(F.array(F.struct(*fields)), F.transform(F.coalesce("others", F.array()), lambda o: F.struct(*[o[f].alias(f) for f in fields])))
    return stories.select("id", F.inline(each)).filter("article_id is not null and title <> '' and published_at is not null")


def feed_audit(items: DataFrame, now: Column, stale_days: int = 14) -> DataFrame:
    """source_id, n, newest (dates more than a day ahead don't count), age_days, verdict of each source's feed."""
    real = F.when(F.col("published_at") <= now + F.expr("interval 1 day"), F.col("published_at"))
    found = items.groupBy("source_id").agg(F.count("published_at").alias("n"), F.max(real).alias("newest"))
    age = F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("newest").cast("timestamp"))) / 86_400)
    verdict = F.when(F.col("n") == 0, "empty").when(F.col("newest").isNull(), "undated").when(F.col("age_days") > stale_days, "stale").otherwise("ok")
    return found.withColumn("age_days", age).withColumn("verdict", verdict)


def source_counts(items: DataFrame) -> DataFrame:
    """source_id, fetched, rejected, kept of a run's items with a reason or none."""
    return items.groupBy("source_id").agg(F.count("*").alias("fetched"), F.count("reason").alias("rejected"), F.count_if(F.col("reason").isNull()).alias("kept"))


def leads(reports: DataFrame) -> DataFrame:
    """The lead of each story (reports: story, cleared, priority, published_at, article_id, uae): cleared sources first, then by priority, then the earliest; `uae` if one report is."""
    order = F.struct((~F.coalesce("cleared", F.lit(False))).alias("_held"), F.coalesce("priority", F.lit(9)).alias("_p"), "published_at", "article_id")
    return reports.groupBy("story").agg(F.min(order).alias("_lead"), F.bool_or("uae").alias("uae"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), F.count_distinct("source_id").alias("n_sources")).select("story", F.col("_lead.article_id").alias("lead"), "uae", "first_at", "last_at", "n_sources")


def suggested(docs: DataFrame, suggestions: DataFrame, dimensions: tuple[str, ...], review_below: float = 0.5) -> DataFrame:
    """Documents with a model's suggestions (id, the dimensions as arrays, confidence, summary) laid over those of rules: what is empty there stays, an editor is asked where nothing or little is known."""
    s = suggestions.select("id", *[F.col(d).alias(f"_{d}") for d in dimensions], F.col("confidence").alias("_confidence"), F.col("summary").alias("_summary"))
    both = docs.join(s, "id", "left")
    out = both.withColumns({d: F.when(F.size(f"_{d}") > 0, F.col(f"_{d}")).otherwise(F.col(d)) for d in dimensions} | {"summary": F.coalesce(F.nullif("_summary", F.lit("")), "summary")})
    nothing = F.lit(True)
    for d in dimensions:
        nothing = nothing & (F.coalesce(F.size(d), F.lit(0)) == 0)
    return out.withColumn("needs_review", nothing | (F.coalesce("_confidence", "confidence") < review_below)).drop("_confidence", "_summary", *[f"_{d}" for d in dimensions])


def first_of_sources(items: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Items in order of arrival with `first`: whether none with the same key came before."""
    return items.withColumn("first", F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1)
