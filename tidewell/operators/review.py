"""What an editor's action makes of a story in review: which fields are set and which are lost, or why it is refused.

A story has the columns that hashes.story_content reads, and id, article_id, status, excerpt, link, source, licence (of its source), approved_by, approved_at, content_hash, published_by,
first_published_at, scheduled_at, rejection_reason, status_changed_at, status_changed_by (dates are timestamps, all alike with or without zone); an action has action, user, reason, schedule_at.

Defined results: no status counts as pending_review, no action is an unknown one. A refused story is as it was. Rows are stories of their own, also with equal ids; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import hashes
from tidewell.functions import text as T
from tidewell.operators import lifecycle, publish, rules

#: A story is scheduled for so many minutes from now, or later.
LEAD_MINUTES = 5
#: Statuses in which a story's content is approved: only approvers may save it.
GUARDED = ("approved", "published")


def suggested_slug(headline: Column, article_id: Column) -> Column:
    """The headline in words of a-z and digits with dashes, and four digits of the article's id, else of the headline's hash."""
    own = hashes.trimmed(headline)
    digits = F.when(F.coalesce(article_id.rlike("^a_[0-9a-f]{4}"), F.lit(False)), F.substring(article_id, 3, 4)).otherwise(F.left(hashes.fnv1a64(own), F.lit(4)))
    return F.concat(F.coalesce(F.nullif(T.dashed(own), F.lit("")), F.lit("story")), F.lit("-"), digits)


def _blockers() -> dict[str, Column]:
    c, image = F.col, F.col("image")
    return publish.blockers(c("headline"), c("summary"), c("excerpt"), c("slug"), c("link"), c("source"), c("licence"), F.nullif(image["asset"], F.lit("")), image["rights_confirmed"], image["credit"], F.nullif(c("duplicate_of"), F.lit("")))


def acted(stories: DataFrame, now: Column, approvers: Sequence[str]) -> DataFrame:
    """stories, each after its action, with ok and `reasons`, why it was refused.

    Actions are those of lifecycle.STORY_ACTIONS, and save, which stamps an approved story's approval anew. To be approved or published a story must pass all that publish.blockers asks for.
    """
    c = F.col
    action, status = F.coalesce("action", F.lit("")), F.coalesce(F.nullif(c("status"), F.lit("")), F.lit("pending_review"))
    why, soon = hashes.trimmed(c("reason")), ~F.coalesce(c("schedule_at") >= now + F.expr(f"interval {LEAD_MINUTES} minutes"), F.lit(False))
    refused = lifecycle.refusal(lifecycle.STORY_ACTIONS, action, status, c("user"), why, approvers, GUARDED, "story")
    refused = F.coalesce(refused, F.when((action == "schedule") & soon, "too soon"))
    moves = action.isin([a[0] for a in lifecycle.STORY_ACTIONS])
    later, goes, back, off = action == "schedule", action.isin("approvePublish", "publish", "schedule"), action == "returnToReview", action.isin("unpublish", "returnToReview")
    puts = goes | (action == "approve")
    at = F.when(later, c("schedule_at")).otherwise(now)
    cleared = lambda name, when: F.when(~when, c(name))
    named = stories.select(F.struct(*stories.columns).alias("_own"), *stories.columns).withColumns({"_refused": refused, "_stamps": puts | ((action == "save") & status.isin(list(GUARDED)))})
    after = named.withColumns({
        "status": F.when(moves, lifecycle.led(lifecycle.STORY_ACTIONS, action, status)).otherwise(c("status")),
        "status_changed_at": F.when(moves, now).otherwise(c("status_changed_at")), "status_changed_by": F.when(moves, c("user")).otherwise(c("status_changed_by")),
        "slug": F.when(puts & ~hashes.trimmed(c("slug")).rlike(publish.SLUG), suggested_slug(c("headline"), c("article_id"))).otherwise(c("slug")),
        "published_at": F.when(goes, at).otherwise(cleared("published_at", off)), "published_by": F.when(goes, c("user")).otherwise(cleared("published_by", off)),
        "scheduled_at": F.when(later, c("schedule_at")).otherwise(cleared("scheduled_at", goes | off)), "first_published_at": F.when(goes, F.coalesce("first_published_at", at)).otherwise(c("first_published_at")),
        "rejection_reason": F.when(action == "reject", why).otherwise(cleared("rejection_reason", puts | back)),
        **{name: cleared(name, back) for name in ("approved_by", "approved_at", "content_hash")},
    })
    reasons = F.when(c("_refused").isNotNull(), F.array("_refused")).when(c("_stamps"), rules.hold_reasons(_blockers())).otherwise(F.array().cast("array<string>"))
    judged = after.withColumn("_hash", hashes.approval_hash()).withColumn("_reasons", reasons).withColumn("_ok", F.size("_reasons") == 0)
    stamps = {"approved_by": c("user"), "approved_at": now, "content_hash": c("_hash")}
    made = lambda name: F.when(c("_stamps"), stamps[name]).otherwise(c(name)) if name in stamps else c(name)
    return judged.select(*[F.when(c("_ok"), made(name)).otherwise(c("_own")[name]).alias(name) for name in stories.columns], c("_ok").alias("ok"), c("_reasons").alias("reasons"))
