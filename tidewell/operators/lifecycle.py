"""State between runs: merges, what has vanished, expiry, caps, circuit breakers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old and new rows by key; what is new and not null wins. `seen` tells which sides had the key: old, new, both."""
    rest = [c for c in old.columns if c not in keys]
    o, n = old.withColumn("_o", F.lit(True)), new.withColumn("_n", F.lit(True))
    for c in rest:
        o, n = o.withColumnRenamed(c, f"_o_{c}"), n.withColumnRenamed(c, f"_n_{c}")
    both = o.join(n, list(keys), "full_outer")
    seen = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "old").otherwise("both")
    return both.select(*keys, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in rest], seen.alias("seen"))


def vanished(known: DataFrame, current: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """Known rows that the current run hasn't, of sources that the current run has."""
    return known.join(current.select(source).distinct(), source, "left_semi").join(current.select(*keys).distinct(), list(keys), "left_anti")


def expired(status: Column, seen: Column, changed: Column, now: Column, pending_days: int = 30, rejected_days: int = 45) -> Column:
    """Pending rows not seen for a while, rejected ones not changed for a while."""
    before = lambda days: now - F.expr(f"interval {days} days")
    return ((status == "pending") & (seen < before(pending_days))) | ((status == "rejected") & (F.coalesce(changed, seen) < before(rejected_days)))


def capped(df: DataFrame, keys: Sequence[str], order: Sequence[str], cap: int) -> DataFrame:
    """Rows with `accepted`: the first cap of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("accepted", F.row_number().over(w) <= cap)


def breaker(outcomes: DataFrame, key: str, at: str, order: Sequence[str], failed: Column, gone: Column | None = None, most: int = 5, pause_days: int = 7) -> DataFrame:
    """The state of each source after its last outcome: consecutive_failures, status (ok, error, paused, not-found), paused_until.

    gone marks failures that pause a source at once. The last success is found by an aggregate, then what came after it is counted.
    """
    gone = F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)
    marked = outcomes.select(key, F.struct(*order).alias("_at"), F.col(at).alias("_t"), F.coalesce(failed, F.lit(False)).alias("_failed"), gone.alias("_gone"))
    last = marked.groupBy(key).agg(F.max(F.when(~F.col("_failed"), F.col("_at"))).alias("_ok"))
    after = marked.filter("_failed").join(last, key).filter(F.col("_ok").isNull() | (F.col("_at") > F.col("_ok")))
    latest = F.max(F.struct("_at", "_t", "_gone"))
    # a pause that a gone page began outlasts later failures until its own end
    streak = after.groupBy(key).agg(F.count("*").alias("_n"), latest.alias("_last"), F.max(F.when(F.col("_gone"), F.col("_t"))).alias("_gone_at"))
    n, ended = F.coalesce("_n", F.lit(0)), F.col("_last._t")
    status = F.when(n == 0, "ok").when(F.col("_last._gone"), "not-found").when(n >= most, "paused").otherwise("error")
    until = F.when(F.col("_last._gone") | (n >= most), ended).otherwise(F.col("_gone_at")) + F.expr(f"interval {pause_days} days")
    return last.join(streak, key, "left").select(key, n.alias("consecutive_failures"), status.alias("status"), until.alias("paused_until"))


# Actions of the review of stories and of jobs, each with the statuses it may start from, the status it leads to and whether only approvers may.
STORY_ACTIONS = (
    ("approve", ("pending_review", "rejected"), "approved", True),
    ("approvePublish", ("pending_review", "rejected"), "published", True),
    ("publish", ("approved",), "published", True),
    ("schedule", ("pending_review", "approved"), "published", True),
    ("reject", ("pending_review", "approved"), "rejected", False),
    ("unpublish", ("published",), "approved", False),
    ("archive", ("pending_review", "approved", "rejected", "published"), "archived", False),
    ("returnToReview", ("approved", "rejected", "archived"), "pending_review", False),
)
JOB_ACTIONS = (
    ("approvePublish", ("pending_review", "rejected", "archived"), "published", True),
    ("reject", ("pending_review", "published"), "rejected", False),
    ("unpublish", ("published",), "pending_review", False),
    ("archive", ("pending_review", "published", "rejected"), "archived", False),
)
#: Characters of a reason for a rejection.
REASON = (5, 300)


def next_status(actions: Sequence[tuple], status: Column, action: Column, approver: Column, reason: Column, checks: Column | None = None) -> Column:
    """The status after an action, or null where it isn't allowed. Rejections need a reason; what only approvers may do needs checks to be true, too."""
    now, to = F.coalesce(status, F.lit("pending_review")), F.lit(None).cast("string")
    why = F.length(F.trim(F.coalesce(reason, F.lit(""))))
    for name, starts, end, only_approvers in actions:
        allowed = (action == name) & now.isin(list(starts))
        if only_approvers:
            allowed = allowed & F.coalesce(approver, F.lit(False)) & (F.coalesce(checks, F.lit(False)) if checks is not None else F.lit(True))
        if name == "reject":
            allowed = allowed & why.between(*REASON)
        to = F.when(allowed, end).otherwise(to)
    return to


def refusal(actions: Sequence[tuple], action: Column, status: Column, user: Column, reason: Column, approvers: Sequence[str], guarded: Sequence[str], of: str) -> Column:
    """Why an action on a document `of` some kind isn't allowed, null if it is. Beside the actions there is save, which only approvers may do while the status is a guarded one.

    status must not be null; reason is trimmed. What the document must fulfil to be published isn't asked here.
    """
    known, starts, vetted = F.lit(False), F.lit(False), (action == "save") & status.isin(list(guarded))
    for name, may, _, only_approvers in actions:
        known, starts = known | (action == name), starts | ((action == name) & status.isin(list(may)))
        vetted = vetted | ((action == name) & F.lit(only_approvers))
    listed = F.coalesce(user.isin(list(approvers)), F.lit(False)) if approvers else F.lit(False)
    return (
        F.when(~known & (action != "save"), "unknown action").when(known & ~starts, F.concat(F.lit(f"not for a {of} that is "), status)).when(vetted & F.lit(not approvers), "no approvers")
        .when(vetted & ~listed, "not an approver").when((action == "reject") & ~(F.octet_length(F.encode(reason, "UTF-16BE")) / 2).between(*REASON), "no reason given")
    )


def led(actions: Sequence[tuple], action: Column, status: Column) -> Column:
    """The status that an action leads to; the same for others."""
    to = status
    for name, _, end, _ in actions:
        to = F.when(action == name, end).otherwise(to)
    return to


def reset(states: DataFrame, key: str, which: Sequence[str]) -> DataFrame:
    """Breaker states (consecutive_failures, status, paused_until) with some sources as new."""
    chosen = F.col(key).isin(list(which))
    return states.withColumns({
        "consecutive_failures": F.when(chosen, F.lit(0)).otherwise(F.col("consecutive_failures")), "status": F.when(chosen, "new").otherwise(F.col("status")),
        "paused_until": F.when(~chosen, F.col("paused_until")),
    })


def paused(until: Column, now: Column) -> Column:
    """Whether a source is skipped: its pause hasn't ended."""
    return F.coalesce(until > now, F.lit(False))
