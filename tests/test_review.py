from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import hashes
from tidewell.operators import review

NOW_AT = "2026-10-30 00:00:00"
AT, LATER = datetime(2026, 10, 30), datetime(2026, 10, 30, 0, 5)
SHAPE = """id string, article_id string, status string, headline string, slug string, summary string, summary_source string, capital_types array<string>, asset_classes array<string>, geography array<string>,
transaction_type string, featured boolean, image struct<asset:string,credit:string,rights_confirmed:boolean>, seo struct<title:string,description:string>, duplicate_of string, published_at timestamp_ntz,
excerpt string, link string, source string, licence string, approved_by string, approved_at timestamp_ntz, content_hash string, published_by string, first_published_at timestamp_ntz, scheduled_at timestamp_ntz,
rejection_reason string, status_changed_at timestamp_ntz, status_changed_by string, action string, user string, reason string, schedule_at timestamp_ntz, ok_of int"""
STORY = {
    "id": "n.1", "article_id": "a_3f2a99", "headline": "Fund buys a stake", "slug": "fund-buys", "summary": "A fund has bought a stake in a firm.", "seo": ("", ""), "link": "https://a.ae/x", "source": "Paper", "licence": "wire",
    "approved_by": "pA", "approved_at": datetime(2026, 1, 1), "content_hash": "old", "published_by": "pA", "published_at": datetime(2026, 1, 2), "scheduled_at": datetime(2026, 1, 2), "rejection_reason": "why", "user": "pB",
}


def at():
    return F.lit(NOW_AT).cast("timestamp_ntz")


def frame(spark, change):
    schema = spark.createDataFrame([], SHAPE).schema
    return spark.createDataFrame([tuple({**STORY, **change}.get(f.name) for f in schema)], schema)


@pytest.mark.parametrize("action, change, sets, why", [
    ("approve", {"status": None, "slug": "No"}, {"status": "approved", "slug": "fund-buys-a-stake-3f2a", "rejection_reason": None, "approved_by": "pB", "approved_at": AT}, []),
    ("approvePublish", {"status": "rejected"}, {"status": "published", "published_at": AT, "published_by": "pB", "first_published_at": AT, "scheduled_at": None, "rejection_reason": None, "approved_by": "pB", "approved_at": AT}, []),
    ("publish", {"status": "approved", "first_published_at": datetime(2025, 1, 1)}, {"status": "published", "published_at": AT, "published_by": "pB", "scheduled_at": None, "rejection_reason": None, "approved_by": "pB", "approved_at": AT}, []),
    ("publish", {"status": "pending_review"}, {}, ["not for a story that is pending_review"]),
    ("schedule", {"status": "approved", "schedule_at": LATER}, {"status": "published", "published_at": LATER, "published_by": "pB", "first_published_at": LATER, "scheduled_at": LATER, "rejection_reason": None, "approved_by": "pB", "approved_at": AT}, []),
    ("schedule", {"status": "approved", "schedule_at": datetime(2026, 10, 30, 0, 4, 59)}, {}, ["too soon"]),
    ("schedule", {"status": "approved"}, {}, ["too soon"]),
    ("approve", {"user": "x", "status": ""}, {}, ["not an approver"]),
    ("approve", {"headline": "short", "licence": "unknown", "image": ("img", "", None)}, {}, ["headline", "licence", "rights", "credit"]),
    ("approve", {"duplicate_of": "n.2", "excerpt": "e" * 281}, {}, ["excerpt", "duplicate"]),
    ("reject", {"reason": " off topic ", "user": "x"}, {"status": "rejected", "rejection_reason": "off topic", "status_changed_by": "x"}, []),
    ("reject", {"reason": "no"}, {}, ["no reason given"]),
    ("unpublish", {"status": "published"}, {"status": "approved", "published_at": None, "published_by": None, "scheduled_at": None}, []),
    ("archive", {"status": "published"}, {"status": "archived"}, []),
    ("returnToReview", {"status": "archived"}, {"status": "pending_review", "published_at": None, "published_by": None, "scheduled_at": None, "rejection_reason": None, "approved_by": None, "approved_at": None, "content_hash": None}, []),
    ("save", {"status": "published", "headline": "Another headline"}, {"approved_by": "pB", "approved_at": AT}, []),
    ("save", {"status": "published", "user": "x"}, {}, ["not an approver"]),
    ("save", {"status": "rejected", "user": "x", "headline": ""}, {}, []),
    (None, {"status": "published"}, {}, ["unknown action"]),
])
def test_actions(spark, action, change, sets, why):
    df = frame(spark, {**change, "action": action})
    out = review.acted(df, at(), ("pA", "pB"))
    assert out.columns == [*df.columns, "ok", "reasons"]
    before, after = df.first(), out.first()
    assert (after.ok, after.reasons) == (not why, why)
    if not why and action != "save":
        sets = {"status_changed_at": AT, "status_changed_by": "pB"} | sets
    if "approved_by" in sets and sets["approved_by"]:
        sets = sets | {"content_hash": out.select(hashes.approval_hash()).first()[0]}
    assert {f: after[f] for f in df.columns if after[f] != before[f]} == sets


def test_nobody_approves_without_approvers(spark):
    df = frame(spark, {"action": "approve"})
    assert review.acted(df, at(), ()).first().reasons == ["no approvers"]
    assert review.acted(df.limit(0), at(), ("pA",)).collect() == []


def test_slugs(spark):
    df = spark.createDataFrame([("Été’s deal", "a_12", 1), (None, None, 2), ("w" * 50 + " " + "v" * 40, "a_beef00", 3)], "h string, a string, n int")
    got = [r[0] for r in df.orderBy("n").select(review.suggested_slug(F.col("h"), F.col("a"))).collect()]
    assert got[0][:-4] == "ete-s-deal-" and got[1].startswith("story-") and len(got[1]) == 10 and got[2] == "w" * 50 + "-beef"
