import pytest
from pyspark.sql import functions as F

from tidewell.functions import hashes
from tidewell.operators import jobs, postings

NOW_AT = "2026-10-30 00:00:00"
SHAPE = """id string, status string, approved_by string, approved_at string, content_hash string, published_at string, first_published_at string, title string, slug string, company string, employer string,
company_url string, location string, work_mode string, employment_type string, seniority string, department string, regulator string, url string, salary_from double, salary_to double, salary_currency string,
salary_period string, visa string, description string, requirements array<string>, expires_at string, published_by string, rejection_reason string, status_changed_at string, status_changed_by string, filer string,
action string, user string, reason string, reasons_of string, n int"""
FIELDS = [x.split()[0] for x in SHAPE.replace("\n", " ").split(",")]
LIVE = {
    "id": "jobs.sub_0123", "status": "published", "approved_by": "pA", "approved_at": "2026-10-01", "published_at": "2026-10-01T09:00:00Z", "title": " Associate ", "slug": "associate-3f2a", "company": "Example Capital",
    "location": "DIFC, Dubai", "url": "https://e.ae/x", "salary_from": 25000.0, "salary_to": 35000.0, "salary_currency": "AED", "salary_period": "month", "visa": "Remote from abroad", "description": "d" * 50,
    "requirements": ["one", " ", None], "filer": "sara", "employer": "employer-1", "work_mode": "", "regulator": "SCA",
}


def at():
    return F.lit(NOW_AT).cast("timestamp")


def frame(spark, *changes, stamp=True):
    """Postings that differ from LIVE; what was approved is LIVE."""
    rows = spark.createDataFrame([[{**LIVE, **c, "n": i}.get(f) for f in FIELDS] for i, c in enumerate(changes)], SHAPE)
    approved = postings.approved_hash(spark.createDataFrame([[LIVE.get(f) for f in FIELDS]], SHAPE), "_h").first()["_h"]
    return rows.withColumn("content_hash", F.lit(approved)) if stamp else rows


def reasons(df, **more):
    return [r.reasons for r in postings.gated(df, at(), more.get("approvers", ("pA", "pB"))).orderBy("n").collect()]


def test_what_holds_a_posting(spark):
    assert reasons(frame(spark, {}, {"title": "Associate"}, {"requirements": ["one"], "salary_to": 35000.0})) == [[]] * 3  # blanks at the ends and blank lines are no change
    cases = [
        ({"id": "drafts.jobs.sub_0123"}, ["not a posting"]), ({"id": None}, ["not a posting"]), ({"id": "jobs.abc"}, ["not a posting"]), ({"status": "rejected", "title": ""}, ["status is rejected"]), ({"status": None}, ["status is missing"]),
        ({"approved_by": None}, ["no approval"]), ({"approved_by": "x"}, ["not an approver"]), ({"salary_from": 26000.0}, ["changed"]), ({"company_url": "https://e.ae"}, ["changed"]), ({"company_url": " "}, ["company website"]),
        ({"salary_from": 10.5}, ["changed", "salary"]), ({"salary_from": float("nan")}, ["changed", "salary"]), ({"salary_to": 10.0}, ["changed", "salary range"]), ({"salary_to": 0.0}, ["changed", "top salary", "salary range"]), ({"salary_to": 1e9}, ["changed", "top salary"]),
        ({"title": "ab"}, ["changed", "title"]), ({"title": None}, ["changed", "title"]), ({"slug": "a--b"}, ["changed", "slug"]), ({"url": "http://e.ae"}, ["changed", "link"]), ({"visa": None}, ["changed", "visa"]), ({"work_mode": "hybrid"}, ["changed", "work mode"]),
        ({"requirements": ["x"]}, ["changed", "requirement"]), ({"requirements": ["ab"] * 21}, ["changed", "requirements"]), ({"requirements": None}, ["changed"]), ({"description": "d" * 5001}, ["changed", "description"]),
        ({"expires_at": "soon"}, ["expiry"]), ({"expires_at": "2026-10-30"}, ["changed", "expired"]), ({"expires_at": "2026-10-31"}, ["changed"]), ({"company": "𝕏"}, ["changed"]), ({"company": "x"}, ["changed", "company"]),
    ]
    assert reasons(frame(spark, *[c for c, _ in cases])) == [r for _, r in cases]
    assert reasons(frame(spark, {}), approvers=()) == [["no approvers"]]
    assert reasons(frame(spark, {}).limit(0)) == []


def test_listings_hide_the_filer_and_take_the_profile(spark):
    docs = spark.createDataFrame(
        [("employer-1", "example-capital", " Example Partners ", "https://img.ae/x", "", "https://example.com"), ("employer-2", "-bad", "Bad", None, None, None), ("employer-3", "bad-name", "x", None, None, None), (None, "lost-one", "Lost", None, None, None)],
        "doc_id string, id string, name string, logo_url string, description string, website string",
    )
    own = postings.profiles(docs)
    assert sorted((r.doc_id or "", r.id, r.name, r.description, r.website) for r in own.collect()) == [("", "lost-one", "Lost", None, None), ("employer-1", "example-capital", "Example Partners", None, "https://example.com")]
    listed = postings.listings(frame(spark, {}, {"id": "jobs.other", "employer": "employer-2", "company_url": "https://own.ae", "first_published_at": "2026-09-09T01:00:00Z", "expires_at": "2026-12-01T00:00:00Z"}, {"id": "jobs.none", "employer": None}), own)
    assert not {"filer", "approved_by", "_own"} & set(listed.columns)
    by = {r.id: r for r in listed.collect()}
    assert (by["sub_0123"].company, by["sub_0123"].employer_key, by["sub_0123"].logo_url, by["sub_0123"].company_url, by["sub_0123"].posted_at, by["sub_0123"].expires_at) == ("Example Capital", "example-capital", "https://img.ae/x", "https://example.com", "2026-10-01", None)
    assert (by["other"].employer_key, by["other"].logo_url, by["other"].company_url, by["other"].posted_at, by["other"].expires_at) == (None, None, "https://own.ae", "2026-09-09", "2026-12-01")
    assert by["none"].employer_key is None and by["none"].requirements == ["one"] and by["none"].title == "Associate"
    picks = spark.createDataFrame([(1, "jobs", 3, "jobs.sub_0123"), (1, "jobs", 1, "jobs.gone"), (1, "jobs", 2, "jobs.other"), (1, "employers", 1, "employer-2"), (1, "employers", 2, "employer-1"), (2, "jobs", 1, "jobs.other")], "page int, list string, at int, ref string")
    found = postings.picked(picks, own, frame(spark, {}, {"id": "jobs.other"}, {"id": "jobs.other"}))
    assert sorted(map(tuple, found.collect())) == [(1, "employers", 1, "example-capital"), (1, "jobs", 1, "other"), (1, "jobs", 2, "sub_0123"), (2, "jobs", 1, "other")]


def test_a_source_without_listings_closes_its_jobs(spark):
    listed = postings.listings(frame(spark, {}), postings.profiles(spark.createDataFrame([], "doc_id string, id string, name string, logo_url string, description string, website string")))
    rows, read = postings.as_source(listed)
    row = rows.first()
    assert row.job_id == spark.range(1).select(F.concat(F.lit("j_"), F.left(F.sha2(F.lit("manual:sub_0123"), 256), F.lit(16)))).first()[0] and row.source_id == "manual"
    known = rows.select("job_id", "source_id", "key", F.lit("open").alias("status"), "posted_at", "expires_at", F.lit(None).cast("timestamp").alias("closed_at"))
    seen = known.drop("status", "closed_at")
    status = lambda now: [r.status for r in jobs.lifecycle(known, now, at(), read=read).collect()]
    assert status(seen) == ["open"] and status(seen.limit(0)) == ["closed"]


@pytest.mark.parametrize("change, ok, why", [
    ({"action": "approvePublish", "status": "pending_review", "slug": None}, True, []),
    ({"action": "approvePublish", "status": None, "user": "someone"}, False, ["not an approver"]),
    ({"action": "approvePublish"}, False, ["not for a job that is published"]),
    ({"action": "approvePublish", "status": "archived", "description": "short", "url": ""}, False, ["link", "description"]),
    ({"action": "reject", "reason": " no "}, False, ["no reason given"]),
    ({"action": "reject", "reason": " Agency repost ", "user": "someone"}, True, []),
    ({"action": "unpublish", "user": "someone"}, True, []),
    ({"action": "unpublish", "status": "pending_review"}, False, ["not for a job that is pending_review"]),
    ({"action": "archive"}, True, []),
    ({"action": "save", "salary_from": 27000.0}, True, []),
    ({"action": "save", "user": "someone"}, False, ["not an approver"]),
    ({"action": "save", "user": "someone", "status": "pending_review"}, True, []),
    ({"action": None}, False, ["unknown action"]),
])
def test_actions(spark, change, ok, why):
    df = frame(spark, {"user": "pB", **change})
    before, after = df.first(), postings.acted(df, at(), ("pA", "pB")).first()
    assert (after.ok, after.reasons) == (ok, why)
    same = {f for f in FIELDS if after[f] == before[f]}
    if not ok or change["action"] == "save" and change.get("status"):
        assert same == set(FIELDS)
    elif change["action"] == "approvePublish":
        assert (after.status, after.published_at, after.first_published_at, after.published_by, after.approved_by) == ("published", "2026-10-30T00:00:00.000Z", "2026-10-30T00:00:00.000Z", "pB", "pB")
        assert after.expires_at[:10] == "2026-12-29" and after.slug.startswith("associate-example-capital-") and len(after.slug) == 30
        public = postings.gated(postings.acted(df, at(), ("pA", "pB")).drop("reasons", "ok"), at(), ("pB",))
        assert public.first().reasons == []  # the stamp is of what is there now
        assert postings.acted(df, at(), ()).first().reasons == ["no approvers"]
    elif change["action"] == "reject":
        assert (after.status, after.rejection_reason, after.approved_by, after.content_hash, after.published_at, after.filer) == ("rejected", "Agency repost", None, None, None, "sara")
    elif change["action"] == "unpublish":
        assert (after.status, after.approved_by, after.published_at, after.status_changed_by) == ("pending_review", None, None, "someone")
    elif change["action"] == "archive":
        assert (after.status, after.filer, after.approved_by, after.published_at) == ("archived", None, None, "2026-10-01T09:00:00Z")
    else:
        assert set(FIELDS) - same == {"approved_by", "approved_at", "content_hash"} and after.approved_by == "pB"


def test_slugs(spark):
    rows = [("Director’s Aide – Zürich", "A & B", "drafts.jobs.x"), ("x" * 30 + " " + "y" * 60, "", "i"), ("z" * 90, "c", "i"), (None, " ", None)]
    df = spark.createDataFrame(rows, "t string, c string, i string").select(postings.suggested_slug(F.col("t"), F.col("c"), F.col("i")).alias("s"), hashes.fnv1a64(F.regexp_replace("i", r"^drafts\.", "")).alias("h"))
    got = [(r.s[:-4], r.h is None or r.s[-4:] == r.h[:4]) for r in df.collect()]
    assert got == [("director-s-aide-zurich-a-b-", True), ("x" * 30 + "-", True), ("z" * 80 + "-", True), ("job-", True)]
