import datetime as dt

from pyspark.sql import functions as F

from tidewell.operators import jobs

NOW = dt.datetime(2026, 10, 26)
KNOWN = "job_id string, source_id string, status string, posted_at timestamp_ntz, expires_at timestamp_ntz, closed_at timestamp_ntz, key string, description string"
SEEN = "ord long, job_id string, source_id string, posted_at timestamp_ntz, expires_at timestamp_ntz, key string, description string"


def day(n):
    return NOW - dt.timedelta(days=n)


def run(spark, known, seen, read):
    after = jobs.lifecycle(spark.createDataFrame(known, KNOWN), spark.createDataFrame(seen, SEEN), F.lit(NOW).cast("timestamp_ntz"), read=spark.createDataFrame([(x,) for x in read], "source_id string"))
    return {r.job_id: (r.status, r.posted_at, r.description) for r in after.collect()}


def known(id, source="a", status="open", posted=5, key=None, closed=None, expires=None):
    return (id, source, status, day(posted), expires, closed, key or id, "text")


def test_a_board_without_roles_closes_all_of_its_own_and_an_unread_one_none(spark):
    got = run(spark, [known("1"), known("2", "b"), known("3", "c")], [], ["a", "b"])
    assert {i: s for i, (s, *_) in got.items()} == {"1": "closed", "2": "closed", "3": "open"} and got["1"][2] is None and got["3"][2] == "text"


def test_of_new_listings_with_one_key_the_first_stays(spark):
    seen = [(3, "x", "a", day(1), None, "k", "x"), (1, "y", "a", day(1), None, "k", "y"), (2, "z", "b", day(1), None, "k", "z"), (0, "w", "a", day(1), None, "other", "w"), (5, "w", "a", day(1), None, "other", "later")]
    got = run(spark, [], seen, ["a", "b"])
    assert {i: d for i, (_, _, d) in got.items()} == {"y": "y", "w": "w"}


def test_a_key_belongs_to_its_open_job_and_a_closed_one_may_come_back_before_it_is_taken(spark):
    held = [known("open", key="k"), known("shut", status="closed", key="c", closed=day(2)), known("shut2", status="closed", key="d", closed=day(2))]
    seen = [
        (0, "copy", "b", day(1), None, "k", "copy"), (1, "open", "a", day(1), None, "k", "open"),
        (2, "shut", "a", day(1), None, "c", "back"), (3, "new", "b", day(1), None, "c", "new"),  # comes back first, and doesn't take the key
        (4, "new2", "b", day(1), None, "d", "new2"), (5, "shut2", "a", day(1), None, "d", "late"),  # too late
    ]
    got = run(spark, held, seen, ["a", "b"])
    assert {i: s for i, (s, *_) in got.items()} == {"open": "open", "shut": "open", "new": "open", "new2": "open", "shut2": "closed"}


def test_days_of_posted_jobs(spark):
    """A board's job keeps its first day, one posted by hand takes that of its list; with an end it outlives the age limit."""
    held = [known("1", posted=40), known("m", "manual", posted=40)]
    seen = [(0, "1", "a", day(1), None, "1", "d"), (1, "m", "manual", day(2), None, "m", "d"), (2, "n", "manual", day(60), day(-5), "n", "d"), (3, "o", "manual", day(60), None, "o", "d")]
    got = run(spark, held, seen, ["a", "manual"])
    assert (got["1"][1], got["m"][1]) == (day(40), day(2)) and {i: s for i, (s, *_) in got.items()} == {"1": "open", "m": "open", "n": "open", "o": "expired"}
