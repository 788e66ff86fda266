import datetime as dt

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from tidewell.functions import dates, text, url
from tidewell.operators import lifecycle, matching, rules
from tidewell.operators.components import components
from tidewell.sources import feeds
from tidewell.streaming import limits

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries whose page lies past the end of the smallest tables.
LARGER = {"paged_search"}


def normal(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(__spark_entry__.catalogue.QUERIES))
def test_query_against_its_sql(spark, sf, name):
    sf = sf.replace("0.001", "0.01") if name in LARGER else sf
    df = __spark_entry__.queries()[name](spark, sf)
    got = sorted(repr(tuple(normal(r[c]) for c in sorted(df.columns))) for r in df.collect())
    assert got
    if sql := __spark_entry__.oracle_sql().get(name):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        want = sorted(repr(tuple(normal(dict(zip(names, r, strict=True))[c]) for c in sorted(names))) for r in cursor.fetchall())
        assert sorted(names) == sorted(df.columns) and got == want


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("http://www.Example.com/a/?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2"),
        ("https://m.example.com:443//x//index.html", "https://example.com/x"),
        ("https://user:pw@example.com/story/amp/", "https://example.com/story"),
        ("  HTTPS://example.com ", "https://example.com/"),
        ("ftp://example.com/a", None), ("not a link", None), ("", None), (None, None),
    ],
)
def test_canonical_urls(spark, raw, want):
    assert one(spark, url.canonical, raw) == want


@settings(max_examples=15, deadline=None)
@given(st.from_regex(r"https?://(www\.)?[a-z]{2,5}x\.com(/[a-z/]{0,6})?(\?[a-z=&]{0,8})?", fullmatch=True))
def test_canonical_is_idempotent(spark, raw):
    """For hosts of which stripping one prefix leaves no other."""
    once = one(spark, url.canonical, raw)
    assert one(spark, url.canonical, once) == once


def test_public_hosts(spark):
    rows = [("https://example.com/", True), ("http://127.0.0.1/x", False), ("http://10.1.2.3/", False), ("http://localhost/", False), ("http://172.20.0.1/", False), ("http://8.8.8.8/", True), (None, False)]
    got = spark.createDataFrame(rows, "u string, w boolean").select(url.is_public(F.col("u")), "w").collect()
    assert all(a == b for a, b in got)


def test_text_functions(spark):
    assert one(spark, text.html_to_text, "<p>A &amp; B</p><script>x</script>&#233;&#x41;&lt;b&gt;c<br>d &unknown; &#1;") == "A & B éA c d &unknown;"
    assert one(spark, text.normalise_title, "Café’s Ünïcode — 12%") == "cafes unicode 12"
    assert one(spark, lambda c: text.truncate(c, 20), "one two three four five six") == "one two three four…"
    assert one(spark, text.amounts, "$150 million and US$2.50bn, 3k; AED 45m") == ["usd150m", "usd2.5b", "3k", "aed45m"]
    assert one(spark, text.words, "Raises raised raising the funds") == ["rais", "fund"]
    assert one(spark, text.initials, "The Gulf Horizon (DIFC) Bank") == "GH"
    assert one(spark, lambda c: text.has_term(F.lower(c), "seed round"), "Two Seed Rounds closed") is True
    assert one(spark, text.clean_excerpt, "Body text. Read more »") == "Body text."


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Tue, 02 Jan 2024 03:04:05 GMT", dt.datetime(2024, 1, 2, 3, 4, 5)), ("2 Jan 2024 03:04 GST", dt.datetime(2024, 1, 1, 23, 4)), ("2024-01-02T03:04:05Z", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02", dt.datetime(2024, 1, 2)), ("Mon, 1 Jan 1980 00:00:00 GMT", None), ("soon", None), (None, None),
    ],
)
def test_dates(spark, raw, want):
    assert one(spark, dates.parse, raw) == want


def test_reasons_come_in_order(spark):
    q = rules.QualityRules(advertorial=rules.Filter(title_prefix=("sponsored",)), non_article=rules.Filter(url_segments=("video",)))
    rows = [("short", "https://a.com/", "missing-title"), ("a long enough title", "", "missing-link"), ("a long enough title", "nope", "invalid-link"), ("Sponsored: a long title", "https://a.com/video/1", "advertorial"), ("a long enough title", "https://a.com/Video/1", "not-an-article"), ("a long enough title", "https://a.com/videos", None)]
    got = spark.createDataFrame(rows, "t string, u string, w string").select(rules.reject_reason(q, F.col("t"), F.col("u")), "w").collect()
    assert all(a == b for a, b in got)


def test_merge_and_vanished(spark):
    old, new = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, s string, v int"), spark.createDataFrame([(2, None, 7), (3, "c", 8)], "k int, s string, v int")
    assert sorted(map(tuple, lifecycle.merge(old, new, ["k"]).collect())) == [(1, "a", 5, "old"), (2, "b", 7, "both"), (3, "c", 8, "new")]
    known, now = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "k int, src string"), spark.createDataFrame([(1, "x")], "k int, src string")
    assert [r.k for r in lifecycle.vanished(known, now, ["k"], "src").collect()] == [2]


def test_stories_are_those_of_one_fold_over_all(spark):
    import random

    import pandas as pd

    rnd = random.Random(5)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(2000)), sorted({rnd.choice("abcdefghij") for _ in range(4)})) for i in range(120)]
    got = {r.id: r.story for r in matching.stories(spark.createDataFrame(rows, "id long, at timestamp, tokens array<string>"), "at", 0.6, 10).collect()}
    whole = matching.fold_stories(0.6, 10)(pd.DataFrame(rows, columns=["id", "at", "tokens"]))
    assert got == dict(zip(whole["id"], whole["story"], strict=True))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 40), (41, 100)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 41: 40, 100: 40}


RSS = """<?xml version="1.0"?><!DOCTYPE rss><rss version="2.0" xmlns:dc="http://d"><channel><title>C</title><item><title>A &amp;amp; B</title><link>https://a.com/1</link><guid isPermaLink="false">g1</guid>
<pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><category>x</category><category> y </category></item><item><title>Second</title><guid>https://a.com/2</guid><dc:date>2024-01-03T00:00:00Z</dc:date></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>E</title><link rel="self" href="https://b.com/self"/><link href="https://b.com/1"/><id>i1</id><updated>2024-02-01T00:00:00Z</updated></entry></feed>"""


def test_feeds(spark):
    df = spark.createDataFrame([("r", RSS), ("a", ATOM), ("n", "<html/>"), ("z", None)], "source string, xml string")
    got = {(r.source, r.ord): r for r in feeds.items(df).collect()}
    assert set(got) == {("r", 0), ("r", 1), ("a", 0)}
    assert got["r", 0].title == "A & B" and got["r", 0].guid == "g1" and got["r", 0].categories == ["x", "y"] and got["r", 0].published_at == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got["r", 1].link is None and got["r", 1].guid == "https://a.com/2" and got["a", 0].link == "https://b.com/1"
    assert {r.source for r in feeds.rejected(df).collect()} == {"n", "z"}
    jobs = spark.createDataFrame([('[{"id":"1","text":"Analyst","hostedUrl":"u","createdAt":1704067200000,"categories":{"location":"Dubai","team":"PE"}}]',)], "json string")
    assert feeds.lever(jobs).first()["posted_at"] == dt.datetime(2024, 1, 1)


def test_bucket_in_batch_and_as_a_stream(spark, tmp_path):
    rows = [(i, i % 2, dt.datetime(2024, 1, 1, 0, 0, i * 4)) for i in range(12)]
    events = spark.createDataFrame(rows, "event_id long, user_id int, ts timestamp")
    want = {r.id: r.ok for r in limits.limited(events, "user_id", "ts", "event_id", 2, 0.05).collect()}
    assert sum(want.values()) == 8 and want[0] and not want[4]
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = limits.limited_stream(stream, "user_id", "ts", "event_id", 2, 0.05).writeStream.format("memory").queryName("bucket").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.id: r.ok for r in spark.table("bucket").collect()} == want
    state = None
    for k, failed in enumerate([True, True, False, True, True, True]):
        state = limits.record(state, float(k), failed, False, most=3)
    assert state[0] == 3 and state[1] > 5


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
