import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell.functions import dates, text, url
from tidewell.operators import classify, forms, intake, jobs, lifecycle, matching, publish, views


def one(spark, column, *values, kinds=None):
    names = [f"x{i}" for i in range(len(values))]
    kinds = kinds or ["string"] * len(values)
    return spark.createDataFrame([values], ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))).select(column(*map(F.col, names))).first()[0]


def test_entities_and_initials(spark):
    assert sorted(one(spark, text.entities, "Blackstone’s $45m deal with ADQ in Dubai and IHC")) == ["adq", "blackstone", "ihc", "usd45m"]
    assert [one(spark, text.initials, n) for n in ("Gulf Horizon Asset Management (demo)", "Mubadala", "The Co", None)] == ["GH", "MU", "?", "?"]


def test_second_rule_of_similarity(spark):
    a, b = "Blackstone and ADQ agree logistics venture", "ADQ, Blackstone plan warehouses worth billions with logistics focus"
    got = spark.createDataFrame([(a, b)], "a string, b string").select(*matching.similarity((text.tokens(F.col("a")), text.entities(F.col("a"))), (text.tokens(F.col("b")), text.entities(F.col("b"))))).first()
    assert got[0] is True and got[1] > 0.5


def test_cleaning(spark):
    assert one(spark, text.clean, "  a​ ‮ b\tc \n") == "a b c"
    assert one(spark, lambda c: text.clean(c, True), "a\r\n\r\n\r\nb\t\tc ") == "a\n\nb c"
    assert one(spark, lambda c: text.cut_words(c, 8), "one two three") == "one two…"
    assert one(spark, text.clean_excerpt, "Body [...]") == "Body…" and one(spark, text.clean_excerpt, "Body. The post Some title appeared first on A Site.") == "Body."
    with pytest.raises(KeyError):
        text.template("{{a}} {{b}}", {"a": F.lit("x")})
    assert one(spark, lambda c: text.template("<h1>{{a}}</h1>", {"a": text.escape_html(c)}), "a<b") == "<h1>a&lt;b</h1>"


def test_days(spark):
    assert one(spark, dates.real_day, "2024-02-30") is None and one(spark, dates.real_day, "2024-02-29") == dt.date(2024, 2, 29)
    assert one(spark, dates.offset_ms, "-2d3h10m") == -(2 * 86_400_000 + 3 * 3_600_000 + 600_000)
    assert one(spark, lambda c: dates.past_day(c, F.lit("2024-01-01").cast("date")), "2024-01-02") is False


def test_phrases_of_one_kind_are_no_words_of_another(spark):
    kinds = classify.Taxonomy(capital={"family-offices": {"family office": 3}}, asset={"office": {"office": 3}}, geography={"global": {"global": 3}}, transaction={"sale": {"sold": 3}})
    docs = spark.createDataFrame([(1, "Family offices buy", ""), (2, "Office sold to family office", "global")], "id int, t string, b string")
    got = {r.id: r for r in classify.classify_taxonomy(docs, kinds, F.col("t"), F.col("b"), F.col("id") == 1).collect()}
    assert (got[1].capital_types, got[1].asset_classes, got[1].geography, got[1].priority, got[1].confidence) == (["family-offices"], [], ["uae"], 1, 0.6)
    assert (got[2].capital_types, got[2].asset_classes, got[2].geography, got[2].transaction_type, got[2].priority) == (["family-offices"], ["office"], ["global"], "sale", 5)


@pytest.mark.parametrize(
    "status, action, approver, reason, want",
    [
        ("pending_review", "approvePublish", True, None, "published"), ("pending_review", "approvePublish", False, None, None), ("approved", "schedule", True, None, "published"), ("published", "unpublish", False, None, "approved"),
        ("pending_review", "reject", False, "no", None), ("pending_review", "reject", False, "not for us", "rejected"), ("archived", "returnToReview", False, None, "pending_review"), (None, "archive", False, None, "archived"),
        ("published", "approve", True, None, None),
    ],
)
def test_review_actions(spark, status, action, approver, reason, want):
    step = lambda s, a, p, r: lifecycle.next_status(lifecycle.STORY_ACTIONS, s, a, p, r)
    assert one(spark, step, status, action, approver, reason, kinds=["string", "string", "boolean", "string"]) == want


def test_breaker_of_gone_sources(spark):
    rows = [("a", 1, True, True), ("b", 1, True, False), ("b", 2, True, False), ("c", 1, True, True), ("c", 2, False, False)]
    df = spark.createDataFrame([(k, dt.datetime(2024, 1, t), f, g) for k, t, f, g in rows], "k string, t timestamp, f boolean, g boolean")
    got = {r.k: (r.consecutive_failures, r.status, r.paused_until) for r in lifecycle.breaker(df, "k", "t", ["t"], F.col("f"), F.col("g"), most=3).collect()}
    assert got == {"a": (1, "not-found", dt.datetime(2024, 1, 8)), "b": (2, "error", None), "c": (0, "ok", None)}


def test_tables_with_versions(spark, tmp_path):
    path = f"{tmp_path}/jobs"
    publish.save(spark.createDataFrame([("a", 1), ("b", None)], "id string, n int"), path, 2)
    assert sorted(map(tuple, publish.load(spark, path, "id string, n int", 2, {"n": 7}).collect())) == [("a", 1), ("b", 7)]
    with pytest.raises(ValueError):
        publish.load(spark, path, "id string, n int", 1)


def test_envelope_is_ordered(spark):
    import json

    rows = spark.createDataFrame([(1, "x"), (3, None), (2, "y")], "id int, s string")
    got = json.loads(publish.envelope(rows, [F.desc("id")], "demo", "2024-01-01T00:00:00Z", "n", most=2).first().json)
    assert got["count"] == 2 and got["items"] == [{"id": 3, "s": None}, {"id": 2, "s": "y"}] and got["mode"] == "demo"
    assert json.loads(publish.envelope(rows.limit(0), [F.col("id")], "demo", "t", "n").first().json)["items"] == []


def test_pages_past_the_end_tell_the_total(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "id int")
    assert [tuple(r) for r in views.page(rows, [F.col("id")], 10, 3).collect()] == [(None, 5)]
    assert [tuple(r) for r in views.page(rows, [F.col("id")], 4, 3).collect()] == [(4, 5)]


def test_parameters():
    known = {"capital": ["reits", "banks"], "asset": ["office"], "geo": [], "section": ["homes"]}
    got = views.parse_query("?capital=reits,BAD!,banks,reits,none&asset=office&q=%20two%20%20words%20&sort=oldest&page=900&section=homes", known)
    assert got == {"capital": ["reits", "banks"], "asset": ["office"], "geo": [], "section": "homes", "q": "two words", "sort": "oldest", "page": 1}
    assert views.parse_query("", known)["page"] == 1
    rules = ({"limit": (1, 100, 20), "offset": (0, 10_000, 0)}, {"category": ["uae", "world"]}, {"topics": ["a", "b"]})
    assert views.checked({"limit": "5", "topics": "a,b"}, *rules) == {"limit": 5, "offset": 0, "category": None, "topics": ["a", "b"], "q": ""}
    for bad in ({"limit": "0"}, {"limit": "x"}, {"category": "eu"}, {"topics": "a,z"}, {"q": "x" * 101}, {"other": "1"}):
        with pytest.raises(ValueError):
            views.checked(bad, *rules)


def test_forms_that_must_be_whole(spark):
    rows = spark.createDataFrame([(1, {"email": "a@b.co", "placement": "home"}), (2, {"email": "bad", "placement": "home"})], "id int, payload map<string,string>")
    done = forms.validate(rows, forms.NEWSLETTER, F.lit("2024-01-01").cast("date"))
    assert {r.id: r.ok for r in done.collect()} == {1: True, 2: False}
    with pytest.raises(ValueError):
        forms.all_or_nothing(done)
    assert forms.all_or_nothing(done.filter("id = 1")).count() == 1
    number = forms.whole_number(1, 100)
    got = spark.createDataFrame([("1,0",), ("0",), ("101",), ("x",), (None,), ("99999999999999",)], "x string").select(*number(F.col("x"), F.lit(None))).collect()
    assert [r[0] for r in got] == [10, None, None, None, None, None] and [r[1] is None for r in got] == [True] + [False] * 5


def test_a_model_overlays_rules(spark):
    docs = spark.createDataFrame([(1, ["a"], ["x"], 0.9, "s"), (2, [], [], 0.9, None)], "id int, capital array<string>, asset array<string>, confidence double, summary string")
    more = spark.createDataFrame([(1, ["b"], [], 0.3, "")], "id int, capital array<string>, asset array<string>, confidence double, summary string")
    got = {r.id: (r.capital, r.asset, r.summary, r.needs_review) for r in intake.suggested(docs, more, ("capital", "asset")).collect()}
    assert got == {1: (["b"], ["x"], "s", True), 2: ([], [], None, True)}


def test_links_and_members(spark):
    items = spark.createDataFrame([("a", 1), ("b", 2)], "link string, n int")
    assert [r.n for r in intake.without_broken(items, spark.createDataFrame([("a", "broken"), ("b", "unknown")], "link string, status string")).collect()] == [2]
    one_ = (1, "a1", "T", "s", "g", dt.datetime(2024, 1, 1), [("a2", "", "s", "g", dt.datetime(2024, 1, 2)), ("a3", "U", "s", "g", dt.datetime(2024, 1, 3))])
    kind = "article_id string, title string, source_id string, guid string, published_at timestamp"
    stories = spark.createDataFrame([one_], f"id int, {kind}, others array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")
    assert [r.article_id for r in intake.members(stories).collect()] == ["a1", "a3"]


def test_picks_fall_back_to_the_automatic_order(spark):
    rows = spark.createDataFrame([(i, 10 - i) for i in range(5)], "id int, s int")
    assert [r.id for r in jobs.picked(rows, "id", [3, 1, 9], [F.desc("s")], 2).orderBy("rank").collect()] == [3, 1]
    assert [r.id for r in jobs.picked(rows, "id", [], [F.desc("s")], 2).orderBy("rank").collect()] == [0, 1]


def test_asset_addresses(spark):
    assert one(spark, lambda c: url.asset_url(c, "https://cdn"), "image-abc-10x20-png") == "https://cdn/abc-10x20.png" and one(spark, lambda c: url.asset_url(c, "x"), "file-a") is None


def test_submissions_without_an_address_are_no_copies_and_ties_have_an_order(spark):
    schema = "kind string, at timestamp_ntz, email string, n int"
    at = dt.datetime(2024, 1, 1)
    new = [("newsletter", at, None, 1), ("newsletter", at, None, 2), ("newsletter", at, "A@b.c", 3), ("newsletter", at + dt.timedelta(1), " a@B.c", 4), ("newsletter", at, "known@x.y", 5), ("contact", at, "a", 6), ("contact", at, "a", 7)]
    held = spark.createDataFrame([("newsletter", at, "KNOWN@x.y", 0)], schema)
    got = [sorted(r.n for r in publish.appended(held, spark.createDataFrame(new[::step], schema), 10).collect()) for step in (1, -1)]
    assert got == [[1, 2, 3, 6, 7]] * 2
    runs = spark.createDataFrame([(i, at) for i in range(6)], "n int, at timestamp_ntz")
    kept = [sorted(r.n for r in publish.history(runs.orderBy(o).repartition(2), runs.limit(0), "at", 3).collect()) for o in ("n", -runs.n)]
    assert kept[0] == kept[1] and len(kept[0]) == 3
