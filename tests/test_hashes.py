import hashlib
import hmac
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidewell.functions import hashes


def fnv(text):
    h = 0xCBF29CE484222325
    data = text.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[i : i + 2])) * 0x100000001B3) & (2**64 - 1)
    return f"{h:016x}"


def test_fnv(spark):
    """The empty text and "a" as the algorithm's authors give them; others by a plain loop."""
    rnd = random.Random(1)
    texts = ["", "a", "foobar", "é", "日本語", "😀", "x" * 3000, "\x00", *["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x400, 0x500), 0x1F600])) for _ in range(rnd.randrange(60))) for _ in range(30)]]
    got = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashes.fnv1a64(F.col("t")).alias("h")).collect()}
    assert got == {t: fnv(t) for t in texts}
    assert (got[""], got["a"]) == ("cbf29ce484222325", "af63dc4c8601ec8c")
    assert spark.range(1).select(hashes.fnv1a64(F.lit(None).cast("string"))).first()[0] is None


def test_json_text(spark):
    texts = ["", "plain", 'a "quoted" \\ one', "tab\tline\nfeed\r\x0c\x08", "\x00\x01\x1f", "é 😀  ", "\\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(hashes.json_text(F.col("t")), hashes.json_list(F.array("t", "t"))).collect()
    assert [r[0] for r in rows] == [json.dumps(t, ensure_ascii=False) for t in texts]
    assert [r[1] for r in rows] == [json.dumps([t, t], ensure_ascii=False, separators=(",", ":")) for t in texts]


STORY = (
    "headline string, slug string, summary string, summary_source string, capital_types array<string>, asset_classes array<string>, geography array<string>, transaction_type string, featured boolean, "
    "image struct<asset:string,credit:string,rights_confirmed:boolean>, seo struct<title:string,description:string>, duplicate_of string, published_at timestamp_ntz"
)


def test_story_content_and_hash(spark):
    import datetime as dt

    full = (" Head ", "slug", "Sum \"m\"", " editor ", ["capitalType-b", None, "capitalType-a", ""], ["x"], ["uae", "asia"], "sale", True, ("img", " Credit ", True), ("T", None), "queue.a_1", dt.datetime(2026, 10, 1, 2, 3, 4, 5000))
    bare = (None,) * 13
    rows = spark.createDataFrame([full, bare, ("Head", *full[1:])], STORY).select(hashes.story_content().alias("c"), hashes.approval_hash().alias("h")).collect()
    want = [
        {"headline": "Head", "slug": "slug", "summary": 'Sum "m"', "summarySource": "editor", "capitalTypes": ["capitalType-a", "capitalType-b"], "assetClasses": ["x"], "geography": ["asia", "uae"], "transactionType": "sale",
         "featured": True, "image": {"asset": "img", "credit": "Credit", "rightsConfirmed": True}, "seo": {"title": "T", "description": ""}, "duplicateOf": "queue.a_1", "publishedAt": "2026-10-01T02:03:04.005Z"},
        {"headline": "", "slug": "", "summary": "", "summarySource": None, "capitalTypes": [], "assetClasses": [], "geography": [], "transactionType": None, "featured": False, "image": None,
         "seo": {"title": "", "description": ""}, "duplicateOf": None, "publishedAt": None},
    ]
    texts = [json.dumps(w, separators=(",", ":"), ensure_ascii=False) for w in want]
    assert [r.c for r in rows] == [*texts, texts[0]]  # blanks at the ends and the references' order change nothing
    assert [r.h for r in rows] == [fnv(t) for t in [*texts, texts[0]]]


def test_job_content(spark):
    schema = (
        "title string, slug string, company string, employer string, company_url string, location string, work_mode string, employment_type string, seniority string, department string, regulator string, url string, "
        "salary_from int, salary_to int, salary_currency string, salary_period string, visa string, description string, requirements array<string>, expires_at timestamp_ntz"
    )
    row = ("Analyst", "a", "Co", "employer-1", "", "DIFC", "Hybrid", None, None, " ", None, "https://x", 10, None, "AED", "month", "yes", "d", [" one ", "", None, "two"], None)
    got = json.loads(spark.createDataFrame([row], schema).select(hashes.job_content()).first()[0])
    assert (got["salaryFrom"], got["salaryTo"], got["requirements"], got["department"], got["companyUrl"], got["employer"], got["expiresAt"]) == (10, None, ["one", "two"], None, None, "employer-1", None)
    assert list(got)[:3] == ["title", "slug", "company"] and len(got) == 20
    assert spark.createDataFrame([row], schema).select(hashes.job_approval_hash()).first()[0] == fnv(json.dumps(got, separators=(",", ":")))


@pytest.mark.parametrize("size", [0, 1, 20, 63, 64, 65, 200])
def test_hmac(spark, size):
    key = bytes(i * 7 % 256 for i in range(size))
    messages = [b"", b"what do ya want for nothing?", bytes(range(256))]
    rows = spark.createDataFrame([(key, m) for m in messages], "k binary, m binary").select(hashes.hmac_sha256(F.col("k"), F.col("m"))).collect()
    assert [r[0] for r in rows] == [hmac.new(key, m, hashlib.sha256).hexdigest() for m in messages]


def test_addresses(spark):
    rows = spark.createDataFrame([("10.0.0.1",), ("",), (None,), ("unknown",)], "ip string").select(hashes.hashed_address(F.col("ip"), F.lit("salt"))).collect()
    want = lambda ip: hmac.new(b"salt", ip.encode(), hashlib.sha256).hexdigest()[:32]
    assert [r[0] for r in rows] == [want("10.0.0.1"), *[want("unknown")] * 3]


@pytest.mark.parametrize("name", ["approval_hashes", "visitor_hashes"])
def test_queries_against_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "events", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    got = __spark_entry__.queries()[name](spark, sf).select(*names)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(cursor.fetchall(), key=str)
    assert "Python" not in plan and "Arrow" not in plan
