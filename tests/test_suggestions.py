import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidewell.operators import classify, matching


def words(text):
    return [w for w in re.sub(r"[^\w\s]|_", " ", (text or "").lower()).split() if w]


def longest(a, b):
    a, b, best = words(a), words(b), 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


@pytest.mark.parametrize("least", [1, 3])
def test_runs_are_those_of_a_loop(spark, least):
    rnd = random.Random(3)
    text = lambda: " ".join(rnd.choice("a b c, d. É é-f".split(" ")) for _ in range(rnd.randrange(25)))
    rows = [(i, text(), text()) for i in range(60)] + [(100, None, "a"), (101, "the same, words", "THE same words"), (102, "a a a a", "a a"), (103, "", "")]
    got = {r.id: r.run for r in matching.longest_runs(spark.createDataFrame(rows, "id long, s string, t string"), "id", "s", "t", least).collect()}
    assert got == {i: n if (n := longest(s, t)) >= least else 0 for i, s, t in rows}


def test_suggestions(spark):
    head, excerpt = "Fund buys tower", "one two three four five six seven eight nine ten"
    base = lambda i, summary, conf, deal="sale", kinds=("a",): (i, head, excerpt, summary, deal, conf, list(kinds) if kinds is not None else None)
    rows = [
        base(1, "  A  summary of its\nown words ", "0.456"), base(2, "short", "2"), base(3, "x" * 281, "-1"), base(4, "so: one two three four five six seven eight", "nan"), base(5, "so: one two three four five six seven then", None),
        base(6, None, "0.5", "gift", ("b", "a", "zz", "a", None)), base(7, "Fund  BUYS tower!", "0.5", None, None),
    ]
    df = spark.createDataFrame(rows, "id long, headline string, excerpt string, summary string, transaction_type string, confidence string, kinds array<string>")
    df = df.withColumn("confidence", F.col("confidence").try_cast("double"))
    got = {r.id: (r.summary, r.transaction_type, r.confidence, r.kinds) for r in matching.clean_suggestions(df, {"kinds": ("a", "b"), "transaction_type": ("sale",)}).collect()}
    assert got == {
        1: ("A summary of its own words", "sale", 0.46, ["a"]), 2: (None, "sale", 1.0, ["a"]), 3: (None, "sale", 0.0, ["a"]), 4: (None, "sale", 0.0, ["a"]),
        5: ("so: one two three four five six seven then", "sale", 0.0, ["a"]), 6: (None, None, 0.5, ["b", "a"]), 7: (None, None, 0.5, []),
    }


def test_terms_of_other_scripts_empty_dimensions_and_phrases_that_share_words(spark):
    rules = classify.Taxonomy(capital={}, asset={"homes": {"عقارات": 2, "land": 2}}, geography={}, transaction={})
    df = spark.createDataFrame([(1, "today عقارات up", ""), (2, "no lands", "x"), (3, "", "")], "id long, t string, b string")
    got = {r.id: r for r in classify.classify_taxonomy(df, rules, F.col("t"), F.col("b"), F.lit(False)).collect()}
    assert [got[i].asset_classes for i in (1, 2, 3)] == [["homes"], ["homes"], []] and got[1].capital_types == [] and got[1].transaction_type is None
    row = spark.createDataFrame([("x a b c d", "p q r")], "s string, t string")
    assert row.select(classify.blanked(F.col("s"), ["x a b", "a b c d"])).first()[0].split() == ["x"]
    assert row.select(classify.blanked(F.col("t"), ["p q", "r"])).first()[0].split() == [] and not classify._meet(["p q", "r"]) and classify._meet(["the fund", "funds of"])


def test_query_against_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cursor = con.execute(__spark_entry__.oracle_sql()["longest_copies"])
    names = [d[0] for d in cursor.description]
    got = __spark_entry__.queries()["longest_copies"](spark, sf).select(*names)
    want = cursor.fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len({r[1] for r in want}) > 3
