"""What shows only in larger tables or at the edges of units, each against its SQL on a few rows made for it."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from tidewell.operators import matching

CAREERS = ("job_gate", "posted_listings", "careers_lists", "job_actions")


def against_sql(spark, folder, name):
    con = duckdb.connect()
    for file in folder.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    rows = __spark_entry__.queries()[name](spark, str(folder)).select(*names).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(cursor.fetchall(), key=str) and rows


@pytest.fixture(scope="module")
def careers(tmp_path_factory, sf):
    """Parts whose keys of seven digits begin with others' six, and suppliers."""
    at = tmp_path_factory.mktemp("careers")
    con = duckdb.connect()
    keys = ", ".join(str(k) for k in (*range(100_000, 100_040), *range(1_000_000, 1_000_040), 1_000_400, 1_000_419))
    con.execute(f"copy (select k as p_partkey, p.* exclude p_partkey from unnest([{keys}]) t(k) join '{sf}/part.parquet' p on p.p_partkey = k % 200) to '{at}/part.parquet'")
    con.execute(f"copy (select * from '{sf}/supplier.parquet') to '{at}/supplier.parquet'")
    return at


@pytest.mark.parametrize("name", CAREERS)
def test_keys_of_seven_digits(spark, careers, name):
    against_sql(spark, careers, name)


@pytest.mark.parametrize("name", CAREERS)
def test_plans_stay_small(spark, sf, name):
    """Each text of a posting is hashed at once, not unit by unit in lambdas; no condition is written out into what it is made of, time and again."""
    plan = __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 400_000 and "aggregate(" not in plan


def test_ages_are_of_whole_seconds(spark, tmp_path):
    import datetime as d

    times = [d.datetime(2024, 3, 6, 12, 0, 0, 500_000), d.datetime(2024, 3, 6, 12, 0, 1), d.datetime(2024, 1, 20, 12, 0, 0, 1), d.datetime(2024, 4, 1)]
    pq.write_table(pa.table({"event_id": range(len(times)), "ts": pa.array(times, pa.timestamp("us"))}), tmp_path / "events.parquet")
    against_sql(spark, tmp_path, "posted_ago")


@pytest.mark.parametrize("threshold", [0.5, 0.07, 0.8])
def test_similar_sets_are_judged_where_they_meet(spark, threshold):
    """All pairs by brute force; no candidates are sorted out by a shuffle of their own, and none is joined with its tokens again."""
    rnd = random.Random(3)
    sets = {frozenset(rnd.choices("abcdefghijklmnopqrst", [20 - i for i in range(20)], k=rnd.randrange(1, 12))) for _ in range(70)}
    sets |= {frozenset(f"x{i}" for i in range(100)), frozenset(f"x{i}" for i in range(93, 100))}
    rows = list(enumerate(map(sorted, sets)))
    found = matching.similar_pairs(spark.createDataFrame(rows + [(1000 + i, t) for i, t in rows], "id long, tokens array<string>"), threshold)
    want = {(a, b, len({*x} & {*y}) / len({*x} | {*y})) for a, x in rows for b, y in rows if a < b and len({*x} & {*y}) / len({*x} | {*y}) >= threshold}
    got = list(map(tuple, found.collect()))
    assert len(got) == len(want) and set(got) == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 3


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_only_runs_that_a_source_has_are_shuffled(spark, tmp_path, broadcast):
    words = [f"w{i}" for i in range(40)]
    docs = [" ".join(words), " ".join(words[:20] * 3), " ".join(words[5:12]), None, "", " ".join(f"X{i}" for i in range(5000)), "Ä " + ", ".join(words[30:38])]
    sources = [" ".join(words[:15] * 2), " ".join(words[28:]), " ".join(words[:7]), None]
    for name, key, texts in (("documents", "doc_id", [*docs, docs[0]]), ("benchmark", "item_id", sources)):
        pq.write_table(pa.table({key: range(len(texts)), "text": pa.array(texts, pa.string())}), tmp_path / f"{name}.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        against_sql(spark, tmp_path, "copied_run_8gram")
        plan = __spark_entry__.queries()["copied_run_8gram"](spark, str(tmp_path))._jdf.queryExecution()
        assert "Aggregate" not in plan.optimizedPlan().toString().partition("Join")[2]
        assert ("BroadcastHashJoin" in plan.sparkPlan().toString()) == (broadcast != "-1")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bodies_are_made_once(spark, tmp_path):
    """No filter inferred from the exploding of blocks makes them, and sends texts through Python, again; odd characters as the SQL has them."""
    texts = ["a\x01bc \x02\x02 c\td​e f  ggggg hhhhhhh  ", "", None, " \n\nx\n yy zzz", "é " * 5 + "\n" + "word " * 300 + "\n" * 12 + "end", "w" * 420 + " " + "v" * 840 + " u"]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    against_sql(spark, tmp_path, "page_bodies")
    plan = __spark_entry__.queries()["page_bodies"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_squeezed(") == 1


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_large_similar_sets(spark, threshold):
    """Sets of hundreds of tokens, more than there are marks, their halves and their near copies; no condition of the join needs the tokens themselves."""
    rnd = random.Random(7)
    words, sets = [f"t{i}" for i in range(900)], []
    for size in (1, 2, 3, 20, 70, 150, 300, 700):
        for _ in range(4):
            some = rnd.sample(words, size)
            sets += [some, some[: size // 2], some[size // 3 :], *[rnd.sample(some, size - size // k) + rnd.sample(words, size // k) for k in (3, 5, 9)]]
    sets = {frozenset(s) for s in sets if s}
    rows = list(enumerate(map(sorted, sets)))
    found = matching.similar_pairs(spark.createDataFrame(rows, "id long, tokens array<string>"), threshold)
    want = {(a, b, len({*x} & {*y}) / len({*x} | {*y})) for a, x in rows for b, y in rows if a < b and len({*x} & {*y}) / len({*x} | {*y}) >= threshold}
    got = list(map(tuple, found.collect()))
    assert len(got) == len(want) and set(got) == want and len(want) > 20
    condition = next(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x)
    assert "bit_count" in condition and "array" not in condition


def test_titles_are_read_once(spark, sf):
    """Neither by lambdas, nor again for the filter on their tokens."""
    plan = __spark_entry__.queries()["token_sets"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ies") == 1 and "isin" not in plan and " IN (" not in plan and "INSET" not in plan


def test_stories_are_folded_by_no_task(spark):
    """One chain of likeness through all items is one fold's work no more; ids below 0, equal times, items without tokens or time."""
    import datetime as dt

    import pandas as pd

    rnd = random.Random(11)
    rows = [(i - 40, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(300)), sorted({"hot", *rnd.choices("abcd", k=rnd.randrange(3))}) if i % 9 else []) for i in range(80)]
    found = matching.stories(spark.createDataFrame([*rows, (99, None, ["hot"])], "id long, at timestamp, tokens array<string>"), "at", 0.5, 5)
    whole = matching.fold_stories(0.5, 5)(pd.DataFrame(rows, columns=["id", "at", "tokens"]))
    assert {r.id: r.story for r in found.collect()} == dict(zip(whole["id"], whole["story"], strict=True))
    assert "InPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
