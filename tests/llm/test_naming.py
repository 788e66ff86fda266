import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.llm import naming, queries


def by_loop(rows):
    """(doc_id, keep_id, group_size, sha) of rows (doc_id, text), by a dictionary of texts."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        same = groups[t or ""]
        out.append((i, max((x for x in same if x is not None), default=None), len(same), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def results(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()], key=str)


ROWS = [
    (1, None), (2, ""), (3, "a"), (4, "a"), (5, "aaaa"), (6, "aaaaaaaa"), (7, "aaaaaaab"), (8, "aaaaaaa"), (9, "é" * 9), (10, "é" * 9), (11, "x" * 20), (12, "x" * 20),
    (13, "x" * 19 + "y"), (14, "x" * 21), (15, " a"), (16, "A"), (17, "abcdabcd"), (18, "abcd"), (19, "abcdabcdabcd"), (20, "abcdabcdabcd"), (-1, "a"),
]


@pytest.mark.parametrize("block", [4, 512])
def test_groups_are_those_of_equal_texts(spark, block):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = naming.exact_duplicates(docs, block)
    assert results(got) == by_loop(ROWS)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got.collect())


@pytest.mark.parametrize("hashed", ["0L", "pmod(xxhash64(_block), 3)"])
def test_blocks_that_share_a_hash_keep_names_of_their_own(spark, hashed):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert results(naming.exact_duplicates(docs, 4, hashed)) == by_loop(ROWS)


def test_hot_and_rare_keys_are_both_found(spark, monkeypatch):
    """A third of the rows hold one text; with HOT of 3 hot blocks, pairs and groups go the short way and the others don't."""
    monkeypatch.setattr(naming, "HOT", 3)
    rows = [(i, "same text, " * 5 if i % 3 == 0 else f"text {i % 40} of its own") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert results(naming.exact_duplicates(docs, 8)) == by_loop(rows)


def test_odd_rows(spark):
    """Null and repeated doc_ids, repeated rows, clashing columns, no rows."""
    rows = [(None, "a", 1), (None, "a", 2), (3, "a", 3), (3, "a", 3), (3, "b", 4), (None, "c", 5), (None, "c", 5), (4, None, 6), (5, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int").withColumn("n", F.lit(1)).withColumn("kept", F.lit("x"))
    got = naming.exact_duplicates(docs)
    assert results(got) == by_loop([r[:2] for r in rows])
    kept = [r for r in got.collect() if r.kept]
    assert len(kept) == 4 and sorted(r.keep_id or 0 for r in kept) == [0, 3, 3, 5]
    assert naming.exact_duplicates(docs.limit(0)).collect() == []


def test_names_do_not_depend_on_how_rows_are_dealt(spark):
    rows = spark.createDataFrame([(i, t) for i, t in ROWS], "_row long, text string")
    for n in (1, 7):
        names = defaultdict(set)
        for r in naming.identities(rows.repartition(n), 4).collect():
            names[r._round, r._name].add(r._row)
        want = defaultdict(set)
        for i, t in ROWS:
            want[t or ""].add(i)
        assert sorted(map(sorted, names.values())) == sorted(map(sorted, want.values()))


def test_query_against_its_sql(spark, sf):
    got = queries.op11_exact_duplicates(spark, sf)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cursor = con.execute(naming.oracle())
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cursor.fetchall())


def test_main_path_has_no_python(spark, sf):
    plan = queries.op11_exact_duplicates(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
