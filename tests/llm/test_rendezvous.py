import hashlib
import math
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.llm import queries, rendezvous


def chosen(key, weights):
    """The shard of a key, by a plain loop over shards."""
    text, best = "null" if key is None else str(key), None
    for s, w in enumerate(weights):
        u = (int(hashlib.md5(f"{text}/{s}".encode()).hexdigest()[: rendezvous.DIGITS], 16) + 0.5) / 16**rendezvous.DIGITS
        score = (w / -math.log(u), -s)
        best = max(best, (score, s)) if best else (score, s)
    return best[1]


@pytest.mark.parametrize("weights", [[1.0], [1.0, 1.0], [1.0, 3.0, 0.5]])
def test_shards_are_those_of_a_loop(spark, weights):
    keys = [None, -1, *range(300)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", rendezvous.choose(F.col("k"), weights)).collect()
    assert {r[0]: r[1] for r in got} == {k: chosen(k, weights) for k in keys}


def test_only_the_new_shard_takes_rows_and_only_the_removed_one_gives(spark):
    weights = [1.0, 2.0, 1.0, 4.0]
    rows = spark.range(4000).select("id", rendezvous.choose(F.col("id"), weights).alias("a"), rendezvous.choose(F.col("id"), [*weights, 2.0]).alias("b"), rendezvous.choose(F.col("id"), weights[:-1]).alias("c")).collect()
    assert all(r.b in (r.a, 4) for r in rows) and all(r.c == r.a for r in rows if r.a != 3)
    shares = [sum(r.a == s for r in rows) / len(rows) for s in range(4)]
    assert all(abs(share - w / 8) < 0.04 for share, w in zip(shares, weights, strict=True))
    assert abs(sum(r.b == 4 for r in rows) / len(rows) - 0.2) < 0.04


@pytest.mark.parametrize("weights", [[], [1.0, 0.0], [1.0, -1.0]])
def test_weights_must_be_positive(spark, weights):
    with pytest.raises(ValueError):
        rendezvous.choose(F.lit(1), weights)


def test_odd_rows(spark):
    """Nulls, repeated rows, empty and long texts, columns that are named like results, no rows at all."""
    long = "wörter " * 50_000
    rows = [(None, None, "x", 9), (None, "a", "x", 9), (3, "", "x", 9), (3, long, "x", 9), (3, long, "x", 9), (4, "é", "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    got = rendezvous.shard_documents(docs).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, *_ in rows if i)
    assert sorted((r.size, r.text_crc32) for r in got if r.doc_id is None) == [(1, 0), (2, zlib.crc32(b"a"))]
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 16) and r.law == "key" for r in got) and len({r.shard for r in got if r.doc_id == 3}) == 1
    assert rendezvous.shard_documents(docs.limit(0)).collect() == []


def test_query_against_its_sql(spark, sf):
    got = queries.op9_rendezvous_shards(spark, sf)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cursor = con.execute(rendezvous.oracle())
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cursor.fetchall())


def test_main_path_has_no_python(spark, sf):
    plan = queries.op9_rendezvous_shards(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
