from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_minhash import brute
from tidewell.llm import minhash


def test_stages_on_each_others_results(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs, sizes = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
        if name != "tokenise":
            assert docs.dtypes == before.dtypes
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").isEmpty()
        if name == "deduplicate":
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in brute(rows, 5, 80).items() if i == c}
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 50
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/quality").join(labels, "doc_id")
    assert kept.filter("quality = 1").count() >= 0.9 * labels.filter("quality = 1").count()


def test_missing_and_repeated_ids_through_all_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    passed = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        passed = stage(spark, passed, sf)
    groups = minhash.near_duplicates(docs, 5, 80, 4).groupBy("component_id").count().filter("count = 1")
    alone = passed.join(groups, passed.doc_id == groups.component_id, "left_semi")  # no near copies of them are left behind
    a, b, c, d, e, f = [r.asDict() for r in alone.filter("length(text) > 500").orderBy("doc_id").limit(6).collect()]
    leak = lambda r: r["text"] + " " + item
    extra = [
        {**b, "doc_id": a["doc_id"]},  # another text under a's id
        {**c, "doc_id": None}, {**c, "doc_id": None},  # copies, none with an id
        {**d, "doc_id": None, "text": d["text"]},  # a copy of d
        {**e, "doc_id": None, "text": leak(e)},
        {**a, "doc_id": f["doc_id"], "text": leak(b)},
    ]
    gone = [b["doc_id"], c["doc_id"], e["doc_id"]]
    rows = docs.filter(~docs.doc_id.isin(gone)).unionByName(spark.createDataFrame(extra, docs.schema))
    marked = {(r["doc_id"], r["text"]) for r in extra} | {(r["doc_id"], r["text"]) for r in (a, d, f)}
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, sf).write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        found[name] = sorted([(r.doc_id, r.text) for r in rows.collect() if (r.doc_id, r.text) in marked], key=str) if name != "tokenise" else rows.count()
        if name == "decontaminate":
            left = rows.count()
    everything = sorted([*((r["doc_id"], r["text"]) for r in extra), *((r["doc_id"], r["text"]) for r in (a, d, f))], key=str)
    assert found["language"] == found["quality"] == everything
    clean = [(a["doc_id"], a["text"]), (a["doc_id"], b["text"]), (None, c["text"]), (d["doc_id"], d["text"]), (f["doc_id"], f["text"])]
    assert set(clean) <= set(found["deduplicate"]) and len(found["deduplicate"]) == len(set(found["deduplicate"]))
    assert (None, d["text"]) not in found["deduplicate"]
    assert found["decontaminate"] == sorted(clean, key=str)
    assert found["tokenise"] == left


def test_extra_columns_keep_their_names_and_values(spark):
    """Columns that are named like what operators add, of a kind that can't be ordered, and no rows at all."""
    sf = "/root/testdata/sf0.001"
    own = {"score": F.lit("s"), "lang_pred": F.lit(1), "predicted": F.col("doc_id"), "_row": F.lit(7), "label": F.create_map(F.lit("k"), F.col("doc_id")), "held_out": F.lit(None).cast("string")}
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns(own)
    for _, stage in corpus_pipeline.STAGES[:4]:
        for rows in (docs, docs.limit(0)) if stage is not corpus_pipeline.quality else (docs,):
            got = stage(spark, rows, sf)
            assert got.dtypes == docs.dtypes
            assert all(r.predicted == r.doc_id == r.label["k"] and (r.score, r.lang_pred, r["_row"]) == ("s", 1, 7) for r in got.collect())
