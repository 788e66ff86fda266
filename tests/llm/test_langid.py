import zlib

import numpy as np

from tidewell.llm import langid, queries


def test_held_out_accuracy(spark):
    out = queries.op8_language(spark, "/root/testdata/sf0.01").toPandas()
    assert list(out.columns) == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = out.merge(docs, on="doc_id")
    assert len(out) == len(docs) and both.score.between(0, 1).all()
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    tested = both[both.held_out]
    assert (tested.lang == tested.lang_pred).mean() > 0.97


def test_filters_hold_what_they_learned_and_counts_are_corrected():
    texts = ["the quick brown fox", "der schnelle braune fuchs"]
    masks = np.zeros(langid.SLOTS, np.uint64)
    for i, text in enumerate(texts):
        for at in langid.slots(langid.grams([text])[0]):
            masks[at] |= np.uint64(1 << i)
    model = langid.Model(["en", "de"], masks, 1)
    names, score = model.predict([*texts, None, "", "12 !", "xyzzy", "THE Quick 12 brown\nfox"])
    assert names == ["en", "de", "und", "und", "und", "de", "en"]
    assert score[:2].min() > 0.9 and score[2:6].tolist() == [0, 0, 0, 0]


def test_grams_do_not_cross_texts():
    together = langid.grams(["alpha beta", None, "gamma"])
    apart = [langid.grams([t])[0] for t in ("alpha beta", None, "gamma")]
    assert (together[0] == np.concatenate(apart)).all()
    assert together[1].tolist() == [len(a) for a in apart] and together[2].tolist() == [True, False, True]


def test_missing_values_and_empty_tables(spark):
    rows = [(1, None, "en", 1), (2, "", None, 2), (None, "words without an id", "en", 3), (4, "some words here and there", "en", 4), (4, "some words here and there", "en", 4), (6, "x" * 200_000, "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = langid.identify(docs).collect()
    assert len(got) == 6 and {r.lang_pred for r in got} <= {"en", "und"}
    assert [r.lang_pred for r in got if r.doc_id in (1, 2)] == ["und", "und"]
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).replace("", None, ["lang"])).collect()} == {"und"}


def test_more_languages_than_a_word_has_bits(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    # language i has words of its own: runs of two letters that no other language pairs
    pairs = [(x, y) for n, x in enumerate(letters) for y in letters[n + 1 :]][:150]
    rows = [(k * 200 + i, f"{x}{y}{x}{y} {y}{x}{y}{x} " * 5, f"l{i:03}") for i, (x, y) in enumerate(pairs) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert len(model.languages) == 150 and model.masks.shape == (3, langid.SLOTS)
    names, score = model.predict([r[1] for r in rows])
    assert names == [r[2] for r in rows] and score.min() > 0.9


def test_the_table_grows_with_its_ngrams():
    assert langid.table_size(10) == langid.SLOTS and langid.table_size(10**9) == langid.LARGEST
    assert langid.table_size(langid.SLOTS) > 4 * langid.SLOTS
    hashed = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for size in (langid.SLOTS, langid.LARGEST):
        assert all(at.max() < size and len(np.unique(at)) > 900 for at in langid.slots(hashed, size))


def test_rows_without_an_id_are_not_learned(spark):
    docs = spark.createDataFrame([(None, "some words here", "aa"), (1, "other words there", "bb")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.held_out, r.lang_pred) for r in langid.identify(docs).collect()}
    assert got == {None: (False, "bb"), 1: (zlib.crc32(b"1") % 5 == 0, "bb")}
