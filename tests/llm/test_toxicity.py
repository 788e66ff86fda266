import itertools
import zlib

import numpy as np
import pytest

from tidewell.llm import queries, toxicity

OBFUSCATED = ["1d1ot", "idi0t", "st*pid", "i.d.i.o.t", "m0r0n", "l0s3r", "idiooot", "$tup1d", "tra5h", "d1sgu$ting", "stuuupid", "p@thetic", "sc_um", "IDIOT!!!"]


@pytest.fixture(scope="module")
def model(spark):
    sf = "/root/testdata/sf0.01"
    return toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


def test_obfuscated_words_are_restored(model):
    for word in OBFUSCATED:
        assert model.word(word.lower()) > 0, word
    clean = "the ing and that edor of to ananti, thonti er"
    marked = model.score([f"{clean} {w} {clean} {w}" for w in [*OBFUSCATED, "i d i o t", "s t u p 1 d"]])
    assert marked.min() > 0.5
    assert model.score([clean, None, "", "123 !!", "x y z", "?" * 5000]).max() < 0.5


def test_viterbi_finds_the_best_path(model):
    """Against all readings of the lattice."""
    channel, number = model.channel, toxicity.class_table()
    for word in ("1d1ot", "st*pid", "m00n", "$cu-m", "a@@b1"):
        runs = [(k, len(list(v))) for k, v in itertools.groupby(word)]
        options = [channel._options(s, n, i in (0, len(runs) - 1)) for i, (s, n) in enumerate(runs)]
        readings = {}
        for path in itertools.product(*options):
            text = "".join(x[0] for x in path)
            c = [0, 0, *(int(number[ord(x)]) for x in text), 0]
            total = sum(x[1] for x in path) + sum(float(channel.log[c[i], c[i + 1], c[i + 2]]) for i in range(len(c) - 2))
            readings[text] = max(readings.get(text, -1e9), total)
        assert readings[channel.restore(word)] == pytest.approx(max(readings.values()), abs=1e-3)


def test_trigrams_are_counted_over_all_words(spark):
    docs = spark.createDataFrame([("ab ab",), (None,), ("", ), ("ab\nc",)], "text string")
    got = {r.trigram: r.n for r in toxicity.trigram_counts(docs).collect()}
    n = toxicity.CLASSES
    assert got == {1: 3, 3: 1, 0 * n + 1 * n + 2: 3, 1 * n * n + 2 * n: 3, 3 * n: 1}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op4_toxicity(spark, sf).toPandas()
    assert list(out.columns) == ["doc_id", "held_out", "score", "predicted"] and len(out) == 1000
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    tested = out[out.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert (tested.predicted == tested.toxic).mean() > 0.93


def test_missing_values_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "text", 5), (7, "a " * 100_000, 5), (7, "4gain " + "1" * 3000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(7, 1, 0), (7, None, 0), (None, 0, 0)], "doc_id long, toxic int, text int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 5 and min(r.score for r in got) > 0.9
    assert max(r.score for r in toxicity.classify(docs, labels.limit(0)).collect()) < 0.1
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert np.isfinite([r.score for r in toxicity.classify(docs, spark.createDataFrame([(7, 1), (2, 0)], "doc_id long, toxic int")).collect()]).all()
