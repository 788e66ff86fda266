import zlib

import numpy as np

from tidewell.llm import bytecnn, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op6_quality(spark, sf).toPandas()
    assert list(out.columns) == ["doc_id", "held_out", "score", "predicted"] and len(out) == 1000
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    tested = out[out.held_out].merge(labels, on="doc_id")
    assert (tested.predicted == tested.quality).mean() > 0.93


def test_gradients_are_those_of_the_loss():
    net = bytecnn.Network.new(3)
    texts, y = [b"some words " * 90, b"x", b"", b"other text!!"], np.array([1, 0, 1, 0], np.float32)

    def loss():
        p = net.score(texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = net._step(texts, y)
    rnd = np.random.default_rng(0)
    for name in ("filters", "weights", "offsets", "embedding"):
        array = getattr(net, name)
        along = rnd.normal(0, 1, array.shape) * (np.abs(grads[name]) > 0)
        kept, h, values = array.copy(), 1e-3, []
        for sign in (1, -1):
            setattr(net, name, (kept + sign * h * along).astype(np.float32))
            values.append(loss())
        setattr(net, name, kept)
        assert abs((values[0] - values[1]) / (2 * h) - (grads[name] * along).sum()) < 2e-2 * max(1, abs((grads[name] * along).sum())), name


def test_every_byte_is_seen_and_neighbours_do_not_matter():
    net = bytecnn.Network.new(1)
    net.embedding[255] = 9 * np.sign(net.filters.sum(1)[:8])
    long = bytes(np.random.default_rng(2).integers(97, 105, 5000, np.uint8))
    alone = net.score([long])[0]
    assert np.allclose(net.score([b"abc", long, b"", b"z" * 700, long])[[1, 4]], alone, atol=1e-6)
    plain = np.array([net._features(net._pool(*net._chunks([t])[:3], False)[0], net._chunks([t])[3]) for t in (long, long[:-1] + b"\xff", b"\xff" + long[1:])])
    assert (plain[1] != plain[0]).any() and (plain[2] != plain[0]).any()


def test_missing_values_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "text", 5), (7, "a" * 100_000, 5), (7, "again", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(7, 1, 0), (7, None, 0), (None, 0, 0)], "doc_id long, quality int, text int")
    got = bytecnn.classify(docs, labels).collect()
    assert len(got) == 5 and {r.score for r in got} == {1.0}
    assert {r.score for r in bytecnn.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert bytecnn.classify(docs.limit(0), labels).count() == 0
