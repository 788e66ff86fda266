import random

import numpy as np

from tidewell.llm import decontam, queries


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_common_subsequence_against_the_table_method():
    rnd = np.random.default_rng(1)
    for _ in range(100):
        a, b = (rnd.integers(0, 6, rnd.integers(0, 30)) for _ in range(2))
        assert decontam.common_subsequence(a, b) == lcs(a.tolist(), b.tolist())


def test_passages_cover_texts_to_their_ends():
    texts = [np.arange(n, dtype=np.int32) for n in (0, 1, 32, 33, 64, 65, 200)]
    p = decontam.Passages([t.tobytes() for t in texts])
    ones = p.sums(np.eye(200, dtype=np.float32))
    for d, t in enumerate(texts):
        assert sorted({w for row in ones[p.doc == d] for w in np.flatnonzero(row)}) == t.tolist()
        assert (ones[p.doc == d].sum(1) <= decontam.WINDOW).all()
    passage, word = p.passages_of_words()
    dense = np.zeros_like(ones)
    np.add.at(dense, (passage, word), 1)
    assert (dense == ones).all()


def test_query_finds_all_copies_and_paraphrases(spark, sf, tmp_path):
    """Against every pair of a document and an item compared by longest common subsequence; and planted paraphrases."""
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rnd = random.Random(2)
    planted = {}
    for k, (item, text) in enumerate(items[:20]):
        words = text.split()
        for _ in range(len(words) // 8):  # one word in eight is another
            words[rnd.randrange(len(words))] = "other"
        host = docs[k][1].split()
        docs.append((10_000 + k, " ".join([*host[:70], *words, *host[70:]])))
        planted[10_000 + k] = item
    docs += [(-1, None), (-2, ""), (None, items[0][1]), (-3, "?!"), (-4, items[1][1].upper()), (-4, items[1][1])]
    spark.createDataFrame([(*d, 0, 0.0) for d in docs], "doc_id long, text string, at int, similarity double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*[(*i, 1) for i in items], (None, "no id", 1), (900, None, 1), (901, "", 1)], "item_id long, text string, covered int").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.covered for r in queries.op2_benchmark_leaks(spark, str(tmp_path)).collect()}
    assert planted.items() <= got.keys()
    assert (-4, items[1][0]) in got
    grams = {}
    for item, text in items:
        words = decontam.words_of(text)
        for i in range(len(words) - 7):
            grams.setdefault(tuple(words[i : i + 8]), set()).add(item)
    for doc, text in docs:
        words = decontam.words_of(text)
        shared = {}
        for i in range(len(words) - 7):
            for item in grams.get(tuple(words[i : i + 8]), ()):
                shared[item] = shared.get(item, 0) + 1
        for item, n in shared.items():
            if doc is not None and n >= 0.9 * (len(decontam.words_of(dict(items)[item])) - 7):
                assert (doc, item) in got
    clean = [k for k in got if k[0] < 10_000 and k[0] >= 0]
    assert all(got[k] > 0.9 for k in clean)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    assert decontam.matches(docs, items).count() == 1
    assert decontam.matches(docs.limit(0), items).count() == 0
    assert decontam.matches(docs, items.limit(0)).count() == 0


def test_whole_items_are_found_in_any_host(spark, sf):
    """Planted in hosts of one or two repeated words of the benchmark, and of another language."""
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    foreign = [t for t in (r.text.split() for r in docs.filter("lang <> 'en' and text is not null").collect()) if len(t) > 100]
    vocabulary = sorted({w for _, text in items for w in decontam.words_of(text)})
    rnd, planted, want = random.Random(4), [], set()
    for item, text in items:
        for host in ([rnd.choice(vocabulary)] * 300, rnd.sample(vocabulary, 2) * 150, rnd.choice(foreign)):
            at = rnd.randrange(len(host))
            want.add((10_000 + len(planted), item))
            planted.append((10_000 + len(planted), " ".join([*host[:at], text, *host[at:]])))
    got = decontam.matches(docs.drop("lang").unionByName(spark.createDataFrame(planted, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"))
    assert want <= {(r.doc_id, r.item_id) for r in got.collect()}


def test_index_of_rarest_words_against_sets(monkeypatch):
    rnd = np.random.default_rng(3)
    texts = [rnd.integers(-1, 40, n).astype(np.int32) for n in (0, 1, 31, 33, 64, 65, 96, 97, 300)]
    rarest = [set(rnd.choice(40, k, replace=False).tolist()) for k in (1, 2, 3, 4, 5, 5, 5)]
    p = decontam.Passages([t.tobytes() for t in texts])
    want = {}
    for i, (d, at) in enumerate(zip(p.doc, p.at, strict=True)):
        near = set(texts[d][max(0, at - decontam.STRIDE) : at + decontam.WINDOW + decontam.STRIDE].tolist())
        for j, r in enumerate(rarest):
            if len(r & near) >= decontam.ANSWER * len(r):
                want[i * len(rarest) + j] = r <= near
    for expanded in (1, 7, 1 << 20):
        monkeypatch.setattr(decontam, "EXPANDED", expanded)
        keys, every = decontam.Rarest(rarest, 40).answered(p)
        assert dict(zip(keys.tolist(), every.tolist(), strict=True)) == want and (np.diff(keys) > 0).all()


def test_holds_compares_whole_numbers():
    assert decontam.holds(np.array([7, 1, 2, 3], np.int32), np.array([2, 3], np.int32))
    assert not decontam.holds(np.array([1 << 8, 0], np.int32), np.array([1], np.int32))


def test_a_larger_benchmark_is_searched_for_in_blocks(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet").limit(60), spark.read.parquet(f"{sf}/benchmark.parquet")
    first = items.orderBy("item_id").first()
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000, first.text)], "doc_id long, text string"))
    parts = decontam.benchmark_parts(items)
    total = parts.agg({"words": "sum"}).first()[0]
    columns = ("doc_id", "item_id", "covered")
    whole = {tuple(r) for r in decontam.matches(docs, items).select(*columns).collect() if r.covered == 1}
    assert (10_000, first.item_id, 1.0) in whole
    monkeypatch.setattr(decontam, "BENCHMARK_WORDS", total * 2 // 3)
    blocks = decontam.in_blocks(parts, total).groupBy("block").agg({"words": "sum", "*": "count"}).collect()
    assert len(blocks) > 1 and all(r["sum(words)"] <= decontam.BENCHMARK_WORDS for r in blocks)
    assert sum(r["count(1)"] for r in blocks) == parts.count()
    assert whole <= {tuple(r) for r in decontam.matches(docs, items).select(*columns).collect()}
    monkeypatch.setattr(decontam, "TILE", 7)  # cosines are worked on by passages and parts
    monkeypatch.setattr(decontam, "BENCHMARK_WORDS", total)
    assert whole <= {tuple(r) for r in decontam.matches(docs, items).select(*columns).collect()}


def test_sums_and_frequencies_of_passages_are_those_of_a_plain_count():
    rnd = np.random.default_rng(4)
    texts = [rnd.integers(-1, 9, n).astype(np.int32) for n in (0, 1, 31, 32, 33, 64, 65, 200, 7)]
    p, table = decontam.Passages([t.tobytes() for t in texts]), rnd.normal(size=(9, 5)).astype(np.float32)
    sums, often = [], np.zeros(9, int)
    for t in texts:
        blocks = [t[i : i + decontam.STRIDE] for i in range(0, len(t), decontam.STRIDE)]
        for pair in [blocks[i : i + 2] for i in range(max(1, len(blocks) - 1))] if blocks else []:
            each = [set(b[b >= 0].tolist()) for b in pair]
            sums.append(sum((table[w] for e in each for w in e), np.zeros(5)))
            for w in set().union(*each):
                often[w] += 1
    assert np.allclose(p.sums(table), np.array(sums), atol=1e-4) and (p.frequencies(9) == often).all()
