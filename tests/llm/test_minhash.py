import random
import re

import numpy as np
import pytest

from tidewell.llm import minhash
from tidewell.operators.components import components


def brute(rows, words, percent):
    """doc_id -> (set size, component), all pairs compared."""
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 3)))
    rows, i = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "two one"), (7, "É é"), (8, "é É"), (9, "one two three"), (10, "one two")], 11
    for _ in range(25):
        text = [word() for _ in range(rnd.choice([5, 8, 12, 40, 200]))]
        for _ in range(rnd.randint(1, 12)):  # a chain of edits: links whose ends aren't similar
            rows.append((i, rnd.choice([" ", "\n", "  "]).join(text)))
            i += 1
            if rnd.random() < 0.8:
                text = list(text)
                text[rnd.randrange(len(text))] = word()
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("words, percent, rows", [(3, 85, 5), (5, 80, 4)])
def test_components_are_those_of_all_pairs(spark, words, percent, rows):
    data = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in data], "doc_id long, text string, component string, label int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, words, percent, rows).collect()}
    assert got == brute(data, words, percent)


def test_repeated_rows_and_missing_ids(spark):
    text = "the same words " * 9
    docs = spark.createDataFrame([(5, text), (5, text), (3, text + "x"), (None, text), (9, text), (5, "quite other words"), (None, "alone"), (None, None)], "doc_id long, text string")
    got = sorted(minhash.near_duplicates(docs, 3, 60, 4).select("doc_id", "component_id", "kept").collect(), key=str)
    want = [(3, 3, True), (5, 3, False), (5, 3, False), (5, 5, True), (9, 3, False), (None, 3, False), (None, None, True), (None, None, True)]
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(r).replace("(", "Row("))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_densified_bins_estimate_similarity():
    rnd = np.random.default_rng(5)
    agree = []
    for _ in range(200):
        both = rnd.integers(0, 2**63, 9, np.uint64)
        a, b = np.unique(both[:8]), np.unique(both[1:])
        keys = minhash.band_keys([a, b], 1)
        agree.append((keys[0] == keys[1]).mean())
    assert abs(np.mean(agree) - 7 / 9) < 0.02


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(200, 200), (7, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "x long, y long")).collect())
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in range(1, 60)}}


@pytest.mark.parametrize("few", [2, 64])
def test_a_group_of_copies_with_few_and_many_edits(spark, monkeypatch, few):
    """Versions of one text, each with copies of its own, some edits being shared: whatever the sizes at which pairs take the place of stars."""
    monkeypatch.setattr(minhash, "FEW", few)
    rnd = random.Random(8)
    base, versions = [f"w{i}" for i in range(60)], []
    for _ in range(6):
        text = list(versions[-1] if versions and rnd.random() < 0.5 else base)
        for _ in range(rnd.choice([0, 2, 4])):
            text[rnd.randrange(60)] = f"v{rnd.randrange(4)}"
        versions.append(text)
    rows = []
    for i in range(150):
        text = list(rnd.choice(versions))
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 6, 10])):
            text[rnd.randrange(60)] = rnd.choice([f"x{rnd.random()}", f"y{rnd.randrange(3)}"])
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 3, 85, 5).collect()}
    assert got == brute(rows, 3, 85)
