import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import alignment, queries
from tidewell.llm.bpe import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def by_loop(rows, tokenizers):
    """The result for rows (doc_id, text), token by token."""
    lib, model = tokenizers
    value = {s: i for i, s in enumerate(byte_symbols())}

    def piece(i):
        p = model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    found = []
    for _, text in rows:
        if not text:
            found.append(None)
            continue
        a = lib.encode(" " + text, add_special_tokens=False).ids
        b = model.encode(text)
        bytes_a, bytes_b = [bytes(value[c] for c in lib.id_to_token(i)) for i in a], [piece(i) for i in b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links, j = Counter(), 0
        for i, end in enumerate(ends_a):
            start = ends_a[i - 1] if i else 0
            while j and (ends_b[j - 1]) > start:
                j -= 1
            while ends_b[j] <= start:
                j += 1
            k = j
            while k < len(b) and (ends_b[k - 1] if k else 0) < end:
                links[a[i], b[k]] += 1
                k += 1
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        found.append((len(a), len(b), groups, links))
    count, highest = Counter(), defaultdict(int)
    for f in filter(None, found):
        count.update(f[3].keys())
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for (i, _), f in zip(rows, found, strict=True):
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = f
            best = sum(m for p, m in links.items() if count[p] == highest[p[0]])
            out.append((i, n_a, n_b, len(groups), sum(links.values()), best, sum(m * count[p] for p, m in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def results(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, df.select(columns).collect()), key=str)


TEXTS = [
    None, "", "a", " ", "  two  blanks ", "line\nfeeds\n\n", "tab\there", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve café 日本語 😀 x́", "underline ▁ stays", "aaaa" * 200, "the cat sat on the mat",
    "the cat sat on the mat", "The Cat's hat, don't!", " nbsp ", "ﬁ ligature ½", "0123456789 " * 40, "\x00\x01 control \x1c", "x" * 3000, "the " * 700, "ελληνικά кириллица",
]


def test_documents_are_those_of_a_loop(spark, tokenizers):
    rows = list(enumerate(TEXTS * 2))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, slice string").repartition(3)
    assert results(alignment.align(docs, A, B)) == by_loop(rows, tokenizers)


def test_real_documents(spark, sf, tokenizers):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 3000").select("doc_id", "text").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 3000")
    assert len(rows) > 50 and results(alignment.align(docs, A, B)) == by_loop(rows, tokenizers)


def test_frequent_ids_are_dealt_out_and_sums_are_emitted_early(spark, tokenizers, monkeypatch):
    """With room for 5 postings an A id, 3 pairs or documents and some bytes, everything is split and the results stay."""
    for name, value in (("SPLIT", 5), ("SLICE_BYTES", 300), ("POSTING_BYTES", 100)):
        monkeypatch.setattr(alignment, name, value)
    rows = [(i, "the same words " * (i % 4) if i % 3 else TEXTS[i % len(TEXTS)]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert results(alignment.align(docs, A, B)) == by_loop(rows, tokenizers)


def test_odd_rows(spark, tokenizers):
    """Null and repeated doc_ids, repeated rows, one multiplicity beyond a byte, no rows."""
    rows = [(None, "a b c"), (None, "a b c"), (1, "a b"), (1, "a b"), (1, "c"), (2, " the" * 1000), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert results(alignment.align(docs, A, B)) == by_loop(rows, tokenizers)
    assert alignment.align(docs.limit(0), A, B).collect() == []
    other = docs.filter("doc_id = 2").withColumn("doc_id", F.lit("as text"))
    assert alignment.align(other, A, B).first().doc_id == "as text"


def test_sums_and_pair_counts_emit_when_they_are_full(monkeypatch):
    monkeypatch.setattr(alignment, "HELD_PAIRS", 3)
    counts, seen = alignment.PairCounts(), Counter()
    for i in range(50):
        counts.add(np.array([i % 5, 5 + i % 2]), np.array([1, 2]))
        for found in filter(None, [counts.taken(alignment.HELD_PAIRS)]):
            seen.update(dict(zip(*map(np.ndarray.tolist, found), strict=True)))
    rest = counts.taken()
    if rest:
        seen.update(dict(zip(*map(np.ndarray.tolist, rest), strict=True)))
    assert seen == {**{k: 10 for k in range(5)}, 5: 50, 6: 50}
    sums, total = alignment.Sums(), Counter()
    for i in range(40):
        sums.add(np.array([i % 7, 70_000 + i % 3, i % 7]), np.array([1, 2, 1]), np.array([3, 4, 5]))
        for batch in [*sums.rows(6), *(sums.rows() if i == 39 else ())]:
            for row in batch.to_pylist():
                docs = np.frombuffer(row["docs"], "<u2").astype(int) + row["slice"] * alignment.DOCUMENTS
                total.update(dict(zip(docs.tolist(), np.frombuffer(row["total"], "<i8").tolist(), strict=True)))
    assert sum(total.values()) == 40 * 12 and sum(v for k, v in total.items() if k >= 70_000) == 160


def test_query_keeps_every_document(spark, sf):
    got = queries.op13_token_links(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
