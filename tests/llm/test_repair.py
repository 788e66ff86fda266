import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewell.llm import queries, repair

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
BASE = LIBRARY.get_vocab_size(with_added_tokens=True)
ODD = [
    "Hello  World's 123 naïve", "", " ", "\n", "a\nb c\n d", " lead trail ", "a   b", "x<|endoftext|>y", "tab\there", "a b c", "né\x1cx\x1d y", "\U000323b0: ok \U000323b0",
    "'s 's\n's", "12 345\n67,8 !!", "日本 語\n🎉 🎉🎉", "w f\nw f", "wf", "f", "w", "word " * 3000,
    "a\tb ", "x\ty  z", "col1\tcol2 \nrow", "0\r0 ", "a\n\nb", "a\n\n\nb", "\nlead", " \n", "a\x85b\u3000c", "word " * 3000 + "end", "long\nlines and words " * 40_000 + "end",
]


@pytest.mark.parametrize("memory", [1, 10**6])
def test_encoder_is_the_library(memory):
    encoder = repair.LibraryEncoder(PATH, memory)
    for texts in (ODD, ODD[::-1], [None, *ODD]):
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == LIBRARY.encode(text or "", add_special_tokens=False).ids, text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30) | st.text("abcA's 12!?,\n\té\U000323b0", max_size=40), max_size=4))
def test_encoder_on_any_text(texts):
    ids, counts = repair.worker_encoder(PATH).encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for t in texts for i in LIBRARY.encode(t, add_special_tokens=False).ids]
    assert len(counts) == len(texts)


@pytest.mark.parametrize("ids", [[], [5], [7] * 1001, list(range(40)) * 50, np.random.default_rng(1).zipf(1.3, 60_000) % 500, np.random.default_rng(2).integers(0, 160, 600_000)])
def test_grammar_round_trip(ids):
    ids = np.asarray(ids, np.int64)
    rules, lengths, sequence = repair.compress(ids, BASE)
    grammar = repair.Grammar(rules, lengths, BASE)
    assert (grammar.expand(sequence) == ids).all() and len(sequence) <= len(ids)
    assert max([0, *rules.ravel(), *sequence]) < repair.SYMBOLS
    again = sequence[:-1].astype(np.int64) << 16 | sequence[1:]
    if len(again):
        again = again[np.append(True, again[1:] != again[:-1])]  # in a run of one symbol every second pair counts
    assert len(rules) == repair.SYMBOLS - BASE or not len(again) or np.unique(again, return_counts=True)[1].max() < 2 * repair.FREQUENT
    for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (0, min(1, len(ids)))):
        assert (grammar.between(sequence, a, b) == ids[a:b]).all()


@pytest.mark.parametrize("shard", [20, 3000, 1 << 20])
def test_query(spark, sf, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(repair, "RANGE_DOCUMENTS", 60)
    monkeypatch.setattr(repair, "SHARD_IDS", shard)
    monkeypatch.setattr(repair, "ENCODED_BYTES", 50_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-5, None, 1), (-7, "", 2), (10**9, "last <|endoftext|> one", 3), (None, "no id", 4)], "doc_id long, text string, start int")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [*docs.collect(), *more.select("doc_id", "text").collect()]
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, queries.op5_token_files(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert got == want
    assert repair.round_trip(docs.limit(0), PATH).count() == 0
