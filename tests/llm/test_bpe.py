import hashlib
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewell.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "Hello  World's 123 naïve ß İ <|endoftext|> x y ÀÉ", "", "  ", "a<|startoftext|>b 日本", "aaaaaaa aaaaaaaaa'saaa", "Σίσυφος ΟΔΟΣ", "a\x1cb\x85c　d​e",
    "<|ENDOFTEXT|> x", "é <|endoftext|><|endoftext|>", "'s's'S 12³½٣", "﻿🎉👍🏽 " + "x" * 5000 + "é" * 500, "don't I'LL we'Re",
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def agree(encoder, texts):
    ids, ends = encoder.encode(texts)
    for text, a, b in zip(texts, np.append(0, ends), ends, strict=False):
        want = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert ids[a:b].tolist() == want
        assert encoder.decode(ids[a:b]) == LIBRARY.decode(want, skip_special_tokens=False)


def test_odd_texts(vocabulary):
    agree(bpe.Encoder(vocabulary), [*ODD, None])


def test_forgetting_changes_nothing(vocabulary):
    encoder = bpe.Encoder(vocabulary, memory=3)
    for _ in range(3):
        agree(encoder, ODD)
        agree(encoder, ["tiny words here and there", "words and more words"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("abcAB'stre 12!?,.<|>é\n\t漢́", max_size=60), max_size=4))
def test_any_text(texts):
    agree(bpe.worker_encoder(PATH), texts)


def test_query(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(-1, None, "x"), (-2, "", "y"), (None, "null id", None), (-3, "twice", ""), (-3, "twice", "")], "doc_id long, text string, decoded string")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op3_bpe_digests(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc_id, text in [*docs.select("doc_id", "text").collect(), *more.select("doc_id", "text").collect()]:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        said = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_decoded_side_by_side(vocabulary):
    encoder = bpe.Encoder(vocabulary)
    ids, ends = encoder.encode([*ODD, None])
    want = [LIBRARY.decode(LIBRARY.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for t in [*ODD, None]]
    assert encoder.decode_all(ids, ends).to_pylist() == want
    assert encoder.decode_all(*encoder.encode([])).to_pylist() == []


def test_letters_beyond_ascii_cost_little_more(vocabulary):
    """A text is looked through for characters that Python doesn't know in one pass of numpy, not by a pattern of hundreds of ranges for each character."""
    encoder = bpe.Encoder(vocabulary)
    plain, beyond = "words and words " * 20_000, "wörds änd wörds " * 20_000

    def seconds(text):
        start = time.process_time()
        encoder.encode([text])
        return time.process_time() - start

    for text in (plain, beyond):
        encoder.encode([text[:160]])
    assert min(seconds(beyond) for _ in range(3)) < 5 * min(seconds(plain) for _ in range(3))
