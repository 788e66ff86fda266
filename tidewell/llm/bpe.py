"""Byte-pair encoding of whole texts by batched merge rounds in numpy, and decoding.

A vocabulary file (merges in order of rank, ids of symbols) becomes one sorted array of pair keys, left id in the
high half and right id in the low half, with each pair's rank and the id it merges to. The symbols of many
words lie in one flat array. A round looks up the keys of all neighbours within words by binary search, takes each
word's lowest rank, merges that pair wherever it stands in the word (from the left, not overlapping) and
closes the gaps; words in which nothing merges leave. Words are split off at white space, which no
pre-token of these vocabularies crosses, so a worker encodes a distinct word once; its memory of words is emptied when it is
full, which changes no result.

Characters that Python's Unicode tables don't know yet have their class and case from the library, which may
be newer; all others follow Python.

Defined results: a null text is encoded as the empty one, which has no ids; ids decode to the tokens' own
strings joined by a blank, as the library does for a vocabulary without a decoder. Repeated rows repeat.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Sequence
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidewell.llm.textbatch import over_slices

#: Distinct words that a worker remembers, give or take one slice's.
MEMORY = 500_000
#: White space as str.split() has it but the vocabularies' patterns don't.
SEPARATORS, WHITE = re.compile("[\x1c-\x1f]"), re.compile(r"[^\S\x1c-\x1f]+")


@lru_cache(maxsize=1)
def unassigned() -> np.ndarray:
    """Of each code point, whether Python's Unicode tables have it as unassigned."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


def unknown(text: str) -> bool:
    """Whether a text holds characters that Python's Unicode tables have as unassigned."""
    return not text.isascii() and bool(unassigned()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any())


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(rest)) for b in range(256)]


class Vocabulary:
    """Merges and ids of a byte-level BPE file whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.byte_of = {s: b for b, s in enumerate(byte_symbols())}
        model, ids = spec["model"], spec["model"]["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pre = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(pre["pattern"]["Regex"])
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left, right, to = (np.array([ids[f(p)] for p in pairs], np.uint64) for f in (lambda p: p[0], lambda p: p[1], "".join))
        keys = left << np.uint64(32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.merged = keys[order], order.astype(np.int64), to[order].astype(np.int64)
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int64)
        self.last = np.array([ids[s + self.suffix] for s in symbols], np.int64)
        self.tokens = [""] * (max(*ids.values(), *self.special.values()) + 1)
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token

    @cached_property
    def shown(self) -> pa.Array:
        """The tokens as an Arrow array."""
        return pa.array(self.tokens, pa.string())

    @cached_property
    def special_pattern(self) -> re.Pattern:
        return re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def normalise(self, text: str) -> str:
        """NFC and lower case character by character (so that sigma has one form)."""
        if unknown(text):
            return self.library.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, word: str, checked: bool = False) -> list[bytes]:
        """A word's pre-tokens; `checked`: no character of it is unknown."""
        if not checked and unknown(word):
            return [bytes(map(self.byte_of.__getitem__, piece)) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(word)]
        return [piece.encode() for piece in self.pattern.findall(word)]

    def merge(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pre-tokens in one array, and how many each has."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.inner[raw]
        ends = np.cumsum(lengths)
        ids[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(pieces)), lengths)
        done_ids, done_words = [], []
        while len(ids):
            key = ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:].astype(np.uint64)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.where(hit, self.rank[at], np.iinfo(np.int64).max)
            rank = np.append(rank, np.iinfo(np.int64).max)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            going = low != np.iinfo(np.int64).max
            if not going.all():
                done_ids.append(ids[~going])
                done_words.append(word[~going])
            take = going & (rank == low)
            # in a run of overlapping matches (a a a), every second one counts from the run's start
            follows = np.append(False, take[:-1]) & take
            if follows.any():
                run = np.where(take & ~follows, np.arange(len(ids)), 0)
                take &= (np.arange(len(ids)) - np.maximum.accumulate(run)) % 2 == 0
            where = np.flatnonzero(take)
            ids[where] = self.merged[at[where]]
            going[where + 1] = False
            ids, word = ids[going], word[going]
        if not done_ids:
            return ids, np.zeros(len(pieces), np.int64)
        all_words = np.concatenate(done_words)
        order = np.argsort(all_words, kind="stable")
        return np.concatenate(done_ids)[order], np.bincount(all_words, minlength=len(pieces))


class Encoder:
    """Encodes texts, remembering the ids of words."""

    def __init__(self, vocabulary: Vocabulary, memory: int = MEMORY):
        self.vocabulary, self.memory = vocabulary, memory
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.pool = np.zeros(0, np.int64)
        self.start = self.count = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Put words into memory, special tokens as their own ids."""
        special = self.vocabulary.special
        pieces, owner = [], []
        checked = not unknown("".join(words))
        for i, word in enumerate(words):
            if word not in special:
                found = self.vocabulary.pieces(word, checked)
                pieces += found
                owner += [i] * len(found)
        ids, sizes = self.vocabulary.merge(pieces) if pieces else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        counts = np.bincount(np.array(owner, np.int64), weights=sizes, minlength=len(words)).astype(np.int64)
        for i, word in enumerate(words):
            if word in special:
                at = int(counts[:i].sum())
                ids, counts[i] = np.insert(ids, at, special[word]), 1
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.start = np.append(self.start, len(self.pool) + np.cumsum(counts) - counts)
        self.count = np.append(self.count, counts)
        self.pool = np.append(self.pool, ids)

    def words(self, text: str) -> list[str]:
        """A text's words and special tokens in order."""
        v = self.vocabulary
        parts = v.special_pattern.split(text) if v.special and any(s in text for s in v.special) else (text,)
        found: list[str] = []
        for part in parts:
            if part in v.special:
                found.append(part)
            else:
                part = v.normalise(part)
                chunks = WHITE.split(part) if SEPARATORS.search(part) else part.split()
                if v.special and any(s in part for s in v.special):
                    # what normalising made into a special token's string is ordinary text
                    chunks = [x.decode() for chunk in chunks for x in v.pieces(chunk)]
                found += filter(None, chunks)
        return found

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts in one array, and where each text's ids end."""
        split = [self.words(t) if t else [] for t in texts]
        if len(self.number) > self.memory:
            self._forget()
        flat = list(chain.from_iterable(split))
        if new := list(set(flat).difference(self.number)):
            self._learn(new)
        which = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        counts = self.count[which]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.arange(total) + np.repeat(self.start[which] - ends + counts, counts)]
        last = np.cumsum([len(s) for s in split], dtype=np.int64)
        return ids, np.append(0, ends)[last] if len(last) else last

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings with a blank between."""
        tokens = self.vocabulary.tokens
        return " ".join([tokens[i] for i in ids.tolist()])

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """decode for many texts, whose ids end at `ends`."""
        each = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), self.vocabulary.shown.take(pa.array(ids)))
        return pc.binary_join(each, " ")


@lru_cache(maxsize=2)
def worker_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(Vocabulary(path))


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (the text those ids decode to)."""

    def make():
        encoder = worker_encoder(path)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            ids, ends = encoder.encode(part.column(1).to_pylist())
            packed, starts = ids.astype("<u4"), np.append(0, ends)[:-1]
            spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
            return pa.record_batch(
                {
                    key: part.column(0),
                    "n_tokens": pa.array(ends - starts, pa.int64()),
                    "ids": pa.array([packed[a:b].tobytes() for a, b in spans], pa.binary()),
                    "decoded": encoder.decode_all(ids, ends),
                }
            )

        return step

    kind = docs.schema[key].dataType.simpleString()
    return over_slices(docs.select(key, text), text, make, f"{key} {kind}, n_tokens long, ids binary, decoded string")
