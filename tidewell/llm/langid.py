"""Language of whole texts by language-bitmask n-gram filters.

Every slot of a table holds a bitmask with one bit a language, in as many 64-bit words as the languages need: a bit-sliced stack of Bloom filters. The table
has SLOTS slots, doubled for as long as its n-grams would fill more than half, up to LARGEST (8 bytes a slot and word); beyond that filters get fuller, which the
correction takes into account. An n-gram has HASHES slots; the AND of their masks is the set of all languages whose filter has the n-gram, in one look at each slot. A
text's n-grams are counted for each language, and each count is corrected for the n-grams that the filter of that
language has only by chance: of n n-grams, a filter filled to a share f passes n * f^HASHES that it doesn't hold.
The language with the largest corrected count is predicted; its share of all corrected counts is the score.

A language's filter holds the n-grams that are about as frequent in it as in any other language (SHARE), counted over a
sample of labelled rows, about ROWS a language, taken by a hash of doc_id (the bound; the whole of each row's text is
used). Statistics of the sample are summed on executors; the driver holds the names of the languages and the table of slots only.

Defined results: a null text, and one without a letter, is "und" with the score 0, as is every text if there is
nothing to learn from. A text of which no n-gram is known gets the commonest language with the score 0. Ties go to
the language that is first in the alphabet.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.sampling import remainder
from tidewell.llm.textbatch import over_slices

#: Labelled rows to learn from, for each language, about.
ROWS = 1000
#: Languages in one word of a bitmask.
WORD = 64
#: Characters of an n-gram, least and most slots of the table (powers of 2), hashes of an n-gram.
GRAM, SLOTS, LARGEST, HASHES = 4, 1 << 20, 1 << 23, 3
#: How often an n-gram must be in the sample, and at which share of its highest frequency in any language.
SEEN, SHARE = 3, 0.5


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts in one array, how many each text has, and whether it has a letter.

    Texts are lower-cased; each run of other characters than letters is one blank, but none is put in front of a text that begins with a letter.
    """
    joined = "\n".join(t.lower() if t else "" for t in texts) + "\n"
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    end = np.cumsum([len(t.lower()) + 1 if t else 1 for t in texts])
    alpha = letters()[chars]
    row = np.searchsorted(end, np.flatnonzero(alpha | np.append(True, alpha[:-1])), side="right")
    chars = np.where(alpha, chars, np.uint32(0x20))[alpha | np.append(True, alpha[:-1])]
    hashed = np.zeros(max(0, len(chars) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        hashed = (hashed + chars[i : len(chars) - GRAM + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
    own = row[: len(hashed)] == row[GRAM - 1 :] if len(hashed) else np.zeros(0, bool)
    counts = np.bincount(row[: len(hashed)][own], minlength=len(texts))
    has = np.add.reduceat(alpha, np.append(0, end[:-1])) > 0 if texts else np.zeros(0, bool)
    return hashed[own], counts, has


def slots(hashed: np.ndarray, size: int = SLOTS) -> list[np.ndarray]:
    """The slots of n-grams in a table of this size, a power of 2."""
    return [(hashed * np.uint64(2 * i + 0xD6E8FEB86659FD93)) >> np.uint64(65 - size.bit_length()) for i in range(HASHES)]


def table_size(grams_: int) -> int:
    """Slots for this many n-grams."""
    size = SLOTS
    while size < LARGEST and 2 * HASHES * grams_ > size:
        size *= 2
    return size


@dataclass
class Model:
    """languages, masks (a row of slots for each word of 64 languages), and which language is the commonest."""

    languages: list[str]
    masks: np.ndarray
    usual: int = 0

    def __post_init__(self) -> None:
        self.masks = np.atleast_2d(self.masks)
        fill = np.array([((self.masks[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).mean() for i in range(len(self.languages))])
        self.chance = fill**HASHES

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and the score of each text."""
        hashed, counts, has = grams(texts)
        at = slots(hashed, self.masks.shape[1])
        some = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[some]
        passed = np.zeros((len(texts), len(self.languages)))
        for word in range(len(self.masks) if len(some) else 0):
            found = self.masks[word][at[0]]
            for more in at[1:]:
                found &= self.masks[word][more]
            for i in range(word * WORD, min(len(self.languages), (word + 1) * WORD)):
                passed[some, i] = np.add.reduceat((found >> np.uint64(i % WORD)) & np.uint64(1), starts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        right = np.maximum(0, (passed - counts[:, None] * self.chance) / (1 - self.chance))
        total = right.sum(1)
        best = np.where(total > 0, right.argmax(1), self.usual)
        score = np.where(total > 0, right.max(1) / np.maximum(total, 1e-300), 0.0)
        return [self.languages[b] if h else "und" for b, h in zip(best, has, strict=True)], np.where(has, score, 0.0)


def learn(docs: DataFrame, rows: int = ROWS) -> Model:
    """A model from the texts and languages of docs (doc_id, text, lang)."""
    known = docs.filter("text is not null and lang is not null")
    many = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not many:
        return Model([], np.zeros(SLOTS, np.uint64))
    languages = sorted(many)
    number = F.array_position(F.lit(languages), F.col("lang")).cast("int") - 1
    rate = F.element_at(F.lit([rows / many[lang] for lang in languages]), number + 1)
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.filter(draw < rate).select(number.alias("lang"), "text")

    def make():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            hashed, counts, _ = grams(part.column(1).to_pylist())
            lang = np.repeat(part.column(0).to_numpy(zero_copy_only=False), counts)
            out: dict[str, list] = {"lang": [], "gram": [], "n": []}
            for i in np.unique(lang):
                values, n = np.unique(hashed[lang == i], return_counts=True)
                for name, column in (("lang", np.full(len(n), i)), ("gram", values.view(np.int64)), ("n", n)):
                    out[name].append(column)
            kinds = {"lang": pa.int32(), "gram": pa.int64(), "n": pa.int64()}
            return pa.record_batch({k: pa.array(np.concatenate(v) if v else [], kinds[k]) for k, v in out.items()})

        return step

    found = over_slices(sample, "text", make, "lang int, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")).persist()
    totals = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    share = F.col("n") / F.element_at(F.lit([float(totals.get(i, 1)) for i in range(len(languages))]), F.col("lang") + 1)
    by_gram = found.withColumn("share", share).groupBy("gram").agg(F.sum("n").alias("n"), F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("by"))
    chosen = by_gram.filter(F.col("n") >= SEEN)
    size = table_size(chosen.count())
    bits = chosen.select("gram", F.explode(F.filter("by", lambda x: x["share"] >= SHARE * F.col("top"))["lang"]).alias("lang"))

    def to_slots(batches):
        for batch in batches:
            gram = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            lang = batch.column(1).to_numpy(zero_copy_only=False)
            at = np.concatenate(slots(gram, size)).astype(np.int64)
            mask = (np.uint64(1) << (lang % WORD).astype(np.uint64)).view(np.int64)
            yield pa.record_batch({"slot": at, "word": np.tile((lang // WORD).astype(np.int32), HASHES), "mask": np.tile(mask, HASHES)})

    filled = bits.mapInArrow(to_slots, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    masks = np.zeros((-(-len(languages) // WORD), size), np.uint64)
    got = filled.toArrow()
    found.unpersist()
    masks[got["word"].to_numpy(), got["slot"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return Model(languages, masks, max(range(len(languages)), key=lambda i: (many[languages[i]], -i)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    at = columns.index("text")

    def make():
        model = shipped.value

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            languages, score = model.predict(part.column(at).to_pylist())
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(languages, pa.string()), pa.array(score)], [*columns, "lang_pred", "score"])

        return step

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return over_slices(docs, "text", make, f"{schema}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's label may not be learned: crc32 of its id as text, mod 5, is 0. A null id is in no fold: false."""
    return remainder(doc_id, 5) == 0


def learnable(doc_id: str = "doc_id") -> Column:
    """Whether a document's label may be learned: it has an id and isn't held out."""
    return remainder(doc_id, 5) > 0


def identify(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those that have an id and aren't held out."""
    model = learn(docs.select("doc_id", "text", "lang").filter(learnable()), rows)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
