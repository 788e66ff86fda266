"""Toxicity of whole texts behind a noisy channel: obfuscated words are restored, then the restored text is scored.

A word that isn't plain letters (leetspeak, letters repeated, letters set apart by signs or blanks) becomes a lattice: each
run of one character may be the letters that it stands for, once or twice. The path that is best under a trigram model of
characters and the channel's costs is the restored word (Viterbi, over the last two letters). The model counts every
trigram of every word of all documents, in tasks, and only a table over classes of characters comes to the driver.

The score: the words and word beginnings of a sample of labelled rows (about ROWS of each label, the bound; whole restored texts)
are tested for dependence on the label (G-square, against the number of features tested); those that pass weigh their
log-likelihood ratio. A logistic regression combines a text's largest weight, its count of words with a weight and its length,
fitted on the sample at the balance of all labelled rows.

Defined results: null and empty texts have no feature; without labelled rows of both kinds every score is that of the only label (0 without any).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.sampling import labelled, remainder
from tidewell.llm.textbatch import over_slices, slices

#: Labelled rows to learn from, for each label, about.
ROWS = 3000
#: Lengths of word beginnings that are features, the least of them for restored words, and of words found inside a spaced run.
PREFIXES, RESTORED_PREFIX, INSIDE = (4, 5, 6), 5, 4
#: G-square that a feature needs, beside twice the logarithm of the number of features.
MARGIN = 4.0
#: Words that a worker remembers.
MEMORY = 500_000
#: Classes of characters in the model: blank, a to z, digit, other sign, and classes that other letters fall into.
CLASSES = 96
#: Natural logarithms of the channel: a letter written as another sign, a letter written more often than it stands, a wildcard.
SUBSTITUTED, REPEATED, WILDCARD = -2.0, -1.0, -3.0

# What signs stand for in leetspeak, and signs that are put between letters.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "#": "h",
}
WILD = {"*": "aeiou"}
BETWEEN = frozenset("-._~*'`^/\\,:;=·​")

SPACED = re.compile(r"(?<!\S)(?:\S ){2,}\S(?!\S)")
EDGE = re.compile(r"^[^\w@$!|+(<€£¡#*]+|[^\w@$|+<€£*]+$")
#: Signs in runs at a word's end are decoration, not letters.
DECORATION = re.compile(r"^([\W_])\1+|([\W_])\2+$")
THRICE = re.compile(r"(.)\1\1")


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point of lower-cased text."""
    table = np.full(0x110000, 28, np.uint8)
    for c in range(0x110000):
        if chr(c).isspace():
            table[c] = 0
        elif chr(c).isalpha():
            table[c] = c - 96 if 97 <= c <= 122 else 29 + c % (CLASSES - 29)
        elif chr(c).isdigit():
            table[c] = 27
    return table


def trigram_counts(docs: DataFrame) -> DataFrame:
    """trigram (class numbers in base CLASSES) and n over the words of all texts, each word with two blanks before it and one behind."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        table, total = class_table(), np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                text = " ".join(filter(None, part.column(0).to_pylist())).lower()
                c = table[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
                key = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
                total += np.bincount(key[c[1:-1] > 0], minlength=len(total))
                # and the first letters of words after two blanks
                total += np.bincount(c[1:][(c[1:] > 0) & (c[:-1] == 0)], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch({"trigram": some, "n": total[some]})

    return docs.select("text").mapInArrow(run, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


class Channel:
    """Restores words under a trigram model of characters."""

    def __init__(self, trigrams: np.ndarray, counts: np.ndarray):
        three = np.zeros(CLASSES**3)
        three[trigrams] = counts
        three = three.reshape(CLASSES, CLASSES, CLASSES)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + CLASSES)
        p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
        p3 = (three + 5 * p2) / (three.sum(2, keepdims=True) + 5)
        self.log = np.log(p3).astype(np.float32)

    def _options(self, sign: str, count: int, edge: bool) -> list[tuple[str, float]]:
        """What a run of one character may stand for, with the channel's cost."""
        found: list[tuple[str, float]] = []
        letters = LEET.get(sign, "") + WILD.get(sign, "")
        cost = WILDCARD if sign in WILD else SUBSTITUTED
        for letter, own in [*((x, cost) for x in letters), *([(sign, 0.0)] if sign.isalnum() else [])]:
            found.append((letter, own + (REPEATED if count > 1 else 0)))
            if count > 1:
                found.append((2 * letter, own + (REPEATED if count > 2 else 0)))
        if edge and not sign.isalnum() or sign in BETWEEN or not found:
            found.append(("", 0.0))
        return found

    def restore(self, word: str) -> str:
        """The best reading of a lower-case word."""
        runs: list[list] = []
        for sign in word:
            if runs and runs[-1][0] == sign:
                runs[-1][1] += 1
            else:
                runs.append([sign, 1])
        number = class_table()
        log = self.log
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # last two classes: score, chain of letters
        for i, (sign, count) in enumerate(runs):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for letters, cost in self._options(sign, count, i in (0, len(runs) - 1)):
                classes = [int(number[ord(x)]) for x in letters]
                for (a, b), (score, chain) in best.items():
                    total = score + cost
                    for c in classes:
                        total += float(log[a, b, c])
                        a, b = b, c
                    if (a, b) not in after or total > after[a, b][0]:
                        after[a, b] = (total, (letters, chain) if letters else chain)
            best = after
        (_, chain) = max(((score + float(log[a, b, 0]), chain) for (a, b), (score, chain) in best.items()), key=lambda x: x[0])
        parts = []
        while chain:
            parts.append(chain[0])
            chain = chain[1]
        return "".join(reversed(parts))


def features(word: str, channel: Channel) -> list[str]:
    """The features of one word of lower-cased text: the word, and its beginnings marked with a hyphen."""
    word = EDGE.sub("", word)
    if word.isalpha() and not THRICE.search(word):
        return [word, *[word[:n] + "-" for n in PREFIXES if len(word) > n]]
    word = DECORATION.sub("", word)
    if not any(c.isalpha() for c in word):
        return []
    # each part that is plain letters by itself is a word too (a.b, well-known)
    found = [f for part in re.split(r"[^\w]+|_", word) if part.isalpha() and len(part) > 2 and part != word for f in features(part, channel)]
    if word.isalpha() and not THRICE.search(word):
        return found + features(word, channel)
    restored = channel.restore(word)
    return found + [restored, *[restored[:n] + "-" for n in PREFIXES if len(restored) > n >= RESTORED_PREFIX]]


def spaced(text: str, channel: Channel) -> list[str]:
    """Words inside runs of single characters set apart by blanks, in lower-cased text."""
    found = []
    for run in SPACED.findall(text):
        if any(c.isalpha() for c in run):
            word = channel.restore(run.replace(" ", ""))
            found += [word[i:j] for i in range(len(word)) for j in range(i + INSIDE, min(len(word), i + 24) + 1)]
    return found


@dataclass
class Model:
    channel: Channel
    weights: dict[str, float]
    slopes: np.ndarray
    intercept: float

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def word(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > MEMORY:
                self.known.clear()
            weights = self.weights
            found = self.known[word] = max([weights[f] for f in features(word, self.channel) if f in weights], default=0.0)
        return found

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """A text's largest weight, the logarithms of its number of words with a weight and of its number of words."""
        text = (text or "").lower()
        words = text.split()
        found = [w for w in map(self.word, words) if w]
        found += [self.weights[f] for f in spaced(text, self.channel) if f in self.weights]
        return max(found, default=0.0), math.log1p(len(found)), math.log1p(len(words))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1 for each text."""
        x = np.array([self.evidence(t) for t in texts]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(x @ self.slopes + self.intercept, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Slopes and, last, the intercept of a weighted logistic regression with a ridge on the slopes, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, rows: int = ROWS, mod: int = 5, fold: int = 0) -> Model:
    """A model of labels.toxic from rows whose crc32(doc_id) modulo mod isn't fold, and of the characters of all docs."""
    spark = docs.sparkSession
    counted = trigram_counts(docs).toArrow()
    channel = Channel(counted["trigram"].to_numpy(), counted["n"].to_numpy())
    table, many = labelled(docs, labels, "toxic", ~remainder("doc_id", mod).isin(fold, -1), rows, "toxicity")
    if not all(many.get(k) for k in (0, 1)):
        return Model(channel, {}, np.zeros(3), 60.0 if many.get(1) else -60.0)
    shipped = spark.sparkContext.broadcast(channel)

    def make():
        channel = shipped.value
        known: dict[str, list[str]] = {}

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            counts: dict[str, list[int]] = {}
            for text, label in zip(*(c.to_pylist() for c in part.columns), strict=True):
                text = (text or "").lower()
                words = set(text.split())
                for w in words - known.keys():
                    known[w] = features(w, channel)
                for f in {f for w in words for f in known[w]}.union(spaced(text, channel)):
                    counts.setdefault(f, [0, 0])[label] += 1
            return pa.record_batch({"feature": pa.array(counts, pa.string()), "n0": pa.array([n[0] for n in counts.values()], pa.int64()), "n1": pa.array([n[1] for n in counts.values()], pa.int64())})

        return step

    sample = spark.createDataFrame(table).repartition(max(1, len(table) // 200))
    found = over_slices(sample, "text", make, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).persist()
    size1 = int(table["label"].to_numpy().sum())
    size0 = len(table) - size1
    share = size1 / (size0 + size1)
    xlog = lambda n, p: F.when(n > 0, n * F.log(n / p)).otherwise(0.0)
    n = F.col("n0") + F.col("n1")
    g = 2 * (xlog(F.col("n1"), n * share) + xlog(F.col("n0"), n * (1 - share)) + xlog(size1 - F.col("n1"), (size1 + size0 - n) * share) + xlog(size0 - F.col("n0"), (size1 + size0 - n) * (1 - share)))
    least = 2 * math.log(max(2, found.count())) + MARGIN
    strong = found.filter((F.col("n1") * size0 > F.col("n0") * size1) & (g >= least)).toArrow()
    found.unpersist()
    n1, n0 = (strong[c].to_numpy().astype(float) for c in ("n1", "n0"))
    ratio = np.log((n1 + 0.5) / (size1 + 1)) - np.log((n0 + 0.5) / (size0 + 1))
    model = Model(channel, dict(zip(strong["feature"].to_pylist(), ratio.tolist(), strict=True)), np.zeros(3), 0.0)
    x, y = np.array([model.evidence(t) for t in table["text"].to_pylist()]), table["label"].to_numpy()
    beta = logistic(x, y, np.where(y == 1, many[1] / size1, many[0] / size0) * len(y) / (many[0] + many[1]))
    model.slopes, model.intercept = beta[:-1], float(beta[-1])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    at = columns.index("text")

    def make():
        model = shipped.value

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            found = model.score(part.column(at).to_pylist())
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], [*columns, "score", "predicted"])

        return step

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return over_slices(docs, "text", make, f"{schema}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = learn(docs, labels)
    return score(docs.select("doc_id", (remainder("doc_id", 5) == F.lit(0)).alias("held_out"), "text"), model).drop("text")
