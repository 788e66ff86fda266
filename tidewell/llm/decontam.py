"""Benchmark passages in documents, verbatim or paraphrased: latent semantic retrieval, then word-order and answer checks.

Documents are cut into passages of WINDOW words, STRIDE apart, to their ends. Passages are TF-IDF vectors over the benchmark's words (other words
can't speak for a benchmark item). A randomised SVD of the matrix of all passages, A, is computed in tasks: with G a random matrix, each task
adds its part of A'(A G), a table of words by dimensions; the sum's orthonormal basis spans the leading singular directions. Passages and
benchmark parts (of up to WINDOW words) are projected on it; passages with a cosine of NEAR * sqrt(words of the part / WINDOW) or more to a part
are candidates, since a part that fills a share s of a passage has a cosine of about sqrt(s) with it. A word counts once in each STRIDE words,
so that a host that repeats a word can't swamp an item.

A candidate's surroundings must hold COVERED of the part's words in order (longest common subsequence) and ANSWER of its rarest words,
which carry what the item asks for. No cosine is promised in every host (one in another language lies outside the leading directions), so behind
the retrieval, passages that hold all rarest words of a part are looked up in an index of these; a part that stands there word for word matches
whatever its cosine. Candidates are found in tasks against the benchmark, which is one broadcast table. A benchmark whose
parts have more than BENCHMARK_WORDS words is dealt by Spark into blocks of at most that many (parts of an item may be in several), each of which is
searched for in all documents.

Defined results: null and empty texts and items match nothing; items whose words are all unknown can't occur. Rows with one doc_id or item_id are
one document or item to the result, which has a row for each pair that matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.textbatch import over_slices
from tidewell.session import materialise

WINDOW, STRIDE = 64, 32
#: Dimensions of the latent space.
RANK = 96
NEAR, COVERED, ANSWER = 0.5, 0.6, 0.4
#: Rarest words of a part that its answer check looks for.
RAREST = 5
#: (word, part) pairs of the index of rarest words that a task works on at a time, and passages and parts whose cosines it holds.
EXPANDED, TILE = 1 << 20, 4096
#: Words of benchmark parts that are collected and broadcast at a time.
BENCHMARK_WORDS = 2_000_000

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def parts_of(words: list[str]) -> list[list[str]]:
    """An item's words in parts of up to WINDOW words, STRIDE apart."""
    return [words[i : i + WINDOW] for i in range(0, max(1, len(words) - STRIDE), STRIDE)] if words else []


def encode(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """doc_id and the text's words as 32-bit numbers in the vocabulary, -1 for others."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        number = shipped.value.get

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for text in part.column(1).to_pylist():
                words = words_of(text)
                found.append(np.fromiter((number(w, -1) for w in words), np.int32, len(words)).tobytes())
            return pa.record_batch({"doc_id": part.column(0), "words": pa.array(found, pa.binary())})

        return step

    return over_slices(docs.select(F.col("doc_id").cast("long"), "text"), "text", make, "doc_id long, words binary")


class Passages:
    """All passages of a batch of documents: blocks of STRIDE words, of which each passage has two."""

    def __init__(self, texts: list[bytes]):
        each = [np.frombuffer(t, np.int32) for t in texts]
        self.size = np.array([len(w) for w in each], np.int64)
        blocks = -(-self.size // STRIDE)
        first = np.cumsum(blocks) - blocks
        self.words = np.concatenate(each) if each else np.zeros(0, np.int32)
        within = np.arange(len(self.words)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.block = np.repeat(first, self.size) + within // STRIDE
        known = np.flatnonzero(self.words >= 0)
        # each word once in a block, in the order of blocks
        self.known = known[np.unique(self.block[known] << 32 | self.words[known], return_index=True)[1]]
        self.blocks = int(blocks.sum())
        # a passage begins at each block but a document's last one, unless it's the only one
        owner = np.repeat(np.arange(len(each)), blocks)
        number = np.arange(self.blocks) - np.repeat(first, blocks)
        keep = (number < blocks[owner] - 1) | (blocks[owner] == 1)
        self.start, self.doc = np.flatnonzero(keep), owner[keep]
        self.second = np.where(number[self.start] + 1 < blocks[self.doc], self.start + 1, -1)
        self.number, self.at = number, number[self.start] * STRIDE

    def sums(self, table: np.ndarray) -> np.ndarray:
        """The sum over each passage's words of their rows in a table."""
        out = np.zeros((self.blocks + 1, table.shape[1]), np.float32)
        if len(self.known):
            block, word = self.block[self.known], self.words[self.known]
            cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            n = np.diff(np.append(cuts, len(block)))
            for k in range(int(n.max())):  # the k-th words of all blocks that have so many: STRIDE rounds at most
                at = cuts[n > k] + k
                out[block[at]] += table[word[at]]
        return out[self.start] + out[self.second]  # the last row, of zeros, stands for no second block

    def passages_of_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Every (passage, word) that a known word stands in."""
        of_block = np.full((self.blocks + 1, 2), -1)
        of_block[self.start, 0] = np.arange(len(self.start))
        has = self.second >= 0
        of_block[self.second[has], 1] = np.flatnonzero(has)
        pairs = of_block[self.block[self.known]]
        words = self.words[self.known]
        return np.concatenate([pairs[pairs[:, 0] >= 0, 0], pairs[pairs[:, 1] >= 0, 1]]), np.concatenate([words[pairs[:, 0] >= 0], words[pairs[:, 1] >= 0]])

    def frequencies(self, size: int) -> np.ndarray:
        """In how many passages each known word is."""
        block, word = self.block[self.known], self.words[self.known].astype(np.int64)
        begins, ends = np.zeros(self.blocks, bool), np.zeros(self.blocks + 1, bool)
        begins[self.start] = True
        ends[self.second] = True  # the last one stands for no second block
        each = begins[block].astype(np.int64) + ends[block]
        # a word in both blocks of a passage counts once; pairs of block and word are in order
        pairs = block << 32 | word
        after = np.minimum(np.searchsorted(pairs, pairs + (1 << 32)), max(0, len(pairs) - 1))
        paired = np.zeros(self.blocks, bool)
        paired[self.start[self.second >= 0]] = True
        each -= paired[block] & (pairs[after] == pairs + (1 << 32)) if len(pairs) else 0
        return np.bincount(word, each, size).astype(np.int64)

    def surroundings(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (passage, word) of wanted words (a mark for each word) within STRIDE words of a passage or in it, once."""
        known = self.known[wanted[self.words[self.known]]]
        block, word = self.block[known], self.words[known].astype(np.int64)
        passage = np.full(self.blocks, -1)
        passage[self.start] = np.arange(len(self.start))
        found = []
        for back in (-1, 0, 1, 2):  # the passage begins so many blocks before the word's
            at = block - back
            inside = (at >= 0) & (at < self.blocks)
            near = passage[at[inside]]
            same = (near >= 0) & (self.number[block[inside]] - self.number[at[inside]] == back)
            found.append(near[same] << 32 | word[inside][same])
        both = np.unique(np.concatenate(found))
        return both >> 32, both & 0xFFFFFFFF


class Rarest:
    """An index from words to the parts of whose rarest words they are."""

    def __init__(self, rarest: list[set[int]], words: int):
        pairs = sorted((w, j) for j, r in enumerate(rarest) for w in r)
        self.parts = np.array([j for _, j in pairs], np.int64)
        self.ends = np.searchsorted([w for w, _ in pairs], np.arange(words), side="right")
        self.begins = np.append(0, self.ends[:-1])
        self.most = np.array([len(r) for r in rarest], np.int64)
        self.need = np.ceil(ANSWER * self.most - 1e-9).astype(np.int64)

    def answered(self, p: Passages) -> tuple[np.ndarray, np.ndarray]:
        """Keys (passage * parts + part), in order, of those whose surroundings hold ANSWER of a part's rarest words, and whether they hold all."""
        passage, word = p.surroundings(self.ends > self.begins)
        many = self.ends[word] - self.begins[word]
        ends = np.cumsum(many)
        keys, every = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        at = 0
        while at < len(passage):  # whole passages, about EXPANDED (word, part) at a time
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED, side="right"))
            to = int(np.searchsorted(passage, passage[min(max(at, to), len(passage) - 1)], side="right"))
            n = many[at:to]
            index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.begins[word[at:to]], n)
            key, count = np.unique(np.repeat(passage[at:to], n) * len(self.most) + self.parts[index], return_counts=True)
            part = key % len(self.most)
            keep = count >= self.need[part]
            keys.append(key[keep])
            every.append(count[keep] == self.most[part[keep]])
            at = to
        return np.concatenate(keys), np.concatenate(every)


def holds(words: np.ndarray, part: np.ndarray) -> bool:
    """Whether a part stands in words, word for word."""
    text, wanted = words.tobytes(), part.tobytes()
    at = text.find(wanted)
    while at >= 0 and at % part.itemsize:
        at = text.find(wanted, at + 1)
    return at >= 0


def document_frequencies(encoded: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many passages each word is, and the number of passages."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            p = Passages(batch.column(0).to_pylist())
            total[:size] += p.frequencies(size)
            total[size] += len(p.start)
        some = np.flatnonzero(total)
        yield pa.record_batch({"word": some, "n": total[some]})

    out = np.zeros(size + 1, np.int64)
    got = encoded.select("words").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out[got["word"].to_numpy()] = got["n"].to_numpy()
    return out[:size], int(out[size])


def norms(p: Passages, weights: np.ndarray) -> np.ndarray:
    """The length of each passage's TF-IDF vector."""
    passage, word = p.passages_of_words()
    key, count = np.unique(passage * len(weights) + word, return_counts=True)
    square = np.bincount(key // len(weights), (count * weights[key % len(weights)]) ** 2, len(p.start))
    return np.sqrt(np.maximum(square, 1e-12))


def latent_basis(encoded: DataFrame, weights: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """An orthonormal basis (words by rank) of the leading right singular directions of the passages' TF-IDF matrix."""
    size = len(weights)
    random = np.random.default_rng(seed).normal(0, 1, (size, rank)).astype(np.float32)
    shipped = encoded.sparkSession.sparkContext.broadcast((random * weights[:, None].astype(np.float32), weights))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        table, weights = shipped.value
        total = np.zeros((rank, size))
        for batch in batches:
            p = Passages(batch.column(0).to_pylist())
            if not len(p.known):
                continue
            y = p.sums(table) / (norms(p, weights) ** 2)[:, None].astype(np.float32)
            # words' rows get the sum of their passages' rows: of blocks first, as both passages of a block hold all its words
            rows = np.zeros((p.blocks, rank), np.float32)
            rows[p.start] += y
            has = p.second >= 0  # a block is the second one of one passage at most
            rows[p.second[has]] += y[has]
            words, block = p.words[p.known], p.block[p.known]
            for d, column in enumerate(np.ascontiguousarray(rows.T)):
                total[d] += np.bincount(words, column[block], size)
        some = np.flatnonzero(total.any(0))
        yield pa.record_batch({"word": some, "row": pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * rank, pa.int32()), pa.array(total[:, some].T.ravel()))})

    # a task sends one row for each word, and rows are summed up as vectors
    sent = encoded.select("words").mapInArrow(run, "word long, row array<double>")
    sums = sent.groupBy("word").agg(*[F.sum(F.get("row", F.lit(d))).alias(f"v{d}") for d in range(rank)]).toArrow()
    z = np.zeros((size, rank))
    for d in range(rank):
        z[sums["word"].to_numpy(), d] = sums[f"v{d}"].to_numpy()
    basis, values, _ = np.linalg.svd(z * weights[:, None], full_matrices=False)
    return basis[:, values > 1e-9 * max(1e-300, values[0])] if size else z


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence of two sequences of numbers (bit-parallel over a)."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if (m := places.get(x)) is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def benchmark_parts(benchmark: DataFrame) -> DataFrame:
    """item_id, part (its number in the row), text (the part's words, with blanks) and words of every part of every item."""

    def make():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(i, k, " ".join(p), len(p)) for i, t in zip(*(c.to_pylist() for c in part.columns), strict=True) for k, p in enumerate(parts_of(words_of(t)))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["item_id", "part", "text", "words"])

        return step

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    return over_slices(items, "text", make, "item_id long, part long, text string, words long")


def in_blocks(parts: DataFrame, total: int) -> DataFrame:
    """parts with `block`, each of at most BENCHMARK_WORDS words (or one part): dealt by hash into about half of that, cut where a share is larger."""
    shares = -(-2 * total // BENCHMARK_WORDS)
    dealt = parts.withColumn("_share", F.pmod(F.xxhash64("item_id", "part", "text"), F.lit(shares)))
    w = Window.partitionBy("_share").orderBy("item_id", "part", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = max(1, BENCHMARK_WORDS - WINDOW)  # a part that begins within the room ends within the block
    return dealt.withColumn("block", F.struct("_share", F.floor((F.sum("words").over(w) - F.col("words")) / room).alias("cut"))).drop("_share")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity (cosine of the best passage), covered (share of a part's words in order), at (first word of that passage)."""
    parts = materialise(benchmark_parts(benchmark), "parts")
    size = parts.agg(F.count("*").alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    if size.words <= BENCHMARK_WORDS:
        found = block_matches(docs, parts, size.n)
    else:
        blocked = materialise(in_blocks(parts, size.words), "blocks")
        found = None
        for row in sorted(tuple(r.block) for r in blocked.select("block").distinct().collect()):
            own = blocked.filter((F.col("block._share") == row[0]) & (F.col("block.cut") == row[1]))
            part = materialise(block_matches(docs, own, size.n), "found")
            found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("covered", "similarity", (-F.col("at")).alias("at"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.similarity", "best.covered", (-F.col("best.at")).alias("at"))


def block_matches(docs: DataFrame, block: DataFrame, n_parts: int) -> DataFrame:
    """The columns of matches for every passage that matches a part of one block of a benchmark of so many parts."""
    spark = docs.sparkSession
    parts = [(r["item_id"], r["text"].split(" ")) for r in block.select("item_id", "text").toArrow().to_pylist()]
    result = "doc_id long, item_id long, similarity double, covered double, at long"
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, p in parts for w in p}))}
    if not vocabulary:
        return spark.createDataFrame([], result)
    encoded = materialise(encode(docs, vocabulary), "words")
    df, passages = document_frequencies(encoded, len(vocabulary))
    weights = np.log((passages + n_parts + 1) / (df + 1)) + 1e-3
    basis = latent_basis(encoded, weights, min(RANK, len(vocabulary)))
    if not basis.shape[1]:
        return spark.createDataFrame([], result)
    ids = np.array([i for i, _ in parts])
    numbers = [np.array([vocabulary[w] for w in p], np.int32) for _, p in parts]
    rarest = [set(sorted(set(n.tolist()), key=lambda w: (-weights[w], w))[:RAREST]) for n in numbers]
    table = (basis * weights[:, None]).astype(np.float32)
    latent = np.stack([sum(table[np.unique(n[i : i + STRIDE])].sum(0) for i in range(0, len(n), STRIDE)) for n in numbers])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    near = NEAR * np.sqrt(np.minimum(1, np.array([len(n) for n in numbers]) / WINDOW))
    shipped = spark.sparkContext.broadcast((table, latent, near.astype(np.float32), ids, numbers, Rarest(rarest, len(vocabulary))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        table, latent, near, ids, numbers, rarest = shipped.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            doc_ids = batch.column(0).to_pylist()
            p = Passages(texts)
            x = p.sums(table)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            answered, every = rarest.answered(p)
            retrieved = np.zeros(len(answered), bool)
            for lo in range(0, len(x), TILE):
                for first in range(0, len(latent), TILE):
                    i, j = np.nonzero(x[lo : lo + TILE] @ latent[first : first + TILE].T >= near[first : first + TILE])
                    retrieved |= np.isin(answered, (i + lo) * len(latent) + j + first, assume_unique=True)
            out = []
            for key, candidate in zip(answered[retrieved | every].tolist(), retrieved[retrieved | every].tolist(), strict=True):
                i, j = divmod(key, len(latent))
                start = int(p.at[i])
                words = np.frombuffer(texts[p.doc[i]], np.int32)[max(0, start - STRIDE) : start + WINDOW + STRIDE]
                if candidate:
                    covered = common_subsequence(numbers[j], words) / len(numbers[j])
                else:
                    covered = float(holds(words, numbers[j]))
                if covered >= COVERED:
                    out.append((doc_ids[p.doc[i]], int(ids[j]), float(x[i] @ latent[j]), covered, start))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], ["doc_id", "item_id", "similarity", "covered", "at"])

    return encoded.filter("doc_id is not null").mapInArrow(run, result)
