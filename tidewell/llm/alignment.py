"""How two tokenizers cut the same texts, and how usual each link of two tokens is corpus-wide.

Every text is encoded by both sides. Byte offsets where tokens of both end cut it into groups; tokens whose
byte ranges overlap are linked. A slice of texts becomes postings: for each A id, the B ids it is linked with and, for each of
those, the documents and the links' number in them. An id pair's count is the number of documents that hold it.

Counts are summed up twice before they are shuffled (a task's pairs, then Spark's map side) and collected by A id into a profile (B ids and counts, at
most one for each id of B). Postings are shuffled by A id and sorted by Spark, which spills; a task reads each id's
profile, takes its maximum, and then its postings, batch by batch, never a group as a whole, and emits what they add to documents. Ids with
over SPLIT postings are dealt out by slice over several keys, each with the profile; which these are is
broadcast, at most a row for each id of the vocabulary. Contributions are summed by document within slices.

Defined results: texts that are null or empty, or whose joined token bytes of a side differ from blank + text, have no tokens: zeros
and an empty groups_sha256. Special tokens' strings are plain text. Each row is a document of its own, whatever its doc_id. An empty table gives
an empty table; input columns but doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bpe import byte_symbols
from tidewell.llm.repair import LibraryEncoder, gather
from tidewell.llm.textbatch import gathered, slices
from tidewell.session import materialise

#: Bytes of text that are aligned at once; one longer text alone.
SLICE_BYTES = 4 << 20
#: Postings of an A id that one key takes at most, give or take a slice's.
SPLIT = 1 << 20
#: Distinct pairs whose counts a task holds, and documents whose sums it holds, before it emits them.
HELD_PAIRS, HELD_DOCUMENTS = 2_000_000, 2_000_000
#: Bytes of postings that are looked up at once.
POSTING_BYTES = 1 << 20
#: Documents of a slice are numbered in two bytes; multiplicities take one, and WIDE and more go on in `wide`.
DOCUMENTS, WIDE = 1 << 16, 255

DOC, PAIR, POSTING = 0, 1, 2
#: Rows of what encoding writes: documents of a slice, counts of pairs in a task, postings of an A id in a slice.
ENCODED = (
    "kind int, slice long, doc_ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "a int, b int, n long, bs binary, ns binary, docs binary, ms binary, wide binary"
)
RESULT = "doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Tokens:
    """The bytes of a vocabulary's tokens, and their ids in decimal with what may follow them."""

    def __init__(self, tokens: list[bytes], end: bytes):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.pool, self.starts = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(self.lengths) - self.lengths
        self.inner, self.last = (np.array([b"%d" % i + x for i in range(len(tokens))], object) for x in (b",", end))

    def spelled(self, ids: np.ndarray) -> bytes:
        return gather(self.pool, self.starts, self.lengths, ids).tobytes()


class Sides:
    """Both tokenizers: A a byte-level file of the tokenizers library, B a sentencepiece model that adds a blank itself."""

    def __init__(self, a_path: str, b_path: str):
        self.encoder = LibraryEncoder(a_path)
        library = self.encoder.library
        library.encode_special_tokens = True
        value = {s: i for i, s in enumerate(byte_symbols())}
        names = [library.id_to_token(i) or "" for i in range(library.get_vocab_size(with_added_tokens=True))]
        self.a = Tokens([bytes(map(value.__getitem__, t)) if all(c in value for c in t) else t.encode() for t in names], b"|")
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        as_byte = [re.fullmatch("<0x([0-9A-F]{2})>", p) for p in pieces]
        self.b = Tokens([bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for p, m in zip(pieces, as_byte, strict=True)], b";")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and how many each text has, ids of B and how many.

        A's encoder gets a letter before the blank; as a word ends before a blank, the letter is its first token, which goes.
        """
        ids, counts = self.encoder.encode(pa.array(["a " + t for t in texts], pa.string()))
        first = np.cumsum(counts) - counts
        b_ids = self.model.encode(texts, num_threads=1)
        b_counts = np.fromiter(map(len, b_ids), np.int64, len(b_ids))
        return np.delete(ids, first), counts - 1, np.fromiter((i for x in b_ids for i in x), np.int32, int(b_counts.sum())), b_counts


@lru_cache(maxsize=1)
def worker_sides(a_path: str, b_path: str) -> Sides:
    return Sides(a_path, b_path)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive parts of an array as binary values."""
    offsets = np.append(0, ends * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


class Aligned:
    """The texts of one slice: for each text its numbers and digest, and for each link its text, A id and B id."""

    def __init__(self, sides: Sides, texts: list[str | None]):
        size = len(texts)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(size, np.int64) for _ in range(4))
        self.digests = [""] * size
        self.doc, self.a, self.b = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        live = [i for i, t in enumerate(texts) if t]
        if not live:
            return
        a, counts_a, b, counts_b = sides.encode([texts[i] for i in live])
        same = self._spells(sides, [(" " + texts[i]).encode("utf-8", "surrogatepass") for i in live], a, counts_a, b, counts_b)
        a, b, counts_a, counts_b = a[np.repeat(same, counts_a)], b[np.repeat(same, counts_b)], counts_a[same], counts_b[same]
        which = np.array(live)[same]
        if not len(which):
            return
        # both sides' bytes are the same, so one line of byte offsets serves them; bit 1: a token of A ends, bit 2: one of B
        ends_a, ends_b = np.cumsum(sides.a.lengths[a]), np.cumsum(sides.b.lengths[b])
        marks = np.zeros(int(ends_a[-1]) + 1, np.uint8)
        marks[ends_a] = 1
        marks[ends_b] |= 2
        marks = marks[np.flatnonzero(marks)]  # of segments; each lies in one token of A and one of B, and is a link
        of_a, of_b, both = marks & 1, marks >> 1, marks == 3
        at_a, at_b = np.cumsum(of_a, dtype=np.int64) - of_a, np.cumsum(of_b, dtype=np.int64) - of_b
        texts_a = np.repeat(which, counts_a)
        self.doc, self.a, self.b = texts_a[at_a], a[at_a].astype(np.int64), b[at_b].astype(np.int64)
        self.n_a[which], self.n_b[which] = counts_a, counts_b
        self.n_links, self.n_groups = np.bincount(self.doc, minlength=size), np.bincount(self.doc[both], minlength=size)
        # the order of ids in the digest: each group's of A, then its of B
        group = np.cumsum(both) - both
        until_a, until_b = at_a[both] + 1, np.append(0, at_b[both] + 1)
        written = np.empty(len(a) + len(b), object)
        last_a, last_b = both[of_a == 1], both[of_b == 1]
        written[np.arange(len(a)) + until_b[group[of_a == 1]]] = np.where(last_a, sides.a.last[a], sides.a.inner[a])
        written[np.arange(len(b)) + until_a[group[of_b == 1]]] = np.where(last_b, sides.b.last[b], sides.b.inner[b])
        end = 0
        for i, n in zip(which.tolist(), (counts_a + counts_b).tolist(), strict=True):
            self.digests[i] = hashlib.sha256(b"".join(written[end : end + n].tolist())[:-1]).hexdigest()
            end += n

    @staticmethod
    def _spells(sides: Sides, wanted: list[bytes], a, counts_a, b, counts_b) -> np.ndarray:
        """Whether both sides' tokens spell each text, all of it and nothing else."""
        good = np.ones(len(wanted), bool)
        for tokens, ids, counts in ((sides.a, a, counts_a), (sides.b, b, counts_b)):
            spelled, ends = tokens.spelled(ids), np.append(0, np.cumsum(tokens.lengths[ids]))[np.append(0, np.cumsum(counts))]
            good &= [spelled[x:y] == w for w, x, y in zip(wanted, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return good

    def postings(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """pair (A id * width + B id), text and number of links of each distinct pair of each text, in that order; where runs of pairs and of A ids begin."""
        size = max(1, len(self.n_a))
        keys, many = np.unique((self.a * width + self.b) * size + self.doc, return_counts=True)
        pair = keys // size
        return pair, keys % size, many, runs(pair), runs(pair // width)


class PairCounts:
    """In how many documents a task has met each pair."""

    def __init__(self):
        self.pairs, self.counts = [], []
        self.size = 0

    def add(self, pairs: np.ndarray, counts: np.ndarray) -> None:
        self.pairs.append(pairs)
        self.counts.append(counts)
        self.size += len(pairs)
        if self.size > 2 * HELD_PAIRS:
            self._sum()

    def _sum(self) -> None:
        pairs, counts = np.concatenate([np.zeros(0, np.int64), *self.pairs]), np.concatenate([np.zeros(0, np.int64), *self.counts])
        order = np.argsort(pairs, kind="stable")
        starts = runs(pairs[order])[:-1]
        self.pairs, self.counts = [pairs[order][starts]], [np.add.reduceat(counts[order], starts) if len(starts) else counts]
        self.size = len(starts)

    def taken(self, least: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
        """All pairs and counts so far, which are then forgotten; None below `least`."""
        if self.size <= least:
            return None
        self._sum()
        if self.size <= least:
            return None
        found = self.pairs[0], self.counts[0]
        self.__init__()
        return found


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """ENCODED rows of all documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ENCODED.format(kind=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = worker_sides(a_path, b_path)
        width = len(sides.b.lengths)
        number = TaskContext.get().partitionId() << 20
        counts, id_type = PairCounts(), pa.int64()
        longs, binary = pa.list_(pa.int64()), pa.binary()

        def rows(many: int, what: int, columns: dict) -> pa.RecordBatch:
            types = {
                "kind": pa.int32(), "slice": pa.int64(), "doc_ids": pa.list_(id_type), "n_a": longs, "n_b": longs, "n_groups": longs, "n_links": longs, "groups_sha256": pa.list_(pa.string()),
                "a": pa.int32(), "b": pa.int32(), "n": pa.int64(), "bs": binary, "ns": binary, "docs": binary, "ms": binary, "wide": binary,
            }
            columns["kind"] = np.full(many, what)
            return pa.record_batch({n: (columns[n] if isinstance(columns[n], pa.Array) else pa.array(columns[n], t)) if n in columns else pa.nulls(many, t) for n, t in types.items()})

        def pair_rows(found) -> Iterator[pa.RecordBatch]:
            if found:
                yield rows(len(found[0]), PAIR, {"a": found[0] // width, "b": found[0] % width, "n": found[1]})

        for batch in gathered(batches, "text", SLICE_BYTES):
            id_type = batch.schema.field("doc_id").type
            for part in slices(batch, "text", SLICE_BYTES):
                for at in range(0, part.num_rows, DOCUMENTS):
                    piece = part.slice(at, DOCUMENTS)
                    found = Aligned(sides, piece.column("text").to_pylist())
                    pair, doc, many, by_pair, by_a = found.postings(width)
                    yield rows(1, DOC, {
                        "slice": [number], "doc_ids": [piece.column("doc_id").to_pylist()], "n_a": [found.n_a], "n_b": [found.n_b], "n_groups": [found.n_groups],
                        "n_links": [found.n_links], "groups_sha256": [found.digests],
                    })
                    if len(pair):
                        distinct, docs_of = pair[by_pair[:-1]], np.diff(by_pair)
                        counts.add(distinct, docs_of)
                        pairs_until = np.searchsorted(by_pair[:-1], by_a[1:])
                        wide = many >= WIDE
                        yield rows(len(by_a) - 1, POSTING, {
                            "slice": np.full(len(by_a) - 1, number), "a": pair[by_a[:-1]] // width, "n": np.diff(by_a),
                            "bs": binaries((distinct % width).astype("<u4"), pairs_until), "ns": binaries((docs_of - 1).astype("<u2"), pairs_until),
                            "docs": binaries(doc.astype("<u2"), by_a[1:]), "ms": binaries(np.minimum(many, WIDE).astype("u1"), by_a[1:]),
                            "wide": binaries(many[wide].astype("<u8"), np.append(0, np.cumsum(wide))[by_a[1:]]),
                        })
                        yield from pair_rows(counts.taken(HELD_PAIRS))
                    number += 1
        yield from pair_rows(counts.taken())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Sums:
    """What postings add to documents (slice * DOCUMENTS + number in it), as sorted arrays."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, docs: np.ndarray, best: np.ndarray, total: np.ndarray) -> None:
        order = np.argsort(docs, kind="stable")
        starts = runs(docs[order])[:-1]
        if len(starts):
            self.parts.append((docs[order][starts], np.add.reduceat(best[order], starts), np.add.reduceat(total[order], starts)))
            self.size += len(starts)

    def rows(self, least: int = -1) -> Iterator[pa.RecordBatch]:
        """All sums by slice, which are then forgotten; none at or below `least` documents."""
        if self.size > max(least, 0):
            merged = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            self.__init__()
            self.add(*merged)
            if self.size > max(least // 2, 0):
                docs, best, total = self.parts[0]
                at = runs(docs // DOCUMENTS)
                yield pa.record_batch({
                    "slice": pa.array(docs[at[:-1]] // DOCUMENTS, pa.int64()), "docs": binaries((docs % DOCUMENTS).astype("<u2"), at[1:]),
                    "best": binaries(best, at[1:]), "total": binaries(total, at[1:]),
                })
                self.__init__()


def contributions(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """What postings add to the documents of slices, from profiles (kind 0) and postings in order of a, salt and kind."""
    sums = Sums()
    known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)  # pairs in order, counts, whether that is the A id's highest
    last = -1  # the A id of the last profile

    for batch in merged_batches(batches):
        is_profile = batch.column("kind").to_numpy() == 0
        ids = batch.column("a").to_numpy().astype(np.int64)
        if is_profile.any():
            profiles = batch.filter(pa.array(is_profile))
            a = profiles.column("a").to_numpy().astype(np.int64)
            new = np.flatnonzero(np.append(a[0] != last, a[1:] != a[:-1]))  # an id that is dealt out may come again
            if len(new):
                a, profiles = a[new], profiles.take(pa.array(new))
                sizes = np.diff(profiles.column("bs").offsets.to_numpy())
                counts = profiles.column("counts").flatten().to_numpy()
                highest = np.maximum.reduceat(counts, np.cumsum(sizes) - sizes)
                fresh = np.repeat(a, sizes) * width + profiles.column("bs").flatten().to_numpy(), counts, counts == np.repeat(highest, sizes)
                keep = np.searchsorted(known[0], last * width) if last >= 0 else len(known[0])  # of earlier profiles the last alone is still asked for
                known = tuple(np.concatenate([x[keep:], y]) for x, y in zip(known, fresh, strict=True))
                last = int(a[-1])
        posted = batch.filter(pa.array(~is_profile))
        if posted.num_rows:
            fields = dict(zip(("bs", "ns", "docs", "ms", "wide"), posted.column("posted").flatten(), strict=True))
            read = {n: np.frombuffer(b"".join(fields[n].to_pylist()), t) for n, t in (("bs", "<u4"), ("ns", "<u2"), ("docs", "<u2"), ("ms", "u1"), ("wide", "<u8"))}
            lengths = lambda n, size: np.fromiter(map(len, fields[n].to_pylist()), np.int64, posted.num_rows) // size
            pairs = np.repeat(ids[~is_profile], lengths("bs", 4)) * width + read["bs"]
            at = np.repeat(np.searchsorted(known[0], pairs), read["ns"].astype(np.int64) + 1)
            many = read["ms"].astype(np.int64)
            many[many == WIDE] = read["wide"]
            docs = np.repeat(posted.column("slice").to_numpy(), lengths("docs", 2)) * DOCUMENTS + read["docs"]
            sums.add(docs, many * known[2][at], many * known[1][at])
            yield from sums.rows(2 * HELD_DOCUMENTS)
    yield from sums.rows()


def merged_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have POSTING_BYTES."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= POSTING_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RESULT rows from the documents of slices, each slice followed by what is added to them."""
    held = best = total = None

    def done() -> pa.RecordBatch:
        row = held.to_pydict()
        flat = {n: held.column(n).flatten() for n in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256") if row}
        return pa.record_batch({
            "doc_id": flat["doc_ids"], "n_a": flat["n_a"], "n_b": flat["n_b"], "n_groups": flat["n_groups"], "n_links": flat["n_links"], "n_best": pa.array(best), "count_sum": pa.array(total),
            "groups_sha256": flat["groups_sha256"],
        })

    for batch in batches:
        for i, kind in enumerate(batch.column("kind").to_pylist()):
            if kind == DOC:
                if held is not None:
                    yield done()
                held = batch.slice(i, 1)
                best, total = (np.zeros(len(held.column("doc_ids")[0]), np.int64) for _ in range(2))
            else:
                docs, more_best, more_total = (np.frombuffer(batch.column(n)[i].as_py(), t) for n, t in (("docs", "<u2"), ("best", "<i8"), ("total", "<i8")))
                best[docs] += more_best
                total[docs] += more_total
    if held is not None:
        yield done()


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """RESULT: a row for each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialise(encoded(docs, a_path, b_path), "encoded")
    pairs = rows.filter(f"kind = {PAIR}").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # a row for each id of A, with at most one entry for each id of B
    profiles = pairs.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("linked"), F.sum("n").alias("postings"))
    profiles = materialise(profiles, "profiles")
    split = F.ceil(F.col("postings") / SPLIT).cast("long")
    # at most a row for each id of A
    salts = F.broadcast(profiles.filter(F.col("postings") > SPLIT).select("a", split.alias("_salts")))
    profiles = profiles.select("a", F.explode(F.sequence(F.lit(0).cast("long"), split - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("linked.b").alias("bs"), F.col("linked.n").alias("counts"))
    postings = rows.filter(f"kind = {POSTING}").join(salts, "a", "left")
    salt = F.coalesce(F.pmod(F.xxhash64("slice"), F.col("_salts")), F.lit(0)).cast("long")
    postings = postings.select("a", salt.alias("salt"), F.lit(1).alias("kind"), "slice", F.struct("bs", "ns", "docs", "ms", "wide").alias("posted"))
    stream = profiles.unionByName(postings, allowMissingColumns=True).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    model = sentencepiece.SentencePieceProcessor(model_file=b_path)
    width = model.vocab_size()
    added = stream.mapInArrow(lambda batches: contributions(batches, width), "slice long, docs binary, best binary, total binary").withColumn("kind", F.lit(DOC + 1))
    slices_ = rows.filter(f"kind = {DOC}").select("kind", "slice", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    ordered = slices_.unionByName(added, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", "kind")
    return ordered.mapInArrow(summed, RESULT.format(kind=kind))
