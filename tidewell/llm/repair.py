"""Token ids in grammar-compressed shard files: Re-Pair, with random access to each document.

Ids are put in order of doc_id over ranges of documents; each range becomes shard records of about SHARD_IDS ids
(whole documents, so that a very long one is a shard of its own). Within a shard, rounds count all pairs of
neighbouring symbols, make nonterminals of the frequent ones and replace them from the left; later rounds pair up what
earlier ones made. A record holds the rules (two symbols each, in order), how many ids each rule expands to, the
remaining sequence, and the documents' ids and counts. Any document is decoded from the sequence's expanded
lengths without expanding what stands before it.

Defined results: a null text is encoded as the empty one and has only its end id; documents with equal ids of
theirs keep a fixed order (by the text's hash) and each has its own place; null doc_ids come first; an
empty table gives an empty file and no rows.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm.bpe import byte_symbols, unknown
from tidewell.llm.textbatch import gathered, slices
from tidewell.session import new_path

#: Ids of a shard record, give or take one document.
SHARD_IDS = 1 << 20
#: Documents that a task encodes, about.
RANGE_DOCUMENTS = 4096
#: Ranges of documents at most.
RANGES = 10_000
#: How often a pair must stand in the shard to become a rule, and the unused symbols that one round may take up.
FREQUENT, LAST = 12, 2048
#: Bytes of text that are encoded at once; one longer text is encoded alone.
ENCODED_BYTES = 16 << 20
#: Symbols are stored in two bytes, so ids and rules together stay below this.
SYMBOLS = 1 << 16
#: Distinct words that a worker remembers, give or take one slice's.
MEMORY = 600_000
TABLE_BITS = 18

FORMAT = "range int, shard int, doc_ids array<long>, counts array<long>, rules binary, lengths binary, sequence binary"


def gather(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of pool numbered which, one after the other."""
    n = counts[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(starts[which] - ends + n, n)]


class Memory:
    """Numbers of strings, and runs of ids for each number; strings are looked up many at a time."""

    def __init__(self):
        self.strings, self.pool = pa.array([], pa.string()), np.zeros(0, np.int32)
        self.start, self.count, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.strings)

    def find(self, strings: pa.Array) -> np.ndarray:
        """The number of each string, -1 if it isn't remembered."""
        return pc.index_in(strings, value_set=self.strings).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, strings: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """Remember new strings with their ids, one run after the other."""
        self.strings = pa.concat_arrays([self.strings, strings])
        self.start = np.append(self.start, len(self.pool) + np.cumsum(counts) - counts)
        self.count, self.used = np.append(self.count, counts), np.append(self.used, np.zeros(len(counts), np.int64))
        self.pool = np.append(self.pool, ids.astype(np.int32))

    def ids(self, which: np.ndarray) -> np.ndarray:
        return gather(self.pool, self.start, self.count, which)

    def forget(self, most: int) -> None:
        """Keep strings that were met more than once, the `most` most frequent at most."""
        again = np.flatnonzero(self.used > 1)
        if len(again) > most:
            again = np.sort(again[np.argsort(-self.used[again], kind="stable")[:most]])
        pool, counts = self.ids(again), self.count[again]
        self.strings = self.strings.take(pa.array(again))
        self.pool, self.count, self.used = pool, counts, np.zeros(len(again), np.int64)
        self.start = np.cumsum(counts) - counts


#: What a text that is cut into pieces must not hold: white space but single blanks and line feeds within.
UNEVEN = r"^[ \n]|[ \n]$|[ \n][ \n]|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class LibraryEncoder:
    """The tokenizers library with a memory of words.

    In texts whose white space is single blanks and line feeds within, no pre-token of the vocabulary crosses the start of
    a blank or line feed, so pieces from one to the next are encoded once and remembered. All other texts, and
    those with a special token's string, go to the library whole.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library, self.memory = Tokenizer.from_file(path), memory
        self.library.no_truncation()
        self.library.no_padding()
        self.pattern, self.symbols = regex.compile(public_tokenizers.PATTERN), dict(enumerate(byte_symbols()))
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.whole = "|".join([UNEVEN, *map(re.escape, special)])
        self.line_feed = len(self.library.encode("\n", add_special_tokens=False).ids)
        self.pieces, self.tokens = Memory(), Memory()

    def _library(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts

    def _symbols(self, token: str) -> str:
        """A pre-token in the vocabulary's letters for bytes."""
        return token.replace(" ", self.symbols[32]) if token.isascii() and token.isprintable() else token.encode().decode("latin-1").translate(self.symbols)

    def _cut(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that each begin with a blank or line feed, and how many each has. Such pieces stay apart in one text,
        whose pre-tokens go to the library's model and are remembered."""
        tokens = pa.array(self.pattern.findall("".join(pieces.to_pylist())), pa.string())
        if len(self.tokens) > self.memory:
            self.tokens = Memory()
        coded = tokens.dictionary_encode()
        number = self.tokens.find(coded.dictionary)
        if len(missing := np.flatnonzero(number < 0)):
            new = coded.dictionary.take(pa.array(missing))
            model = self.library.model.tokenize
            found = [[t.id for t in model(self._symbols(token))] for token in new.to_pylist()]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            number[missing] = len(self.tokens) + np.arange(len(new))
            self.tokens.add(new, np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts)
        which = number[coded.indices.to_numpy()]
        ends = np.cumsum(pc.utf8_length(pieces).to_numpy().astype(np.int64))
        owner = np.searchsorted(ends, np.cumsum(pc.utf8_length(tokens).to_numpy().astype(np.int64)), side="left")
        return self.tokens.ids(which), np.bincount(owner, self.tokens.count[which], len(pieces)).astype(np.int64)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Remember words and return their numbers; each as what follows a blank unless it begins with a line feed; what Python's tables don't know goes to the library whole."""
        led = pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise(" ", words, ""))
        odd = [c for c in set("".join(led.to_pylist())) if unknown(c)]
        strange = pc.match_substring_regex(led, "|".join(map(re.escape, odd))) if odd else pa.repeat(False, len(led))
        number = np.zeros(len(words), np.int64)
        for mask, encode in ((pc.invert(strange), self._cut), (strange, self._library)):
            if pc.any(mask).as_py():
                number[mask.to_numpy(zero_copy_only=False)] = len(self.pieces) + np.arange(pc.sum(mask).as_py())
                self.pieces.add(words.filter(mask), *encode(led.filter(mask)))
        return number

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts in one array, and how many each has; null counts as empty."""
        texts = texts.cast(pa.string()).fill_null("")
        some = pc.greater(pc.binary_length(texts), 0)
        whole = pc.and_(some, pc.match_substring_regex(texts, self.whole)).to_numpy(zero_copy_only=False)
        plain = some.to_numpy(zero_copy_only=False) & ~whole
        parts = []
        if plain.any():
            if len(self.pieces) > self.memory:
                self.pieces.forget(self.memory // 2)
            # a line feed before each text: its first piece, too, is one after a line feed then, and no other piece is empty
            led = pc.replace_substring(pc.binary_join_element_wise("\n", texts.filter(pa.array(plain)), ""), "\n", " \n")
            lists = pc.split_pattern(led, " ")
            words = lists.flatten()
            coded = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
            number = self.pieces.find(coded.dictionary)
            if len(missing := np.flatnonzero(number < 0)):
                number[missing] = self._learn(coded.dictionary.take(pa.array(missing)))
            which = number[coded.indices.to_numpy()]
            self.pieces.used += np.bincount(which, minlength=len(self.pieces))
            last = np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64) - 1)
            counts = np.diff(np.append(0, np.cumsum(self.pieces.count[which]))[last], prepend=0)
            ids, first = self.pieces.ids(which), np.cumsum(counts) - counts
            keep = np.ones(len(ids), bool)
            for i in range(self.line_feed):
                keep[first + i] = False
            parts.append((np.flatnonzero(plain), ids[keep], counts - self.line_feed))
        if whole.any():
            parts.append((np.flatnonzero(whole), *self._library(texts.filter(pa.array(whole)))))
        counts = np.zeros(len(texts), np.int64)
        for rows, _, n in parts:
            counts[rows] = n
        if len(parts) == 1:
            return parts[0][1], counts
        starts, out = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.int32)
        for rows, ids, n in parts:
            out[np.arange(len(ids)) + np.repeat(starts[rows] - np.cumsum(n) + n, n)] = ids
        return out, counts


@lru_cache(maxsize=2)
def worker_encoder(path: str) -> LibraryEncoder:
    """One encoder for all tasks of a Python worker. Its memory has no cycles to look for, so the cycle collector rests.

    A vocabulary too large for two bytes an id is refused: FORMAT has no room for it.
    """
    gc.disable()
    encoder = LibraryEncoder(path)
    if encoder.library.get_vocab_size(with_added_tokens=True) > SYMBOLS:
        raise ValueError(f"token ids of {path} don't fit in two bytes")
    return encoder


def _slot(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (a row of two symbols for each nonterminal base, base + 1, ...), their expanded lengths, the sequence.

    Rounds go on until no pair stands there FREQUENT times or all symbols are in use; each leaves half of them to later ones, whose pairs hold nonterminals.
    """
    seq = ids.astype(np.uint32)
    rules = np.zeros(0, np.uint32)  # left symbol in the high half, right symbol in the low half, as all pairs here
    since = 0  # the first symbol of the last round; pairs of older ones are known to be rare then
    while (room := SYMBOLS - base - len(rules)) > 0 and len(seq) > 1:
        at = np.flatnonzero((seq[:-1] >= since) | (seq[1:] >= since)) if since else np.arange(len(seq) - 1)
        pairs = seq[at] << np.uint32(16) | seq[at + 1]
        # slots that are met less often than a pair must be hold no such pair
        slot = _slot(pairs)
        many = np.bincount(slot, minlength=1 << TABLE_BITS)
        ordered = np.sort(pairs[many[slot] >= FREQUENT])
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(ordered)))
        often = np.flatnonzero(counts >= FREQUENT)
        every, most = len(often), room if room <= LAST else room // 2
        often = often[np.argsort(-counts[often], kind="stable")][:most]
        chosen = ordered[first[often]]
        _, index = np.unique(_slot(chosen), return_index=True)  # of pairs with one slot, the more frequent now, the others next round
        chosen = chosen[np.sort(index)]
        if not len(chosen):
            break
        table = np.full(1 << TABLE_BITS, -1, np.int32)
        table[_slot(chosen)] = np.arange(len(chosen))
        rule = table[slot]
        hit = np.flatnonzero(rule >= 0)
        hit = hit[chosen[rule[hit]] == pairs[hit]]
        where, rule = at[hit], rule[hit]
        follows = np.append(False, where[1:] == where[:-1] + 1)
        if follows.any():  # in a run of overlapping pairs every second one counts, from the run's start
            run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(where))))
            second = (np.arange(len(where)) - run) % 2 == 0
            where, rule = where[second], rule[second]
        used = np.flatnonzero(np.bincount(rule, minlength=len(chosen)))
        number = np.zeros(len(chosen), np.uint32)
        number[used] = base + len(rules) + np.arange(len(used))
        seq[where] = number[rule]
        stay = np.ones(len(seq), bool)
        stay[where + 1] = False
        seq = seq[stay]
        since = base + len(rules) if len(chosen) == every else 0
        rules = np.append(rules, chosen[used])
    rows = np.stack([rules >> np.uint32(16), rules & np.uint32(0xFFFF)], 1)
    lengths = [1] * base
    for a, b in rows.tolist():
        lengths.append(lengths[a] + lengths[b])
    return rows, np.array(lengths[base:], np.int64), seq


class Grammar:
    """A shard's rules, ready to expand symbols."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, base: int):
        self.lengths = np.append(np.ones(base, np.int64), lengths)
        pool = [np.arange(base, dtype=np.uint32)]
        self.starts = np.append(np.arange(base, dtype=np.int64), base + np.cumsum(lengths) - lengths)
        parts: list[np.ndarray] = []
        for a, b in rules.tolist():
            parts.append(np.concatenate([parts[x - base] if x >= base else pool[0][x : x + 1] for x in (a, b)]))
        self.pool = np.concatenate([pool[0], *parts])

    def expand(self, sequence: np.ndarray) -> np.ndarray:
        """All ids of a part of the sequence."""
        return gather(self.pool, self.starts, self.lengths, sequence)

    def between(self, sequence: np.ndarray, start: int, end: int) -> np.ndarray:
        """The ids from start to end of a shard; only symbols that reach into that span are expanded."""
        ends = np.cumsum(self.lengths[sequence])
        first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, end, side="left")
        before = ends[first - 1] if first else 0
        return self.expand(sequence[first : last + 1])[start - before : end - before]


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all documents, each with end_id behind, as shard records (FORMAT) in ascending order of the key."""
    schema = pa.schema(
        [("range", pa.int32()), ("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("rules", pa.binary()), ("lengths", pa.binary()), ("sequence", pa.binary())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        base = encoder.library.get_vocab_size(with_added_tokens=True)
        doc_ids: list = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        shard = 0

        def records(last: bool) -> Iterator[pa.RecordBatch]:
            """Records of what is gathered, each of SHARD_IDS ids and the rest of a document; what is left over stays unless it is the last."""
            nonlocal shard
            n, every = np.concatenate([np.zeros(0, np.int64), *counts]), np.concatenate([np.zeros(0, np.int32), *ids])
            ends = np.cumsum(n)
            at = done = 0
            while at < len(n):
                to = int(np.searchsorted(ends, done + SHARD_IDS)) + 1
                if to > len(n) and not last:
                    break
                to = min(to, len(n))
                rules, lengths, sequence = compress(every[done : ends[to - 1]], base)
                row = {"range": TaskContext.get().partitionId(), "shard": shard, "doc_ids": doc_ids[at:to], "counts": n[at:to]}
                row |= {"rules": rules.astype("<u2").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "sequence": sequence.astype("<u2").tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema)
                at, done, shard = to, int(ends[to - 1]), shard + 1
            del doc_ids[:at]
            counts[:], ids[:] = [n[at:]], [every[done:]]

        for batch in gathered(batches, text, ENCODED_BYTES):
            for part in slices(batch, text, ENCODED_BYTES):
                found, n = encoder.encode(part.column(1))
                doc_ids += part.column(0).to_pylist()
                counts.append(n + 1)
                ids.append(np.insert(found, np.cumsum(n), end_id))
                if sum(map(len, ids)) >= SHARD_IDS:
                    yield from records(False)
        yield from records(True)

    ranges = min(RANGES, max(1, -(-docs.count() // RANGE_DOCUMENTS)))
    rows = docs.select(F.col(key).cast("long").alias(key), text, F.xxhash64(text).alias("_order"))
    ordered = rows.repartitionByRange(ranges, key, "_order").sortWithinPartitions(key, "_order").select(key, text)
    ordered.mapInArrow(encode, FORMAT).write.parquet(path)


def read(spark, path: str, tokenizer: str) -> DataFrame:
    """Documents of the files under path: doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit integers)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = worker_encoder(tokenizer).library.get_vocab_size(with_added_tokens=True)
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                rules, sequence = (np.frombuffer(row[c], "<u2") for c in ("rules", "sequence"))
                ids = Grammar(rules.reshape(-1, 2), np.frombuffer(row["lengths"], "<u4").astype(np.int64), base).expand(sequence).astype("<u4")
                ends = np.cumsum(row["counts"])
                spans = zip((ends - row["counts"]).tolist(), ends.tolist(), strict=True)
                yield pa.record_batch(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "start": pa.array(ends - row["counts"] + row["before"], pa.int64()),
                        "n_tokens": pa.array(row["counts"], pa.int64()),
                        "ids": pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()),
                    }
                )

    files = spark.read.schema(FORMAT).parquet(path)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n)
    shards = files.select("range", "shard", total.alias("n"))
    ranges = shards.groupBy("range").agg(F.sum("n").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range in one task, RANGES at most; a row for each shard in its range's
    ranges = ranges.select("range", earlier(Window.orderBy("range")).alias("_ranges"))
    shards = shards.select("range", "shard", earlier(Window.partitionBy("range").orderBy("shard")).alias("_shards"))
    starts = shards.join(ranges, "range").select("range", "shard", (F.col("_ranges") + F.col("_shards")).alias("before"))
    return files.join(starts, ["range", "shard"]).select("before", *files.columns[2:]).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the documents' ids to new files in the shared folder and read them back."""
    path = new_path(docs.sparkSession, "ids")
    write(docs, tokenizer, path)
    return read(docs.sparkSession, path, tokenizer)

