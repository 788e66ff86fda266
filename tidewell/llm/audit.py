"""How filters interact: what each removes in every order of application, table-wide.

Documents run through an RDD that is routed by the xxhash of their text. A task first works on its own split: chains of
texts that share a fingerprint hold the full text and the least doc_id met; a row that isn't least in its chain is settled there and then, so of
a text that many rows hold one row a split (or a part of SPLIT_BYTES of it) is routed with its text. Routed rows arrive in order of (fingerprint, doc_id) from
spillable sorted streams, so that a task holds the chain of one fingerprint at a time, the first of each text in it is
the least and all later ones are emitted as copies. Each document becomes a mask of the filters it fails; combineByKey merges, part by
part, vectors that count documents by mask, and every order and step is read off a part's vector.

Defined results: a null text is empty; a null doc_id is no smaller than any other and copies nothing; rows that share text and doc_id
are no copies of each other; a part is a source, null as the empty string; of several labels of a document any 1 counts; unlabelled documents count
as neither good nor toxic; an empty table has no parts. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import permutations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialise

#: Bytes of distinct texts that a task holds before it routes them.
SPLIT_BYTES = 24 << 20
#: Bytes of text that a route gets, about; its sorted stream holds and spills no more.
ROUTE_BYTES = 16 << 20
#: What a chain's entry takes besides its text, about.
ENTRY_BYTES = 400

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
LETTERS, MARKS = bytes(range(65, 91)), b"#$%&*|"

RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: str, data: bytes) -> int:
    """The mask of filters A to D that a text (data in UTF-8) fails; bytes.split() cuts at blanks and 0x09 to 0x0D alone."""
    words = data.split()
    upper = len(data) - len(data.translate(None, LETTERS))
    found = len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * upper > 2 * len(text), len(data.translate(None, MARKS)) < len(data)
    return sum(1 << i for i, failed in enumerate(found) if failed)


def fingerprint(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def settled_here(rows: Iterator, hashed: Callable[[bytes], int], most: int) -> Iterator[tuple]:
    """((route, doc_id), (text or None, mask, {part: rows})) of rows (doc_id, part, text) of one split. Without text: settled."""
    chains: dict[int, list[list]] = {}
    held = 0

    def settled(doc_id, mask: int, parts: dict) -> tuple:
        return (fingerprint(str(doc_id).encode()), doc_id or 0), (None, doc_id, mask, dict(parts))

    def candidates() -> Iterator[tuple]:
        for print_, chain in chains.items():
            for data, doc_id, mask, parts in chain:
                yield (print_, doc_id), (data, doc_id, mask, dict(parts))
        chains.clear()

    for doc_id, part, text in rows:
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        print_ = hashed(data)
        chain = chains.setdefault(print_, []) if doc_id is not None else []
        entry = next((x for x in chain if x[0] == data), None)
        if doc_id is None:
            yield settled(None, failures(text, data), {part: 1})
        elif entry is None:
            chain.append([data, doc_id, failures(text, data), Counter({part: 1})])
            held += len(data) + ENTRY_BYTES
            if held > most:
                yield from candidates()
                held = 0
        elif doc_id > entry[1]:
            yield settled(doc_id, entry[2] | COPY, {part: 1})
        elif doc_id == entry[1]:
            entry[3][part] += 1
        else:
            yield settled(entry[1], entry[2] | COPY, entry[3])
            entry[1], entry[3] = doc_id, Counter({part: 1})
    yield from candidates()


def settled_there(rows: Iterator) -> Iterator[tuple]:
    """(doc_id, part, mask, rows) of what was routed, in order of (route, doc_id)."""
    at, chain = None, []
    for (print_, _), (data, doc_id, mask, parts) in rows:
        if data is not None:
            if print_ != at:
                at, chain = print_, []
            least = next((i for text, i in chain if text == data), None)
            if least is None:
                chain.append((data, doc_id))
            elif doc_id > least:
                mask |= COPY
        for part, n in parts.items():
            yield doc_id, part, mask, n


def masks(docs: DataFrame, hashed: Callable[[bytes], int] = fingerprint, most: int = SPLIT_BYTES) -> DataFrame:
    """doc_id, part, mask and how many rows have all three."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count(F.lit(1)) * ENTRY_BYTES).first()[0]
    many = total // ROUTE_BYTES + 1
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")), "text").rdd
    routed = rows.mapPartitions(lambda x: settled_here(x, hashed, most)).repartitionAndSortWithinPartitions(many, lambda key: key[0] % many)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return spark.createDataFrame(routed.mapPartitions(settled_there), f"doc_id {kind}, part string, mask int, n long", verifySchema=False)


def _add(vector: list[int], row: tuple) -> list[int]:
    mask, good, toxic, n = row
    for which, counted in enumerate((1, good, toxic)):
        vector[which << len(FILTERS) | mask] += counted * n
    return vector


def report(part: str, vector: list[int]) -> list[tuple]:
    """A part's rows, from how many documents (good ones, toxic ones) fail which filters."""
    size = 1 << len(FILTERS)
    every, good, toxic = (dict(enumerate(vector[i * size : (i + 1) * size])) for i in range(3))
    bit = {letter: 1 << i for i, letter in enumerate(FILTERS)}
    total = lambda counts, wanted: sum(n for mask, n in counts.items() if n and wanted(mask))
    rows, shapley = [], Counter()
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            own = bit[letter]
            lost = lambda mask, own=own, before=before: mask & own and not mask & before
            removed = total(every, lost)
            shapley[letter] += removed
            counts = total(every, lambda mask, gone=before | own: not mask & gone), removed, total(every, lambda mask, own=own, before=before: mask & own and mask & before)
            rows.append(("".join(order), step, *counts, every[own], total(good, lost), total(toxic, lost)))
            before |= own
    return [(part, *row, shapley[row[0][row[1] - 1]]) for row in rows]


def audit(docs: DataFrame, labels: DataFrame, hashed: Callable[[bytes], int] = fingerprint, most: int = SPLIT_BYTES) -> DataFrame:
    """RESULT: a row for each part, order of FILTERS and step."""
    spark = docs.sparkSession
    found = materialise(masks(docs, hashed, most), "masks").groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    one = lambda label: F.coalesce(F.max((F.col(label) == 1).cast("int")), F.lit(0)).alias(label)
    known = labels.filter("quality = 1 or toxic = 1").groupBy("doc_id").agg(one("quality"), one("toxic"))
    labelled = found.join(known, "doc_id", "left").na.fill(0, ["quality", "toxic"]).select("part", "mask", "quality", "toxic", "n")
    pairs = labelled.rdd.map(lambda r: (r[0], tuple(r[1:])))
    vectors = pairs.combineByKey(lambda row: _add([0] * (3 << len(FILTERS)), row), _add, lambda a, b: [x + y for x, y in zip(a, b, strict=True)])
    return spark.createDataFrame(vectors.flatMap(lambda kv: report(*kv)), RESULT, verifySchema=False)


def oracle() -> str:
    """DuckDB's words for audit."""
    count = lambda what, wanted: f"cast(coalesce(sum({what}) filter ({wanted}), 0) as bigint)"
    return f"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
f as (select doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w, min(doc_id) over (partition by t) as least from d),
known as (select doc_id, max(cast(coalesce(quality = 1, false) as int)) as good, max(cast(coalesce(toxic = 1, false) as int)) as toxic from labels group by doc_id),
m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
  cast(len(w) < 200 as int) + 2 * cast(100 * len(list_distinct(w)) < 50 * len(w) as int) + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) as int)
  + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(coalesce(doc_id > least, false) as int) as mask
  from f left join known using (doc_id)),
g as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, mask),
l as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(f, b)),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits from l a, l b, l c, l d, l e where a.b | b.b | c.b | d.b | e.b = 31),
s as (select filter_order, cast(step as int) as step, bits[step] as own, list_sum(list_prepend(0, bits[:step - 1])) as before from o, range(1, 6) t(step)),
r as (select part, filter_order, step, own,
  {count("n", "mask & (own | before) = 0")} as kept, {count("n", "mask & own > 0 and mask & before = 0")} as removed, {count("n", "mask & own > 0 and mask & before > 0")} as redundant,
  {count("n", "mask = own")} as unique_fails, {count("g.good", "mask & own > 0 and mask & before = 0")} as good_lost, {count("g.toxic", "mask & own > 0 and mask & before = 0")} as toxic_lost
  from g, (select filter_order, step, own, cast(before as int) as before from s) s group by part, filter_order, step, own)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from r"""
