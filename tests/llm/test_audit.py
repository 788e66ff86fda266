import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from tidewell.llm import audit, queries

WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = " ".join(f"word{i}" for i in range(220))
TEXTS = [
    None, "", "a few words", "a few words", LONG, LONG, LONG + " $", LONG.upper(), "same " * 300, LONG + "\x85\xa0\x1c", "É" * 30 + " CAPS", "x\ty\nz\x0bw\x0cv\ru " * 40, "same " * 300,
    "|", "ab" * 49 + "AB", "ab" * 48 + "AB", LONG, "\n", "日本 " * 250,
]


def failed(rows):
    """{row number: letters that it fails}, filter by filter."""
    out = []
    for i, t in rows:
        t = t or ""
        words = WORD.findall(t)
        a, b = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
        c, d = 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t))
        e = i is not None and any(j is not None and j < i and (s or "") == t for j, s in rows)
        out.append("".join(x for x, y in zip("ABCDE", (a, b, c, d, e), strict=True) if y))
    return out


def by_loop(rows, labels):
    """The report of rows (doc_id, source, text), applying each order to each document."""
    fails = failed([(i, t) for i, _, t in rows])
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {s or "" for _, s, _ in rows}:
        shapley, steps = Counter(), {}
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                n = Counter()
                for (i, s, _), x in zip(rows, fails, strict=True):
                    if (s or "") != part:
                        continue
                    gone = any(y in x for y in order[:k])
                    n["kept"] += not gone and f not in x
                    n["removed"] += not gone and f in x
                    n["redundant"] += gone and f in x
                    n["unique"] += x == f
                    n["good"] += not gone and f in x and i in good
                    n["toxic"] += not gone and f in x and i in toxic
                shapley[f] += n["removed"]
                steps[part, order, k + 1] = [n[y] for y in ("kept", "removed", "redundant", "unique", "good", "toxic")]
        out |= {(p, o, k): (*v, shapley[o[k - 1]]) for (p, o, k), v in steps.items()}
    return out


def results(df):
    rows = df.collect()
    found = {tuple(r)[:3]: tuple(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


LABELS = [(1, 1, 0), (2, 0, 1), (4, 1, 1), (5, None, 1), (5, 1, None), (8, 0, 0), (99, 1, 1), (None, 1, 1)]


@pytest.mark.parametrize("hashed,most", [(audit.fingerprint, audit.SPLIT_BYTES), (lambda data: len(data) % 2, 2000), (lambda data: 7, 1)])
def test_report_is_that_of_a_loop(spark, hashed, most):
    """With fingerprints of their own, with two chains for all texts, with one and nothing settled at the first task."""
    rows = [(i * 7 % 19, "web" if i % 3 else None if i % 2 else "", t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, s, t, 1, "x") for i, s, t in rows], "doc_id long, source string, text string, part int, mask string").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert results(audit.audit(docs, labels, hashed, most)) == by_loop(rows, LABELS)


def test_odd_ids(spark):
    """Null and repeated doc_ids, a text that a third of the rows hold, no rows."""
    rows = [(None, "a", LONG), (None, "a", LONG), (1, "a", LONG), (1, "a", LONG), (1, "b", LONG), (1, "b", "other"), (0, None, "other"), *[(5 + i, "c", "hot") for i in range(8)]]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert results(audit.audit(docs, labels)) == by_loop(rows, LABELS)
    assert audit.audit(docs.limit(0), labels.limit(0)).collect() == []


def test_a_frequent_text_is_routed_once_a_split():
    rows = [(i, "s", "the same") for i in range(1000)]
    out = list(audit.settled_here(iter(rows[::-1]), audit.fingerprint, 1 << 20))
    assert sum(value[0] is not None for _, value in out) == 1 and len(out) == 1000


def test_query_against_its_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    cursor = con.execute(audit.oracle())
    names = [d[0] for d in cursor.description]
    got = queries.op12_filter_audit(spark, sf).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(cursor.fetchall())
