import datetime as dt
import random
import tempfile

import duckdb
import pytest

import __spark_entry__
from tidewell.operators import commits

OLD, NEW = "2026-09-01T00:00:00.000Z", "2026-10-20T00:00:00.000Z"
A, B = "queue.a_3f2a9c0d1e2b4a5f", "queue.a_ffffffffffffffff"
BOUNDS = dt.datetime(2026, 9, 27), dt.datetime(2026, 9, 12)


def m(seq, kind, id=None, fields=None, sets=None, fills=None, other=None, pending=None, rejected=None):
    return (seq, kind, id, fields, sets, fills, other, pending, rejected)


def doc(**more):
    return {"_type": "newsArticle", "status": "pending_review", "headline": "H", "lastSeenAt": NEW, **more}


def frame(spark, rows):
    return spark.createDataFrame(rows, commits.MUTATION)


def prune(seq):
    return m(seq, "delete", pending=BOUNDS[0], rejected=BOUNDS[1])


def test_guard(spark):
    state = {"_id": "newsAggregatorState", "_type": "newsAggregatorState", "sources": "[]"}
    good = [
        m(0, "createIfNotExists", A, doc()), m(1, "patch", A, sets={"lastSeenAt": NEW, "otherSources": "[]"}, fills={"excerpt": "x"}), m(2, "patch", "drafts." + A, sets={"excerpt": "x"}),
        prune(3), m(4, "createOrReplace", "newsAggregatorState", state),
    ]
    bad = [
        (m(0, "createIfNotExists", A, doc(status="published")), "must be pending_review"), (m(0, "createIfNotExists", A, doc(approval="{}")), 'may not write "approval"'),
        (m(0, "createIfNotExists", A, doc(featured="true")), 'may not write "featured"'), (m(0, "createIfNotExists", "a_3f2a9c0d1e2b4a5f", doc()), "not a queue id"),
        (m(0, "createIfNotExists", "drafts." + A, doc()), "not a queue id"), (m(0, "createIfNotExists", A, doc(_type="sponsorItem")), "type must be"), (m(0, "createIfNotExists", A), "type must be"),
        (m(0, "createIfNotExists", A, doc(excerpt="x" * 281)), "too long"), (m(0, "createIfNotExists", A, doc(classification='{"suggestedSummary": "' + "x" * 281 + '"}')), "too long"),
        (m(0, "patch", A, sets={"headline": "x"}), 'may not change "headline"'), (m(0, "patch", A, sets={"approval.approvedById": "x"}), 'may not change "approval"'),
        (m(0, "patch", A, fills={"slug": "x"}), "may not change"), (m(0, "patch", A, sets={"excerpt": "x"}, other=["unset"]), 'not allowed: "unset"'), (m(0, "patch", "sponsor-1", sets={"excerpt": "x"}), "cannot patch"),
        (m(0, "patch", A), "empty patch"), (m(0, "patch", A, fills={"excerpt": "x" * 281}), "too long"), (m(0, "delete", A, pending=BOUNDS[0], rejected=BOUNDS[1]), "prune rule"), (m(0, "delete", pending=BOUNDS[0]), "prune rule"),
        (m(0, "createOrReplace", A, doc()), "only the aggregator state"), (m(0, "createOrReplace", "newsAggregatorState", {**state, "headline": "x"}), 'may not hold "headline"'), (m(0, "create", A, doc()), "not allowed"), (m(0, None), "not allowed"),
    ]
    rows = frame(spark, good + [b for b, _ in bad]).withColumn("reason", commits.refusal()).collect()
    assert [r.reason for r in rows[: len(good)]] == [None] * len(good)
    for row, (_, want) in zip(rows[len(good) :], bad, strict=True):
        assert row.reason and want in row.reason


def test_prune_rule(spark):
    cases = [
        (A, {"status": "pending_review", "lastSeenAt": OLD}, True), ("drafts." + A, {"status": "pending_review", "lastSeenAt": OLD}, True), (A, {"status": "pending_review", "lastSeenAt": NEW}, False),
        (A, {"status": "rejected", "statusChangedAt": OLD, "lastSeenAt": NEW}, True), (A, {"status": "rejected", "statusChangedAt": NEW}, False), (A, {"status": "rejected", "lastSeenAt": OLD}, True),
        *[(A, {"status": s, "lastSeenAt": OLD, "statusChangedAt": OLD}, False) for s in ("approved", "published", "archived")], (A, {"status": "pending_review", "lastSeenAt": "soon"}, False), ("x", {"status": "rejected", "lastSeenAt": OLD}, False),
    ]
    rows = spark.createDataFrame([(i, {"_type": "newsArticle", **f}) for i, f, _ in cases], commits.DOCUMENT)
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(commits.pruned(*map(F.lit, BOUNDS))).collect()] == [w for *_, w in cases]


def by_loop(docs, mutations):
    """(documents, counts), mutation by mutation; None if a patch finds nothing."""
    docs, counts = {i: dict(f) for i, f in docs.items()}, {"created": 0, "patched": 0, "deleted": 0}
    for _, kind, id, fields, sets, fills, *_ in sorted(mutations, key=lambda x: x[0]):
        if kind == "createIfNotExists" and id not in docs:
            docs[id] = dict(fields)
            counts["created"] += 1
        elif kind == "createOrReplace":
            docs[id] = dict(fields)
        elif kind == "patch":
            if id not in docs:
                return None
            for f, v in (fills or {}).items():
                docs[id].setdefault(f, v)
            docs[id].update(sets or {})
            counts["patched"] += 1
        elif kind == "delete":
            gone = [i for i, f in docs.items() if f.get("status") == "pending_review" and f.get("lastSeenAt", NEW) == OLD]
            for i in gone:
                del docs[i]
            counts["deleted"] += len(gone)
    return docs, counts


@pytest.mark.parametrize("seed", range(3))
def test_replay_is_that_of_a_loop(spark, seed):
    """Random batches with a hot document, deletes between, and documents that come back after they were deleted."""
    rnd = random.Random(seed)
    ids = [f"queue.a_{i:016x}" for i in range(8)]
    held = {i: doc(lastSeenAt=rnd.choice([OLD, NEW]), **({"excerpt": "held"} if rnd.random() < 0.5 else {})) for i in ids[:4]}
    rows, present = [], set(ids[:4])
    for seq in range(60):
        kind = rnd.choice(["create", "patch", "patch", "patch", "state", "delete" if seq % 25 == 24 else "patch"])
        id = ids[0] if rnd.random() < 0.4 else rnd.choice(ids)
        if kind == "create":
            rows.append(m(seq, "createIfNotExists", id, doc(lastSeenAt=rnd.choice([OLD, NEW]), headline=str(seq))))
            present.add(id)
        elif kind == "state":
            rows.append(m(seq, "createOrReplace", "newsAggregatorState", {"_type": "newsAggregatorState", "updatedAt": str(seq)}))
        elif kind == "delete":
            rows.append(prune(seq))
        else:
            rows.append(m(seq, "patch", id, sets={f: rnd.choice([OLD, NEW]) for f in rnd.sample(["lastSeenAt", "otherSources"], rnd.randint(0, 2))}, fills={"excerpt": str(seq), "sourceImageUrl": str(seq)}))
    rnd.shuffle(rows)
    docs = spark.createDataFrame(list(held.items()), commits.DOCUMENT)
    want = by_loop(held, rows)
    if want is None:
        with pytest.raises(ValueError, match="not found"):
            commits.replay(docs, frame(spark, rows))
        rows = [r for r in rows if r[1] != "patch" or r[2] in ids[:1]] + [m(-1, "createIfNotExists", ids[0], doc())]
        rows = [r for r in rows if r[1] != "delete"]
        want = by_loop(held, rows)
    after, counts = commits.replay(docs, frame(spark, rows))
    assert ({r.id: r.fields for r in after.collect()}, counts) == want


def test_batches_are_stored_once_and_whole(spark):
    path = tempfile.mkdtemp() + "/queue"
    assert commits.stored(spark, path).collect() == []
    first = frame(spark, [m(0, "createIfNotExists", A, doc(excerpt="e"))])
    assert commits.commit(first, 0, path) == {"created": 1, "patched": 0, "deleted": 0}
    assert commits.commit(frame(spark, [m(0, "createIfNotExists", A, doc(headline="other"))]), 0, path) is None  # brought again
    with pytest.raises(ValueError, match="may not change"):
        commits.commit(frame(spark, [m(0, "createIfNotExists", B, doc()), m(1, "patch", A, sets={"headline": "x"})]), 1, path)
    with pytest.raises(ValueError, match="not found"):
        commits.commit(frame(spark, [m(0, "patch", B, sets={"excerpt": "x"}), m(1, "createIfNotExists", B, doc())]), 1, path)
    assert [(r.id, r.fields["headline"], r.fields["excerpt"]) for r in commits.stored(spark, path).collect()] == [(A, "H", "e")]
    assert commits.commit(frame(spark, [m(0, "patch", A, sets={"lastSeenAt": OLD}, fills={"excerpt": "ignored"})]), 1, path)["patched"] == 1
    assert commits.commit(frame(spark, []), 2, path) == {"created": 0, "patched": 0, "deleted": 0}
    row = commits.stored(spark, path).first()
    assert row.fields["lastSeenAt"] == OLD and row.fields["excerpt"] == "e"
    assert commits.commit(frame(spark, [prune(0)]), 3, path)["deleted"] == 1 and commits.stored(spark, path).collect() == []


def test_query_against_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cursor = con.execute(__spark_entry__.oracle_sql()["queue_commit"])
    names = [d[0] for d in cursor.description]
    got = __spark_entry__.queries()["queue_commit"](spark, sf).select(*names)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(cursor.fetchall(), key=str)
