import datetime as dt
import random

import duckdb
import pytest

import __spark_entry__
from tidewell.operators import arrivals

ITEM = "ord long, source_id string, article_id string, guid string, title string, published_at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def by_loop(items, queue, days=7):
    """{ord: (status, doc)}, item by item."""
    known, guids, titles, out = {}, {}, {}, {}
    for _, s, a, g, title, at, doc in sorted(queue):
        known[a] = doc
        if g:
            guids[s, g] = doc
        titles[s, title.lower()] = (doc, at)
    for o, s, a, g, title, at, wanted in sorted(items):
        same = titles.get((s, title.lower()))
        close = same is not None and abs(same[1] - at) < dt.timedelta(days=days)
        if a in known or (g and (s, g) in guids) or close:
            docs = [known.get(a), guids.get((s, g)) if g else None, same[0] if close else None]
            out[o] = ("duplicate", next((d for d in docs if d is not None), None))
        elif not wanted:
            out[o] = ("unwanted", None)
        else:
            out[o] = ("new", None)
            known[a] = None
            if g:
                guids[s, g] = None
            titles[s, title.lower()] = (None, at)
    return out


def run(spark, items, queue):
    found = arrivals.first_arrivals(spark.createDataFrame(items, ITEM + ", wanted boolean"), spark.createDataFrame(queue, ITEM + ", doc string"))
    return {r.ord: (r.status, r.doc) for r in found.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_random_items(spark, seed):
    rnd = random.Random(seed)
    row = lambda o: (o, rnd.choice("ab"), f"id{rnd.randrange(60)}", rnd.choice([None, "", *map(str, range(40))]), f"T{rnd.randrange(8)}", T0 + dt.timedelta(hours=rnd.randrange(900)))
    queue = [(*row(o), f"q{o}") for o in range(12)]
    items = [(*row(o), rnd.random() < 0.8) for o in range(150)]
    assert run(spark, items, queue) == by_loop(items, queue)


def test_a_refused_item_hides_nothing_and_a_title_that_a_third_hold_takes_few_rounds(spark, monkeypatch):
    items = [
        (1, "s", "a", "g1", "One", T0, True),
        (2, "s", "b", "g1", "Two", T0, True),  # refused for its guid: neither its address nor its title becomes known
        (3, "s", "b", "g3", "Three", T0, True),
        (4, "s", "c", "g4", "Two", T0, True),
        (5, "s", "d", "g5", "Five", T0, False),  # not wanted: nor do its keys
        (6, "s", "d", "g6", "Six", T0, True),
        (7, "s", "a", None, "Seven", T0, False),  # not wanted, and a copy
        (8, "t", "h", "g1", "One", T0, True),  # guids and titles are their source's
        (9, "s", "i", None, "One", T0 + dt.timedelta(days=7), True),  # a title comes back after its days
        (10, "s", "j", None, "one!", T0 + dt.timedelta(days=1), True),  # the last accepted one counts: that of ord 9, six days on
        *[(100 + i, "hot", f"x{i}", None, "Hot", T0 + dt.timedelta(minutes=i), True) for i in range(60)],
    ]
    calls = []
    write = arrivals.materialise
    monkeypatch.setattr(arrivals, "materialise", lambda df, name: calls.append(name) or write(df, name))
    got = run(spark, items, [(0, "s", "q", "gq", "Queued", T0, "doc")])
    assert {o: s for o, (s, _) in got.items() if o < 100} == {1: "new", 2: "duplicate", 3: "new", 4: "new", 5: "unwanted", 6: "new", 7: "duplicate", 8: "new", 9: "new", 10: "duplicate"}
    assert [o for o, (s, _) in got.items() if o >= 100 and s == "new"] == [100]
    assert calls.count("far") <= 5


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [(1, "s", "a", None, "", T0, True)], []) == {1: ("new", None)}
    assert run(spark, [], [(1, "s", "a", None, "t", T0, "q")]) == {}


def test_query_against_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cursor = con.execute(__spark_entry__.oracle_sql()["first_arrivals"])
    names = [d[0] for d in cursor.description]
    got = __spark_entry__.queries()["first_arrivals"](spark, sf).select(*names)
    want = cursor.fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len({r[1] for r in want}) == 3
