import datetime as dt
import random
from fractions import Fraction

from tidewell.streaming import composite

START = dt.datetime(2024, 1, 1)


def plainly(rows, limits):
    """One request after the other, in fractions."""
    out, state = [], {}
    for id, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        held, since = state.get(key, ([Fraction(c) for c, _ in limits], at))
        passed = Fraction(round((at - since).total_seconds() * 1_000_000), 1_000_000)
        held = [min(Fraction(c), h + passed * c / Fraction(w)) for h, (c, w) in zip(held, limits, strict=True)]
        wait = 0
        for i, (c, w) in enumerate(limits):
            if held[i] < 1:
                wait = max(1, -int((held[i] - 1) * Fraction(w) // c))
                break
            held[i] -= 1
        state[key] = (held, at)
        out.append((id, key, wait == 0, wait))
    return sorted(out, key=repr)


def run(spark, rows, limits, kind="long"):
    df = spark.createDataFrame(rows, f"n long, who {kind}, at timestamp_ntz")
    return sorted(map(tuple, composite.limited(df, "who", "at", "n", limits).collect()), key=repr)


def test_five_a_minute(spark):
    rows = [(i, "a", START) for i in range(6)] + [(6, "a", START + dt.timedelta(seconds=13))]
    got = run(spark, rows, [(5, 60)], "string")
    assert [r[2:] for r in got] == [(True, 0)] * 5 + [(False, 12), (True, 0)]


def test_first_limits_are_debited_by_requests_that_later_ones_refuse(spark):
    rows = [(i, "a", START + dt.timedelta(seconds=30 * i)) for i in range(4)]
    # the third is refused by the hour's two; the minute's one has filled up half each time
    assert run(spark, rows, [(2, 60), (2, 3600)], "string") == plainly(rows, [(2, 60), (2, 3600)])


def test_random_keys_and_a_hot_one(spark):
    rng = random.Random(3)
    rows, at = [], 0
    for n in range(3000):
        at += rng.choice([1, 1, 2, 7, 40, 700]) if n % 400 else 9000
        rows.append((n, 0 if rng.random() < 0.4 else rng.randrange(1, 60), START + dt.timedelta(milliseconds=250 * at)))
    limits = [(3, 10), (9, 90), (20, 400)]
    assert run(spark, rows, limits) == plainly(rows, limits)


def test_nulls_ties_empty_tables_and_wide_keys(spark):
    big = 2**62 + 1
    rows = [(1, None, START), (2, None, START), (None, None, START), (3, big, None), (4, big, START), (4, big, START)]
    got = run(spark, rows, [(2, 60)])
    assert got == sorted([(None, None, True, 0), (1, None, True, 0), (2, None, False, 30), (3, big, None, None), (4, big, True, 0), (4, big, True, 0)], key=repr)
    assert run(spark, [], [(2, 60)]) == []


def test_a_pause_of_exactly_the_window_fills_the_bucket(spark):
    rows = [(0, 1, START), (1, 1, START), (2, 1, START), (3, 1, START + dt.timedelta(seconds=60)), (4, 1, START + dt.timedelta(seconds=60)), (5, 1, START + dt.timedelta(seconds=60))]
    assert run(spark, rows, [(2, 60)]) == plainly(rows, [(2, 60)])
