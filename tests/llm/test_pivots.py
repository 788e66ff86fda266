import numpy as np

from tidewell.llm import pivots


def brute(ids, x):
    """vec_id -> (links, component), all pairs compared; ids without a vector are alone."""
    out, root = {}, {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ok = [k for k, v in enumerate(x) if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(np.asarray(v) != 0)]
    links = dict.fromkeys(ids, 0)
    for a in ok:
        for b in ok:
            if a < b and len(x[a]) == len(x[b]):
                u, v = (np.asarray(x[k], np.float32).astype(float) for k in (a, b))
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.95:
                    links[ids[a]] += 1
                    links[ids[b]] += 1
                    i, j = find(ids[a]), find(ids[b])
                    root[max(i, j)] = min(i, j)
    for i in ids:
        out[i] = (links[i], find(i))
    return out


def test_against_all_pairs(spark):
    rnd = np.random.default_rng(4)
    x = [rnd.normal(0, 1, 32) for _ in range(250)]
    for size, noise in ((60, 0.01), (30, 0.18), (25, 0.22), (12, 0.05)):  # from tight groups to pairs about the threshold
        centre = rnd.normal(0, 1, 32)
        x += [(centre + noise * rnd.normal(0, 1, 32)) * rnd.uniform(0.1, 9) for _ in range(size)]
    x += [x[0]] * 40 + [2 * x[1], -x[1]]
    x = [v.astype(np.float32).tolist() for v in x]
    x += [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1.0, 2.0], [2.0, 4.1], [1e-30] * 32, [1e30] * 32]
    ids = rnd.permutation(len(x)).tolist()
    df = spark.createDataFrame(list(zip(ids, x, [9] * len(x), strict=True)), "vec_id long, embedding array<float>, id int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(df).collect()}
    want = brute(ids, x)
    assert len(got) == len(x)
    total = sum(n for n, _ in want.values())
    assert sum(got[i][0] for i in ids) >= 0.97 * total
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert np.mean([got[i][:2] == want[i] for i in ids]) > 0.9
    assert all(kept == (i == component) for i, (_, component, kept) in got.items())


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [0.0, 1.0]), (None, [1.0, 0.0]), (8, None)], "vec_id long, embedding array<double>")
    got = sorted(map(str, (tuple(r) for r in pivots.near_duplicates(df).collect())))
    assert got == sorted(map(str, [(3, 2, 2, False), (3, 2, 2, False), (2, 2, 2, True), (2, 0, 2, True), (None, 0, None, True), (8, 0, 8, True)]))
    assert pivots.near_duplicates(df.limit(0)).count() == 0
