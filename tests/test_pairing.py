"""Constellation matches against a brute-force version."""

import numpy as np

from issq.catalog import base_queries
from issq.operators import pairing
from issq.plans import queries


def order(d):
    return np.lexsort((np.arange(len(d)), d))


def features(p, n):
    return [[tuple(p[j] - p[i]) for j in order(np.sqrt(((p - p[i]) ** 2).sum(axis=1)))[:n]] for i in range(len(p))]


def align(a, b, penalty):
    last = [float(len(b) - j) for j in range(len(b) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row = [0.0] * len(b) + [float(len(b) - i + 1)]
        for j in range(len(b) - 1, -1, -1):
            x, y = a[i][0] - b[j][0], a[i][1] - b[j][1]
            row[j] = min(last[j] + penalty, last[j + 1] + (x * x + y * y) ** 0.5, row[j + 1] + penalty)
        last = row
    return last[0]


def brute_pairs(p, q, n=10, penalty=5.0, candidates=100):
    """{i: (j, d)}: the first of equals in order of the nearest, as a loop
    over candidates finds them."""
    f, g = features(p, n), features(q, n)
    best_i, best_j = {}, {}
    for i in range(len(p)):
        for j in order(np.sqrt(((q - p[i]) ** 2).sum(axis=1)))[:candidates].tolist():
            d = align(f[i], g[j], penalty)
            if d < best_i.get(i, (0, np.inf))[1]:
                best_i[i] = j, d
            if d < best_j.get(j, (0, np.inf))[1]:
                best_j[j] = i, d
    return {i: (j, d) for i, (j, d) in best_i.items() if best_j[j][0] == i}


def points(df):
    rows = sorted((r.id, r.x, r.y) for r in df.collect())
    assert [r[0] for r in rows] == list(range(len(rows)))
    return np.array([r[1:] for r in rows])


def as_table(spark, p):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")


def shifted(seed=2):
    rng = np.random.default_rng(seed)
    p = rng.permutation(90000)[:120]
    p = np.stack([p // 300, p % 300], axis=1).astype(float)
    return [p, p[rng.permutation(120)[:110]] + [90, 40], p[rng.permutation(120)[:100]] + [-70, 80]]


def test_constellations_beyond_the_nearest(spark):
    p, q, _ = shifted()
    got = {r.id_i: (r.id_j, round(r.d, 6)) for r in pairing.pair_constellations(as_table(spark, p), as_table(spark, q)).collect()}
    assert got == {i: (j, round(d, 6)) for i, (j, d) in brute_pairs(p, q).items()}
    true = [i for i, (j, _) in got.items() if (p[i] + [90, 40] == q[j]).all()]
    assert len(true) > 40


def test_j11_equals_brute_force(spark, sf):
    got = {r.id_i: (r.id_j, r.d) for r in base_queries()["j11_constellations"](spark, sf).collect()}
    want = brute_pairs(points(queries._points(spark, sf, 2, 0)), points(queries._points(spark, sf, 2, 1)))
    assert got.keys() == want.keys()
    assert all(got[i][0] == j and abs(got[i][1] - d) < 2e-6 for i, (j, d) in want.items())


def brute_sets(sets, min_dots=2):
    groups = []
    for a in range(len(sets)):
        found = [brute_pairs(sets[a], sets[b]) if b > a else {} for b in range(len(sets))]
        fresh = []
        for i in range(len(sets[a])):
            row = {a: i} | {b: m[i][0] for b, m in enumerate(found) if i in m}
            target = next((g for g in groups if any(g[b] == j for b, j in row.items())), None)
            if target is None:
                fresh.append([row.get(b, -1) for b in range(len(sets))])
            for b, j in row.items() if target else ():
                target[b] = j
        groups += fresh
    return sorted(tuple(g) for g in groups if sum(j != -1 for j in g) >= min_dots)


def test_match_sets_by_constellations(spark):
    sets = shifted(3)
    got = pairing.match_sets([as_table(spark, p) for p in sets]).collect()
    assert sorted((r.set_0, r.set_1, r.set_2) for r in got) == brute_sets(sets)


def test_j13_equals_brute_force(spark, sf):
    got = base_queries()["j13_match_sets"](spark, sf).collect()
    assert sorted((r.set_0, r.set_1, r.set_2) for r in got) == brute_sets([points(queries._points(spark, sf, 3, k)) for k in range(3)])


def test_mutual_best_of_all_pairs_without_all_pairs(spark):
    """Equal places, ties, and points without a place; every plan that ran is
    free of joins of all pairs."""
    rng = np.random.default_rng(4)
    p, q = rng.integers(0, 40, (300, 2)).astype(float), rng.integers(0, 40, (200, 2)).astype(float)
    d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2))
    near, back = d.argmin(axis=1), d.argmin(axis=0)
    want = {(i, int(j), d[i, j]) for i, j in enumerate(near) if back[j] == i}
    odd = spark.createDataFrame([(900, None, 1.0), (901, float("nan"), 1.0), (902, float("inf"), 2.0)], "id long, x double, y double")
    left, right = (as_table(spark, each).unionByName(odd) for each in (p, q))
    got = pairing.pair_all(left, right)
    assert {(r.id_i, r.id_j, r.d) for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    apart = pairing.pair_all(as_table(spark, p), as_table(spark, q), lambda: pairing.euclid() + 0)
    assert {(r.id_i, r.id_j, r.d) for r in apart.collect()} == want
    assert pairing.pair_all(left, odd).count() == 0
