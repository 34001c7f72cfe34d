import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from issq.operators import cluster, spatial

EMPTY = "array<array<double>>"


def reads_of(spark, points):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "read_id long, x double, y double")


@pytest.mark.parametrize("linkage,largest", [("max", 2), ("mean", 4)])
def test_line(spark, linkage, largest):
    reads = reads_of(spark, [(x, 0) for x in range(20)])
    edges = spatial.distance_matrix(reads, 10.5, 1, 0, 0)
    assert edges.where("abs(dist - (j - i)) > 1e-9").count() == 0
    out = cluster.hierarchical(reads, edges, 2.5, linkage)
    assert out.count() == 20
    assert out.groupBy("cluster").count().agg(F.max("count")).first()[0] == largest


def test_forest_is_not_single_linkage(spark):
    reads = reads_of(spark, [(0, 0), (1, 1), (2, 2)])
    edges = spark.createDataFrame([(0, 2, 1.0), (1, 2, 1.0)], "i long, j long, dist double")
    assert {r.read_id: r.cluster for r in cluster.forest(reads, edges, 1).collect()} == {0: 0, 1: 1, 2: 1}
    assert {r.read_id: r.cluster for r in cluster.single(reads, edges, 1).collect()} == {0: 0, 1: 0, 2: 0}


def test_no_edges_means_singletons(spark):
    reads = reads_of(spark, [(0, 0), (5, 5)])
    edges = spark.createDataFrame([], "i long, j long, dist double")
    for f in (cluster.forest, cluster.single, cluster.hierarchical):
        assert sorted(r.cluster for r in f(reads, edges, 1).collect()) == [0, 1]


def test_radius_join_equals_brute_force(spark):
    rnd = random.Random(1)
    points = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)]
    got = {(r.i, r.j) for r in spatial.distance_matrix(reads_of(spark, points), 20, 1, 0, 0).collect()}
    near = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= 400
    assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if near(points[i], points[j])}


def plain_agglomeration(edges, n, threshold, linkage):
    """From the definition, over all members: clusters are linked where all
    pairs of their members are; the closest linked ones merge."""
    d = {(i, j): x for i, j, x in edges}
    clusters = {k: [k] for k in range(n)}
    far = lambda x: sum(x) / len(x) if linkage == "mean" else max(x)
    while True:
        best = None
        for a in clusters:
            for b in clusters:
                if a < b:
                    cross = [d.get((min(p, q), max(p, q))) for p in clusters[a] for q in clusters[b]]
                    if None not in cross and far(cross) <= threshold:
                        best = min(best or (np.inf,), (far(cross), a, b))
        if best is None:
            return {m: a for a, members in clusters.items() for m in members}
        clusters[best[1]] += clusters.pop(best[2])


@pytest.mark.parametrize("linkage", ["mean", "max"])
@pytest.mark.parametrize("ties", [False, True])
def test_agglomeration_equals_the_definition(spark, linkage, ties):
    rnd = random.Random(2)
    n = 40
    draw = (lambda: float(rnd.randrange(1, 9))) if ties else (lambda: rnd.random() * 9)
    edges = [(i, j, draw()) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.35]
    if ties and linkage == "mean":  # sums of powers of two stay exact
        edges = [(i, j, 2.0 ** (x % 3)) for i, j, x in edges]
    want = plain_agglomeration(edges, n, 4.0, linkage)
    assert 5 < len(set(want.values())) < n - 5
    reads, table = reads_of(spark, [(0, 0)] * n), spark.createDataFrame(edges, "i long, j long, dist double")
    rank = {root: k for k, root in enumerate(sorted(set(want.values())))}
    for most in (None, 30):  # one task a component, and rounds of merges first
        got = {r.read_id: r.cluster for r in cluster.hierarchical(reads, table, 4.0, linkage, most).collect()}
        assert got == {v: rank[root] for v, root in want.items()}


@pytest.mark.parametrize("linkage", ["mean", "max"])
def test_blocks_of_the_plane_equal_one_run(spark, monkeypatch, linkage):
    """Points on a grid, so with many equal distances: merging within blocks
    first gives the clusters of one global run, and rounds on tables have
    little left to do."""
    rnd = random.Random(5)
    places = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(600)]
    reads = reads_of(spark, places)
    edges = spatial.distance_matrix(reads, 9, 1, 0, 0)
    got = cluster.agglomerate([(r.i, r.j, r.dist) for r in edges.collect()], 4.0, linkage)
    rank = {root: k for k, root in enumerate(sorted({got.get(v, v) for v in range(600)}))}
    rounds, once = [], cluster._merge_round
    monkeypatch.setattr(cluster, "_merge_round", lambda *a: rounds.append(1) or once(*a))
    out = {r.read_id: r.cluster for r in cluster.hierarchical(reads, edges, 4.0, linkage, 1000).collect()}
    assert out == {v: rank[got.get(v, v)] for v in range(600)}
    assert len(rounds) <= 1


def test_heap():
    heap, order = cluster.Heap(), list(range(100))
    random.Random(3).shuffle(order)
    for item, priority in enumerate(order):
        heap.push(item, priority)
    heap.push(7, -1)
    heap.remove(8)
    out = [heap.pop() for _ in range(len(heap))]
    assert out[0] == (7, -1) and len(out) == 99
    assert [p for _, p in out] == sorted(p for _, p in out)
    with pytest.raises(KeyError):
        heap.pop()


def test_running_consensus(spark, tmp_path):
    from issq.streaming.consensus import running_consensus

    rows = [(1, [[1.0, 0.0, 0.0, 0.0]]), (1, [[0.0, 3.0, 0.0, 0.0]]), (2, [[0.0, 0.0, 1.0, 0.0]])]
    spark.createDataFrame(rows, f"cell long, values {EMPTY}").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"cell long, values {EMPTY}").parquet(str(tmp_path / "in"))
    q = running_consensus(stream, "cell", 1).writeStream.outputMode("complete").format("memory").queryName("consensus").start()
    q.processAllAvailable()
    q.stop()
    assert {r.cell: (r.n, r.sequence) for r in spark.table("consensus").collect()} == {1: (2, "T"), 2: (1, "A")}
