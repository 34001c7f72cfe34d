"""Components of long and large graphs against union-find, and how many rounds
they take when no single task may finish them."""

import math
import random

import numpy as np
import pytest

from issq.operators import components as C
from issq.scratch import Scratch, even_join


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def path(n, seed):
    ids = random.Random(seed).sample(range(10 * n), n)
    return list(zip(ids, ids[1:]))


def grid(n, seed):
    ids = np.random.default_rng(seed).permutation(n * n).reshape(n, n)
    return list(zip(ids[:, :-1].ravel().tolist(), ids[:, 1:].ravel().tolist())) + list(zip(ids[:-1].ravel().tolist(), ids[1:].ravel().tolist()))


def star(n):
    return [(n + 1, k) for k in range(n)] + [(-1, -2), (-5, -5)]


@pytest.mark.parametrize("edges", [path(20_000, 1), grid(150, 2), star(3000)], ids=["path", "grid", "star"])
def test_rounds_are_few(spark, monkeypatch, edges):
    monkeypatch.setattr(C, "LOCAL_EDGES", 40)
    rounds = []
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in C.components(table, Scratch(spark, "t"), "c", rounds).collect()}
    want = union_find(edges)
    assert got == want
    assert len(rounds) <= 1.5 * math.log2(len(want)) + 2


def test_one_task_finishes_what_is_left(spark, monkeypatch):
    rnd = random.Random(3)
    edges = [(rnd.randrange(3000), rnd.randrange(3000)) for _ in range(2500)]
    table = spark.createDataFrame(edges + [(None, 1)], "a long, b long")
    for most in (10**6, 400):
        monkeypatch.setattr(C, "LOCAL_EDGES", most)
        assert {r.node: r.label for r in C.components(table, Scratch(spark, "t"), "c").collect()} == union_find(edges)
    assert C.components(table.where("a < 0"), Scratch(spark, "t"), "c").count() == 0


def test_even_join_of_a_hot_key(spark):
    left = spark.createDataFrame([(k, 7 if k % 3 == 0 else (None if k % 3 == 1 else k)) for k in range(6000)], "v long, k long")
    right = spark.createDataFrame([(k, -k) for k in range(4000)], "k long, w long")
    for how in ("inner", "left"):
        got = sorted(map(str, even_join(left, right, "k", how).select("v", "k", "w").collect()))
        assert got == sorted(map(str, left.join(right, "k", how).select("v", "k", "w").collect()))
