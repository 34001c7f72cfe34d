"""Clustering of reads on sparse distance tables (i < j, dist)."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issq.functions import calling
from issq.operators.components import components
from issq.scratch import Scratch, even_join
from issq.scratch import checkpointed as _cut
from issq.session import ship

#: Edges of a component that one task agglomerates. Larger components first
#: lose edges in rounds of merges on blocks (``_block_round``) and on tables
#: (``_merge_round``).
TASK_EDGES = 500_000
#: Distances that agree to so many decimals are equally close: averages of the
#: same pairs differ in the last bits by the order in which they were summed.
DECIMALS = 9
SLACK = 0.5 * 10.0**-DECIMALS
#: A table of nodes (about 24 bytes a row) of so many rows is broadcast.
BROADCAST_NODES = 1_000_000


def connected(edges: DataFrame) -> DataFrame:
    """read_id, label: components of the edges (i, j), by the smallest member."""
    found = components(edges.select(F.col("i").alias("a"), F.col("j").alias("b")), Scratch(edges.sparkSession, "connected"), "c")
    return found.select(F.col("node").alias("read_id"), "label")


def dense(labels: DataFrame) -> DataFrame:
    """Dense cluster numbers in the order of each cluster's first read. The
    number is the rank of distinct labels: ranges of labels are counted in
    parallel and added up, so no task sorts all rows."""
    firsts = labels.select("label").distinct()
    n = int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = firsts.repartitionByRange(n, "label").select("label", F.spark_partition_id().alias("p"))
    ranged = _cut(ranged)
    counts = ranged.groupBy("p").count()
    before = counts.alias("a").join(counts.alias("b"), F.col("b.p") < F.col("a.p"), "left").groupBy(F.col("a.p").alias("p")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("before"))
    inside = ranged.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("label")) - 1)
    numbers = inside.join(F.broadcast(before), "p").select("label", (F.col("k") + F.col("before")).alias("cluster"))
    return labels.join(numbers, "label").select("read_id", "cluster")


def forest(reads: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """linkage 'min': the parent of j is the greatest i < j within the
    threshold, the cluster is the tree. Pointer doubling, then dense numbers."""
    parents = edges.where(F.col("dist") <= threshold).groupBy(F.col("j").alias("read_id")).agg(F.max("i").alias("parent"))
    scratch, step = Scratch(reads.sparkSession, "forest"), 0
    p = scratch.table(reads.select("read_id").join(parents, "read_id", "left").select("read_id", F.coalesce("parent", "read_id").alias("label")), "p0")
    while True:
        up = p.select(F.col("read_id").alias("label"), F.col("label").alias("above"))
        step += 1
        new = scratch.table(even_join(p, up, "label").select("read_id", F.col("label").alias("old"), F.col("above").alias("label")), f"p{step}")
        p = new.select("read_id", "label")
        scratch.drop(f"p{step - 1}")
        if not new.where("old <> label").limit(1).count():
            return dense(p)


def single(reads: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """linkage 'single': true components within the threshold."""
    near = edges.where(F.col("dist") <= threshold)
    labels = connected(near)
    return dense(reads.select("read_id").join(labels, "read_id", "left").select("read_id", F.coalesce("label", "read_id").alias("label")))


class Heap:
    """A priority queue whose entries can be replaced or removed; equal
    priorities leave in the order they came."""

    def __init__(self):
        self._heap: list[list] = []
        self._entry: dict = {}
        self._count = 0

    def push(self, item, priority: float) -> None:
        self.remove(item)
        entry = [priority, self._count, item, True]
        self._count += 1
        self._entry[item] = entry
        heapq.heappush(self._heap, entry)

    def remove(self, item) -> None:
        old = self._entry.pop(item, None)
        if old is not None:
            old[3] = False

    def pop(self):
        while self._heap:
            priority, _, item, live = heapq.heappop(self._heap)
            if live:
                del self._entry[item]
                return item, priority
        raise KeyError("the heap is empty")

    def __len__(self) -> int:
        return len(self._entry)


def agglomerate(edges: list[tuple[int, int, float, int, int]], threshold: float, linkage: str) -> dict[int, int]:
    """Sparse threshold agglomeration: the closest pair (of equally close ones
    the first by lower, then higher id) merges while within the threshold, the
    lower id survives, and a neighbour stays linked only if it was linked to
    both parts ('mean': size-weighted, 'max': the larger). Edges: i, j,
    distance and, where they are clusters already, the sizes of both."""
    near: dict[int, dict[int, float]] = {}
    size: dict[int, int] = {}
    heap = Heap()
    for i, j, d, *sizes in edges:
        near.setdefault(i, {})[j] = d
        near.setdefault(j, {})[i] = d
        size[i], size[j] = sizes or (1, 1)
        heap.push((i, j), (round(d, DECIMALS), i, j))
    parent = {v: v for v in near}
    while len(heap):
        (a, b), (d, _, _) = heap.pop()
        if d > threshold + SLACK:
            break
        parent[b] = a
        shared = sorted((near[a].keys() & near[b].keys()) - {a, b})
        for v in (near[a].keys() | near[b].keys()) - {a, b}:
            for u in (a, b):
                if v in near[u]:
                    heap.remove((min(u, v), max(u, v)))
                    near[v].pop(u, None)
        total = size[a] + size[b]
        new = {v: (near[a][v] * size[a] + near[b][v] * size[b]) / total if linkage == "mean" else max(near[a][v], near[b][v]) for v in shared}
        near[a], size[a] = new, total
        del near[b]
        for v, dv in new.items():
            near[v][a] = dv
            pair = min(a, v), max(a, v)
            heap.push(pair, (round(dv, DECIMALS), *pair))
    out = {}
    for v in parent:
        r = v
        while parent[r] != r:
            r = parent[r]
        out[v] = r
    return out


def merge_closest(i: np.ndarray, j: np.ndarray, dist: np.ndarray, sizes: tuple, own: tuple, threshold: float, linkage: str) -> tuple[np.ndarray, np.ndarray]:
    """(v, p) of the merges that are sure among the edges of some own nodes (all
    their edges are given, of other nodes only those): again and again, own
    pairs that are each other's closest. See ``_merge_round`` for why it does not
    matter what the other nodes do meanwhile. ``sizes`` and ``own`` are those of
    i and of j."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)].astype(np.int64), at[len(i) :].astype(np.int64)
    n, d = len(nodes), dist.astype(float)
    size, mine = np.ones(n), np.zeros(n, dtype=bool)
    size[a], size[b] = sizes
    mine[a], mine[b] = own
    root = np.arange(n)
    while True:
        near = np.flatnonzero(d <= threshold + SLACK)
        down = near[np.lexsort((b[near], a[near], np.round(d[near], DECIMALS)))[::-1]]
        best = np.full(n, -1)
        best[np.stack([a[down], b[down]], axis=1).ravel()] = np.repeat(down, 2)  # the last one written is the closest
        e = near[mine[a[near]] & mine[b[near]]]
        e = e[(best[a[e]] == e) & (best[b[e]] == e)]
        if not len(e):
            root = root[root]
            moved = np.flatnonzero(root != np.arange(n))
            return nodes[moved], nodes[root[moved]]
        low, high = a[e], b[e]
        to, parts = np.arange(n), np.ones(n, dtype=np.int64)
        to[high] = low
        parts[low] = 2
        root = to[root]
        touched = np.zeros(n, dtype=bool)
        touched[low] = touched[high] = True
        hit = touched[a] | touched[b]
        p, q, w, x = to[a[hit]], to[b[hit]], size[a[hit]] * size[b[hit]], d[hit]
        apart = p != q
        p, q, w, x = np.minimum(p, q)[apart], np.maximum(p, q)[apart], w[apart], x[apart]
        order = np.lexsort((q, p))
        p, q, w, x = p[order], q[order], w[order], x[order]
        first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])]) if len(p) else np.zeros(0, dtype=np.int64)
        if len(first):
            together = np.add.reduceat(x * w, first) / np.add.reduceat(w, first) if linkage == "mean" else np.maximum.reduceat(x, first)
            whole = np.diff(np.r_[first, len(p)]) == parts[p[first]] * parts[q[first]]
            p, q, x = p[first][whole], q[first][whole], together[whole]
        a, b, d = np.concatenate([a[~hit], p]), np.concatenate([b[~hit], q]), np.concatenate([d[~hit], x])
        size[low] += size[high]


def _small_side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_NODES else df


def _block_round(edges: DataFrame, n_edges: int, reads: DataFrame, turn: int, most: int, threshold: float, linkage: str) -> DataFrame:
    """v, p: merges of one round in which each task has the nodes of a block of
    the plane with all their edges. Which nodes share a block changes how many
    merges are sure, not what they are. Blocks are squares with about ``most``
    edges, shifted by half from turn to turn; a fuller one is split by id."""
    ends = reads.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count("*")).first()
    area = max(ends[2] - ends[0], 1e-9) * max(ends[3] - ends[1], 1e-9)
    side, off = max((area * most / (2 * n_edges)) ** 0.5, 1e-9), 0.5 * (turn % 2)
    square = lambda c, low: F.floor((F.col(c) - F.lit(low)) / F.lit(side) + F.lit(off))
    place = reads.select(F.col("read_id").alias("v"), F.xxhash64(square("x", ends[0]), square("y", ends[1]), F.lit(turn)).alias("square"))
    degree = edges.select(F.col("i").alias("v")).unionAll(edges.select("j")).groupBy("v").count()
    placed = _cut(place.join(degree, "v"))
    full = placed.groupBy("square").agg(F.ceil(F.sum("count") / F.lit(2 * most)).alias("pieces"))
    block = placed.join(full, "square").select("v", F.xxhash64("square", F.expr("pmod(xxhash64(v), pieces)")).alias("block"))
    block = _cut(block)
    met = edges
    for c in ("i", "j"):
        met = met.join(_small_side(block.select(F.col("v").alias(c), F.col("block").alias(f"b_{c}")), ends[4]), c)
    sent = met.select("i", "j", "dist", "n_i", "n_j", "b_i", "b_j", F.explode(F.array_distinct(F.array("b_i", "b_j"))).alias("block"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        at = df.block.iloc[0]
        v, p = merge_closest(df.i.to_numpy(), df.j.to_numpy(), df.dist.to_numpy(), (df.n_i, df.n_j), (df.b_i == at, df.b_j == at), threshold, linkage)
        return pd.DataFrame({"v": v, "p": p})

    return _cut(sent.groupBy("block").applyInPandas(run, "v long, p long"))


def _merge_round(edges: DataFrame, threshold: float) -> DataFrame:
    """v, p: merges of one round in which all pairs merge that are each other's
    closest. Both linkages are reducible (a merge never brings a third cluster
    nearer than the nearer of its parts), and pairs are ordered by (distance, i,
    j) throughout, so such a pair merges in the order of closest pairs as well,
    whatever merges before it elsewhere."""
    key = F.struct(F.round("dist", DECIMALS).alias("dist"), "i", "j")
    edges = edges.where(F.col("dist") <= threshold + SLACK)
    ends = edges.select(F.col("i").alias("v"), key.alias("k")).unionAll(edges.select(F.col("j"), key))
    best = ends.groupBy("v").agg(F.min("k").alias("k"))
    pairs = best.groupBy("k").agg(F.count("*").alias("n")).where("n = 2")
    return _cut(pairs.select(F.col("k.j").alias("v"), F.col("k.i").alias("p")))


def _carried(edges: DataFrame, merges: DataFrame, linkage: str) -> DataFrame:
    """The edges between clusters after the merges (v into p)."""
    own = merges.groupBy("p").agg((F.count("*") + 1).alias("parts"))
    new = merges.join(own, "p").select("v", "p", "parts").unionAll(own.select(F.col("p").alias("v"), "p", "parts"))
    rows = merges.count() * 2
    moved = edges
    for c in ("i", "j"):
        own = new.select(F.col("v").alias(c), F.col("p").alias(f"p_{c}"), F.col("parts").alias(f"parts_{c}"))
        moved = moved.join(_small_side(own, rows), c, "left").withColumn(f"p_{c}", F.coalesce(f"p_{c}", c)).withColumn(f"parts_{c}", F.coalesce(f"parts_{c}", F.lit(1)))
    # A pair of clusters is left if all pairs of their parts are; each part's
    # size then counts once for every part of the other side.
    weight = F.col("n_i") * F.col("n_j")
    dist = F.sum(F.col("dist") * weight) / F.sum(weight) if linkage == "mean" else F.max("dist")
    low, high = F.least("p_i", "p_j").alias("i"), F.greatest("p_i", "p_j").alias("j")
    turned = F.col("p_i") > F.col("p_j")
    sides = moved.where("p_i <> p_j").select(
        low, high, "dist", "n_i", "n_j", F.when(turned, F.col("n_j")).otherwise(F.col("n_i")).alias("low_n"), F.when(turned, F.col("n_i")).otherwise(F.col("n_j")).alias("high_n"),
        F.when(turned, F.col("parts_j")).otherwise(F.col("parts_i")).alias("low_parts"), F.when(turned, F.col("parts_i")).otherwise(F.col("parts_j")).alias("high_parts"),
    )
    grouped = sides.groupBy("i", "j").agg(
        dist.alias("dist"), F.count("*").alias("n"), F.max("low_parts").alias("a"), F.max("high_parts").alias("b"), F.sum("low_n").alias("sn"), F.sum("high_n").alias("tn"),
    ).where(F.col("n") == F.col("a") * F.col("b"))
    return grouped.select("i", "j", "dist", (F.col("sn") / F.col("b")).cast("long").alias("n_i"), (F.col("tn") / F.col("a")).cast("long").alias("n_j"))


def _live(edges: DataFrame, threshold: float, rows: int) -> DataFrame:
    """The edges between clusters that have one within the threshold each: no
    other cluster can ever merge."""
    near = edges.where(F.col("dist") <= threshold + SLACK)
    nodes = near.select(F.col("i").alias("v")).unionAll(near.select("j")).distinct()
    for c in ("i", "j"):
        edges = edges.join(_small_side(nodes.withColumnRenamed("v", c), rows), c, "left_semi")
    return edges.select("i", "j", "dist", "n_i", "n_j")


def hierarchical(reads: DataFrame, edges: DataFrame, threshold: float, linkage: str = "mean", task_edges: int | None = None) -> DataFrame:
    """read_id, cluster. Reads that no chain of edges within the threshold
    connects can never merge, so each such component is clustered by itself, on
    all its edges (longer ones feed the averages; the largest of a pair of
    clusters only grows, so 'max' needs none beyond the threshold). While there
    are more than ``task_edges`` edges, reads with a place (x, y) first merge
    within blocks of the plane, as far as a block's edges decide. Components
    that then still have more than ``task_edges`` edges merge closest pairs on
    tables, round by round, until what is left of them falls apart into
    components that a task can finish."""
    ship(reads.sparkSession)
    most = TASK_EDGES if task_edges is None else task_edges
    scratch, step = Scratch(reads.sparkSession, "hac"), 0
    one = F.lit(1).cast("long")
    if linkage == "max":
        edges = edges.where(F.col("dist") <= threshold + SLACK)
    todo = scratch.table(edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("dist").cast("double").alias("dist"), one.alias("n_i"), one.alias("n_j")), "edges0")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        got = agglomerate(list(zip(df.i.tolist(), df.j.tolist(), df.dist.tolist(), df.n_i.tolist(), df.n_j.tolist())), threshold, linkage)
        return pd.DataFrame({"v": list(got), "p": list(got.values())})

    moves: list[DataFrame] = []  # in the order they happen; a read moves along all
    if {"x", "y"} <= set(reads.columns):
        points = reads.select(F.col("read_id").cast("long").alias("read_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        rows, left = points.count(), todo.count()
        while left > most:
            merges = _block_round(todo, left, points, step, max(most, 1), threshold, linkage)
            made = merges.count()
            if not made:
                break
            moves.append(merges)
            step += 1
            carried = scratch.table(_carried(todo, merges, linkage), f"carried{step}")
            todo = scratch.table(_live(carried, threshold, rows), f"edges{step}")
            scratch.drop(f"edges{step - 1}")
            scratch.drop(f"carried{step}")
            left = todo.count()
            if made * 100 < rows:
                break
    while True:
        labels = connected(todo.where(F.col("dist") <= threshold + SLACK))
        both = labels.select(F.col("read_id").alias("i"), F.col("label").alias("c")), labels.select(F.col("read_id").alias("j"), F.col("label").alias("c"))
        tagged = scratch.table(todo.join(both[0], "i").join(both[1], ["j", "c"]), f"tagged{step}")
        large = tagged.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > most).select("c")
        small = tagged.join(large, "c", "left_anti").select("c", "i", "j", "dist", "n_i", "n_j")
        moves.append(scratch.table(small.groupBy("c").applyInPandas(run, "v long, p long"), f"done{step}"))
        large = scratch.table(tagged.join(large, "c", "left_semi").drop("c"), f"large{step}")
        scratch.drop(f"tagged{step}")
        if not large.limit(1).count():
            break
        step += 1
        merges = _merge_round(large, threshold)
        moves.append(merges)
        todo = scratch.table(_carried(large, merges, linkage), f"edges{step}")
    found = reads.select("read_id", F.col("read_id").alias("label"))
    for k, move in enumerate(moves):
        found = found.join(move.select(F.col("v").alias("label"), "p"), "label", "left").select("read_id", F.coalesce("p", "label").alias("label"))
        if k % 8 == 7:
            found = scratch.table(found, f"found{k}")
    return dense(scratch.table(found, "found"))


def unique_reads(reads: DataFrame, key: str = "cell") -> DataFrame:
    """Reads of a cell by called sequence: first_read (order of appearance),
    count, and the values of the last occurrence."""
    called = reads.withColumn("sequence", calling.sequence(F.col("values")))
    return called.groupBy(key, "sequence").agg(F.count("*").alias("count"), F.min("read_id").alias("first_read"), F.max_by("values", "read_id").alias("values"))


def complete_linkage(values: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of complete-linkage clusters on sum(|a||b| - a.b) over cycles; a
    merge at or above the threshold is not made."""
    n = len(values)
    norms = np.sqrt((values**2).sum(axis=2))
    d = np.einsum("ic,jc->ij", norms, norms) - np.einsum("ick,jck->ij", values, values)
    np.fill_diagonal(d, np.inf)
    label = np.arange(n)
    live = list(range(n))
    while len(live) > 1:
        sub = d[np.ix_(live, live)]
        a, b = divmod(int(sub.argmin()), len(live))
        if sub[a, b] >= threshold:
            break
        a, b = sorted((live[a], live[b]))
        d[a] = d[:, a] = np.maximum(d[a], d[b])
        d[a, a] = np.inf
        label[label == b] = a
        live.remove(b)
    return label


def cell_clusters(reads: DataFrame, threshold: float, key: str = "cell", most: int = 10) -> DataFrame:
    """Consensus of each cell's reads: cells with 2 to ``most`` reads by complete
    linkage (cluster mean values and counts), others by unique sequence."""
    ship(reads.sparkSession)
    counted = reads.join(reads.groupBy(key).agg(F.count("*").alias("n_")), key)
    few, rest = counted.where(F.col("n_").between(2, most)), counted.where(~F.col("n_").between(2, most))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("read_id")
        v = np.array([[list(c) for c in r] for r in df["values"]], dtype=float)
        label = complete_linkage(v, threshold)
        out = []
        for a in dict.fromkeys(label.tolist()):
            mine = label == a
            out.append((df[key].iloc[0], int(df.read_id.to_numpy()[mine].min()), int(mine.sum()), v[mine].mean(axis=0).tolist()))
        return pd.DataFrame(out, columns=[key, "first_read", "count", "values"])

    schema = f"{key} long, first_read long, count long, values array<array<double>>"
    grouped = few.select(F.col(key).cast("long").alias(key), "read_id", "values").groupBy(key).applyInPandas(run, schema)
    alone = unique_reads(rest.drop("n_"), key).select(F.col(key).cast("long").alias(key), "first_read", "count", "values")
    return grouped.unionByName(alone)
