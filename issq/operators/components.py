"""Connected components of edge tables by local contraction.

Each round every node moves to the least node of its closed neighbourhood, in
an order drawn anew for the round from a hash. Edges are carried along to the
nodes their ends moved to, so the components stay, and an expected constant
share of the nodes is gone after a round, whatever the ids and the diameter
(a path of n nodes takes about log2(n) rounds). Moves are tables, each smaller
than the one before, and are put together once at the end.

As soon as at most ``LOCAL_EDGES`` edges are left, one task finishes them; that
bounds its memory (about 100 bytes an edge) and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issq.scratch import Scratch, even_join
from issq.session import ship

#: Edges that one task finishes (16 bytes each, times six in work).
LOCAL_EDGES = 1_000_000
MOVES = "v long, p long"


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[one], root[two]
        live = x != y
        if not live.any():
            return nodes, nodes[root]
        one, two = one[live], two[live]
        np.minimum.at(root, np.maximum(x, y)[live], np.minimum(x, y)[live])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [batch for batch in batches if batch.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        nodes, least = roots(table.column("a").to_numpy(), table.column("b").to_numpy())
        yield from pa.table({"v": nodes, "p": least}).to_batches(max_chunksize=1 << 16)


def _moved(edges: DataFrame, turn: int) -> DataFrame:
    """v, p: every node of the edges and where it moves."""
    order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("x"))
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min(order("b")).alias("m"))
    return near.select(F.col("a").alias("v"), F.least(F.col("m"), order("a"))["x"].alias("p"))


def _carried(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """The edges between the nodes that their ends moved to."""
    to = lambda c, name: moves.select(F.col("v").alias(c), F.col("p").alias(name))
    met = edges.join(to("a", "x"), "a").join(to("b", "y"), "b").where("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: list[int] | None = None) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: bigint); the label is
    the smallest node of the component. Edges from a node to itself give that
    node a row; null ends are left out. ``rounds`` gets the edges left after
    each round."""
    spark = edges.sparkSession
    ship(spark)
    a, b = F.col("a"), F.col("b")
    known = edges.where(a.isNotNull() & b.isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    known = scratch.table(known, f"{name}-edges")
    alone, todo = known.where("a = b").select(a.alias("node")), known.where("a <> b")
    left, levels, turn = todo.count(), [], 0
    while left > LOCAL_EDGES:
        moves = scratch.table(_moved(todo, turn), f"{name}-moves-{turn}")
        levels.append(moves)
        todo = scratch.table(_carried(todo, moves), f"{name}-edges-{turn + 1}")
        if turn:
            scratch.drop(f"{name}-edges-{turn}")
        left, turn = todo.count(), turn + 1
        if rounds is not None:
            rounds.append(left)
    last = scratch.table(todo.coalesce(1).mapInArrow(_finish, MOVES), f"{name}-moves-{turn}")
    found = last
    for k, moves in enumerate(reversed(levels)):
        up = found.select(F.col("v").alias("p"), F.col("p").alias("q"))
        joined = even_join(moves, up, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
        found = scratch.table(joined, f"{name}-whole-{k}")
    if levels:  # what a component ended at need not be its smallest node
        least = found.groupBy("p").agg(F.min("v").alias("q"))
        found = scratch.table(even_join(found, least, "p").select("v", F.least("q", "p").alias("p")), f"{name}-labels")
    if turn:
        scratch.drop(f"{name}-edges-{turn}")
    out = found.select(F.col("v").alias("node"), F.col("p").alias("label"))
    single = alone.join(out, "node", "left_anti")
    return out.unionByName(single.select("node", F.col("node").alias("label")))
