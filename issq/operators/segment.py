"""Reconciling cell and nucleus masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issq.operators.cluster import dense


def reconcile(labels: DataFrame) -> DataFrame:
    """x, y, cell, nucleus with matching numbers 1..n, 0 elsewhere.

    Each nucleus takes its most frequent cell (ties: met first in pixel order);
    the score is overlap / nucleus pixels + overlap / cell pixels; each cell
    keeps the nucleus of greatest (score, label); pairs are numbered by the
    first nucleus label that named the cell."""
    at = F.struct("x", "y")
    nuclei = labels.where("nucleus <> 0").groupBy("nucleus").agg(F.count("*").alias("n_nucleus"))
    cells = labels.where("cell <> 0").groupBy("cell").agg(F.count("*").alias("n_cell"))
    overlap = labels.where("nucleus <> 0 and cell <> 0").groupBy("nucleus", "cell").agg(F.count("*").alias("n"), F.min(at).alias("first"))
    best = overlap.groupBy("nucleus").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "cell")).alias("b")).select("nucleus", F.col("b.cell").alias("cell"), (-F.col("b.n")).alias("n"))
    scored = best.join(nuclei, "nucleus").join(cells, "cell").withColumn("score", F.col("n") / F.col("n_nucleus") + F.col("n") / F.col("n_cell"))
    kept = scored.groupBy("cell").agg(F.max(F.struct("score", "nucleus")).alias("b"), F.min("nucleus").alias("named")).select("cell", F.col("b.nucleus").alias("nucleus"), "named")
    numbers = dense(kept.select(F.col("cell").alias("read_id"), F.col("named").alias("label")))
    pairs = kept.join(numbers.select(F.col("read_id").alias("cell"), (F.col("cluster") + 1).alias("number")), "cell")
    new_cell, new_nucleus = pairs.select("cell", F.col("number").alias("c")), pairs.select("nucleus", F.col("number").alias("m"))
    out = labels.join(new_cell, "cell", "left").join(new_nucleus, "nucleus", "left")
    return out.select("x", "y", F.coalesce("c", F.lit(0)).alias("cell"), F.coalesce("m", F.lit(0)).alias("nucleus"))
