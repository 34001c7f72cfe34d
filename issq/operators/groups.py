"""Grouping reads and combining groups to a consensus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issq.functions import calling
from issq.schema import CHANNELS


def ordinals(df: DataFrame, key: str, order: str = "read_id") -> DataFrame:
    """Adds first_read: groups come in the order of their first read."""
    return df.withColumn("first_read", F.min(order).over(Window.partitionBy(key)))


def first_reads(df: DataFrame, key: str, order: str = "read_id") -> DataFrame:
    """One row a group: key, first_read, num_reads."""
    return df.groupBy(key).agg(F.min(order).alias("first_read"), F.count("*").alias("num_reads"))


def mode(col: Column) -> Column:
    """The most frequent value, the smallest of ties."""
    return F.mode(col, True)


def default_method(df: DataFrame, attr: str) -> str:
    floating = isinstance(df.schema[attr].dataType, (T.FloatType, T.DoubleType, T.DecimalType))
    return "mean" if floating else "mode"


def combine(df: DataFrame, key: str | None, cycles: int, method: str | Callable | dict | None = None, channels: list[str] = CHANNELS) -> DataFrame:
    """One consensus read a group (or one for all with key None): mean position,
    elementwise sum of values, mode of explicit sequences or else the call of
    the summed values; other columns by ``method`` (a name of an aggregate, a
    Column function, or a dict of these by column), by default the mean of
    floating columns and the mode of others. One hash aggregate with a sum per
    value keeps map-side combining and blows up no rows."""
    special = {"read_id", "x", "y", "values", "sequence", key}
    aggs = [F.avg(c).alias(c) for c in ("x", "y") if c in df.columns]
    if "values" in df.columns:
        aggs += [F.sum(F.col("values")[c][k]).alias(f"s_{c}_{k}") for c in range(cycles) for k in range(len(channels))]
    if "sequence" in df.columns:
        aggs.append(mode(F.col("sequence")).alias("sequence"))
    attrs = [c for c in df.columns if c not in special]
    for c in attrs:
        how = method.get(c) if isinstance(method, dict) else method
        how = how or default_method(df, c)
        if callable(how):
            aggs.append(how(F.col(c)).alias(c))
        elif how == "mode":
            aggs.append(mode(F.col(c)).alias(c))
        else:
            aggs.append(getattr(F, {"mean": "avg", "std": "stddev_pop", "amin": "min", "amax": "max"}.get(how, how))(c).alias(c))
    out = (df.groupBy(key) if key else df.groupBy()).agg(*aggs)
    fields = [F.col(c) for c in ([key] if key else [])] + [F.col(c) for c in ("x", "y") if c in df.columns]
    if "values" in df.columns:
        sums = F.array(*[F.array(*[F.col(f"s_{c}_{k}") for k in range(len(channels))]) for c in range(cycles)])
        out = out.withColumn("values", sums)
        explicit = F.col("sequence") if "sequence" in df.columns else None
        out = out.withColumn("sequence", calling.sequence(F.col("values"), explicit, channels))
        fields.append(F.col("values"))
    if "sequence" in out.columns:
        fields.append(F.col("sequence"))
    return out.select(*fields, *attrs)


def head(df: DataFrame, key: str, n: int, order: str = "read_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("rank_", rank).where(F.col("rank_") <= n).drop("rank_")


def tail(df: DataFrame, key: str, n: int, order: str = "read_id") -> DataFrame:
    """The last n reads of each group; n = 0 means all."""
    if n == 0:
        return df
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("rank_", rank).where(F.col("rank_") <= n).drop("rank_")


def nth(df: DataFrame, key: str, i: int, order: str = "read_id") -> DataFrame:
    """Read i of each group, from the end for negative i; shorter groups have
    none (the caller can compare counts)."""
    by = F.desc(order) if i < 0 else F.asc(order)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(by))
    return df.withColumn("rank_", rank).where(F.col("rank_") == (-i if i < 0 else i + 1)).drop("rank_")


def sizes(df: DataFrame, key: str) -> DataFrame:
    """max_reads and n_groups."""
    return df.groupBy(key).count().agg(F.max("count").alias("max_reads"), F.count("*").alias("n_groups"))


def composition(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Letters by position: pos, base, n, fraction."""
    letters = df.select(F.posexplode(F.split(sequence, "")).alias("pos", "base")).groupBy("pos", "base").agg(F.count("*").alias("n"))
    return letters.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("pos")))


def call_reads(reads: DataFrame, labels: DataFrame, cycles: int) -> DataFrame:
    """Reads in cells by sequence: cell, sequence, count, rank (by count
    descending, then sequence); a cell without reads has one row with nulls.
    Values are scaled by their mean before calling, which changes no call."""
    inside = labels.where("cell <> 0").select("x", "y", "cell")
    placed = reads.select(F.floor("x").alias("x"), F.floor("y").alias("y"), calling.sequence(F.col("values")).alias("sequence"))
    found = placed.join(inside, ["x", "y"]).groupBy("cell", "sequence").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("count"), "sequence"))
    cells = inside.select("cell").distinct()
    return cells.join(found.withColumn("rank", rank), "cell", "left")
