"""A running consensus over a stream of reads (an addition: batch operators
have no event time). Counts and sums by key in update or complete mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issq.functions import calling


def running_consensus(reads: DataFrame, key: str, cycles: int, channels: int = 4) -> DataFrame:
    """key, n, sequence: the call of the summed values so far."""
    sums = [F.sum(F.col("values")[c][k]).alias(f"s_{c}_{k}") for c in range(cycles) for k in range(channels)]
    out = reads.groupBy(key).agg(F.count("*").alias("n"), *sums)
    values = F.array(*[F.array(*[F.col(f"s_{c}_{k}") for k in range(channels)]) for c in range(cycles)])
    return out.select(key, "n", calling.sequence(values).alias("sequence"))
