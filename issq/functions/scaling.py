"""Intensity scaling. Percentiles are linear interpolations, found by a
grouped aggregate; the formulas are Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Channel to red, green and blue, by number of channels (fixed values).
COLOURS = {
    1: [[1.0], [1.0], [1.0]],
    2: [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]],
    3: [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]],
    4: [[0.66, 0.0, 0.0, 0.33], [0.0, 0.66, 0.0, 0.33], [0.0, 0.0, 1.0, 0.0]],
    5: [[0.5, 0.0, 0.0, 0.25, 0.25], [0.0, 0.5, 0.0, 0.25, 0.0], [0.0, 0.0, 0.5, 0.0, 0.25]],
    6: [[0.5, 0.0, 0.0, 0.25, 0.25, 0.0], [0.0, 0.5, 0.0, 0.25, 0.0, 0.25], [0.0, 0.0, 0.5, 0.0, 0.25, 0.25]],
    7: [[0.43, 0.0, 0.0, 0.21, 0.21, 0.0, 0.14], [0.0, 0.43, 0.0, 0.21, 0.0, 0.21, 0.14], [0.0, 0.0, 0.43, 0.0, 0.21, 0.21, 0.14]],
}
TINY = 1.1754943508222875e-38


def log_scale(pixels: DataFrame, by: list[str], value: str = "v", out: str = "scaled") -> DataFrame:
    """Per plane: floor = 10th percentile of the positive values; then
    max(log10(v - floor + 1), log10(50)) - log10(50)."""
    floors = pixels.where(F.col(value) > 0).groupBy(*by).agg(F.percentile(value, 0.1).alias("floor_"))
    base = F.log10(F.lit(50.0))
    lifted = F.log10(F.greatest(F.col(value) - F.col("floor_"), F.lit(0.0)) + 1)
    return pixels.join(floors, by, "left").withColumn(out, F.greatest(lifted, base) - base).drop("floor_")


def percentile_normalize(pixels: DataFrame, by: list[str], percent: float, value: str = "v", out: str = "scaled", clip: bool = True) -> DataFrame:
    """Per plane to [0, 1] between the percentiles p and 100 - p."""
    ends = pixels.groupBy(*by).agg(F.percentile(value, percent / 100).alias("lo_"), F.percentile(value, 1 - percent / 100).alias("hi_"))
    share = (F.col(value) - F.col("lo_")) / F.greatest(F.col("hi_") - F.col("lo_"), F.lit(TINY))
    return pixels.join(ends, by).withColumn(out, F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) if clip else share).drop("lo_", "hi_")


def rgb(channels: Column, n: int) -> list[Column]:
    """Red, green, blue as 0 to 255 from an array of n scaled channels."""

    def one(weights: list[float]) -> Column:
        s = sum((F.lit(w) * channels[i] for i, w in enumerate(weights)), F.lit(0.0))
        return F.floor(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")

    return [one(w) for w in COLOURS[n]]
