"""Colour and illumination correction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from issq.operators.image import blur, gaussian_weights, tiles
from issq.session import ship

#: A sample dye response, dyes G, T, A, C by channels (fixed values).
EXAMPLE_DYES = [
    [0.890, 0.048, 0.028, 0.034],
    [0.163, 0.790, 0.020, 0.027],
    [0.051, 0.037, 0.589, 0.323],
    [0.092, 0.068, 0.162, 0.679],
]


def unmix(dyes: list[list[float]]) -> list[list[float]]:
    """channels -> dyes: the pseudo-inverse of the response, transposed."""
    return np.linalg.pinv(np.asarray(dyes, dtype=float).T).tolist()


def color_correct(vector: Column, dyes: list[list[float]] = EXAMPLE_DYES) -> Column:
    """Least-squares dye amounts of one channel vector, negatives to 0."""
    rows = unmix(dyes)
    terms = [sum((F.lit(w) * vector[k] for k, w in enumerate(row)), F.lit(0.0)) for row in rows]
    return F.array(*[F.when(t < 0, 0.0).otherwise(t) for t in terms])


def crosstalk(pixels: DataFrame, bins: int = 8) -> DataFrame:
    """Crosstalk of every ordered channel pair, from columns id, channel, v:
    source, target, crosstalk.

    The range of the source channel is cut in bins - 1 equal parts, both ends
    inclusive; of each part the pixel with the smallest target (the first of
    ties) gives target / source; the answer is number bins // 4 of the sorted
    ratios."""
    ends = pixels.groupBy("channel").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    cut = lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / (bins - 1)
    edges = ends.select("channel", F.explode(F.array(*[F.struct(F.lit(k).alias("bin"), cut(k).alias("a"), (cut(k + 1) if k + 2 < bins else F.col("hi")).alias("b")) for k in range(bins - 1)])).alias("e")).select("channel", "e.*")
    source = pixels.join(F.broadcast(edges), "channel").where((F.col("v") >= F.col("a")) & (F.col("v") <= F.col("b"))).select("id", F.col("channel").alias("source"), "bin", F.col("v").alias("ref"))
    target = pixels.select("id", F.col("channel").alias("target"), F.col("v").alias("val"))
    met = source.join(target, "id").where("source <> target")
    low = met.groupBy("source", "target", "bin").agg(F.min(F.struct("val", "id", "ref")).alias("m"))
    ratio = F.col("m.val") / F.col("m.ref")
    return low.groupBy("source", "target").agg(F.get(F.array_sort(F.collect_list(ratio)), F.lit(bins // 4 - 1)).alias("crosstalk"))


def dye_matrix(pixels: DataFrame, bins: int = 8) -> DataFrame:
    """source, target, response: 1 on the diagonal, crosstalk elsewhere."""
    own = pixels.select("channel").distinct().select(F.col("channel").alias("source"), F.col("channel").alias("target"), F.lit(1.0).alias("response"))
    return own.unionByName(crosstalk(pixels, bins).withColumnRenamed("crosstalk", "response"))


def estimated_dyes(pixels: DataFrame, bins: int = 8) -> tuple[list, list[list[float]]]:
    """The channels in order, and the estimated matrix of dyes by channels: one
    number for each two channels. A ratio that cannot be told counts as 0."""
    found = {(r.source, r.target): r.response for r in dye_matrix(pixels, bins).collect()}
    channels = sorted({source for source, _ in found})
    return channels, [[float(found.get((s, t)) or 0.0) for t in channels] for s in channels]


def color_correct_pixels(pixels: DataFrame, dyes: list[list[float]] | None = None, bins: int = 8) -> DataFrame:
    """id, dye, v of pixels in rows id, channel, v: the dye amounts in the type
    of v (integers cut off). Without a matrix it is estimated from the pixels;
    a given one has a column for each channel, in order. A pixel that lacks a
    channel has null amounts; an empty table gives no rows."""
    if dyes is None:
        channels, dyes = estimated_dyes(pixels, bins)
    else:
        channels = sorted(r[0] for r in pixels.select("channel").distinct().collect())
        if channels and len(dyes[0]) != len(channels):
            raise ValueError(f"a matrix of {len(dyes[0])} channels for pixels of {len(channels)}")
    kind = pixels.schema["v"].dataType
    if not channels:
        return pixels.select("id", F.lit(0).alias("dye"), "v").limit(0)
    each = [F.max(F.when(F.col("channel") == c, F.col("v"))) for c in channels]
    amounts = color_correct(F.col("w"), dyes)
    wide = pixels.groupBy("id").agg(F.array(*each).alias("w")).select("id", F.posexplode(amounts).alias("dye", "v"))
    return wide.withColumn("v", F.col("v").cast(kind))


def _halves(a: Column) -> tuple[Column, Column]:
    """A double as the sum of two of half the digits."""
    c = a * 134217729.0
    high = c - (c - a)
    return high, a - high


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once: the product's rest is found exactly, by halves."""
    (p, q), (r, s) = _halves(a), _halves(b)
    product = a * b
    rest = ((p * r - product) + p * s + q * r) + q * s
    total = product + c
    part = total - product
    lost = (product - (total - part)) + (c - part)
    return F.nanvl(total + (lost + rest), total)


def quantile(stack: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """By keys, the quantile of the values: low * (1 - d) + high * d of the two
    values beside its place, the sum fused as SQL engines compute it, since
    values over it are truncated later and show its last bit."""
    sorted_ = stack.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("all_"))
    placed = sorted_.withColumn("at_", (F.size("all_") - 1) * F.lit(float(share))).withColumn("d_", F.col("at_") - F.floor("at_"))
    ends = placed.select(*keys, "d_", *[F.get("all_", f("at_").cast("int")).cast("double").alias(n) for f, n in ((F.floor, "low_"), (F.ceil, "high_"))])
    ends = ends.withColumn("far_", F.col("high_") * F.col("d_"))
    between = F.when((F.col("d_") == 0) | (F.col("low_") == F.col("high_")), F.col("low_")).otherwise(fused(F.col("low_"), 1 - F.col("d_"), F.col("far_")))
    return ends.select(*keys, between.alias(name))


def background_levels(stack: DataFrame, layer: str, pixel: list[str], value: str = "v", percent: float = 0.05) -> DataFrame:
    """Per layer and pixel: the percentile over images, truncated where values
    are integers, over the layer's largest."""
    kind = stack.schema[value].dataType
    low = quantile(stack, [layer, *pixel], value, percent, "low")
    if isinstance(kind, IntegralType):
        low = low.withColumn("low", F.col("low").cast(kind))
    top = low.groupBy(layer).agg(F.max("low").alias("top"))
    return low.join(top, layer).select(layer, *pixel, (F.col("low") / F.col("top")).alias("background"))


def background(stack: DataFrame, layer: str, pixel: list[str], value: str = "v", percent: float = 0.05, sigma: float = 8.0, size: int = 512) -> DataFrame:
    """``background_levels`` after a Gaussian over each layer, in tiles with
    halo. Pixels (one or two columns) that are not given count as 0."""
    ship(stack.sparkSession)
    kinds = {c: stack.schema[c].dataType for c in (layer, *pixel)}
    at = [F.col(c).cast("long") for c in pixel] + [F.lit(0).cast("long")] * (2 - len(pixel))
    levels = background_levels(stack, layer, pixel, value, percent)
    ends = stack.agg(F.min(at[0]), F.min(at[1]), F.max(at[0]), F.max(at[1])).first()
    low, high, halo = ends[:2], ends[2:], len(gaussian_weights(sigma)) // 2

    def run(df: pd.DataFrame) -> pd.DataFrame:
        tile = int(df.tile_x.iloc[0]), int(df.tile_y.iloc[0])
        start = [max(t * size - halo, a) for t, a in zip(tile, low)]
        stop = [min((t + 1) * size + halo, b + 1) for t, b in zip(tile, high)]
        plane = np.zeros((stop[0] - start[0], stop[1] - start[1]))
        here = df.x.to_numpy() - start[0], df.y.to_numpy() - start[1]
        plane[here] = df.background
        own = (df.x // size == tile[0]) & (df.y // size == tile[1])
        return df.assign(background=blur(plane, sigma)[here])[own][["layer", "x", "y", "background"]]

    tiled = tiles(levels.select(F.col(layer).alias("layer"), at[0].alias("x"), at[1].alias("y"), "background"), size, halo)
    out = tiled.groupBy("layer", "tile_x", "tile_y").applyInPandas(run, f"layer {kinds[layer].simpleString()}, x long, y long, background double")
    return out.select(F.col("layer").alias(layer), *[F.col(c).cast(kinds[p]).alias(p) for c, p in zip("xy", pixel)], "background")


def illumination(stack: DataFrame, back: DataFrame, keys: list[str], value: str = "v", limits: tuple[int, int] | None = None) -> DataFrame:
    """Values over the background; integer images are clipped to their limits
    and truncated."""
    out = stack.join(back, keys).withColumn("corrected", F.col(value) / F.col("background"))
    if limits is not None:
        out = out.withColumn("corrected", F.least(F.greatest(F.col("corrected"), F.lit(float(limits[0]))), F.lit(float(limits[1]))).cast("long"))
    return out.drop("background")

