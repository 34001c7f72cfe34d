"""Image operators. Per-pixel steps are relational, on (cycle, channel, x, y,
v); neighbourhood filters run in numpy on planes or on tiles with a halo."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issq.scratch import checkpointed
from issq.session import ship

#: Angles of the four elongated footprints of the opening filter.
ANGLES = (-np.pi / 4, 0.0, np.pi / 4, np.pi / 2)


def standardize(pixels: DataFrame) -> DataFrame:
    """(v - mean) / population deviation of each (cycle, channel) plane."""
    facts = pixels.groupBy("cycle", "channel").agg(F.avg("v").alias("m_"), F.stddev_pop("v").alias("s_"))
    return pixels.join(facts, ["cycle", "channel"]).withColumn("v", (F.col("v") - F.col("m_")) / F.col("s_")).drop("m_", "s_")


def highlight(pixels: DataFrame) -> DataFrame:
    """x, y, grey: less the second highest channel, clipped at 0; then the
    population deviation over cycles, summed over channels."""
    second = F.element_at(F.array_sort(F.collect_list("v")), -2)
    spots = pixels.groupBy("cycle", "x", "y").agg(second.alias("second"), F.collect_list(F.struct("channel", "v")).alias("c"))
    clipped = spots.select("x", "y", F.explode("c").alias("c"), "second").select("x", "y", "c.channel", F.greatest(F.col("c.v") - F.col("second"), F.lit(0.0)).alias("v"))
    return clipped.groupBy("x", "y", "channel").agg(F.stddev_pop("v").alias("s")).groupBy("x", "y").agg(F.sum("s").alias("grey"))


def mark(pixels: DataFrame, points: DataFrame, low: int = 2, high: int = 5, value: float = 1.0) -> DataFrame:
    """Cross-hairs around points as rows of an extra plane: x, y, v."""
    arms = [(d * s, 0) for d in range(low, high) for s in (1, -1)] + [(0, d * s) for d in range(low, high) for s in (1, -1)]
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in arms])
    drawn = points.select(F.explode(steps).alias("s"), F.floor("x").alias("px"), F.floor("y").alias("py"))
    drawn = drawn.select((F.col("px") + F.col("s.dx")).alias("x"), (F.col("py") + F.col("s.dy")).alias("y")).distinct()
    return pixels.select("x", "y").distinct().join(drawn, ["x", "y"], "left_semi").withColumn("v", F.lit(value))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def blur(plane: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, edges continued by the nearest pixel."""
    w = gaussian_weights(sigma)
    r = len(w) // 2
    for axis in (0, 1):
        pad = np.pad(plane, [(r, r) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        n = plane.shape[axis]
        plane = sum(w[k] * np.take(pad, np.arange(k, k + n), axis=axis) for k in range(len(w)))
    return plane


def disk(radius: float) -> np.ndarray:
    r = np.arange(-int(radius), int(radius) + 1)
    return r[:, None] ** 2 + r[None, :] ** 2 <= radius**2


def ellipse(radius: int, long_: float, short: float, angle: float) -> np.ndarray:
    r = np.arange(-radius, radius + 1)
    u = r[:, None] * np.cos(angle) + r[None, :] * np.sin(angle)
    v = -r[:, None] * np.sin(angle) + r[None, :] * np.cos(angle)
    return (u / long_) ** 2 + (v / short) ** 2 < 1


def _extreme(plane: np.ndarray, shape: np.ndarray, least: bool) -> np.ndarray:
    rx, ry = shape.shape[0] // 2, shape.shape[1] // 2
    pad = np.pad(plane, [(rx, rx), (ry, ry)], constant_values=np.inf if least else -np.inf)
    out = None
    for dx, dy in zip(*np.nonzero(shape)):
        part = pad[dx : dx + plane.shape[0], dy : dy + plane.shape[1]]
        out = part if out is None else (np.minimum if least else np.maximum)(out, part)
    return out


def erode(plane: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return _extreme(plane, shape, True)


def dilate(plane: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return _extreme(plane, shape[::-1, ::-1], False)


def opening(plane: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return dilate(erode(plane, shape), shape)


def ellipse_filter(plane: np.ndarray, major: int = 4, minor: float = 0.5) -> np.ndarray:
    """The plane less the largest of its openings by four rotated ellipses
    laid over a disk, and 0."""
    base = np.zeros_like(plane)
    for angle in ANGLES:
        base = np.maximum(base, opening(plane, disk(major) | ellipse(major, major + 1, minor, angle)))
    return plane - base


def top_hat(plane: np.ndarray, radius: float = 2) -> np.ndarray:
    return plane - opening(plane, disk(radius))


def background_free(plane: np.ndarray, sigma: float = 4.0) -> np.ndarray:
    """Less its blur, standardised."""
    out = plane - blur(plane, sigma)
    return (out - out.mean()) / max(out.std(), 1e-12)


def clipped_contrast(plane: np.ndarray, sigma: float = 4.0) -> np.ndarray:
    """Standardised and clipped at 0, less its blur, clipped again."""
    out = np.maximum((plane - plane.mean()) / max(plane.std(), 1e-12), 0)
    return np.maximum(out - blur(out, sigma), 0)


FILTERS = {"ellipse": ellipse_filter, "top_hat": top_hat, "background": background_free, "contrast": clipped_contrast}
#: How far a pixel of each filter sees: an opening twice its footprint.
REACH = {
    "ellipse": lambda major=4, minor=0.5: 2 * major,
    "top_hat": lambda radius=2: 2 * int(radius),
    "background": lambda sigma=4.0: len(gaussian_weights(sigma)) // 2,
    "contrast": lambda sigma=4.0: len(gaussian_weights(sigma)) // 2,
}


def filter_planes(pixels: DataFrame, method: str, size: int = 512, **how) -> DataFrame:
    """Apply a neighbourhood filter to each (cycle, channel, ...) plane, in tiles
    with a halo of the filter's reach. Borders are those of the whole plane, and
    the mean and deviation of 'background' and 'contrast' the whole plane's
    (pixels that are not given count as 0), found by a pass over the tiles, so
    results do not depend on the tile size."""
    ship(pixels.sparkSession)
    keys = [c for c in pixels.columns if c not in ("x", "y", "v")]
    names = [c for c in pixels.columns if c != "v"]
    run_filter, halo, sigma = FILTERS[method], REACH[method](**how), how.get("sigma", 4.0)
    fields = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.schema.fields}

    def beside(df: DataFrame, facts: DataFrame) -> DataFrame:
        """Each row with the facts of its plane."""
        facts = facts.select(*[F.col(f"`{k}`").alias(f"k{n}_") for n, k in enumerate(keys)], *[c for c in facts.columns if c not in keys])
        same = F.lit(True)
        for n, k in enumerate(keys):
            same = same & df[f"`{k}`"].eqNullSafe(facts[f"k{n}_"])
        return df.join(facts, same).drop(*[f"k{n}_" for n in range(len(keys))])

    ends = pixels.groupBy(*keys).agg(*[f(F.floor(c)).cast("long").alias(f"{c}{n}_") for c in ("x", "y") for n, f in ((0, F.min), (1, F.max))])
    tiled = beside(tiles(pixels, size, halo), ends)
    by = [*keys, "tile_x", "tile_y"]

    def load(df: pd.DataFrame) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[slice, slice]]:
        """The plane of a tile, the place of each row in it, and where the
        tile's own pixels are."""
        tile = int(df.tile_x.iloc[0]), int(df.tile_y.iloc[0])
        low, high = (int(df.x0_.iloc[0]), int(df.y0_.iloc[0])), (int(df.x1_.iloc[0]), int(df.y1_.iloc[0]))
        start = [max(t * size - halo, a) for t, a in zip(tile, low)]
        stop = [min((t + 1) * size + halo, b + 1) for t, b in zip(tile, high)]
        plane = np.zeros((stop[0] - start[0], stop[1] - start[1]))
        at = np.floor(df.x.to_numpy()).astype(int) - start[0], np.floor(df.y.to_numpy()).astype(int) - start[1]
        plane[at] = df.v.to_numpy()
        own = tuple(slice(max(t * size, a) - s, max(min((t + 1) * size, b + 1) - s, 0)) for t, a, b, s in zip(tile, low, high, start))
        return plane, at, own

    def moments(df: pd.DataFrame) -> pd.DataFrame:
        plane, _, own = load(df)
        mine = (plane - blur(plane, sigma) if method == "background" else plane)[own]
        mean = mine.mean() if mine.size else 0.0
        return df[keys].iloc[:1].assign(n_=mine.size, mean_=mean, squares_=float(((mine - mean) ** 2).sum()))

    if method in ("background", "contrast"):
        schema = ", ".join([*[fields[k] for k in keys], "n_ long", "mean_ double", "squares_ double"])
        facts = beside(checkpointed(tiled.groupBy(*by).applyInPandas(moments, schema)), ends.withColumn("area_", (F.col("x1_") - F.col("x0_") + 1) * (F.col("y1_") - F.col("y0_") + 1)))
        means = facts.groupBy(*keys).agg((F.sum(F.col("n_") * F.col("mean_")) / F.max("area_")).alias("m_"))
        # Tiles without a pixel near them are 0 throughout.
        apart = F.col("mean_") - F.col("m_")
        rest = (F.max("area_") - F.sum("n_")) * F.max("m_") * F.max("m_")
        spread = beside(facts, means).groupBy(*keys).agg(F.max("m_").alias("m_"), F.sqrt((F.sum(F.col("squares_") + F.col("n_") * apart * apart) + rest) / F.max("area_")).alias("s_"))
        tiled = beside(tiled, checkpointed(spread))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        plane, at, _ = load(df)
        if method == "background":
            out = (plane - blur(plane, sigma) - df.m_.iloc[0]) / max(df.s_.iloc[0], 1e-12)
        elif method == "contrast":
            out = np.maximum((plane - df.m_.iloc[0]) / max(df.s_.iloc[0], 1e-12), 0)
            out = np.maximum(out - blur(out, sigma), 0)
        else:
            out = run_filter(plane, **how)
        mine = (np.floor(df.x / size) == df.tile_x) & (np.floor(df.y / size) == df.tile_y)
        return df.assign(v=out[at])[mine][[*names, "v"]]

    out = tiled.groupBy(*by).applyInPandas(run, ", ".join(fields[c] for c in names) + ", v double")
    return out.select(*pixels.columns)


def tiles(pixels: DataFrame, size: int, halo: int) -> DataFrame:
    """Adds tile_x, tile_y; pixels near a border are copied to the tiles whose
    halo they lie in."""
    span = lambda c: F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size))
    return pixels.withColumn("tile_x", F.explode(span("x"))).withColumn("tile_y", F.explode(span("y")))


def inner(tiled: DataFrame, size: int) -> DataFrame:
    """Each pixel from its own tile only."""
    return tiled.where((F.floor(F.col("x") / size) == F.col("tile_x")) & (F.floor(F.col("y") / size) == F.col("tile_y"))).drop("tile_x", "tile_y")


def blobs(plane: np.ndarray, low: float = 1.0, high: float = 2.0, steps: int = 7, threshold: float = 0.0) -> np.ndarray:
    """(x, y, sigma) of local maxima, over space and scale, of the negated
    scale-normalised Laplacian of Gaussians."""
    sigmas = np.linspace(low, high, steps)
    cube = []
    for s in sigmas:
        g = np.pad(blur(plane, s), 1, mode="edge")
        cube.append(-(g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]) * s * s)
    cube = np.stack(cube)
    pad = np.pad(cube, 1, constant_values=-np.inf)
    top = np.ones(cube.shape, dtype=bool)
    for a in range(3):
        for b in range(3):
            for c in range(3):
                if (a, b, c) != (1, 1, 1):
                    top &= cube >= pad[a : a + cube.shape[0], b : b + cube.shape[1], c : c + cube.shape[2]]
    k, x, y = np.nonzero(top & (cube > threshold))
    return np.stack([x, y, sigmas[k]], axis=1)


def _highlighted(cube: np.ndarray) -> np.ndarray:
    """``highlight`` of one cube of planes."""
    part = np.sort(cube, axis=1)[:, -2:-1] if cube.shape[1] > 1 else 0
    return np.maximum(cube - part, 0).std(axis=0).sum(axis=0)


def detect_dots(pixels: DataFrame, size: int = 512, halo: int = 26) -> DataFrame:
    """x, y, sigma, values[cycle][channel] of the dots of an image.

    Blur is taken off every plane and planes are standardised, the highlighted
    grey image is searched for blobs above its mean, and intensities are read
    from the planes after a small dilation. The work is done per tile with halo,
    but the mean and deviation of the planes and the mean of the grey image are
    the whole image's (pixels that are not given count as 0), each found by a
    pass over the tiles, so dots do not depend on the tile size. The halo is the
    reach of the two blurs (16 and 8), the Laplacian and the maximum."""
    spark = pixels.sparkSession
    ship(spark)
    schema = "x double, y double, sigma double, values array<array<double>>"
    ends = pixels.agg(*[f(c).cast("long") for c in ("x", "y") for f in (F.min, F.max)], F.max("cycle").cast("long"), F.max("channel").cast("long")).first()
    if ends[0] is None:
        return spark.createDataFrame([], schema)
    low, high, planes = (ends[0], ends[2]), (ends[1], ends[3]), (ends[4] + 1, ends[5] + 1)
    area = (high[0] - low[0] + 1) * (high[1] - low[1] + 1)

    def load(df: pd.DataFrame) -> tuple[np.ndarray, tuple[int, int], tuple[slice, slice]]:
        """The planes of a tile less their blur, the tile's first pixel, and
        where its inner pixels are."""
        tile = int(df.tile_x.iloc[0]), int(df.tile_y.iloc[0])
        start = [max(t * size - halo, a) for t, a in zip(tile, low)]
        stop = [min((t + 1) * size + halo, b + 1) for t, b in zip(tile, high)]
        cube = np.zeros((*planes, stop[0] - start[0], stop[1] - start[1]))
        cube[df.cycle, df.channel, (df.x - start[0]).astype(int), (df.y - start[1]).astype(int)] = df.v
        for c in range(planes[0]):
            for k in range(planes[1]):
                cube[c, k] -= blur(cube[c, k], 4.0)
        own = tuple(slice(max(t * size, a) - s, max(min((t + 1) * size, b + 1) - s, 0)) for t, a, b, s in zip(tile, low, high, start))
        return cube, (start[0], start[1]), own

    def plane_sums(df: pd.DataFrame) -> pd.DataFrame:
        cube, _, own = load(df)
        mine = cube[:, :, own[0], own[1]]
        rows = [(c, k, float(mine[c, k].sum()), float((mine[c, k] ** 2).sum())) for c in range(planes[0]) for k in range(planes[1])]
        return pd.DataFrame(rows, columns=["cycle", "channel", "total", "squares"])

    tiled = tiles(pixels, size, halo).groupBy("tile_x", "tile_y")
    sums = tiled.applyInPandas(plane_sums, "cycle long, channel long, total double, squares double").groupBy("cycle", "channel").agg(F.sum("total"), F.sum("squares")).collect()
    mean, deviation = np.zeros((*planes, 1, 1)), np.zeros((*planes, 1, 1))
    for c, k, total, squares in sums:
        mean[c, k] = total / area
        deviation[c, k] = max(max(squares / area - (total / area) ** 2, 0.0) ** 0.5, 1e-12)

    def grey_sums(df: pd.DataFrame) -> pd.DataFrame:
        cube, _, own = load(df)
        mine = _highlighted((cube - mean) / deviation)[own]
        return pd.DataFrame([(mine.size, float(mine.sum()))], columns=["n", "total"])

    n, total = tiled.applyInPandas(grey_sums, "n long, total double").agg(F.sum("n"), F.sum("total")).first()
    threshold = (total + (area - n) * float(_highlighted(-mean / deviation)[0, 0])) / area

    def run(df: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(df.tile_x.iloc[0]), int(df.tile_y.iloc[0])
        cube, (x0, y0), _ = load(df)
        cube = (cube - mean) / deviation
        found = blobs(_highlighted(cube), threshold=threshold)
        wide = np.stack([[dilate(p, disk(2)) for p in each] for each in cube])
        rows = []
        for x, y, s in found:
            if (x + x0) // size == tx and (y + y0) // size == ty:
                rows.append((float(x + x0), float(y + y0), float(s), wide[:, :, int(x), int(y)].tolist()))
        return pd.DataFrame(rows, columns=["x", "y", "sigma", "values"])

    return tiled.applyInPandas(run, schema)
