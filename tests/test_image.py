"""Dots found in tiles against those of the whole image."""

import numpy as np
import pytest

from issq.operators import image


def picture(spark):
    """Noise on a 150 x 90 image with dots in one corner only, one of them
    faint; a part of the image is not given."""
    rng = np.random.default_rng(6)
    cube = rng.normal(0, 0.05, (2, 3, 150, 90))
    for x, y, height in [(10 + 6 * i, 8 + 6 * j, 9.0) for i in range(6) for j in range(5)] + [(63, 20, 2.0), (64, 50, 5.0)]:
        spot = np.zeros((150, 90))
        spot[x, y] = height
        cube[x % 2, y % 3] += image.blur(spot, 1.2)
    rows = [(c, k, x, y, float(cube[c, k, x, y])) for c in range(2) for k in range(3) for x in range(150) for y in range(90) if not (x > 120 and y < 60)]
    return cube, spark.createDataFrame(rows, "cycle int, channel int, x int, y int, v double")


def dots(df):
    return {(r.x, r.y, r.sigma): np.array(r["values"]) for r in df.collect()}


def test_dots_do_not_depend_on_tiles(spark):
    cube, pixels = picture(spark)
    cube[:, :, 121:, :60] = 0
    planes = np.stack([[image.background_free(p) for p in each] for each in cube])
    grey = np.maximum(planes - np.sort(planes, axis=1)[:, -2:-1], 0).std(axis=0).sum(axis=0)
    want = {(float(x), float(y), s) for x, y, s in image.blobs(grey, threshold=grey.mean())}
    wide = np.stack([[image.dilate(p, image.disk(2)) for p in each] for each in planes])
    assert len(want) > 20
    for size in (512, 32):
        got = dots(image.detect_dots(pixels, size))
        assert got.keys() == want
        assert all(np.allclose(v, wide[:, :, int(x), int(y)]) for (x, y, _), v in got.items())
    assert image.detect_dots(pixels.where("v > 1e9")).count() == 0


@pytest.mark.parametrize("method", sorted(image.FILTERS))
def test_filters_do_not_depend_on_tiles(spark, method):
    """Each filter in small tiles equals the filter of the whole planes; groups
    are tiles, so no task gets a plane. A corner is not given."""
    cube, pixels = picture(spark)
    cube[:, :, 121:, :60] = 0
    want = np.stack([[image.FILTERS[method](p) for p in each] for each in cube])
    found = image.filter_planes(pixels, method, 32).collect()
    assert len(found) == pixels.count() and len({(r.cycle, r.channel, r.x, r.y) for r in found}) == len(found)
    assert all(abs(r.v - want[r.cycle, r.channel, r.x, r.y]) < 1e-9 for r in found)
    assert image.filter_planes(pixels.where("v > 1e9"), method).count() == 0
