"""Background of image layers against numpy on whole layers."""

import numpy as np
import pytest

from issq.operators import correct, image


@pytest.mark.parametrize("kind", ["int", "double"])
def test_background_is_truncated_and_blurred(spark, kind):
    rng = np.random.default_rng(8)
    images = rng.integers(50, 400, (4, 2, 60, 45)).astype(kind)
    rows = [(k, x, y, images[n, k, x, y].item()) for n in range(4) for k in range(2) for x in range(60) for y in range(45)]
    stack = spark.createDataFrame(rows, f"layer int, x int, y int, v {kind}")
    low = np.percentile(images, 5, axis=0).astype(images.dtype)
    want = np.stack([image.blur(p / p.max(), 8.0) for p in low])
    for size in (512, 40):
        got = np.zeros_like(want)
        back = correct.background(stack, "layer", ["x", "y"], size=size)
        rows = back.collect()
        for r in rows:
            got[r.layer, r.x, r.y] = r.background
        assert len(rows) == want.size
        assert np.allclose(got, want)
    if kind == "int":
        out = correct.illumination(stack, back, ["layer", "x", "y"], limits=(0, 450))
        total = np.clip(images / want, 0, 450).astype(int).sum()
        assert abs(sum(r.corrected for r in out.collect()) - total) <= 2


def test_background_of_a_line(spark):
    low = np.random.default_rng(9).uniform(1, 9, 100)
    stack = spark.createDataFrame([("a", x, float(v)) for x, v in enumerate(low)], "layer string, x long, v double")
    got = {r.x: r.background for r in correct.background(stack, "layer", ["x"], size=30).collect()}
    assert np.allclose([got[x] for x in range(100)], image.blur(low[:, None] / low.max(), 8.0)[:, 0])


def test_levels_to_the_last_bit(spark):
    """Values over the background are truncated, so its last bit shows: levels
    equal those of SQL exactly, and so does a value that is just a multiple."""
    import duckdb

    rng = np.random.default_rng(8)
    rows = [("a", int(x), round(float(v), 2)) for x, v in zip(rng.integers(0, 300, 6000), rng.exponential(50, 6000))]
    stack = spark.createDataFrame(rows, "layer string, x long, v double")
    con = duckdb.connect()
    con.sql("CREATE TABLE t (layer VARCHAR, x BIGINT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    low = con.sql("SELECT x, quantile_cont(v, 0.05) AS low FROM t GROUP BY x").fetchall()
    top = max(v for _, v in low)
    got = {r.x: r.background for r in correct.background_levels(stack, "layer", ["x"]).collect()}
    assert got == {x: v / top for x, v in low}
