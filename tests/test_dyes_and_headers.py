"""Estimated dye matrix and image headers against numpy."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from issq.operators import correct
from issq.sources import images


@pytest.mark.parametrize("kind", ["int", "double"])
def test_color_correct_estimates_the_matrix(spark, kind):
    rng = np.random.default_rng(3)
    amounts = rng.integers(0, 900, (300, 4)) * (rng.random((300, 4)) < 0.5)
    seen = (amounts @ np.asarray(correct.EXAMPLE_DYES) + rng.integers(1, 6, (300, 4))).astype(kind)
    pixels = spark.createDataFrame([(i, c, seen[i, c].item()) for i in range(300) for c in range(4)], f"id long, channel int, v {kind}")
    response = {(r.source, r.target): r.response for r in correct.dye_matrix(pixels).collect()}
    dyes = np.array([[response[s, t] for t in range(4)] for s in range(4)])
    want = np.linalg.lstsq(dyes.T, seen.T.astype(float), rcond=None)[0].T
    want[want < 0] = 0
    got = correct.color_correct_pixels(pixels)
    assert got.schema["v"].dataType == pixels.schema["v"].dataType
    rows = {(r.id, r.dye): r.v for r in got.collect()}
    assert len(rows) == 1200
    for (i, d), v in rows.items():
        if kind == "int":  # cut off, but for amounts that lie on an integer
            assert v in {int(want[i, d] - 1e-6), int(want[i, d]), int(want[i, d] + 1e-6)}
        else:
            assert v == pytest.approx(want[i, d], abs=1e-6)


def test_color_correct_odd_tables(spark):
    empty = spark.createDataFrame([], "id long, channel int, v double")
    assert correct.color_correct_pixels(empty).count() == 0
    assert correct.color_correct_pixels(empty, correct.EXAMPLE_DYES).count() == 0
    some = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0), (2, 0, 4.0)], "id long, channel int, v double")
    got = correct.color_correct_pixels(some, [[1.0, 0.0], [0.0, 1.0]]).orderBy("id", "dye").collect()
    assert [(r.id, r.dye) for r in got] == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert [r.v for r in got][:2] == pytest.approx([2.0, 3.0]) and got[3].v is None
    with pytest.raises(ValueError):
        correct.color_correct_pixels(some, correct.EXAMPLE_DYES)


def test_described(spark, tmp_path):
    cube = np.arange(2 * 3 * 5, dtype="uint16").reshape(2, 3, 5)
    np.save(tmp_path / "cube.npy", cube)
    np.save(tmp_path / "turned.npy", np.asfortranarray(cube[0].astype("float32")))
    body = cube[1].astype("<u2").tobytes()
    tags = [(256, 4, 5), (257, 4, 3), (258, 3, 16), (259, 3, 1), (273, 4, 8), (278, 4, 3), (279, 4, len(body))]
    entries = b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in tags)
    (tmp_path / "page.tif").write_bytes(b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0))
    rows = images.described(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1)).collect()
    assert {r.path: (r["shape"], r.dtype, r.nbytes) for r in rows} == {"cube.npy": ([2, 3, 5], "uint16", 60), "turned.npy": ([3, 5], "float32", 60), "page.tif": ([3, 5], "uint16", 30)}
    planes = {(r.path.rsplit("/", 1)[-1], r.plane): r.v for r in images.planes(spark, str(tmp_path)).collect()}
    assert planes["cube.npy", 1] == planes["page.tif", 0] == cube[1].ravel().tolist()
    assert planes["turned.npy", 0] == cube[0].ravel().tolist()
