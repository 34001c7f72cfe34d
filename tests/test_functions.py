import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from issq.functions import calling, codec
from issq.operators import correct, groups, image, matching, pairing
from issq.sources import images, tables


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_pack_known_values(spark):
    assert one(spark, "GTAC", "string", codec.pack) == 228
    assert one(spark, "N" * 3, "string", codec.pack) is None
    assert one(spark, "G" * 33, "string", codec.pack) is None
    assert one(spark, "", "string", codec.pack) == 0
    assert one(spark, 228, "long", lambda c: codec.hamming(c, F.lit(27).cast("long"))) == 4


def test_pack_round_trip_and_hamming(spark):
    rnd = random.Random(12345)
    rows = [("".join(rnd.choice("GTAC") for _ in range(32)), "".join(rnd.choice("GTAC") for _ in range(32))) for _ in range(50)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", codec.pack(F.col("a")).alias("p"), codec.pack(F.col("b")).alias("q"))
    for r in df.select("a", "b", codec.unpack(F.col("p"), 32).alias("back"), codec.hamming(F.col("p"), F.col("q")).alias("h")).collect():
        assert r.back == r.a
        assert r.h == sum(x != y for x, y in zip(r.a, r.b))


def test_call_first_of_ties_and_overwrite(spark):
    assert one(spark, [[1.0, 3.0, 3.0, 0.0]], "array<array<double>>", calling.sequence) == "T"
    assert one(spark, "A" * 12, "string", lambda c: calling.overwrite(c, 4, "C")) == "CAAACAAACAAA"


def test_normalize(spark):
    got = one(spark, [[3.0, 4.0, 0.0, 0.0]], "array<array<double>>", lambda c: calling.normalize(c, "full"))
    assert got[0] == pytest.approx([0.6, 0.8, 0, 0])
    assert one(spark, [[3.0, 4.0, 0.0, 0.0]], "array<array<double>>", lambda c: calling.normalize(c, "sub"))[0] == pytest.approx([0, 1, -3, -3])


def test_mode_takes_smallest_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("c",)], "v string")
    assert df.agg(groups.mode(F.col("v"))).first()[0] == "a"


def test_group_table_pads_and_comes_back(spark):
    rows = [(0, 0, "GTAC"), (0, 1, "GGGG"), (1, 2, "GTAT"), (2, 3, "GTGT"), (2, 4, "GGTT"), (2, 5, "TTTT")]
    df = spark.createDataFrame(rows, "grp long, read_id long, read string")
    wide = tables.groups_to_table(df, "grp", "read_id", 3)
    assert {r.grp: (r.num_reads, r.read_2) for r in wide.collect()} == {0: (2, None), 1: (1, None), 2: (3, "TTTT")}
    assert {(r.grp, r.read) for r in tables.groups_from_table(wide, "grp").collect()} == {(g, s) for g, _, s in rows}


def test_match_rules(spark):
    lib = spark.createDataFrame([(0, 0, 228), (1, 0, 229)], "lib_id long, slot int, packed long")

    def run(rows, **how):
        reads = spark.createDataFrame(rows, "entry long, ord long, count long, packed long")
        return [(r.entry, r.lib_id) for r in matching.match(reads, lib, bases=4, **how).orderBy("entry").collect()]

    assert run([(0, 0, 5, 228), (0, 1, 3, 229)]) == [(0, 0)]  # 1/6 is less than 1/4
    assert run([(0, 0, 5, 228), (0, 1, 5, 229)]) == [(0, None)]  # a tie
    assert run([(0, 0, 0, 228)]) == [(0, None)]  # count 0 takes no part
    two = spark.createDataFrame([(0, 0, 228), (0, 1, 27)], "lib_id long, slot int, packed long")
    for count, want in ((1, None), (2, 0)):
        reads = spark.createDataFrame([(0, 0, count, 228), (0, 1, count, 27)], "entry long, ord long, count long, packed long")
        assert matching.match(reads, two, 2, 0, 4).first().lib_id == want


def test_fuzzy_join_equals_brute_force(spark):
    rnd = random.Random(5)
    a = [(i, rnd.getrandbits(24)) for i in range(60)]
    b = [(i, a[i % 60][1] ^ (1 << 2 * rnd.randrange(12)) ^ (2 << 2 * rnd.randrange(12))) for i in range(120)]
    h = lambda x, y: bin(((x ^ y) | (x ^ y) >> 1) & 0x555555).count("1")
    left, right = spark.createDataFrame(a, "i long, packed long"), spark.createDataFrame(b, "j long, packed long")
    for radius in (0, 1, 2):
        got = sorted((r.i, r.j, r.h) for r in matching.hamming_pairs(left, right, radius, 12).collect())
        assert got == sorted((i, j, h(x, y)) for i, x in a for j, y in b if h(x, y) <= radius)


def test_dye_mix_and_unmix(spark):
    amounts = np.array([1.0, 0.0, 2.0, 3.0])
    mixed = (amounts @ np.array(correct.EXAMPLE_DYES)).tolist()
    assert one(spark, mixed, "array<double>", lambda c: correct.color_correct(c)) == pytest.approx(amounts.tolist(), abs=1e-9)


def test_alignment_distance_by_hand():
    a, b = np.array([[0.0, 0.0]]), np.array([[3.0, 4.0]])
    assert pairing.alignment_distance(a, b, 10) == 5.0
    assert pairing.alignment_distance(a, b, 1) == 2.0  # row border 1, plus a gap
    assert pairing.alignment_distance(np.zeros((0, 2)), np.zeros((3, 2))) == 3.0


def test_nearest_is_exact(spark):
    rnd = np.random.default_rng(3)
    p, q = rnd.integers(0, 400, (40, 2)).astype(float), rnd.integers(0, 400, (50, 2)).astype(float)
    make = lambda v: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(v)], "id long, x double, y double")
    got = {(r.id_i, r.id_j) for r in pairing.nearest(make(p), make(q), 5).collect()}
    d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2))
    want = {(i, int(j)) for i in range(40) for j in sorted(range(50), key=lambda j: (d[i, j], j))[:5]}
    assert got == want


def test_morphology():
    plane = np.zeros((15, 15))
    plane[7, 7] = 5
    assert image.opening(plane, image.disk(1)).max() == 0
    assert image.top_hat(plane, 1).max() == 5
    assert image.dilate(plane, image.disk(2)).astype(bool).sum() == image.disk(2).sum()
    assert np.isclose(image.blur(np.ones((9, 9)), 2.0), 1).all()
    assert len(image.blobs(image.blur(plane, 1.2))) >= 1


def test_image_files(spark, tmp_path):
    import io
    import struct

    data = np.arange(24, dtype=np.uint16).reshape(4, 6)
    buffer = io.BytesIO()
    np.save(buffer, np.stack([data, data + 1]))
    (tmp_path / "a.npy").write_bytes(buffer.getvalue())
    tags = [(256, 3, 1, 6), (257, 3, 1, 4), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, 8), (279, 4, 1, 48), (339, 3, 1, 1)]
    body = b"II*\0" + struct.pack("<I", 56) + data.tobytes() + struct.pack("<H", len(tags))
    body += b"".join(struct.pack("<HHII", t, k, n, v) for t, k, n, v in tags) + struct.pack("<I", 0)
    (tmp_path / "b.tif").write_bytes(body)
    rows = images.planes(spark, str(tmp_path)).collect()
    assert len(rows) == 3
    assert all(r.width == 4 and r.height == 6 for r in rows)
    assert sorted(r.v[0] for r in rows) == [0.0, 0.0, 1.0]
    assert images.headers(spark, str(tmp_path)).count() == 2


def test_blocked_matching_equals_plain(spark):
    """Near entries come from segments, far ones from the whole library; both
    equal a plain search, ties and counts included."""
    rng = random.Random(5)
    bits = lambda a, b: sum((a >> 2 * k) & 3 != (b >> 2 * k) & 3 for k in range(6))
    lib = [(n // 2, n % 2, rng.randrange(4**6)) for n in range(60)] + [(30, 0, 7)]
    reads = []
    for e in range(60):
        row = rng.randrange(30)
        for o in range(rng.randrange(1, 4)):
            code = lib[2 * row + o % 2][2] ^ (rng.choice([0, 0, 1, 3 << 4, 5 << 6]))
            reads.append((e, o, rng.randrange(0, 4), code if e % 5 else rng.randrange(4**6)))
    r, t = spark.createDataFrame(reads, "entry long, ord long, count long, packed long"), spark.createDataFrame(lib, "lib_id long, slot int, packed long")
    want_near, want_match = {}, {0: {}, 2: {}}
    for e in range(60):
        mine, used = [x for x in reads if x[0] == e], [x for x in reads if x[0] == e and x[2] > 0]
        d = {n: sum(min(bits(x[3], c) for x in mine) for _, _, c in lib[2 * n : 2 * n + 2]) for n in range(30)}
        low = min(d.values())
        hit = [n for n in d if d[n] == low]
        want_near[e] = (hit[0] if len(hit) == 1 else None, low)
        for m in want_match:
            cost = lambda x, c: (min(bits(x[3], c), 1) if m == 0 else bits(x[3], c)) + 1 / (x[2] + 1)  # noqa: B023, E731
            if len(used) < 2:
                want_match[m][e] = (None, None)
                continue
            order = sorted((sum(min(cost(x, c) for x in used) for _, _, c in lib[2 * n : 2 * n + 2]), n) for n in range(30))
            bad = order[0][0] >= m + 1 or order[1][0] - order[0][0] < 1e-5
            want_match[m][e] = (None if bad else order[0][1], order[0][0])
    got = {x.entry: (x.lib_id, x.distance) for x in matching.nearest(r, t, 2, bases=6).collect()}
    assert got == want_near
    assert {d <= 1 for _, d in got.values()} == {True, False}
    for m, want in want_match.items():
        got = {x.entry: (x.lib_id, x.distance) for x in matching.match(r, t, 2, m, bases=6).collect()}
        assert set(got) == set(want)
        for e, (lib_id, total) in want.items():
            assert got[e][0] == lib_id, e
            assert (got[e][1] is None) == (total is None) and (total is None or abs(got[e][1] - math.floor(total + 1e-9)) <= (abs(total - round(total)) < 1e-9)), e
