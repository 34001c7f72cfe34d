"""One query per operator id, over whole tables, with DuckDB SQL where SQL can
express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issq.functions import calling, codec, scaling
from issq.operators import cluster, correct, groups, image, matching, pairing, segment, spatial
from issq.plans import sql as S
from issq.sources import derived, images, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CYCLES = derived.CYCLES


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def rounded(array):
    return F.transform(array, lambda v: F.round(v, 6))


# --- tables -----------------------------------------------------------------

@query(f"WITH {S.EMB} SELECT read_id, x, y, cell, cnt AS count, array_to_string({S.CALL.format(v='vals')}, '') AS sequence, len(vals) AS n_cycles FROM emb")
def s1_build(spark, d):
    reads = tables.from_values(derived.reads(spark, d), "values", "read_id", "x", "y", attrs=["cell", "count"])
    return reads.select("read_id", "x", "y", "cell", "count", calling.sequence(F.col("values")).alias("sequence"), F.size("values").cast("long").alias("n_cycles"))


_WIDE = ", ".join(f"round(list_max(vals[{c + 1}]), 6) AS quality_{c:02}" for c in range(CYCLES)) + ", " + ", ".join(
    f"round(vals[{c + 1}][{k + 1}], 6) AS value_cycle{c:02}_ch{k:02}" for c in range(CYCLES) for k in range(4))


@query(f"""WITH {S.CALLED} SELECT x AS xpos, y AS ypos, array_to_string(bases, '') AS read,
round(list_sum(list_transform(vals, lambda w: list_max(w))) / 16, 6) AS quality, {_WIDE}, cell, cnt AS count FROM called""")
def s3_to_table(spark, d):
    wide = tables.to_table(derived.reads(spark, d).drop("read_id"), CYCLES, sequences=True, qualities=True)
    return wide.select(*[r6(c) if c.startswith(("value_", "quality")) else F.col(c) for c in wide.columns])


@query(f"WITH {S.CALLED} SELECT read_id, x, y, array_to_string(bases, '') AS sequence, round(list_sum(list_transform(vals, lambda w: list_sum(w))), 6) AS total, cell FROM called")
def s4_from_table(spark, d):
    wide = tables.to_table(derived.reads(spark, d).withColumnRenamed("read_id", "id"), CYCLES, sequences=True, qualities=True)
    back = tables.from_table(wide)
    total = calling.total(F.transform("values", calling.total))
    return back.select(F.col("id").alias("read_id"), "x", "y", "sequence", r6(total, "total"), "cell")


def _quads(spark, d):
    """Reads by fours: group, read_id, xpos, read."""
    r = derived.reads(spark, d)
    return r.select(F.floor(F.col("read_id") / 3 - F.col("read_id") % 2).alias("grp"), "read_id", F.col("x").alias("xpos"), calling.sequence(F.col("values")).alias("read"))


_QUADS = f"WITH {S.CALLED}, q AS (SELECT CAST(floor(read_id / 3 - read_id % 2) AS BIGINT) AS grp, read_id, x AS xpos, array_to_string(bases, '') AS read FROM called), rk AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY read_id) - 1 AS j FROM q)"


@query(_QUADS + " SELECT grp, count(*) AS num_reads, " + ", ".join(f"max(CASE WHEN j = {j} THEN xpos END) AS xpos_{j}, max(CASE WHEN j = {j} THEN read END) AS read_{j}" for j in range(4)) + " FROM rk GROUP BY grp")
def s5_groups_to_table(spark, d):
    return tables.groups_to_table(_quads(spark, d), "grp", "read_id", 4)


@query(_QUADS + " SELECT grp, j, xpos, read FROM rk")
def s6_groups_from_table(spark, d):
    back = tables.groups_from_table(tables.groups_to_table(_quads(spark, d), "grp", "read_id", 4), "grp")
    return back.select("grp", F.col("j").cast("long").alias("j"), "xpos", "read")


@query(f"WITH {S.CALLED} SELECT x, y, array_to_string(bases, '') AS read, cell, cnt AS count, " + ", ".join(
    f"round(vals[{c + 1}][{k + 1}], 6) AS cycle{c:02}_{n}" for c in range(CYCLES) for k, n in enumerate("GTAC")) + " FROM called")
def s7_read_table(spark, d):
    nested = tables.read_table(derived.reads(spark, d), CYCLES, ["cell", "count"])
    return nested.select("position.x", "position.y", "read", "cell", "count", *[r6(f"values.cycle{c:02}.{n}", f"cycle{c:02}_{n}") for c in range(CYCLES) for n in "GTAC"])


_RAGGED = f"WITH {S.EMB}, r AS (SELECT read_id, list_transform(vals[1 : 1 + read_id % 3], lambda w: list_max(w)) AS q FROM emb)"


def _ragged(spark, d):
    r = derived.reads(spark, d)
    return r.select("read_id", F.slice(calling.qualities(F.col("values")), F.lit(1), (1 + F.col("read_id") % 3).cast("int")).alias("q"))


@query(_RAGGED + " SELECT read_id, " + ", ".join(f"round(coalesce(q[{i + 1}], 0), 6) AS q_{i}" for i in range(3)) + ", len(q) AS q_length FROM r")
def s8_write_multicolumn(spark, d):
    wide = tables.write_multicolumn(_ragged(spark, d), "q", "q", 3)
    return wide.select("read_id", *[r6(f"q_{i}") for i in range(3)], "q_length")


@query(_RAGGED + " SELECT read_id, len(q) AS n, round(list_sum(q), 6) AS total FROM r")
def s9_read_multicolumn(spark, d):
    back = tables.read_multicolumn(tables.write_multicolumn(_ragged(spark, d), "q", "q", 3), "q")
    return back.select("read_id", F.size("q").cast("long").alias("n"), r6(calling.total(F.col("q")), "total"))


@query()
def s10_image_headers(spark, d):
    return images.headers(spark, d, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query(f"WITH {S.EMB} SELECT read_id, cell * 100 + cnt AS tag FROM emb")
def s13_attributes(spark, d):
    return derived.reads(spark, d).withColumn("tag", F.col("cell") * 100 + F.col("count")).select("read_id", "tag")


# --- projections ------------------------------------------------------------

@query(f"WITH {S.CALLED} SELECT read_id, array_to_string(bases, '') AS sequence FROM called")
def p1_base_call(spark, d):
    return derived.reads(spark, d).select("read_id", calling.sequence(F.col("values")).alias("sequence"))


@query(f"WITH {S.CALLED} SELECT read_id, c AS cycle, bases[c + 1] AS base FROM called, (SELECT unnest(range(16)) AS c)")
def p2_letters(spark, d):
    rows = derived.reads(spark, d).select("read_id", F.posexplode(calling.letters(F.col("values"))).alias("cycle", "base"))
    return rows.select("read_id", F.col("cycle").cast("long").alias("cycle"), "base")


@query(f"WITH {S.CALLED} SELECT read_id, array_to_string(list_transform(range(16), lambda i: CASE WHEN i % 4 = 0 THEN 'C' ELSE bases[i + 1] END), '') AS sequence FROM called")
def p3_overwrite(spark, d):
    return derived.reads(spark, d).select("read_id", calling.overwrite(calling.sequence(F.col("values")), 4, "C").alias("sequence"))


@query(f"WITH {S.EMB} SELECT read_id, c AS cycle, round(list_max(vals[c + 1]), 6) AS quality FROM emb, (SELECT unnest(range(16)) AS c)")
def p4_quality(spark, d):
    rows = derived.reads(spark, d).select("read_id", F.posexplode(calling.qualities(F.col("values"))).alias("cycle", "q"))
    return rows.select("read_id", F.col("cycle").cast("long").alias("cycle"), r6("q", "quality"))


def _normal(method: str):
    def run(spark, d):
        v = calling.normalize(F.col("values"), method)
        rows = derived.reads(spark, d).select("read_id", F.posexplode(v).alias("cycle", "w"))
        return rows.select("read_id", F.col("cycle").cast("long").alias("cycle"), *[F.round(F.col("w")[k], 6).alias(f"v{k}") for k in range(4)])

    return run


def _normal_sql(by: str) -> str:
    return f"WITH {S.CALLED} SELECT read_id, c AS cycle, " + ", ".join(f"round({by.format(k=k + 1)}, 6) AS v{k}" for k in range(4)) + " FROM called, (SELECT unnest(range(16)) AS c)"


for _m, _by in (("full", "vals[c + 1][{k}] / greatest(norms[c + 1], 1e-10)"), ("large", "vals[c + 1][{k}] / greatest(norms[c + 1], 1.0)"), ("sub", "vals[c + 1][{k}] - list_sort(vals[c + 1])[3]")):
    QUERIES[f"p5_normalize_{_m}"] = _normal(_m)
    SQL[f"p5_normalize_{_m}"] = _normal_sql(_by)


@query(f"WITH {S.EMB} SELECT read_id, x, y FROM emb WHERE read_id >= 10 AND read_id < 60")
def p6_slice(spark, d):
    return derived.reads(spark, d).where("read_id >= 10 and read_id < 60").select("read_id", "x", "y")


@query(f"""WITH {S.CALLED}, f AS (SELECT read_id, bases, list_max(list_transform(vals, lambda w: list_max(w) / greatest(list_sort(w)[3], 1e-6))) AS r FROM called)
SELECT read_id FROM f WHERE len(list_distinct(bases)) > 1 AND r < 150000""")
def p8_filter(spark, d):
    return derived.reads(spark, d).where(calling.passes_filter(F.col("values"), 150000)).select("read_id")


@query(f"WITH {S.PIXELS} SELECT read_id, round(sum(px.v), 6) AS total, count(*) AS n FROM emb JOIN px ON px.x = emb.cell AND px.y = 0 GROUP BY read_id")
def p9_intensities(spark, d):
    points = derived.reads(spark, d).select("read_id", F.col("cell").alias("x"), F.lit(0).alias("y"))
    met = points.join(derived.pixels(spark, d), ["x", "y"])
    return met.groupBy("read_id").agg(r6(F.sum("v"), "total"), F.count("*").alias("n"))


@query(f"WITH {S.EMB}, {S.MASKS} SELECT read_id, mk.cell AS cell FROM emb JOIN mk ON mk.x = emb.x AND mk.y = emb.y WHERE mk.cell <> 0")
def p10_label_lookup(spark, d):
    labels = derived.masks(spark, d).where("cell <> 0").select("x", "y", "cell")
    points = derived.reads(spark, d).select("read_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    return points.join(labels, ["x", "y"]).select("read_id", "cell")


# --- groups -----------------------------------------------------------------

@query(f"WITH {S.EMB} SELECT cell, min(read_id) AS first_read, count(*) AS num_reads FROM emb GROUP BY cell")
def a1_groupby(spark, d):
    return groups.first_reads(derived.reads(spark, d), "cell")


_SUMS = "SELECT cell, list_transform(range(16), lambda c: [" + ", ".join(f"sums[4 * c + {k}]" for k in range(1, 5)) + "]) AS vals FROM (SELECT cell, [" + ", ".join(f"sum(vals[{c}][{k}])" for c in range(1, 17) for k in range(1, 5)) + "] AS sums FROM emb GROUP BY cell)"


@query(f"WITH {S.EMB}, s AS ({_SUMS}), p AS (SELECT cell, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM emb GROUP BY cell), {S.modes('emb', 'cell', 'cnt', 'm')} SELECT cell, x, y, array_to_string({S.CALL.format(v='vals')}, '') AS sequence, round(list_sum(list_transform(vals, lambda w: list_sum(w))), 6) AS total, cnt AS count FROM s JOIN p USING (cell) JOIN m USING (cell)")
def a2_combine(spark, d):
    out = groups.combine(derived.reads(spark, d), "cell", CYCLES)
    return out.select("cell", r6("x"), r6("y"), "sequence", r6(calling.total(F.transform("values", calling.total)), "total"), "count")


@query(f"WITH {S.EMB}, {S.modes('emb', 'cell', 'cnt', 'm')} SELECT cell, cnt AS count FROM m")
def a3_mode(spark, d):
    return derived.reads(spark, d).groupBy("cell").agg(groups.mode(F.col("count")).alias("count"))


@query(f"WITH {S.CALLED}, q AS (SELECT cell, array_to_string(bases, '') AS sequence, cnt, x FROM called), {S.modes('q', 'cell', 'sequence', 'm')}, p AS (SELECT cell, round(avg(x), 6) AS x, sum(cnt)::BIGINT AS count FROM q GROUP BY cell) SELECT cell, x, sequence, count FROM p JOIN m USING (cell)")
def a4_groups_combine(spark, d):
    reads = derived.reads(spark, d).withColumn("sequence", calling.sequence(F.col("values"))).drop("values", "y")
    return groups.combine(reads, "cell", CYCLES, {"count": F.sum}).select("cell", r6("x"), "sequence", "count")


_INCELL = f"WITH {S.CALLED}, {S.MASKS}, f AS (SELECT mk.cell, array_to_string(bases, '') AS sequence, count(*) AS count FROM called JOIN mk ON mk.x = called.x AND mk.y = called.y WHERE mk.cell <> 0 GROUP BY ALL), c AS (SELECT DISTINCT cell FROM mk WHERE cell <> 0)"


@query(_INCELL + ", k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY count DESC, sequence) AS rank FROM f) SELECT cell, sequence, count, rank FROM c LEFT JOIN k USING (cell)")
def a5_call_reads(spark, d):
    return groups.call_reads(derived.reads(spark, d), derived.masks(spark, d), CYCLES).select("cell", "sequence", "count", "rank")


@query(f"WITH {S.EMB} SELECT cell, read_id FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY read_id) AS r FROM emb) WHERE r <= 3")
def a6_head(spark, d):
    return groups.head(derived.reads(spark, d), "cell", 3).select("cell", "read_id")


@query(f"WITH {S.EMB} SELECT cell, read_id FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY read_id DESC) AS r FROM emb) WHERE r <= 2")
def a6_tail(spark, d):
    return groups.tail(derived.reads(spark, d), "cell", 2).select("cell", "read_id")


@query(f"WITH {S.EMB} SELECT cell, read_id FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY read_id) AS r FROM emb) WHERE r = 5")
def a6_nth(spark, d):
    return groups.nth(derived.reads(spark, d), "cell", 4).select("cell", "read_id")


@query(f"WITH {S.EMB}, g AS (SELECT cell, count(*) AS n FROM emb GROUP BY cell) SELECT max(n) AS max_reads, count(*) AS n_groups FROM g")
def a7_sizes(spark, d):
    return groups.sizes(derived.reads(spark, d), "cell")


@query(f"WITH {S.BC}, s AS (SELECT {S.UNPACK.format(p='packed')} AS sequence FROM bc), l AS (SELECT pos, substr(sequence, CAST(pos AS INT) + 1, 1) AS base, count(*) AS n FROM s, (SELECT unnest(range(12)) AS pos) GROUP BY ALL) SELECT pos, base, n, round(n / sum(n) OVER (PARTITION BY pos), 6) AS fraction FROM l")
def a8_composition(spark, d):
    return groups.composition(derived.barcode_reads(spark, d)).select(F.col("pos").cast("long").alias("pos"), "base", "n", r6("fraction"))


# --- joins ------------------------------------------------------------------

@query(f"WITH {S.EDGES.format(cutoff=50)} SELECT i, j, round(direct + vd + sd, 6) AS dist FROM e")
def j1_distance_matrix(spark, d):
    return spatial.distance_matrix(derived.reads(spark, d), 50, digits=6)


def _cell_reads(spark, d):
    r = derived.reads(spark, d)
    return r.withColumn("x", F.col("read_id") * 7919 % 128 + 0.5).withColumn("y", F.col("read_id") * 104729 % 117 + 0.25)


@query(f"""WITH {S.MASKS}, p AS (SELECT vec_id AS read_id, vec_id * 7919 % 128 + 0.5 AS x, vec_id * 104729 % 117 + 0.25 AS y FROM embeddings),
c AS (SELECT cell, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg(x) AS cx, avg(y) AS cy FROM mk WHERE cell <> 0 GROUP BY cell),
side AS (SELECT max(greatest(x1 - x0, y1 - y0) + 1) AS s FROM c),
near AS (SELECT p.read_id, p.x, p.y, c.cell FROM p, c, side WHERE sqrt((p.x - cx) ** 2 + (p.y - cy) ** 2) <= 6 + s
  AND p.x >= greatest(x0 - 6, 0) AND p.x < x1 + 7 AND p.y >= greatest(y0 - 6, 0) AND p.y < y1 + 7),
dc AS (SELECT read_id, n.cell, min(sqrt((floor(n.x) - mk.x) ** 2 + (floor(n.y) - mk.y) ** 2)) AS d FROM near n JOIN mk ON mk.cell = n.cell GROUP BY ALL),
pr AS (SELECT a.read_id AS i, b.read_id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS direct FROM p a JOIN p b ON a.read_id < b.read_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 6),
th AS (SELECT i, j, min(u.d + v.d) AS t FROM pr JOIN dc u ON u.read_id = i JOIN dc v ON v.read_id = j AND v.cell = u.cell GROUP BY ALL)
SELECT i, j, round(least(direct, coalesce(t, direct)), 6) AS dist FROM pr LEFT JOIN th USING (i, j)""")
def j2_distance_via_cells(spark, d):
    return spatial.distance_matrix(_cell_reads(spark, d), 6, 1, 0, 0, labels=derived.masks(spark, d), digits=6)


def _match_sql(edit: int) -> str:
    on = "bc.packed = lib.packed" if edit == 0 else S.HAMMING.format(a="bc.packed", b="lib.packed") + f" <= {edit}"
    cost = "0" if edit == 0 else S.HAMMING.format(a="bc.packed", b="lib.packed")
    return f"""WITH {S.BC}, {S.LIB}, m AS (SELECT entry, lib_id, min({cost} + 1 / (cnt + 1)) AS dd, arg_min(ord, ({cost} + 1 / (cnt + 1), ord)) AS ord FROM bc JOIN lib ON {on} GROUP BY ALL),
k AS (SELECT *, row_number() OVER w AS r, lead(dd) OVER w AS nx FROM m WINDOW w AS (PARTITION BY entry ORDER BY dd, lib_id)),
f AS (SELECT entry, CASE WHEN dd >= {edit + 1} OR abs(coalesce(nx, 1e9) - dd) < 1e-5 THEN NULL ELSE lib_id END AS lib_id,
  CASE WHEN dd >= {edit + 1} OR abs(coalesce(nx, 1e9) - dd) < 1e-5 THEN NULL ELSE ord END AS read_ord, CAST(floor(dd) AS BIGINT) AS distance FROM k WHERE r = 1)
SELECT entry, lib_id, read_ord, distance FROM (SELECT DISTINCT entry FROM bc) LEFT JOIN f USING (entry)"""


@query(_match_sql(0))
def j3_match_exact(spark, d):
    out = matching.match(derived.barcode_reads(spark, d), derived.library(spark, d), 1, 0)
    return out.select("entry", "lib_id", F.col("read_ords")[0].alias("read_ord"), "distance")


@query(_match_sql(1))
def j3_match_fuzzy(spark, d):
    out = matching.match(derived.barcode_reads(spark, d), derived.library(spark, d), 1, 1)
    return out.select("entry", "lib_id", F.col("read_ords")[0].alias("read_ord"), "distance")


_H_SMALL = S.HAMMING.format(a="sr.packed", b="{t}.packed")


@query(f"""WITH {S.SMALL}, n AS (SELECT entry FROM sr GROUP BY entry HAVING count(*) >= 2),
b AS (SELECT entry, lib_id, slot, min({_H_SMALL.format(t='pl')} + 1 / (cnt + 1)) AS dd FROM sr JOIN n USING (entry), pl GROUP BY ALL),
w AS (SELECT entry, lib_id, sum(dd) AS dd FROM b GROUP BY entry, lib_id HAVING count(*) = 2),
k AS (SELECT *, row_number() OVER z AS r, lead(dd) OVER z AS nx FROM w WINDOW z AS (PARTITION BY entry ORDER BY dd, lib_id))
SELECT e.entry, CASE WHEN dd >= 4 OR abs(coalesce(nx, 1e9) - dd) < 1e-5 THEN NULL ELSE lib_id END AS lib_id, CAST(floor(dd + 1e-9) AS BIGINT) AS distance
FROM (SELECT DISTINCT entry FROM sr) e LEFT JOIN (SELECT * FROM k WHERE r = 1) k USING (entry)""")
def j3_match_two_slots(spark, d):
    out = matching.match(derived.small_reads(spark, d), derived.paired_library(spark, d), 2, 3)
    return out.select("entry", "lib_id", "distance")


@query(f"WITH {S.SMALL} SELECT entry, lib_id, min({_H_SMALL.format(t='sl')}) AS d FROM sr, sl GROUP BY ALL")
def j4_distances(spark, d):
    out = matching.distances(derived.small_reads(spark, d), derived.small_library(spark, d))
    return out.select("entry", "lib_id", F.col("d").cast("long").alias("d"))


@query(f"WITH {S.SMALL}, p AS (SELECT entry, lib_id, ord, min({_H_SMALL.format(t='sl')}) AS d FROM sr, sl GROUP BY ALL) SELECT entry, lib_id, list_sort(list(d))[2] AS d FROM p GROUP BY ALL")
def j4_distances_second(spark, d):
    out = matching.distances(derived.small_reads(spark, d), derived.small_library(spark, d), 2)
    return out.select("entry", "lib_id", F.col("d").cast("long").alias("d"))


@query(f"""WITH {S.BC}, {S.LIB}, m AS (SELECT entry, lib_id, min({S.HAMMING.format(a='bc.packed', b='lib.packed')}) AS h FROM bc JOIN lib ON {S.HAMMING.format(a='bc.packed', b='lib.packed')} <= 1 GROUP BY ALL),
f AS (SELECT entry, count(*) AS n, min(lib_id) AS lib_id FROM m GROUP BY entry HAVING count(*) = 1) SELECT entry, lib_id FROM (SELECT DISTINCT entry FROM bc) LEFT JOIN f USING (entry)""")
def j5_unique_within(spark, d):
    return matching.unique_within(derived.barcode_reads(spark, d), derived.library(spark, d), 1).select("entry", "lib_id")


@query(f"""WITH {S.SMALL}, p AS (SELECT entry, lib_id, slot, min({_H_SMALL.format(t='pl')}) AS d FROM sr, pl GROUP BY ALL), w AS (SELECT entry, lib_id, sum(d)::BIGINT AS d FROM p GROUP BY entry, lib_id HAVING count(*) = 2),
k AS (SELECT *, row_number() OVER z AS r, lead(d) OVER z AS nx FROM w WINDOW z AS (PARTITION BY entry ORDER BY d, lib_id))
SELECT entry, CASE WHEN nx IS NULL OR nx > d THEN lib_id END AS lib_id, d AS distance FROM k WHERE r = 1""")
def j6_nearest(spark, d):
    out = matching.nearest(derived.small_reads(spark, d), derived.paired_library(spark, d), 2)
    return out.select("entry", "lib_id", F.col("distance").cast("long").alias("distance"))


def _points(spark, d, n: int, k: int):
    r = derived.reads(spark, d).where(F.col("read_id") % n == k)
    return r.select(F.floor(F.col("read_id") / n).alias("id"), "x", "y")


_TWO = f"WITH {S.EMB}, a AS (SELECT read_id // 2 AS id, x, y FROM emb WHERE read_id % 2 = 0), b AS (SELECT read_id // 2 AS id, x, y FROM emb WHERE read_id % 2 = 1), p AS (SELECT a.id AS id_i, b.id AS id_j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM a, b)"
_MUTUAL = """, bi AS (SELECT id_i, id_j, d FROM (SELECT *, row_number() OVER (PARTITION BY id_i ORDER BY d, id_j) AS r FROM {p}) WHERE r = 1),
bj AS (SELECT id_i, id_j FROM (SELECT *, row_number() OVER (PARTITION BY id_j ORDER BY d, id_i) AS r FROM {p}) WHERE r = 1)
SELECT id_i, id_j, round(d, 6) AS d FROM bi JOIN bj USING (id_i, id_j)"""


@query(_TWO + _MUTUAL.format(p="p"))
def j8_mutual_best(spark, d):
    return pairing.pair_all(_points(spark, d, 2, 0), _points(spark, d, 2, 1)).select("id_i", "id_j", r6("d"))


@query(_TWO + ", c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_i ORDER BY d, id_j) AS k FROM p) WHERE k <= 100)" + _MUTUAL.format(p="c"))
def j9_mutual_nearest_100(spark, d):
    return pairing.pair_nearest(_points(spark, d, 2, 0), _points(spark, d, 2, 1), 100, 128.0).select("id_i", "id_j", r6("d"))


@query(_TWO + _MUTUAL.format(p="p"))
def j10_mutual_nearest(spark, d):
    """Mutual first neighbours: both directions by the exact grid search."""
    a, b = _points(spark, d, 2, 0), _points(spark, d, 2, 1)
    there = pairing.nearest(a, b, 1)
    back = pairing.nearest(b, a, 1).select(F.col("id_i").alias("id_j"), F.col("id_j").alias("id_i"))
    return there.join(back, ["id_i", "id_j"]).select("id_i", "id_j", r6("d"))


@query()
def j11_constellations(spark, d):
    return pairing.pair_constellations(_points(spark, d, 2, 0), _points(spark, d, 2, 1), 10, 5.0, 100).select("id_i", "id_j", r6("d"))


@query()
def j13_match_sets(spark, d):
    return pairing.match_sets([_points(spark, d, 3, k) for k in range(3)])


@query(f"WITH {S.EMB} SELECT a.read_id AS id_i, b.read_id AS id_j, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS d, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM emb a JOIN emb b ON a.read_id < b.read_id")
def j14_offsets(spark, d):
    points = derived.reads(spark, d).select(F.col("read_id").alias("id"), "x", "y")
    return pairing.sorted_offsets(points)


@query(_TWO + " SELECT id_i, id_j, round(d, 6) AS d FROM p")
def j16_distances(spark, d):
    return pairing.rounded_distances(_points(spark, d, 2, 0), _points(spark, d, 2, 1))


@query(f"""WITH {S.MASKS}, n AS (SELECT nucleus, count(*) AS an FROM mk WHERE nucleus <> 0 GROUP BY nucleus), c AS (SELECT cell, count(*) AS ac FROM mk WHERE cell <> 0 GROUP BY cell),
o AS (SELECT nucleus, cell, count(*) AS k, min(x * 1000000 + y) AS f FROM mk WHERE nucleus <> 0 AND cell <> 0 GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nucleus ORDER BY k DESC, f) AS r FROM o) WHERE r = 1),
s AS (SELECT b.*, k / an + k / ac AS score FROM b JOIN n USING (nucleus) JOIN c USING (cell)),
p AS (SELECT cell, nucleus, named FROM (SELECT *, min(nucleus) OVER (PARTITION BY cell) AS named, row_number() OVER (PARTITION BY cell ORDER BY score DESC, nucleus DESC) AS q FROM s) WHERE q = 1),
m AS (SELECT cell, nucleus, row_number() OVER (ORDER BY named) AS num FROM p)
SELECT mk.x, mk.y, coalesce(a.num, 0) AS cell, coalesce(b.num, 0) AS nucleus FROM mk LEFT JOIN m a ON a.cell = mk.cell LEFT JOIN m b ON b.nucleus = mk.nucleus""")
def j18_reconcile(spark, d):
    return segment.reconcile(derived.masks(spark, d)).select("x", "y", F.col("cell").cast("long").alias("cell"), F.col("nucleus").cast("long").alias("nucleus"))


# --- clustering -------------------------------------------------------------

@query(f"WITH {S.CALLED} SELECT cell, array_to_string(bases, '') AS sequence, count(*) AS count, min(read_id) AS first_read FROM called GROUP BY ALL")
def c1_unique_reads(spark, d):
    return cluster.unique_reads(derived.reads(spark, d)).select("cell", "sequence", "count", "first_read")


@query()
def c1_cell_clusters(spark, d):
    return cluster.cell_clusters(derived.reads(spark, d).withColumn("cell", F.floor(F.col("read_id") / 5)), 3.0)


def _near(spark, d):
    reads = derived.reads(spark, d)
    return reads, spatial.distance_matrix(reads, 30, 1, 0, 0)


@query()
def c2_hierarchical_mean(spark, d):
    reads, edges = _near(spark, d)
    return cluster.hierarchical(reads, edges, 12.0, "mean")


@query()
def c2_hierarchical_max(spark, d):
    reads, edges = _near(spark, d)
    return cluster.hierarchical(reads, edges, 12.0, "max")


@query(f"""WITH RECURSIVE {S.EMB}, e AS (SELECT b.read_id AS j, max(a.read_id) AS i FROM emb a JOIN emb b ON a.read_id < b.read_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 8 GROUP BY b.read_id),
t AS (SELECT read_id, read_id AS root FROM emb WHERE read_id NOT IN (SELECT j FROM e) UNION ALL SELECT e.j, t.root FROM t JOIN e ON e.i = t.read_id)
SELECT read_id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM t""")
def c3_min_linkage(spark, d):
    reads, edges = _near(spark, d)
    return cluster.forest(reads, edges, 8.0)


@query(f"""WITH RECURSIVE {S.EMB}, e AS (SELECT a.read_id AS i, b.read_id AS j FROM emb a JOIN emb b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 8),
t AS (SELECT i AS read_id, j AS root FROM e UNION SELECT t.read_id, e.j FROM t JOIN e ON e.i = t.root)
SELECT read_id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT read_id, min(root) AS root FROM t GROUP BY read_id)""")
def c3_single_linkage(spark, d):
    reads, edges = _near(spark, d)
    return cluster.single(reads, edges, 8.0)


# --- scalar functions -------------------------------------------------------

@query(f"WITH {S.CALLED} SELECT read_id, CAST(list_sum(list_transform(range(16), lambda i: (position(bases[i + 1] IN 'GTAC') - 1)::BIGINT << (2 * i)::BIGINT)) AS BIGINT) AS packed FROM called")
def f1_pack(spark, d):
    return derived.reads(spark, d).select("read_id", codec.pack(calling.sequence(F.col("values"))).alias("packed"))


@query(f"WITH {S.LIB} SELECT lib_id, {S.UNPACK.format(p='packed')} AS barcode FROM lib")
def f2_unpack(spark, d):
    return derived.library(spark, d).select("lib_id", "barcode")


@query(f"WITH {S.LIB}, u AS (SELECT lib_id, {S.UNPACK.format(p='packed')} AS barcode FROM lib) SELECT lib_id, i AS pos, ascii(barcode[i + 1]) AS code FROM u, (SELECT unnest(range(12)) AS i)")
def f3_byte_vector(spark, d):
    rows = derived.library(spark, d).select("lib_id", F.posexplode(codec.byte_vector(F.col("barcode"))).alias("pos", "code"))
    return rows.select("lib_id", F.col("pos").cast("long").alias("pos"), "code")


@query(f"WITH {S.SMALL} SELECT a.lib_id AS a, b.lib_id AS b, {S.HAMMING.format(a='a.packed', b='b.packed')} AS h FROM sl a, sl b")
def f4_edit_distance(spark, d):
    lib = derived.small_library(spark, d)
    a, b = lib.select(F.col("lib_id").alias("a"), F.col("packed").alias("p")), lib.select(F.col("lib_id").alias("b"), F.col("packed").alias("q"))
    return a.join(F.broadcast(b), F.lit(True)).select("a", "b", codec.hamming(F.col("p"), F.col("q")).cast("long").alias("h"))


@query(f"WITH {S.EMB} SELECT read_id, c AS cycle, round(list_max(vals[c + 1]) / greatest(list_sort(vals[c + 1])[3], 1e-6), 4) AS ratio FROM emb, (SELECT unnest(range(16)) AS c)")
def f5_ratio(spark, d):
    rows = derived.reads(spark, d).select("read_id", F.posexplode(calling.ratios(F.col("values"))).alias("cycle", "ratio"))
    return rows.select("read_id", F.col("cycle").cast("long").alias("cycle"), F.round("ratio", 4).alias("ratio"))


@query(f"WITH {S.PIXELS}, s AS (SELECT cycle, channel, x, 1000 * v AS v FROM px), f AS (SELECT cycle, channel, quantile_cont(v, 0.1) AS f FROM s WHERE v > 0 GROUP BY ALL) SELECT cycle, channel, x, round(greatest(log10(greatest(v - f, 0) + 1), log10(50)) - log10(50), 6) AS scaled FROM s JOIN f USING (cycle, channel)")
def f6_log_scale(spark, d):
    px = derived.pixels(spark, d).withColumn("v", F.col("v") * 1000)
    return scaling.log_scale(px, ["cycle", "channel"]).select(F.col("cycle").cast("long").alias("cycle"), F.col("channel").cast("long").alias("channel"), "x", r6("scaled"))


@query(f"WITH {S.PIXELS}, q AS (SELECT channel, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM px GROUP BY channel) SELECT cycle, channel, x, round(least(greatest((v - lo) / (hi - lo), 0), 1), 6) AS scaled FROM px JOIN q USING (channel)")
def f7_percentile_normalize(spark, d):
    out = scaling.percentile_normalize(derived.pixels(spark, d), ["channel"], 5.0)
    return out.select(F.col("cycle").cast("long").alias("cycle"), F.col("channel").cast("long").alias("channel"), "x", r6("scaled"))


@query(f"""WITH {S.PIXELS}, c AS (SELECT channel, x, sum(v) AS v FROM px GROUP BY ALL), q AS (SELECT channel, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM c GROUP BY channel),
s AS (SELECT x, list((v - lo) / (hi - lo) ORDER BY channel) AS w FROM c JOIN q USING (channel) GROUP BY x),
t AS (SELECT x, .66 * w[1] + .33 * w[4] AS r, .66 * w[2] + .33 * w[4] AS g, w[3] AS b FROM s)
SELECT x, CAST(floor(round(least(greatest(r, 0), 1) * 255, 6)) AS INT) AS r, CAST(floor(round(least(greatest(g, 0), 1) * 255, 6)) AS INT) AS g, CAST(floor(round(least(greatest(b, 0), 1) * 255, 6)) AS INT) AS b FROM t""")
def f8_rgb(spark, d):
    px = derived.pixels(spark, d).groupBy("channel", "x").agg(F.sum("v").alias("v"))
    scaled = scaling.percentile_normalize(px, ["channel"], 10.0, clip=False)
    by_pixel = scaled.groupBy("x").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "scaled"))), lambda s: s["scaled"]).alias("w"))
    r, g, b = scaling.rgb(F.col("w"), 4)
    return by_pixel.select("x", r.alias("r"), g.alias("g"), b.alias("b"))


# --- images -----------------------------------------------------------------

@query()
def i1_detect_dots(spark, d):
    return image.detect_dots(_picture(spark, d))


@query(f"WITH {S.PIXELS}, m AS (SELECT cycle, channel, avg(v) AS a, stddev_pop(v) AS s FROM px GROUP BY ALL) SELECT cycle, channel, x, round((v - a) / s, 6) AS v FROM px JOIN m USING (cycle, channel)")
def i2_standardize(spark, d):
    out = image.standardize(derived.pixels(spark, d))
    return out.select(F.col("cycle").cast("long").alias("cycle"), F.col("channel").cast("long").alias("channel"), "x", r6("v"))


@query(f"WITH {S.PIXELS}, s AS (SELECT cycle, x, list_sort(list(v))[3] AS second FROM px GROUP BY ALL), c AS (SELECT channel, px.x, greatest(v - second, 0) AS v FROM px JOIN s ON s.cycle = px.cycle AND s.x = px.x), k AS (SELECT channel, x, stddev_pop(v) AS s FROM c GROUP BY ALL) SELECT x, round(sum(s), 6) AS grey FROM k GROUP BY x")
def i3_highlight(spark, d):
    return image.highlight(derived.pixels(spark, d)).select("x", r6("grey"))


def _picture(spark, d):
    """A two-cycle image: cells and nuclei of the masks as bright areas."""
    m = derived.masks(spark, d)
    v = lambda a, b: (F.when(F.col("cell") > 0, float(a)).otherwise(0.0) + F.when(F.col("nucleus") > 0, float(b)).otherwise(0.0))
    planes = [(0, 0, v(1, 9)), (0, 1, v(2, 1)), (1, 0, v(3, 2)), (1, 1, v(1, 7))]
    return m.select("x", "y", F.explode(F.array(*[F.struct(F.lit(c).alias("cycle"), F.lit(k).alias("channel"), e.alias("v")) for c, k, e in planes])).alias("p")).select("p.cycle", "p.channel", "x", "y", "p.v")


def _filtered(method: str, **how):
    return lambda spark, d: image.filter_planes(_picture(spark, d), method, **how)


QUERIES["i2_background"] = _filtered("background")
QUERIES["i4_ellipse_filter"] = _filtered("ellipse")
QUERIES["i5_top_hat"] = _filtered("top_hat")
QUERIES["i6_contrast"] = _filtered("contrast")

_INVERSE = correct.unmix(correct.EXAMPLE_DYES)


@query(f"WITH {S.EMB} SELECT read_id, c AS cycle, " + ", ".join("round(greatest(" + " + ".join(f"({w!r}) * vals[c + 1][{k + 1}]" for k, w in enumerate(row)) + f", 0), 6) AS d{i}" for i, row in enumerate(_INVERSE)) + " FROM emb, (SELECT unnest(range(16)) AS c)")
def i10_color_correct(spark, d):
    rows = derived.reads(spark, d).select("read_id", F.posexplode("values").alias("cycle", "w"))
    return rows.select("read_id", F.col("cycle").cast("long").alias("cycle"), correct.color_correct(F.col("w")).alias("d")).select("read_id", "cycle", *[F.round(F.col("d")[k], 6).alias(f"d{k}") for k in range(4)])


_TALK = f"""WITH {S.PIXELS}, p AS (SELECT cycle * 1000000 + x AS id, channel, v FROM px), r AS (SELECT channel, min(v) AS lo, max(v) AS hi FROM p GROUP BY channel),
b AS (SELECT channel, k AS bin, lo + (hi - lo) * k / 7 AS a, CASE WHEN k = 6 THEN hi ELSE lo + (hi - lo) * (k + 1) / 7 END AS z FROM r, (SELECT unnest(range(7)) AS k)),
s AS (SELECT id, p.channel AS source, bin, v AS ref FROM p JOIN b ON b.channel = p.channel AND v >= a AND v <= z),
m AS (SELECT source, t.channel AS target, bin, arg_min(t.v / ref, (t.v, s.id)) AS ratio FROM s JOIN p t ON t.id = s.id AND t.channel <> s.source GROUP BY ALL),
x AS (SELECT source, target, list_sort(list(ratio))[2] AS crosstalk FROM m GROUP BY ALL) """


def _talk(spark, d):
    return derived.pixels(spark, d).select((F.col("cycle") * 1000000 + F.col("x")).alias("id"), F.col("channel").cast("long").alias("channel"), "v")


@query(_TALK + "SELECT source, target, round(crosstalk, 6) AS crosstalk FROM x")
def i11_crosstalk(spark, d):
    return correct.crosstalk(_talk(spark, d)).select("source", "target", r6("crosstalk"))


@query(_TALK + "SELECT source, target, round(crosstalk, 6) AS response FROM x UNION ALL SELECT channel, channel, 1.0 FROM r")
def i12_dye_matrix(spark, d):
    return correct.dye_matrix(_talk(spark, d)).select("source", "target", r6("response"))


@query()
def i10_color_correct_estimated(spark, d):
    return correct.color_correct_pixels(_talk(spark, d)).select("id", "dye", r6("v"))


_BACK = "WITH l AS (SELECT event_type AS layer, user_id AS x, quantile_cont(value, 0.05) AS low FROM events GROUP BY ALL), b AS (SELECT layer, x, low / max(low) OVER (PARTITION BY layer) AS background FROM l) "


@query(_BACK + "SELECT layer, x, round(background, 6) AS background FROM b")
def i13_background(spark, d):
    """The part before the blur."""
    return correct.background_levels(derived.stack(spark, d), "layer", ["x"]).select("layer", "x", r6("background"))


@query(_BACK + "SELECT layer, x, sum(CAST(trunc(least(greatest(value / background, 0), 65535)) AS BIGINT))::BIGINT AS total, count(*) AS n FROM events e JOIN b ON b.layer = e.event_type AND b.x = e.user_id WHERE background > 0 GROUP BY ALL")
def i14_illumination(spark, d):
    """With the background before the blur."""
    s = derived.stack(spark, d)
    return _corrected(s, correct.background_levels(s, "layer", ["x"]))


def _corrected(stack, back):
    out = correct.illumination(stack, back.where("background > 0"), ["layer", "x"], limits=(0, 65535))
    return out.groupBy("layer", "x").agg(F.sum("corrected").alias("total"), F.count("*").alias("n"))


@query()
def i13_background_blurred(spark, d):
    return correct.background(derived.stack(spark, d), "layer", ["x"]).select("layer", "x", r6("background"))


@query()
def i14_illumination_blurred(spark, d):
    s = derived.stack(spark, d)
    return _corrected(s, correct.background(s, "layer", ["x"]))


@query(f"WITH {S.PIXELS} SELECT cycle, x, round(v, 6) AS v FROM px WHERE channel = 3")
def i18_cytoplasm(spark, d):
    return derived.pixels(spark, d).where("channel = 3").select(F.col("cycle").cast("long").alias("cycle"), "x", r6("v"))


@query(f"""WITH {S.EMB}, {S.MASKS}, s AS (SELECT unnest([2, 3, 4]) AS k), a AS (SELECT k AS dx, 0 AS dy FROM s UNION ALL SELECT -k, 0 FROM s UNION ALL SELECT 0, k FROM s UNION ALL SELECT 0, -k FROM s),
w AS (SELECT DISTINCT emb.x + dx AS x, emb.y + dy AS y FROM emb, a) SELECT mk.x, mk.y, 1.0 AS v FROM mk JOIN w ON w.x = mk.x AND w.y = mk.y""")
def i19_mark(spark, d):
    return image.mark(derived.masks(spark, d), derived.reads(spark, d).select("x", "y"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Consensus read, size and mean quality by cell."""
    reads = derived.reads(spark, d).withColumn("quality", calling.total(calling.qualities(F.col("values"))) / F.size("values"))
    return groups.combine(reads, "cell", CYCLES).select("cell", "sequence", "count", F.round("quality", 6).alias("quality"))
