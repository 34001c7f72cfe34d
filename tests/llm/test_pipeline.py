"""Each stage against a brute-force version, on rows with planted cases."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as C

from . import helpers as H


def planted(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.limit(60).collect()
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    extra = [(9001, rows[0].text + " "), (9002, rows[1].text), (9003, "clean words " + item + " more"), (9004, None), (9005, ""), (9006, "idiot moron scum trash stupid you pathetic loser")]
    more = spark.createDataFrame([(d, t, "en", "src0", len(t or "")) for d, t in extra], docs.schema)
    return docs.limit(60).unionByName(more).withColumn("kept", F.lit(1)), item


def test_stages(spark, sf, tmp_path):
    docs, item = planted(spark, sf)
    columns = docs.columns
    at = dict(C.STAGES)
    docs.write.parquet(str(tmp_path / "0"))
    docs = spark.read.parquet(str(tmp_path / "0"))
    calm = at["toxicity"](spark, docs, sf)
    assert calm.columns == columns
    ids = {r.doc_id for r in calm.collect()}
    assert 9006 not in ids and {9001, 9002, 9003, 9004, 9005} <= ids
    single = at["exact_dedup"](spark, docs, sf)
    assert single.columns == columns
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    rows = docs.collect()
    kept = [r.text for r in single.collect()]
    assert len(kept) == len({norm(r.text) for r in rows}) == len({norm(t) for t in kept})
    near = at["jaccard_join"](spark, docs, sf)
    assert near.columns == columns
    want = sorted(d for d, _, c in H.components([(r.doc_id, r.text) for r in rows]) if d == c)
    assert sorted(r.doc_id for r in near.collect()) == want
    clean = at["decontamination"](spark, docs, sf)
    assert clean.columns == columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {d for d, _ in H.leaks([(r.doc_id, r.text) for r in rows], items)}
    assert 9003 in leaked
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows} - leaked
    packed = at["packing"](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in rows}


def test_stages_on_odd_rows(spark, sf):
    """Nulls in every column, repeated rows, empty and long texts, a clashing
    column; and an empty table."""
    like = spark.read.parquet(f"{sf}/documents.parquet").schema
    long = " ".join(f"w{k}" for k in range(40_000))
    rows = [(None, None, None, None, None), (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, " \t", None, "s", 2), (4, "same five words stand here twice", "en", None, 32), (4, "same five words stand here twice", "en", None, 32),
            (5, long, "en", "s", len(long)), (6, long + " more", "en", "s", len(long) + 5), (None, "a text of some words without any id", "en", "s", 35)]
    at = dict(C.STAGES)
    for some in (rows, []):
        docs = spark.createDataFrame(some, like).withColumn("gone", F.lit(1)).withColumn("score", F.lit("x"))
        sizes = {}
        for name in ("toxicity", "exact_dedup", "jaccard_join", "decontamination"):
            out = at[name](spark, docs, sf)
            assert out.columns == docs.columns
            sizes[name] = sorted((r.doc_id is None, r.doc_id, len(r.text or "")) if r.doc_id is not None else (True, 0, len(r.text or "")) for r in out.collect())
        packed = at["packing"](spark, docs, sf)
        assert packed.where("start = 0").count() == len(some)
        every = sorted((d is None, d or 0, len(t or "")) for d, t, *_ in some)
        assert sizes["toxicity"] == sizes["decontamination"] == every
        if some:
            assert sizes["exact_dedup"] == [(False, 3, 2), (False, 4, 32), (False, 5, len(long)), (False, 6, len(long) + 5), (True, 0, 35)]
            assert sizes["jaccard_join"] == [r for r in every if r[:2] != (False, 6)]
        else:
            assert not any(sizes.values())


def test_run(spark, sf):
    got = C.run(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 0
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "packing"]
