"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts, each partition is
sorted externally (Spark's spilling sort), equal texts come to lie side by
side, and full comparisons of neighbours find the runs. The splitter key is
(leading bytes, 64-bit digest of the whole normalised text, id): short, so the
sample that Spark takes stays small however long texts are, and ending in the
id, so that a text with very many copies is spread over partitions. Runs at
the edge of a partition may go on in the next one; their heads, at most two a
partition, are merged by a small aggregate.

Defined results
---------------
* Two texts are equal when identical after deleting space and 0x09-0x0D; null
  counts as empty, so null, empty and blank texts are copies of each other.
* The row with the most code points in its original text stays, then the one
  with the smallest id (a null id is last). Among rows that repeat both,
  exactly one stays.
* An empty table gives an empty result; other columns are carried untouched,
  and result columns get a trailing underscore where a carried one clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issq.llm.common import Scratch, free_name, parts, session_limits

#: Characters that normalisation deletes (fixed by the contract).
BLANKS = " \t\n\x0b\x0c\r"
VERDICT = ["keep_id", "group_size", "kept", "text_sha256"]


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _runs(batches: Iterator[pa.RecordBatch], carried: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted; each leaves with its run's head, size and digest.

    Held back at any time: the rows of one run without their texts, which the
    splitters bound by a partition's share."""
    part = TaskContext.get().partitionId()
    number, last_text = 0, None
    held: list[pa.Table] = []
    head: tuple = ()
    waiting: tuple | None = None  # the finished run that may prove to be the last

    def flush(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal waiting
        if waiting is not None:
            yield from emit(*waiting, edge=waiting[-1] == 0 or final)
            waiting = None

    def emit(tables, first, digest, index, edge) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(tables).combine_chunks()
        n = rows.num_rows
        head_mark = np.zeros(n, dtype=bool)
        head_mark[0] = True
        full = lambda v, kind: pa.array([v], kind).take(pa.array(np.zeros(n, dtype=np.int32)))
        columns = [rows.column(c) for c in carried] + [
            full(first[0], pa.int64()), full(n, pa.int64()), pa.array(head_mark), full(digest, pa.string()),
            full(bool(edge), pa.bool_()), full(first[1], pa.int64()), full((part << 32) | (index & 0xFFFFFFFF), pa.int64()),
        ]
        yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=4096)

    for batch in batches:
        if not batch.num_rows:
            continue
        norm = batch.column("n_")
        same = np.zeros(batch.num_rows, dtype=bool)
        if last_text is not None:
            same[0] = norm[0].as_py() == last_text
        if batch.num_rows > 1:
            same[1:] = pc.equal(norm.slice(1), norm.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        table = pa.Table.from_batches([batch]).drop_columns(["n_"])
        cuts = np.flatnonzero(~same).tolist()
        if not cuts or cuts[0] > 0:
            stop = cuts[0] if cuts else batch.num_rows
            held.append(table.slice(0, stop))
        for k, at in enumerate(cuts):
            if held:
                yield from flush(False)
                waiting = (held, *head)
            stop = cuts[k + 1] if k + 1 < len(cuts) else batch.num_rows
            held = [table.slice(at, stop - at)]
            text = norm[at].as_py()
            head = ((table.column("i_")[at].as_py(), table.column("c_")[at].as_py()), hashlib.sha256(text.encode()).hexdigest(), number)
            number += 1
        last_text = norm[batch.num_rows - 1].as_py()
    if held:
        yield from flush(False)
        yield from emit(held, *head, edge=True)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``df``: the ``carry`` columns (default: the id) and
    keep_id, group_size, kept, text_sha256 (see the module's docstring)."""
    spark = df.sparkSession
    session_limits(spark)
    carry = [id_col] if carry is None else list(carry)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    plain = {f"p{k}_": c for k, c in enumerate(carry)}
    keyed = df.select(
        F.col(f"`{id_col}`").cast("long").alias("i_"),
        F.col(f"`{text_col}`").alias("t_"),
        *[F.col(f"`{c}`").alias(p) for p, c in plain.items()],
    ).withColumn("n_", normalised(F.col("t_"))).withColumn("c_", F.length(F.coalesce("t_", F.lit(""))).cast("long"))
    keyed = keyed.drop("t_").withColumn("b_", F.substring("n_", 1, 16)).withColumn("h_", F.xxhash64("n_"))
    order = [F.col("b_"), F.col("h_"), F.col("n_"), F.col("c_").desc(), F.col("i_").asc_nulls_last()]
    placed = keyed.repartitionByRange(parts(spark), "b_", "h_", "i_").sortWithinPartitions(*order)
    placed = placed.select("n_", "i_", "c_", *plain)
    out = T.StructType(
        [T.StructField(p, kinds[c]) for p, c in plain.items()]
        + [T.StructField("keep_id", T.LongType()), T.StructField("group_size", T.LongType()), T.StructField("kept", T.BooleanType()),
           T.StructField("text_sha256", T.StringType()), T.StructField("edge", T.BooleanType()), T.StructField("code_points", T.LongType()), T.StructField("run", T.LongType())]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, names = to_arrow_schema(out), list(plain)
    runs = placed.mapInArrow(lambda it: _runs(it, names, arrow), out)
    runs = Scratch(spark, "dedup").table(runs, "runs")
    # Edge runs: at most two a partition, so the merged table is of bounded size.
    heads = runs.where(F.col("edge") & F.col("kept")).groupBy("text_sha256").agg(
        F.min(F.struct((-F.col("code_points")).alias("a"), F.col("keep_id").isNull().alias("b"), F.col("keep_id").alias("c"), F.col("run").alias("d"))).alias("best"),
        F.sum("group_size").alias("size"),
    )
    merged = heads.select(F.col("text_sha256").alias("sha"), F.col("best.c").alias("best_id"), F.col("best.d").alias("best_run"), "size")
    inner = runs.where(~F.col("edge"))
    edge = runs.where("edge").join(F.broadcast(merged), F.col("text_sha256") == F.col("sha"), "left").withColumn(
        "kept", F.col("kept") & (F.col("run") == F.col("best_run"))
    ).withColumn("keep_id", F.col("best_id")).withColumn("group_size", F.col("size"))
    both = inner.unionByName(edge.select(*inner.columns))
    names_out: list[str] = []
    for v in VERDICT:
        names_out.append(free_name(carry + names_out, v))
    return both.select(
        *[F.col(p).alias(c) for p, c in plain.items()], *[F.col(v).alias(n) for v, n in zip(VERDICT, names_out)]
    )
