"""Wide tables, group tables and multi-columns, and their inverses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issq.functions import calling
from issq.schema import CHANNELS

KNOWN = {"x", "y", "sequence", "values"}


def from_values(df: DataFrame, values: str, read_id: str, x: str | None = None, y: str | None = None, sequence: str | None = None, attrs: list[str] = ()) -> DataFrame:
    """A read table with explicit columns; one of values and sequence is needed."""
    if values is None and sequence is None:
        raise ValueError("reads need values or sequences")
    picked = [F.col(read_id).alias("read_id")]
    picked += [F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y")) if c]
    picked += [F.col(values).alias("values")] if values else []
    picked += [F.col(sequence).alias("sequence")] if sequence else []
    return df.select(*picked, *attrs)


def wide_columns(df: DataFrame, cycles: int, channels: list[str] = CHANNELS, sequences: bool | None = None, qualities: bool = False) -> list[Column]:
    """xpos, ypos, read, quality, quality_NN, value_cycleNN_chNN, chanNN, attributes."""
    has = set(df.columns)
    out = [F.col(a).alias(b) for a, b in (("x", "xpos"), ("y", "ypos")) if a in has]
    called = F.col("sequence") if "sequence" in has else None
    if sequences if sequences is not None else called is not None:
        out.append((calling.sequence(F.col("values"), called, channels) if "values" in has else called).alias("read"))
    if "values" in has:
        if qualities:
            out.append((calling.total(calling.qualities(F.col("values"))) / F.size("values")).alias("quality"))
            out += [F.array_max(F.col("values")[c]).alias(f"quality_{c:02}") for c in range(cycles)]
        out += [F.col("values")[c][k].alias(f"value_cycle{c:02}_ch{k:02}") for c in range(cycles) for k in range(len(channels))]
    if channels != CHANNELS:
        out += [F.lit(c).alias(f"chan{k:02}") for k, c in enumerate(channels)]
    return out + [F.col(c) for c in df.columns if c not in KNOWN]


def to_table(df: DataFrame, cycles: int, **how) -> DataFrame:
    return df.select(*wide_columns(df, cycles, **how))


def from_table(wide: DataFrame) -> DataFrame:
    """Inverse of ``to_table``: quality columns go, unknown ones are attributes."""
    cells: dict[int, dict[int, str]] = {}
    attrs = []
    for c in wide.columns:
        m = re.fullmatch(r"value_cycle(\d+)_ch(\d+)", c)
        if m:
            cells.setdefault(int(m[1]), {})[int(m[2])] = c
        elif c not in ("xpos", "ypos", "read") and not re.fullmatch(r"quality(_\d+)?|chan\d\d", c):
            attrs.append(c)
    out = [F.col(a).alias(b) for a, b in (("xpos", "x"), ("ypos", "y"), ("read", "sequence")) if a in wide.columns]
    if cells:
        out.append(F.array(*[F.array(*[F.col(row[k]) for k in sorted(row)]) for _, row in sorted(cells.items())]).alias("values"))
    return wide.select(*out, *attrs)


def groups_to_table(wide: DataFrame, key: str, order: str, max_reads: int, columns: list[str] | None = None, drop: list[str] = ()) -> DataFrame:
    """One row a group: key, num_reads, then every column suffixed _0, _1, ...;
    short groups are padded with nulls. ``max_reads`` comes from one small
    aggregate, so the pivot needs no scan for its values."""
    names = [c for c in (columns or wide.columns) if c not in (key, order) and c not in drop]
    rank = Window.partitionBy(key).orderBy(order)
    ranked = wide.withColumn("rank_", F.row_number().over(rank) - 1)
    cells = [F.max(F.when(F.col("rank_") == j, F.col(c))).alias(f"{c}_{j}") for j in range(max_reads) for c in names]
    return ranked.groupBy(key).agg(F.count("*").alias("num_reads"), *cells)


def groups_from_table(table: DataFrame, key: str) -> DataFrame:
    """Inverse: one row a read, with its number j in the group; columns without
    a _<digits> suffix are common to the group."""
    slots: dict[str, dict[int, str]] = {}
    for c in table.columns:
        m = re.fullmatch(r"(.+)_(\d+)", c)
        if m:
            slots.setdefault(m[1], {})[int(m[2])] = c
    common = [c for c in table.columns if not re.fullmatch(r".+_\d+", c) and c != "num_reads"]
    width = max((max(s) + 1 for s in slots.values()), default=0)
    reads = F.array(*[F.struct(F.lit(j).alias("j"), *[F.col(s[j]).alias(n) for n, s in slots.items()]) for j in range(width)])
    return table.select(*common, "num_reads", F.explode(F.slice(reads, F.lit(1), F.col("num_reads").cast("int"))).alias("r")).select(*common, "r.*")


def read_table(df: DataFrame, cycles: int, extra: list[str] = ()) -> DataFrame:
    """Nested headers as structs: position, values, read, extras."""
    values = F.struct(*[F.struct(*[F.col("values")[c][k].alias(n) for k, n in enumerate(CHANNELS)]).alias(f"cycle{c:02}") for c in range(cycles)])
    return df.select(F.struct("x", "y").alias("position"), values.alias("values"), calling.sequence(F.col("values")).alias("read"), *extra)


def write_multicolumn(df: DataFrame, array: str, name: str, width: int, length_column: str | None = None) -> DataFrame:
    """An array to columns name_0 ... padded with zeros, and its length."""
    out = [F.coalesce(F.get(F.col(array), F.lit(i)), F.lit(0)).alias(f"{name}_{i}") for i in range(width)]
    length = [F.size(array).cast("long").alias(length_column or f"{name}_length")]
    return df.select(*[c for c in df.columns if c != array], *out, *length)


def read_multicolumn(df: DataFrame, name: str, length_column: str | None = None) -> DataFrame:
    cols = sorted((c for c in df.columns if re.fullmatch(rf"{re.escape(name)}_\d+", c)), key=lambda c: int(c.rsplit("_", 1)[1]))
    length = length_column or f"{name}_length"
    array = F.array(*[F.col(c) for c in cols])
    if length in df.columns:
        array = F.slice(array, F.lit(1), F.col(length).cast("int"))
    return df.select(*[c for c in df.columns if c not in cols and c != length], array.alias(name))
