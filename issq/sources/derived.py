"""Reads, libraries, pixels and masks derived from the driver tables, each over
the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issq.functions import codec

CYCLES, CHANNEL_COUNT, BASES = 16, 4, 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(key: Column) -> Column:
    """A 12-base packed barcode of an integer key."""
    return F.shiftright(key.cast("long") * F.lit(2654435761), 8).bitwiseAND(F.lit(0xFFFFFF))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, x, y, cell, count, values (16 cycles x 4 channels)."""
    cycle = lambda c: F.transform(F.slice("embedding", c * CHANNEL_COUNT + 1, CHANNEL_COUNT), lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("read_id"),
        (F.col("vec_id") * 7919 % 401).cast("double").alias("x"),
        (F.col("vec_id") * 104729 % 397).cast("double").alias("y"),
        F.col("label").cast("long").alias("cell"),
        (1 + F.col("vec_id") % 5).alias("count"),
        F.transform(F.sequence(F.lit(0), F.lit(CYCLES - 1)), cycle).alias("values"),
    )


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lib_id"), F.lit(0).alias("slot"), code(F.col("p_partkey")).alias("packed"))
    return rows.withColumn("barcode", codec.unpack(F.col("packed"), BASES))


def barcode_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry, ord (read ordinal within the entry), count, packed, sequence: one
    read per order and part; a quarter has its last base changed."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("ord")).agg(F.count("*").alias("count"))
    packed = code(F.col("ord"))
    packed = F.when((F.col("entry") + F.col("ord")) % 4 == 0, packed.bitwiseXOR(F.lit(1 << 22))).otherwise(packed)
    return rows.withColumn("packed", packed).withColumn("sequence", codec.unpack(F.col("packed"), BASES))


def small_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry, ord, count, packed: suppliers as reads of their nation."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    packed = code(F.col("s_nationkey"))
    for k_mod, bit in ((2, 1), (3, 1 << 10), (5, 1 << 22)):
        packed = F.when(k % k_mod == 0, packed.bitwiseXOR(F.lit(bit))).otherwise(packed)
    return s.select(F.col("s_nationkey").cast("long").alias("entry"), k.alias("ord"), (1 + k % 4).alias("count"), packed.alias("packed"))


def small_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lib_id, slot, packed: nations, in one slot."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("lib_id"), F.lit(0).alias("slot"), code(F.col("n_nationkey")).alias("packed"))


def paired_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lib_id, slot, packed: nations by twos."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("long")
    return n.select(F.floor(k / 2).alias("lib_id"), (k % 2).cast("int").alias("slot"), code(k).alias("packed"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cycle, channel, x, y, v."""
    rows = reads(spark, sf_dir).select(F.col("read_id").alias("x"), F.posexplode("values").alias("cycle", "vector"))
    return rows.select("cycle", "x", F.posexplode("vector").alias("channel", "v")).select("cycle", "channel", "x", F.lit(0).alias("y"), "v")


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, cell, nucleus over a 128 wide image, 0 for background."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((k % 128).alias("x"), F.floor(k / 128).alias("y"))
    x, y = F.col("x"), F.col("y")
    cell = F.when((x % 16 < 12) & (y % 16 < 12), 1 + F.floor(x / 16) + 8 * F.floor(y / 16)).otherwise(0)
    nucleus = F.when(((x + 3) % 16 < 7) & ((y + 5) % 16 < 7), 1 + F.floor((x + 3) / 16) + 9 * F.floor((y + 5) / 16)).otherwise(0)
    return rows.select("x", "y", cell.alias("cell"), nucleus.alias("nucleus"))


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layer, x, v: many observations of a pixel."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("layer"), F.col("user_id").alias("x"), F.col("value").alias("v"))
