"""Session limits, row keys and tables shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issq.scratch import Scratch, even_join, shared_dir  # noqa: F401
from issq.session import ship

#: Records in one Arrow batch sent to a Python worker. Texts can be long, and
#: a batch is held in memory whole, so this is far below Spark's default.
ARROW_RECORDS = 512


def session_limits(spark: SparkSession) -> None:
    """Bound what one Python worker holds: small Arrow batches, limited by
    bytes as well where the Spark version knows that setting. Also makes sure
    that workers can import this package. The settings stay in the session, as
    results are lazy and planned with them when they are asked for."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_RECORDS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def parts(spark: SparkSession) -> int:
    """Shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` integers that Spark's hash partitioning sends to ``n`` different
    partitions, one each, so that a shuffle by bucket number is even."""
    span = max(64, n * 24)
    while True:
        rows = (
            spark.range(span)
            .select(F.col("id").cast("int").alias("k"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"))
            .groupBy("p").agg(F.min("k").alias("k")).collect()
        )
        if len(rows) == n:
            return [r["k"] for r in sorted(rows, key=lambda r: r["p"])]
        span *= 2


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, mod ``modulus``, equals ``remainder``. A null
    id counts as the text '' (crc32 0)."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


def free_name(df_columns: list[str], wanted: str) -> str:
    """``wanted``, or with underscores added until no column has that name
    (Spark compares names without case)."""
    taken = {c.lower() for c in df_columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    session_limits(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
