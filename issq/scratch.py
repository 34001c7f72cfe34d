"""Written tables in the folder that driver and executors share. They cut the
lineage of iterative plans: the next plan starts from files, with the size the
files have, and a lost executor costs nothing that was finished before."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
#: A key with more than this share of the rows is joined apart (``even_join``).
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its
    own; on a cluster a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dirs.setdefault(app, tempfile.mkdtemp(prefix="issq-"))
    return f"{base.rstrip('/')}/issq-{app}"


class Scratch:
    """A folder of written tables; what is left of it goes with the session."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)  # results are lazy: they may still read it

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def table(self, df: DataFrame, name: str, codec: str = "snappy", partition_by: str | None = None) -> DataFrame:
        """Write ``df`` once, free its shuffle files, and read it back."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, "false")
        self.spark.conf.set(key, "true")
        try:
            writer = df.write.mode("overwrite").option("compression", codec)
            if partition_by:
                writer = writer.partitionBy(partition_by)
            writer.parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(key, before)
        schema = df.schema
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written and read back once."""
    return Scratch(df.sparkSession, "cut").table(df, "rows")


def even_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``left`` (a written table) joined with ``right`` (one row a key) on a
    column of both. Keys that hold more than one in ``HOT_SHARE`` rows of
    ``left``, so fewer than ``HOT_SHARE`` of them, meet a broadcast of their
    rows of ``right`` where they lie; only the others are shuffled."""
    share = left.groupBy(on).agg(F.count("*").alias("n_"))
    bar = (left.count() // HOT_SHARE) + 1000
    hot = [r[0] for r in share.where((F.col("n_") > bar) & F.col(on).isNotNull()).select(on).collect()]
    if not hot:
        return left.join(right, on, how)
    listed = F.coalesce(F.col(on).isin(hot), F.lit(False))
    apart = left.where(listed).join(F.broadcast(right.where(F.col(on).isin(hot))), on, how)
    return left.where(~listed).join(right, on, how).unionByName(apart)
