"""Session helpers: a local session, and shipping this package to workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
ROOT = Path(__file__).resolve().parent.parent


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package. Workers of a local master can
    where PYTHONPATH or the working folder has it; to all others, whose paths
    the driver does not know, Spark sends a zip file."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    paths = [os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    if spark.sparkContext.master.startswith("local[") and str(ROOT) in paths:
        return
    target = Path(tempfile.mkdtemp(prefix="issq-")) / "issq.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "issq").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
