"""Queries with their oracles, declared side by side."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None):
        def add(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[name] = f
            if oracle:
                self.oracles[name] = oracle
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A scan below this size a core is dealt out again before heavy work on its texts.
SPREAD_BYTES = 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out over all cores where a small table sits in fewer row groups than there are cores; larger tables stay as their files are split."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < SPREAD_BYTES * cores else rows


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names; a local one only where the session runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="glasshouse-")
    return f"{base.rstrip('/')}/glasshouse-{name}-{uuid.uuid4().hex}"


def discard(df: DataFrame) -> None:
    """Removes a table that was written to a scratch() path and that nothing will read again."""
    sc = df.sparkSession.sparkContext
    for folder in {f[: f.index("/", f.index("/glasshouse-") + 1)] for f in df.inputFiles() if "/glasshouse-" in f}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
