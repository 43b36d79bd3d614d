"""The result table in files: a folder a run, sorted, with Bloom filters on the host; upserts rewrite only the runs they touch.

A version of the table is a small manifest that names the live folder of each run.  A write puts new folders beside the old ones and
then publishes the next manifest, which must not exist yet: readers see a version whole or not at all, and of two writers that
start from one version the second fails instead of losing the first one's rows.  Lookups are left to the scan: the run prunes folders,
the variable row groups (by their ranges, as rows are sorted by variable and host), the host row groups by the Bloom filter.

A null run is a run of its own.  Rows that repeat a key keep the last by time, in one write and over writes.  An empty write changes
nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasshouse.operators.store import FILTERS, KEY, upsert

#: Rows that a file is planned for, and distinct hosts that its Bloom filter is made for.
FILE_ROWS, HOSTS = 5_000_000, 1_000_000


class ResultTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- versions ---

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest version; 0 before the first write."""
        path, files = self._files()
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def runs(self, version: int | None = None) -> dict[str, str]:
        """The live folder of each run, by the run as JSON: one entry a run."""
        version = self.version() if version is None else version
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version:08}.json", wholetext=True).first().value) if version else {}

    def _publish(self, version: int, live: dict[str, str]) -> None:
        path, files = self._files()
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path, f"{version:08}.json")
        draft = jvm.org.apache.hadoop.fs.Path(path, f".{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(json.dumps(live).encode()))
        out.close()
        if files.exists(target) or not files.rename(draft, target):
            files.delete(draft, False)
            raise RuntimeError(f"version {version} was written by another writer")

    # --- rows ---

    def read(self, version: int | None = None, runs: list[str] | None = None) -> DataFrame | None:
        """The rows of a version, or of some of its runs (as JSON); None if there are none."""
        live = self.runs(version)
        folders = [f for r, f in live.items() if runs is None or r in runs]
        return self.spark.read.option("basePath", f"{self.root}/data").parquet(*folders).drop("part") if folders else None

    def upsert(self, rows: DataFrame) -> list[str]:
        """Adds rows, the last of each key winning; returns the runs that were rewritten."""
        version = self.version()
        live = self.runs(version)
        run = F.to_json(F.struct("run_id"))
        touched = [r[0] for r in rows.select(run).distinct().collect()]  # runs of one write
        if not touched:
            return []
        old = self.read(version, touched)
        merged = upsert(rows.limit(0) if old is None else old.select(*rows.columns), rows)
        part = F.sha2(run, 256)
        parts = max(1, -(-rows.count() // FILE_ROWS)) * len(touched)
        laid = merged.withColumn("part", part).repartitionByRange(parts, "part", "variable_name", "domain_url").sortWithinPartitions("part", "variable_name", "domain_url")
        commit = f"{self.root}/data/commit={uuid.uuid4().hex}"
        bloom = {"parquet.bloom.filter.enabled#domain_url": "true", "parquet.bloom.filter.expected.ndv#domain_url": str(HOSTS), "parquet.bloom.filter.adaptive.enabled#domain_url": "true"}
        laid.write.partitionBy("part").options(**bloom).parquet(commit)
        places = {r[0]: r[1] for r in self.spark.createDataFrame([(r,) for r in touched], "run string").select("run", F.sha2("run", 256)).collect()}
        self._publish(version + 1, live | {r: f"{commit}/part={p}" for r, p in places.items()})
        return sorted(touched)

    def lookup(self, wanted: dict[str, str], version: int | None = None) -> DataFrame | None:
        """Equality on the four allowed columns, other names and empty values ignored, oldest first.  A run's folder is the only one read."""
        runs = [json.dumps({"run_id": wanted["run_id"]}, separators=(",", ":"), ensure_ascii=False)] if wanted.get("run_id") else None
        rows = self.read(version, runs)
        if rows is None:
            return None
        for k, v in wanted.items():
            if k in FILTERS and v:
                rows = rows.where(F.col(k) == v)
        return rows.drop("commit").orderBy("computed_at")

    def vacuum(self) -> int:
        """Removes the folders and manifests of all versions but the latest; readers of older ones must be done.  Returns the folders removed."""
        path, files = self._files()
        jvm, latest = self.spark.sparkContext._jvm, self.version()
        live, gone = set(self.runs(latest).values()), 0
        for version in range(1, latest):
            old = jvm.org.apache.hadoop.fs.Path(path, f"{version:08}.json")
            if files.exists(old):
                for folder in set(self.runs(version).values()) - live:
                    gone += bool(files.delete(jvm.org.apache.hadoop.fs.Path(folder), True))
                files.delete(old, False)
        return gone


__all__ = ["FILTERS", "KEY", "ResultTable"]
