"""Captured evidence: manifests, archives, text packages and the custody that ties them together."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "tar_filename string, sha256 string, domain_url string, run_id string, fetcher_name string, created_at string, errors_count int, protocol_version_hash string"
AUDIT = "event string, manifest_sha256 string, tar_filename string, ts string"
PAGES = "tar_filename string, page_key string, seq int, body binary"


def read_manifest(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped."""
    rows = spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(path).where("tar_filename IS NOT NULL")
    return rows.where(F.col("run_id") == run_id) if run_id else rows


def with_digest(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("actual_sha256", F.sha2(F.col(content), 256))


def audit_manifest(manifest: DataFrame, files: DataFrame, log: DataFrame | None = None, manifest_sha256: str | None = None) -> DataFrame:
    """One row: total, verified, missing, corrupted, chain_valid, all_valid.

    files(tar_filename, actual_sha256); the last line of log(manifest_sha256, line_no) must name the manifest's digest."""
    joined = manifest.join(files.select("tar_filename", "actual_sha256"), "tar_filename", "left")
    ok, gone = F.col("actual_sha256") == F.col("sha256"), F.col("actual_sha256").isNull()
    counts = joined.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("verified"), F.count_if(gone).alias("missing"), F.count_if(~gone & ~ok).alias("corrupted"),
    )
    if log is not None:
        counts = counts.crossJoin(log.agg((F.max_by("manifest_sha256", "line_no") == F.lit(manifest_sha256)).alias("chain_valid")))  # one row by one row
    else:
        counts = counts.withColumn("chain_valid", F.lit(True))
    return counts.withColumn("all_valid", (F.col("verified") == F.col("total")) & F.coalesce("chain_valid", F.lit(False)))


def verified_only(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The entries whose file has the declared digest."""
    return manifest.join(files, (manifest.tar_filename == files.tar_filename) & (manifest.sha256 == files.actual_sha256), "left_semi")


def archive_pages(archives: DataFrame) -> DataFrame:
    """archives(tar_filename, content) to the pages of each, keyed by the archive's own index where it has one."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, content in zip(part["tar_filename"], part["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    files = {m.name: tar.extractfile(m).read() for m in tar.getmembers() if m.isfile()}
                index = next((json.loads(v) for k, v in files.items() if k.endswith("_index.json")), {})
                pages = [(k, v) for k, v in files.items() if k.endswith((".html", ".htm"))]
                rows += [(name, index.get(k.rsplit("/", 1)[-1], index.get(k, k)), i, v) for i, (k, v) in enumerate(pages)]
            yield pd.DataFrame(rows, columns=["tar_filename", "page_key", "seq", "body"])

    return archives.select("tar_filename", "content").mapInPandas(run, PAGES)


def sequence_digest(texts: Column, order: Column) -> Column:
    """Order-sensitive digest of a group's texts, each followed by a NUL byte (an aggregate)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), texts.alias("t")))), lambda x: F.concat(x["t"], F.lit("\0")))
    return F.sha2(F.array_join(ordered, ""), 256)


def directory_digest(files: DataFrame) -> DataFrame:
    """files(dir, name, actual_sha256) to one digest a directory: sorted names, each with NUL and its file's digest."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("name", "actual_sha256"))), lambda x: F.concat(x["name"], F.lit("\0"), x["actual_sha256"]))
    return files.groupBy("dir").agg(F.sha2(F.array_join(parts, ""), 256).alias("sha256"))


def package_sections(packages: DataFrame, text: str = "text") -> DataFrame:
    """Sections of a frozen text package: kind ([SUBPAGINA] or [POLITICA EM PDF ...]), name and body, in order."""
    parts = F.filter(F.split(F.col(text), r"(?m)^(?=\[(?:SUBPAGINA|POLITICA EM PDF))"), lambda x: x.startswith("[SUBPAGINA") | x.startswith("[POLITICA EM PDF"))
    rows = packages.select(*[c for c in packages.columns if c != text], F.posexplode(parts).alias("seq", "part"))
    return rows.select(
        *[c for c in rows.columns if c != "part"], F.regexp_extract("part", r"^\[(SUBPAGINA|POLITICA EM PDF)", 1).alias("kind"),
        F.trim(F.regexp_extract("part", r"^\[(?:SUBPAGINA|POLITICA EM PDF)([^\]]*)\]", 1)).alias("name"), F.regexp_replace(F.regexp_replace("part", r"^\[[^\]]*\][^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"),
    )


def pending(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Entries of hosts that no derived manifest has yet: makes enrichment repeatable."""
    return manifest.join(done.select("host").distinct(), "host", "left_anti")


def derived_manifest(documents: DataFrame, origin: DataFrame) -> DataFrame:
    """One entry a host, linked to the archive that it came from by that archive's digest."""
    return documents.groupBy("host").agg(F.count(F.lit(1)).alias("n_documentos"), sequence_digest(F.col("url"), F.col("seq")).alias("sha256_meta")).join(
        origin.select("host", F.col("tar_filename").alias("origin_tar"), F.col("sha256").alias("origin_sha256")), "host"
    )


def publishable(manifests: DataFrame) -> DataFrame:
    """Counts and digest of each manifest file; fails if a line holds an e-mail address."""
    guard = F.when(F.col("line").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.raise_error(F.concat(F.lit("e-mail address in "), "file"))).otherwise(F.lit(1))
    return manifests.groupBy("file").agg(F.sum(guard).alias("n_lines"), sequence_digest(F.col("line"), F.col("line_no")).alias("sha256"))


def slug(text: Column, longest: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9._-]+", "_"), r"^[_.]+|[_.]+$", ""), 1, longest)


def latest_line(log: DataFrame) -> DataFrame:
    return log.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("line_no")))).where("n = 1").drop("n")
