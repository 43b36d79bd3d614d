"""The evidence store: pages appended as Parquet, a manifest entry for each site of a run, and a chained audit log.

A put writes the pages of its batch, then their entries, then one line of the log; whatever fails in between leaves pages or entries
of a batch that the log does not name, which nothing reads.  One writer at a time appends to a folder.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glasshouse.sources.evidence import slug

PAGES = "domain_url string, seq long, page_key string, body binary, run_id string, batch string"
ENTRIES = "tar_filename string, sha256 string, domain_url string, n_pages long, errors_count long, created_at timestamp, protocol_version_hash string, run_id string, batch string"
LOG = "event string, line_no long, batch string, previous string, manifest_sha256 string, ts string"
#: Pages, or entries, that one digest of the lower level covers.
LEAF = 4096
START = hashlib.sha256(b"").hexdigest()


def _tree(rows: DataFrame, keys: list[str], leaf: Column, order: list[str], digest: Column, **more: Column) -> DataFrame:
    """One digest for each key: of its leaves' digests in order, each over its rows' digests in order.  Only digests are gathered."""
    sums = [c.alias(n) for n, c in more.items()]
    own = rows.withColumn("_leaf", leaf).withColumn("_own", digest)
    low = own.groupBy(*keys, "_leaf").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_own"))), lambda x: x["_own"]), ""), 256).alias("_low"), *sums)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_leaf", "_low"))), lambda x: x["_low"])
    return low.groupBy(*keys).agg(F.sha2(F.array_join(ordered, ""), 256).alias("sha256"), *[F.sum(n).alias(n) for n in more])


def site_digests(pages: DataFrame) -> DataFrame:
    """run_id, batch, domain_url, sha256, n_pages; a page counts with the digests of its key and of its body (null: empty)."""
    own = F.concat(F.sha2(F.coalesce("page_key", F.lit("")), 256), F.sha2(F.coalesce("body", F.lit(b"")), 256))
    leaf = F.floor(F.coalesce("seq", F.lit(0)) / LEAF)
    return _tree(pages, ["run_id", "batch", "domain_url"], leaf, ["seq", "page_key"], own, n_pages=F.count(F.lit(1)))


def batch_digests(entries: DataFrame) -> DataFrame:
    """batch, sha256 over its entries, in an order that their sites decide."""
    own = F.sha2(F.to_json(F.struct("tar_filename", "sha256", "domain_url", "n_pages", "errors_count", "protocol_version_hash", "run_id")), 256)
    return _tree(entries, ["batch"], F.pmod(F.xxhash64("domain_url"), F.lit(LEAF)), ["domain_url"], own).select("batch", "sha256")


def stored(spark: SparkSession, folder: str, part: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{part}")


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LOG).json(f"{folder}/log")


def entries_of(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of batches that the log names."""
    return stored(spark, folder, "manifest", ENTRIES).join(F.broadcast(read_log(spark, folder).select("batch")), "batch", "left_semi")  # one line a put


def _last(spark: SparkSession, folder: str) -> tuple[int, str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/log")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return 0, START
    line = read_log(spark, folder).agg(F.max(F.struct("line_no", "manifest_sha256")).alias("m")).first().m
    return (0, START) if line is None else (line.line_no, line.manifest_sha256)


def put(spark: SparkSession, pages: DataFrame, folder: str, run_id: str, protocol_hash: str | None = None, errors: DataFrame | None = None) -> DataFrame:
    """Appends pages(domain_url, seq, page_key, body) and returns the new entries; errors(domain_url, errors_count) may name what failed."""
    if not run_id:
        raise ValueError("run_id is empty")
    batch, now = uuid.uuid4().hex, datetime.datetime.now(datetime.UTC)
    rows = pages.select("domain_url", F.col("seq").cast("long").alias("seq"), "page_key", F.col("body").cast("binary").alias("body"), F.lit(run_id).alias("run_id"), F.lit(batch).alias("batch"))
    rows.write.mode("append").partitionBy("run_id", "batch").parquet(f"{folder}/pages")
    found = site_digests(stored(spark, folder, "pages", PAGES).where((F.col("run_id") == run_id) & (F.col("batch") == batch)))
    found = found.join(errors.select("domain_url", "errors_count"), "domain_url", "left") if errors is not None else found.withColumn("errors_count", F.lit(0))
    name = F.concat_ws("__", F.lit(now.strftime("%Y%m%dT%H%M%SZ")), slug(F.lit(run_id), 40), slug(F.col("domain_url")))
    found.select(
        name.alias("tar_filename"), "sha256", "domain_url", "n_pages", F.coalesce("errors_count", F.lit(0)).cast("long").alias("errors_count"), F.lit(now).alias("created_at"),
        F.lit(protocol_hash).cast("string").alias("protocol_version_hash"), "run_id", "batch",
    ).write.mode("append").partitionBy("run_id", "batch").parquet(f"{folder}/manifest")
    entries = stored(spark, folder, "manifest", ENTRIES).where((F.col("run_id") == run_id) & (F.col("batch") == batch))
    line, previous = _last(spark, folder)
    own = batch_digests(entries).first()
    chained = hashlib.sha256(f"{previous}{own.sha256 if own else START}".encode()).hexdigest()
    spark.createDataFrame([("manifest_updated", line + 1, batch, previous, chained, now.isoformat())], LOG).coalesce(1).write.mode("append").json(f"{folder}/log")
    return entries


def audit_chain(spark: SparkSession, folder: str) -> DataFrame:
    """line_no, batch and whether the line follows the one before it and fits the entries as they are now."""
    log = read_log(spark, folder)
    before = log.select((F.col("line_no") + 1).alias("line_no"), F.col("manifest_sha256").alias("before"))
    now = batch_digests(stored(spark, folder, "manifest", ENTRIES))
    rows = log.join(before, "line_no", "left").join(now, "batch", "left")
    expected = F.sha2(F.concat("previous", F.coalesce("sha256", F.lit(START))), 256)
    first = F.when(F.col("line_no") == 1, F.lit(START)).otherwise(F.col("before"))
    return rows.select("line_no", "batch", F.coalesce((F.col("previous") == first) & (F.col("manifest_sha256") == expected), F.lit(False)).alias("valid"))


def get(spark: SparkSession, folder: str, refs: DataFrame) -> DataFrame:
    """The pages of refs(run_id, domain_url, sha256); fails if an entry is missing or its pages no longer have the entry's digest."""
    key = ["run_id", "domain_url", "sha256"]
    # of equal evidence that was put twice one batch serves
    entries = entries_of(spark, folder).groupBy(*key).agg(F.min("batch").alias("batch"))
    named = refs.select(*key).distinct().join(entries, key, "left")
    place = ["run_id", "batch", "domain_url"]
    pages = stored(spark, folder, "pages", PAGES).join(named.select(*place), place, "left_semi")
    actual = site_digests(pages).select("run_id", "batch", "domain_url", F.col("sha256").alias("actual"))
    checked = named.join(actual, place, "left")
    fault = F.raise_error(F.concat(F.when(F.col("batch").isNull(), "no evidence of ").otherwise("digest differs for "), "domain_url")).cast("boolean")
    sound = checked.where(F.when(F.col("actual").eqNullSafe(F.col("sha256")), F.lit(True)).otherwise(fault))
    return sound.select(*place).join(pages, place, "left").select("run_id", "domain_url", "seq", "page_key", "body")
