"""Exact deduplication by a stateful stream.

The keyed state lives in the disk-backed RocksDB store under a folder, never expires, and keeps for each digest the
number of rows, the identifier of the row that stays and a locator of its content (file and identifier).  A folder that
is used again goes on from its state: its rows count, and a call that was cut short is finished.
Partial aggregation before the state shuffle makes a hot digest one row per task.

On hits (digests of two rows or more) the full bytes are checked: of the rows at hand, found again by marks of the
hit digests, and of what the locators of earlier calls point to.  The smallest and the largest text of a digest must be equal,
which aggregates before it shuffles; texts without a copy are not shuffled.  A digest that different texts share is
resolved by the texts themselves; if one of them came in an earlier call, that is an error.

Nulls: a null text counts as empty; a null identifier is smaller than any other.  Rows repeated with
the same identifier are the same document and get the same values.  Long texts are digested and checked whole.  An empty
table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasshouse.llm.common import ascii_lower, join_hot, marks, shared_folder, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "digest string, n long, locator struct<doc_id: long, file: string>"
ROWS = "doc_id long, digest string, file string"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
    "spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(digest=None):
    """The text that is compared, and its digest."""
    norm = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return norm, digest(norm) if digest else F.sha2(norm, 256)


def fingerprints(docs: DataFrame, digest=None) -> DataFrame:
    """doc_id, digest of the normalised text, and where the content lies."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(digest)[1].alias("digest"), F.input_file_name().alias("file"))


def digest_state(stream: DataFrame) -> DataFrame:
    """The stateful operator on a stream of fingerprints: state per digest, without watermark and so without expiry."""
    at = F.struct(F.col("doc_id"), F.col("file"))
    return stream.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("locator"))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def advance(spark: SparkSession, folder: str, files_per_batch: int) -> DataFrame:
    """Feeds the fingerprints of the folder that its state does not have yet through it, batch by batch; the state of all digests."""
    out = f"{folder}/state-out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("digest", "n", "locator").write.mode("overwrite").parquet(f"{out}/batch={number}")  # a retried batch replaces itself

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        query = (
            digest_state(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/rows/*"))
            .writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not _exists(spark, out):
        return spark.createDataFrame([], STATE)
    # the last update of a digest has the largest count and identifier
    return spark.read.schema(STATE).parquet(f"{out}/*").groupBy("digest").agg(F.max("n").alias("n"), F.max("locator").alias("locator"))


def exact_groups(spark: SparkSession, docs: DataFrame, files_per_batch: int = 1000, digest=None, folder: str | None = None, call: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest, keep_file.  The largest doc_id of equal texts stays.

    `folder` is where the state lives (a new one if not given); `call` names these documents, so that the same call
    made again, after a loss, does not count them twice."""
    fresh = folder is None
    folder = folder or shared_folder(spark, "state")
    table = f"{folder}/rows/{call or uuid.uuid4().hex}"
    if not _exists(spark, f"{table}/_SUCCESS"):
        fingerprints(docs, digest).write.mode("overwrite").parquet(table)
    rows = spark.read.schema(ROWS).parquet(table)
    # a table of its own, so that the join below deals out a hot digest's rows
    state = written(spark, advance(spark, folder, files_per_batch), "digests")
    norm, key = normalised(digest)
    hits = state.where("n > 1")
    hit = marks(spark, hits.select(F.xxhash64("digest").alias("key")))
    whole = docs.select(key.alias("digest"), norm.alias("norm"), F.lit(True).alias("here")).where(hit(F.xxhash64("digest")))
    if not fresh:
        whole = whole.unionByName(_located(spark, hits, rows, norm, key))
    differing = whole.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"), F.bool_and("here").alias("here")).where("least != most").select("digest", "here")
    own = join_hot(rows, state, "digest", "n").select("doc_id", F.col("locator.doc_id").alias("keep_id"), F.col("n").alias("group_size"), "digest", F.col("locator.file").alias("keep_file"))
    collided = differing.agg(F.count(F.lit(1)), F.coalesce(F.bool_and("here"), F.lit(True))).first()
    if collided[0]:
        if not collided[1] or not fresh:
            raise ValueError("a text shares the digest of a different text of an earlier call")
        # two texts share a digest: these are told apart by the text itself
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"), key.alias("digest"), F.input_file_name().alias("file")).join(differing.select("digest"), "digest")
        groups = texts.groupBy("norm").agg(F.max(F.struct("doc_id", "file")).alias("locator"), F.count(F.lit(1)).alias("group_size"))
        apart = texts.select("doc_id", "norm", "digest").join(groups, "norm").select("doc_id", F.col("locator.doc_id").alias("keep_id"), "group_size", "digest", F.col("locator.file").alias("keep_file"))
        own = own.join(differing.select("digest"), "digest", "left_anti").select(*apart.columns).unionByName(apart)
    return own.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "keep_file")


def _located(spark: SparkSession, hits: DataFrame, rows: DataFrame, norm, key) -> DataFrame:
    """Content of earlier calls that shares a digest with these rows, read from the files that its locators name."""
    wanted = hits.join(rows.select("digest").distinct(), "digest").select("digest", "locator.*")
    files = [r.file for r in wanted.join(rows.select("file").distinct(), "file", "left_anti").select("file").distinct().collect() if r.file]  # names of files only
    if not files:
        return spark.createDataFrame([], "digest string, norm string, here boolean")
    earlier = spark.read.parquet(*files).select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("digest"), norm.alias("norm"))
    return earlier.join(wanted.select("doc_id", "digest"), ["doc_id", "digest"]).select("digest", "norm", F.lit(False).alias("here"))
