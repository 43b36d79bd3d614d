"""Excerpts looked for in all documents through an index of fragments.

Bytes are hashed in fixed windows; of each run of consecutive windows the smallest hash is kept (winnowing).  A run that lies within an excerpt
has the same smallest hash wherever the excerpt stands, so a document that contains the excerpt has all of the excerpt's kept hashes.
Each excerpt is joined by the one of them that the fewest documents have, and then verified.  Excerpts are taken by size: longer ones
use wider windows and longer runs, of which a document keeps few; short ones, down to one byte, windows of their own length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasshouse.operators.joins import by_frequency
from glasshouse.plans.registry import scratch

#: Excerpts of at least `size` bytes: bytes of a window, windows of a run (size = window + run - 1).
SIZES = [(50, 16, 35), (24, 8, 17), (12, 8, 5), (8, 8, 1), (4, 4, 1), (2, 2, 1), (1, 1, 1)]
#: Bytes of text that one vectorised step works on.
STEP_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _doubled(x: np.ndarray, size: int, join) -> np.ndarray:
    """The join of every `size` consecutive items, in steps that double."""
    part, done, out = x, 1, None
    while True:
        if out is None and size == done:
            return part
        if done * 2 > size:
            break
        part, done = join(part[:-done], part[done:]) if len(part) > done else part[:0], done * 2
    rest = size - done  # the last items overlap where the join allows it
    return join(part[: max(len(part) - rest, 0)], part[rest:])


def fragments(raw: np.ndarray, window: int, run: int) -> np.ndarray:
    """The kept hashes of a text's bytes, distinct; none if the text is shorter than a window."""
    if len(raw) < window:
        return np.zeros(0, dtype=np.int64)
    hashes = _doubled(_mixed(raw.astype(np.uint64) + _ODD), window, lambda a, b: _mixed(a * _ODD + b))  # windows are powers of two
    if len(hashes) >= run:
        hashes = _doubled(hashes, run, np.minimum)
    else:
        hashes = hashes.min(keepdims=True)
    return np.unique(hashes).view(np.int64)


def _indexed(key: str, sizes: list[tuple[int, int, int]]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("_text").cast(pa.large_binary())
            rows, classes, found, size = [], [], [], 0
            for i in range(batch.num_rows):
                if (text := data[i].as_py()) is not None:
                    raw = np.frombuffer(text, dtype=np.uint8)
                    for n, window, run in sizes:
                        kept = fragments(raw, window, run)
                        rows.append(np.full(len(kept), i))
                        classes.append(np.full(len(kept), n, dtype=np.int32))
                        found.append(kept)
                        size += len(kept)
                if size and (size * 16 > STEP_BYTES or i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(classes)), pa.array(np.concatenate(found))], names=[key, "_size", "_hash"])
                    rows, classes, found, size = [], [], [], 0

    return work


def _index(rows: DataFrame, key: str, text: str, sizes: list[tuple[int, int, int]]) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(_indexed(key, sizes), f"{key} {kind}, _size int, _hash long")


def containing(docs: DataFrame, doc_key: str, text: str, excerpts: DataFrame, item_key: str, part: str) -> DataFrame:
    """Documents with the columns of the excerpts whose `part` they contain, one row a pair of document and excerpt row.

    A null or empty part is in no document, and a null text contains nothing.  Repeated parts are looked for once."""
    spark = docs.sparkSession
    size = F.octet_length(part)
    kind = reduce(lambda c, s: c.when(size >= s[0], s[0]), SIZES[1:], F.when(size >= SIZES[0][0], SIZES[0][0]))
    parts = excerpts.where(size > 0).groupBy(part).agg(F.first(kind).alias("_size")).withColumn("_id", F.sha2(part, 256))
    parts = parts.select("_id", "_size", F.col(part).alias("_part"))
    used = [s for s in SIZES if s[0] in {r[0] for r in parts.select("_size").distinct().collect()}]  # as many as SIZES has
    mine = [_index(parts.where(F.col("_size") == s[0]), "_id", "_part", [s]) for s in used]
    if not used:
        return docs.join(excerpts.where("false"), F.lit(False))
    path = scratch(spark, "fragments")
    reduce(DataFrame.unionByName, mine).write.parquet(path)
    asked = spark.read.parquet(path)
    at = F.concat_ws("#", "_size", "_hash")  # one name for what is joined by
    known = asked.withColumn("_at", at).groupBy("_at").agg(F.count(F.lit(1)).alias("_asked"))
    hits = by_frequency(_index(docs, doc_key, text, used).withColumn("_at", at), known, "_at", "_asked", F.octet_length("_at") + 16).select(doc_key, "_at")
    path = scratch(spark, "hits")
    hits.write.parquet(path)
    hits = spark.read.parquet(path)
    spread = hits.groupBy("_at").agg(F.count(F.lit(1)).alias("_docs"))
    rarest = asked.withColumn("_at", at).join(spread, "_at").groupBy("_id").agg(F.min(F.struct("_docs", "_at")).alias("r"), F.count(F.lit(1)).alias("_found"))
    wanted = asked.groupBy("_id").agg(F.count(F.lit(1)).alias("_kept")).join(rarest, "_id").where("_found = _kept")  # a hash that no document has: nowhere
    chosen = wanted.select("_id", "r.*").groupBy("_at").agg(F.first("_docs").alias("_docs"), F.collect_list("_id").alias("_ids"))
    pairs = by_frequency(hits, chosen, "_at", "_docs", F.size("_ids") * 80).select(doc_key, F.explode("_ids").alias("_id"))
    near = docs.join(pairs, doc_key).join(parts, "_id").where(F.contains(F.col(text), F.col("_part"))).select(*docs.columns, "_part")
    return near.join(excerpts, near["_part"] == excerpts[part]).drop("_part")
