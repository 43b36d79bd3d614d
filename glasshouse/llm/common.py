"""Helpers shared by the training-data operators: shared folders, Arrow text buffers, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on.
STEP_BYTES = 4 << 20
#: Bytes of text in one block of documents that is exchanged and read again as a unit.
BLOCK_BYTES = 4 << 20
#: White space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Upper-case ASCII to lower case, other bytes unchanged.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir.  Where that is unset only a session on one machine (tests) gets a local folder, which then becomes it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="glasshouse-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/glasshouse-{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives the loss of an executor."""
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Removes a table that written() made and that nothing will read again."""
    files = df.inputFiles()
    folders = {f[: f.index("/", f.index("glasshouse-"))] for f in files if "/glasshouse-" in f}
    sc = df.sparkSession.sparkContext
    for folder in folders:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one key from which on a join treats it as hot: this many, or this share of all rows if that is more.
HOT_ROWS, HOT_SHARE = 1000, 100_000


def join_hot(rows: DataFrame, known: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of rows with one row for each key; known[count] is the number of rows with the key.

    Keys of more than HOT_ROWS rows, and of more than 1 / HOT_SHARE of all, are broadcast: there are fewer than HOT_SHARE of
    them however large the table is.  The others are shuffled, and no task gets many rows of one key."""
    total = known.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.col(count) > max(HOT_ROWS, total // HOT_SHARE)
    few, rest = known.where(hot), known.where(~hot)
    if few.isEmpty():
        return rows.join(rest, key)
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Total bytes of the texts; sizes blocks and sketches."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()[0])


def strings(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """One contiguous array with 64-bit offsets; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_string()).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def buffers(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offset of each text in them (one more at the end)."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw, offsets - offsets[0]


def release() -> None:
    """Gives memory that has been freed back to the system: a worker lives through many stages, and the C library and Arrow keep what each of them needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text, so that memory does not follow the batch size; frees memory at the end of a task."""
    for batch in batches:
        _, offsets = buffers(strings(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    release()


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in raw, and for each text the number of its first word (one more at the end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers of the two lanes of a 128-bit fingerprint.
LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
LONG_WORD = 1024  # bytes from which on a word is hashed by itself


def combined(one: np.ndarray, other: np.ndarray, lane: np.uint64) -> np.ndarray:
    """A fingerprint of pairs of fingerprints; the order counts, and no sum of terms that could cancel out is involved."""
    return mix(mix(one * lane + np.uint64(1)) + other)


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit fingerprint of each word, as two lanes of 64 bits: its 8-byte pieces are taken in one after the other, each behind a mixing step."""
    size = stops - starts
    out = [mix(size.astype(np.uint64) + lane) for lane in LANES]
    if not len(starts):
        return out[0], out[1]
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    at = np.flatnonzero(size <= LONG_WORD)
    place, left = starts[at], size[at]
    while len(at):
        piece = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[place]).view("<u8").reshape(-1)
        part = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        piece = piece & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - part))
        for i, lane in enumerate(LANES):
            out[i][at] = combined(out[i][at], piece, lane)
        more = left > 8
        at, place, left = at[more], place[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        import xxhash

        whole = xxhash.xxh3_128_intdigest(raw[starts[i] : stops[i]].tobytes())
        out[0][i], out[1][i] = np.uint64(whole >> 64), np.uint64(whole & (1 << 64) - 1)
    return out[0], out[1]


#: Places of a set of marks(): 2 MB, whatever the number of keys.
MARKS = 1 << 24


def marks(spark: SparkSession, keys: DataFrame) -> Callable[[Column], Column]:
    """A test on a column of long that is true for every one of keys(key long), and for others by chance only.

    The more keys there are the more others pass; at the size of MARKS and beyond nearly all do.  So it saves a shuffle and decides nothing."""
    place = F.pmod(F.xxhash64("key"), F.lit(MARKS))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits"))
    found = words.toArrow()  # at most MARKS / 64 rows
    bitmap = np.zeros(MARKS // 64, dtype=np.int64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def marked(p: pd.Series) -> pd.Series:
        v = p.to_numpy()
        return pd.Series((shared.value[v >> 6] >> (v & 63) & 1).astype(bool))

    return lambda column: marked(F.pmod(F.xxhash64(column), F.lit(MARKS)))
