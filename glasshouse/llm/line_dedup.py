"""Removal of lines that many documents share, as bitmaps of the lines that stay.

The hashes of all long enough lines are range-partitioned with document (falling) and position as secondary sort, and each
partition is streamed once: a line's first occurrence is in the document with the largest doc_id, which keeps it; if enough
documents hold the line, all others lose it.  A range may end within a hash, so a line that a third of all documents hold is
spread over as many partitions as its occurrences need.  The first and the last hash of a partition are therefore left open: their
documents are counted over all partitions afterwards.  There are at most two open hashes a partition.  What comes back for a
document is a compressed bitmap of its lines, no text.

A line is what stands between line feeds; its key is the line without white space [\\x20\\x09-\\x0D] at its ends, A-Z
lower-cased.  Keys are told apart by 128-bit fingerprints.  Texts are read whole; a long text's lines are spread like all others.  A null
or empty text is one empty line.  A null doc_id counts as smaller than any other.  Rows that repeat a doc_id are judged as one
document, and each has its bitmap; rows that repeat the text too share one.  Ties: all lines of a key within the
document that keeps it stay.  An empty table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasshouse.llm.common import ASCII_LOWER, SPACE, buffers, partitions, steps, strings, word_hashes, written

#: Code points from which on a line counts, and documents from which on it is shared.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Records of one hash that a partition holds back before it leaves the hash open.
HELD = 1 << 18
_FEED = 10
_RECORDS = "one long, two long, doc_id long, mark long, pos int"
_FOUND = f"{_RECORDS}, open boolean"


def line_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line's key in raw, the text it stands in and its place there.  Every text has at least one line."""
    feeds = np.flatnonzero(raw == _FEED)
    text = np.searchsorted(offsets, feeds, side="right") - 1
    lines = np.bincount(text, minlength=len(offsets) - 1) + 1
    first = np.r_[0, np.cumsum(lines)]
    start, stop = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    behind = np.arange(len(feeds)) + text + 1  # the line behind each feed
    start[first[:-1]], stop[first[1:] - 1] = offsets[:-1], offsets[1:]
    start[behind], stop[behind - 1] = feeds + 1, feeds
    ink = np.flatnonzero(~SPACE[raw])
    begin, end = np.searchsorted(ink, start), np.searchsorted(ink, stop)
    some = begin < end
    start[some], stop[some] = ink[begin[some]], ink[end[some] - 1] + 1
    stop[~some] = start[~some]
    whose = np.repeat(np.arange(len(lines)), lines)
    return start, stop, whose, np.arange(first[-1]) - first[whose]


def _records(least_chars: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in steps(batches, "text"):
            ids, marks = rows.column("doc_id"), rows.column("mark")
            keys = np.stack([ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), marks.to_numpy(zero_copy_only=False)])
            rows = rows.take(pa.array(np.sort(np.unique(keys, axis=1, return_index=True)[1])))  # repeated rows once
            raw, offsets = buffers(strings(rows.column("text")))
            raw = ASCII_LOWER[raw]
            start, stop, whose, place = line_spans(raw, offsets)
            points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
            take = np.flatnonzero(points[stop] - points[start] >= least_chars)
            one, two = word_hashes(raw, start[take], stop[take])
            whose = pa.array(whose[take])
            out = [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), rows.column("doc_id").take(whose), rows.column("mark").take(whose), pa.array(place[take].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=["one", "two", "doc_id", "mark", "pos"])

    return work


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted table's rows differ from the row before; the first does."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _marked(table: pa.Table, is_open: bool) -> pa.RecordBatch:
    table = table.append_column("open", pa.array(np.full(table.num_rows, is_open)))
    return table.combine_chunks().to_batches()[0]


def _closed(table: pa.Table, least_docs: int) -> pa.RecordBatch | None:
    """The records of whole hashes that go: all but those of the first document of a hash with enough documents."""
    one, two = (table.column(c).to_numpy() for c in ("one", "two"))
    doc, none = table.column("doc_id").fill_null(0).to_numpy(), table.column("doc_id").is_null().to_numpy()
    line = _changes(one, two)
    new = line | _changes(doc, none)
    run = np.cumsum(line) - 1
    nth = np.cumsum(new)  # documents so far; those of a line are numbered from its first on
    documents = np.bincount(run, weights=new).astype(np.int64)
    gone = (nth > nth[np.flatnonzero(line)][run]) & (documents[run] >= least_docs)
    return _marked(table.filter(pa.array(gone)), False) if gone.any() else None


def _stream(least_docs: int, most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun = None, None  # records of the last hash so far, and the hash that may have begun before what is held
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            one, two = held.column("one").to_numpy(), held.column("two").to_numpy()
            begun = begun if begun is not None else (one[0], two[0])
            same = (one == begun[0]) & (two == begun[1])
            if same[0]:  # goes on with a hash that is open
                ahead = int(same.sum())
                yield _marked(held.slice(0, ahead), True)
                held, one, two = held.slice(ahead), one[ahead:], two[ahead:]
            if not len(one):
                held = None
                continue
            last = int(np.flatnonzero(_changes(one, two))[-1])
            if last and (found := _closed(held.slice(0, last), least_docs)) is not None:
                yield found
            held = held.slice(last)
            if held.num_rows > most:
                begun = (one[last], two[last])
                yield _marked(held, True)
                held = None
        if held is not None and held.num_rows:
            yield _marked(held, True)

    return work


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        keeps = []
        for gone in batch.column("gone"):
            at = gone.values.to_numpy()
            keep = np.ones((int(at.max()) // 8 + 1) * 8, dtype=np.uint8)  # whole bytes; what lies beyond the last line that goes stays
            keep[at] = 0
            keeps.append(pack.compress(np.packbits(keep).tobytes()))
        dropped = pa.array([len(x) for x in batch.column("gone")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), dropped, pa.array(keeps, pa.binary())], names=["doc_id", "mark", "n_dropped", "keep"])


def lines_kept(keep: bytes | None, lines: int) -> np.ndarray:
    """Which of a document's lines stay, by its bitmap; all without one, and all beyond it."""
    out = np.ones(lines, dtype=bool)
    if keep is not None:
        bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(keep), dtype=np.uint8)).astype(bool)[:lines]
        out[: len(bits)] = bits
    return out


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))


def keep_bitmaps(spark: SparkSession, docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, held: int = HELD) -> DataFrame:
    """doc_id, mark (XXH64 of the text), n_dropped and keep (a bit for each line up to the last that goes, compressed), for documents that lose lines."""
    records = written(spark, _rows(docs).mapInArrow(_records(least_chars), _RECORDS), "lines")
    order = ["one", "two", F.col("doc_id").desc_nulls_last(), "mark", "pos"]
    ranged = records.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    found = written(spark, ranged.mapInArrow(_stream(least_docs, held), _FOUND), "found")
    left = found.where("open")
    documents = left.groupBy("one", "two", "doc_id").agg(F.lit(1).alias("n")).groupBy("one", "two").agg(F.count("n").alias("documents"), F.max("doc_id").alias("keeper"))
    shared = F.broadcast(documents.where(F.col("documents") >= least_docs))  # at most two a partition
    others = left.join(shared, ["one", "two"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = found.where("NOT open").select("doc_id", "mark", "pos").unionByName(others.select("doc_id", "mark", "pos"))
    lost = gone.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("gone"))
    return lost.mapInArrow(_bitmaps, "doc_id long, mark long, n_dropped long, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        texts, keeps = batch.column("text"), batch.column("keep").to_pylist()
        counts, dropped, digests = [], [], []
        for text, keep in zip(texts.cast(pa.large_binary()), keeps, strict=True):
            data = text.as_py()
            lines = data.count(b"\n") + 1
            counts.append(lines)
            if keep is None:
                dropped.append(0)
            else:
                stay = lines_kept(keep, lines)
                data = b"\n".join([x for x, s in zip(data.split(b"\n"), stay.tolist(), strict=True) if s])
                dropped.append(lines - int(stay.sum()))
            digests.append(hashlib.sha256(data).hexdigest())
        out = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def digests(spark: SparkSession, docs: DataFrame, held: int = HELD) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the lines that stay.  The texts meet their bitmaps in one shuffle."""
    rows = _rows(docs)
    kept = keep_bitmaps(spark, docs, held=held).select(F.col("doc_id").alias("id"), F.col("mark").alias("of"), "keep")
    both = rows.join(kept, rows["doc_id"].eqNullSafe(kept["id"]) & (rows["mark"] == kept["of"]), "left")
    return both.select("doc_id", "text", "keep").mapInArrow(_apply, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
