"""Removal of word passages that repeat across documents, behind a count-min prefilter.

Pass one: blocks of documents sketch the fingerprints of their 13-word windows; the sketches are merged
shard by shard and overestimate each window's count.  Pass two: only windows estimated to repeat are
grouped exactly, by a 128-bit fingerprint of their words, to the smallest doc_id that holds them.
The estimate is never too low, so no window is lost.  A word goes if a window over it also starts in
a document with a smaller doc_id.  Sketch rows grow with the input and stay sharded, as their touched
cells; nothing is broadcast.

Nulls: a null text has no words; a null doc_id counts as smaller than any other.  Rows that repeat a
doc_id are judged as one document: they do not remove each other's words.  Empty texts give zero words
and the digest of nothing.  Long texts are read whole.  Empty table: empty result.  Other columns are ignored,
or carried unchanged whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from glasshouse.llm.common import LANES, buffers, combined, strings, word_hashes, word_spans
from glasshouse.llm.exchange import QUESTIONS, Sketch, answer, answered, ask, blocked, leading_runs, merge_least, merge_sketch, per_block, table

WINDOW = 13
EXACT = 9  # phase of the exact round, after the sketch's rows
_NONE = np.iinfo(np.int64).min


def _sequences(words: np.ndarray, size: int, count: int, lane: np.uint64) -> np.ndarray:
    """A fingerprint of every `size` consecutive words, put together from those of 1, 2, 4, ... words."""
    total, done, power = None, 0, 1
    while done < size and count:
        if size & power:
            part = words[done : done + count]
            total = part if total is None else combined(total, part, lane)
            done += power
        words, power = combined(words[:-power], words[power:], lane) if len(words) > power else words[:0], power * 2
    return np.zeros(0, dtype=np.uint64) if total is None else total


class Windows:
    """The windows of one block: two fingerprint lanes, the document and the first word of each."""

    def __init__(self, rows: pa.Table, size: int = WINDOW):
        self.raw, offsets = buffers(strings(rows.column("text")))
        self.starts, self.stops, self.first = word_spans(self.raw, offsets)
        self.ids = rows.column("doc_id").combine_chunks().fill_null(_NONE).to_numpy(zero_copy_only=False)
        count = max(0, len(self.starts) - size + 1)
        lanes = [_sequences(words, size, count, lane) for lane, words in zip(LANES, word_hashes(self.raw, self.starts, self.stops), strict=True)]
        doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        whole = np.flatnonzero(doc[:count] == doc[size - 1 : size - 1 + count]) if count else np.zeros(0, np.int64)
        self.at, self.one, self.two, self.doc = whole, lanes[0][whole], lanes[1][whole], self.ids[doc[:count][whole]] if count else np.zeros(0, np.int64)


def _records(w: Windows, answers: dict, sketch: Sketch) -> tuple[np.ndarray, ...]:
    """Windows estimated to repeat, in order of their fingerprints, and the distinct ones with the smallest doc_id in the block."""
    take = np.flatnonzero(sketch.repeated(w.one, answers))
    order = take[np.lexsort((w.doc[take], w.two[take], w.one[take]))]
    one, two = w.one[order], w.two[order]
    new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if len(order) else np.zeros(0, dtype=bool)
    return order, np.cumsum(new) - 1, one[new], two[new], w.doc[order][new]


def dedup_passages(spark: SparkSession, docs: DataFrame, window: int = WINDOW, rewrite: bool = False, length: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256; or, to rewrite, the documents with their columns and what is left of the text.

    A rewritten text is its kept words joined by one space; a text that loses nothing stays as it is, and a
    document that loses every word goes.  Column `length`, if there is one, follows a text that was cut."""
    blocks, total, shards = blocked(spark, docs, carry=rewrite)
    sketch = Sketch(total, shards)

    def first(block: int, rows: pa.Table, _: dict) -> pa.Table:
        return sketch.questions(block, Windows(rows, window).one)

    def second(block: int, rows: pa.Table, answers: dict) -> pa.Table:
        _, _, one, two, least = _records(Windows(rows, window), answers, sketch)
        return table([(EXACT, s, block, one[a:b].tobytes() + two[a:b].tobytes() + least[a:b].tobytes()) for s, a, b in leading_runs(one, shards)], QUESTIONS)

    def last(block: int, rows: pa.Table, answers: dict) -> pa.Table:
        w = Windows(rows, window)
        order, group, one, _, least = _records(w, answers, sketch)
        earlier = answered(leading_runs(one, shards), EXACT, answers)
        gone = w.at[order][earlier[group] | (w.doc[order] > least[group])] if len(order) else np.zeros(0, np.int64)
        cover = np.zeros(len(w.starts) + 1, dtype=np.int32)
        np.add.at(cover, gone, 1)
        np.add.at(cover, np.minimum(gone + window, len(w.starts)), -1)
        keep = np.cumsum(cover[:-1]) == 0
        data, begin, end = w.raw.tobytes(), w.starts.tolist(), w.stops.tolist()
        words, removed, digests, texts = [], [], [], []
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            kept = np.flatnonzero(keep[a:b]) + a
            text = b" ".join([data[begin[i] : end[i]] for i in kept.tolist()])
            words.append(b - a)
            removed.append(b - a - len(kept))
            digests.append(hashlib.sha256(text).hexdigest())
            texts.append(text.decode() if rewrite and removed[-1] else None)
        if rewrite:
            lost = pa.array(removed, pa.int64())
            new = pc.if_else(pc.greater(lost, 0), pa.array(texts, pa.string()), rows.column("text").cast(pa.string()))
            out = pa.table({"doc_id": rows.column("doc_id"), "text": new, "carry": rows.column("carry"), "n_removed": lost})
            return out.filter(pc.or_(pc.equal(lost, 0), pc.less(lost, pa.array(words, pa.int64()))))
        out = {"doc_id": rows.column("doc_id"), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out)

    estimates = answer(ask(blocks, None, first), merge_sketch)
    exact = answer(ask(blocks, estimates, second), merge_least)
    found = estimates.unionByName(exact)
    if not rewrite:
        return per_block(blocks, found, last, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    schema = StructType([*blocks.schema.fields[:3], StructField("n_removed", LongType())])
    left = per_block(blocks, found, last, schema)

    def column(name: str):
        kind = docs.schema[name].dataType
        if name in ("doc_id", "text"):
            return F.col(name).cast(kind).alias(name)
        kept = F.col(f"carry.`{name}`")
        return F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(kept).alias(name) if name == length else kept

    return left.select(*map(column, docs.columns))
