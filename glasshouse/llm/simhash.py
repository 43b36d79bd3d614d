"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints of 64 bits have 8 positional bytes.  Two that differ in at most 4 bits differ in at most 4
bytes, so they share at least 4 positional bytes: the guaranteed minimum.  A posting list holds the
fingerprints with given bytes at one or more positions.  In each list the shared positional bytes
of a pair are tallied, pairs that reach the minimum are retained, and these are verified by their differing
bits.  A pair that shares the bytes of positions a < b < c < d meets in the lists of (a), of (a, b), of (a, b, c) and
of (a, b, c, d), so a frequent list may be split by its next position without losing the pair: lists start with as
many positions as keep them short on average, and one longer than LONGEST is split, by bytes
up to 4 positions and then by half-bytes of the other 4 bytes (at most 4 of these 8 differ).  What cannot be split any more
shares 48 bits and has at most 2**16 members.  Lists never emit all their pairs: each emits a spanning forest of
its verified links, which has the same components.

Nulls: a null text is empty; no words give fingerprint zero, linked like any other; a null doc_id is
ignored when the smallest of a component is taken (null only if all are null).  Repeated rows share
fingerprint and component.  Long texts are read whole.  Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasshouse.llm.common import ASCII_LOWER, buffers, drop, join_hot, mix, steps, strings, word_spans, written
from glasshouse.llm.components import components

SHINGLE = 4
MOST_BITS = 4
SHARED = 4  # the guaranteed minimum of shared positional bytes
SHORT, LONGEST = 64, 1024  # members of a list: on average at the start, and before it is split
_FINGERPRINTS = "doc_id long, fp long"
_ENTRY = "path int, key long, fp long"


def text_fingerprints(texts: pa.LargeStringArray, width: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set if it is set in over half of the shingles' XXH64."""
    import xxhash

    raw, offsets = buffers(texts)
    starts, stops, first = word_spans(raw, offsets)
    # one space between words, so that a shingle is a slice
    size = stops - starts
    new = np.cumsum(size + 1) - size - 1
    clean = np.full(int((size + 1).sum()), 0x20, dtype=np.uint8)
    if len(starts):
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        clean[np.repeat(new, size) + within] = ASCII_LOWER[raw[np.repeat(starts, size) + within]]
    data, begin, end = clean.tobytes(), new.tolist(), (new + size).tolist()
    out = np.zeros(len(texts), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if a == b:
            continue
        last = max(b - width + 1, a + 1)
        tails = end[a + width - 1 : b] or [end[b - 1]]
        hashes = np.array([digest(data[x:y], 42) for x, y in zip(begin[a:last], tails, strict=True)], dtype="<u8")
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 1 << 16):
            ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            fp = text_fingerprints(strings(b.column("text"))).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _FINGERPRINTS)


# --- the index ---

# The path of a list: 8 bits for its positions (bytes), 8 for its half-bytes among those of the other bytes.


def half_bytes(mask: int) -> list[int]:
    """Bit offsets of the half-bytes of the bytes that a mask leaves out."""
    return [8 * p + h for p in range(8) if not mask >> p & 1 for h in (0, 4)]


def longer(path: int) -> list[int]:
    """The paths of the lists that a list is split into; none if it is split to the end."""
    mask, halves = path & 255, path >> 8
    if mask.bit_count() < SHARED:
        # enough positions must remain for the minimum
        return [mask | 1 << q for q in range(mask.bit_length(), 8 - (SHARED - 1 - mask.bit_count()))]
    if halves.bit_count() < 8 - SHARED:
        return [mask | (halves | 1 << q) << 8 for q in range(halves.bit_length(), 8 - (3 - halves.bit_count()))]
    return []


def paths(level: int) -> list[int]:
    """Where the index starts: all lists of `level` positions that leave enough positions for the minimum."""
    return [m for m in (sum(1 << p for p in at) for at in combinations(range(8), level)) if m.bit_length() <= 8 - (SHARED - level)]


def keys(fps: np.ndarray, path: int) -> np.ndarray:
    """The posting list of each fingerprint on a path: a hash of the path and of the bytes there."""
    mask, halves = path & 255, path >> 8
    bits = sum(255 << 8 * p for p in range(8) if mask >> p & 1) | sum(15 << at for q, at in enumerate(half_bytes(mask)) if halves >> q & 1)
    return mix(mix(fps & np.uint64(bits)) + np.uint64((path + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def _entries(fps: np.ndarray, path: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), path, dtype=np.int32)), pa.array(keys(fps, path).view(np.int64)), pa.array(fps.view(np.int64))], names=["path", "key", "fp"])


def start_level(count: int) -> int:
    """Positions of the lists to start with, so that lists of evenly spread fingerprints have at most SHORT members on average."""
    level = 1
    while level < SHARED and count > SHORT << 8 * level:
        level += 1
    return level


def postings(fps: DataFrame, level: int) -> DataFrame:
    """Distinct fingerprints (fp) to the entries of the index."""
    start = paths(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            yield from (_entries(fp, p) for p in start)

    return fps.mapInArrow(run, _ENTRY)


def split(entries: DataFrame) -> DataFrame:
    """The entries of frequent lists, in the lists with one more position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            path = b.column("path").to_numpy(zero_copy_only=False)
            for p in np.unique(path).tolist():
                yield from (_entries(fp[path == p], q) for q in longer(p))

    return entries.mapInArrow(run, _ENTRY)


# --- pairs of a list ---


def tally(x: np.ndarray) -> np.ndarray:
    """Shared positional bytes of pairs, from the exclusive or of their fingerprints."""
    low, top = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
    return np.bitwise_count(~((x & low) + low | x) & top)  # the top bit of every byte that is zero


def retained(a: np.ndarray, b: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Which pairs reach the minimum of shared positional bytes and, of these, differ in at most `most` bits."""
    x = a ^ b
    out = tally(x) >= SHARED
    at = np.flatnonzero(out)
    out[at] = np.bitwise_count(x[at]) <= most
    return out


def forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member that each of `size` members is linked to, directly or through others."""
    least = np.arange(size)
    while len(a):
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        least = least[least]
        if (least == before).all():
            break
    return least


def short_lists(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of many short lists side by side; list i is values[first[i]:first[i + 1]]."""
    end = np.repeat(first[1:], np.diff(first))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    at, gap = np.arange(len(values)), 1
    while len(at := at[at + gap < end[at]]):
        near = at[retained(values[at], values[at + gap])]
        pairs.append((near, near + gap))
        gap += 1
    a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in range(2))
    least = forest(len(values), a, b)
    of = np.flatnonzero(least != np.arange(len(values)))
    return values[least[of]], values[of]


def long_list(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one list: reaches out from a member to the ones not yet reached."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    rest = values
    while len(rest):
        reach, rest = [rest[0]], rest[1:]
        while reach and len(rest):
            one = reach.pop()
            near = retained(rest, one)
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), one), found))
                reach.extend(found)
                rest = rest[~near]
    return tuple(np.concatenate([o[i] for o in out]) if out else values[:0] for i in range(2))


def candidate_links(spark: SparkSession, fps: DataFrame, level: int, longest: int = LONGEST) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that connect every two of at most 4 differing bits."""
    now = written(spark, postings(fps, level), "postings")
    kept: list[DataFrame] = []
    while True:
        # the end of a path is never split; one row a frequent list, and there are at most entries / longest
        ends = F.bit_count("path") == 2 * SHARED
        frequent = now.where(~ends).groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > longest).select("path", "key")
        frequent = written(spark, frequent, "frequent")
        if frequent.isEmpty():
            kept.append(now)
            break
        kept.append(now.join(frequent, ["path", "key"], "left_anti"))
        now = written(spark, split(now.join(frequent, ["path", "key"], "left_semi")), "postings")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members = b.column("members")
            values, first = members.values.to_numpy(zero_copy_only=False).view(np.uint64), members.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.diff(first)
            found = []
            some = np.flatnonzero((size > 1) & (size <= SHORT))
            if len(some):
                at = np.arange(int(size[some].sum())) - np.repeat(np.cumsum(size[some]) - size[some], size[some]) + np.repeat(first[some], size[some])
                found.append(short_lists(values[at], np.r_[0, np.cumsum(size[some])]))
            found += [long_list(values[first[i] : first[i + 1]]) for i in np.flatnonzero(size > SHORT).tolist()]
            a, c = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64) for i in range(2))
            pairs = np.unique(np.stack([np.minimum(a, c), np.maximum(a, c)], axis=1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    entries = kept[0]
    for k in kept[1:]:
        entries = entries.unionByName(k)
    lists = entries.groupBy("path", "key").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    found = written(spark, lists.select("members").mapInArrow(links, "a long, b long").distinct(), "links")
    drop(entries)
    return found


def near_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp (signed 64 bits), component_id (smallest doc_id reachable over links)."""
    rows = written(spark, fingerprints(docs), "fingerprints")
    fps = written(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    links = candidate_links(spark, fps.select("fp"), start_level(fps.count()))
    roots = components(spark, links)
    # only fingerprints with a link look for others; the smallest of a component goes back to them through the hot-key join
    linked = written(spark, fps.join(roots, fps.fp == roots.node).select("fp", "least", "n", "root"), "linked")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    found = join_hot(linked.select("fp", "root"), of_root, "root", "members").select("fp", "component_id")
    known = fps.join(found.withColumn("linked", F.lit(True)), "fp", "left").select("fp", "n", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return join_hot(rows, written(spark, known, "components"), "fp", "n").select("doc_id", "fp", "component_id")
