"""Sequence packing by patterns fitted with non-negative least squares (after Krell et al., 2021).

Documents become token ids and an end mark; longer ones are cut so that only the first piece may be
short.  The histogram of piece lengths has at most `size` entries whatever the input, so it is the one
thing that reaches the driver.  There, patterns of up to three lengths that fill a sequence exactly are
enumerated, their repeat counts fitted to the histogram by non-negative least squares and rounded, and
what is left over is packed best-fit, longest first, in bulk by length.  Pieces then take places by
their rank within their length; ranks come from salted chunks and prefix sums, so a hot length is not
ranked in one task.

Nulls: a null text is empty (just the end mark); a null doc_id stays null.  Repeated rows are packed
each on their own.  Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glasshouse.llm.common import partitions, steps, strings, written

SIZE = 2048
END = 0
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level vocabulary file as a rank encoder; its ids are the ranks of its merges."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {x["content"]: x["id"] for x in data["added_tokens"]}
    of = byte_alphabet()
    ranks = {bytes(of[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
    for i, merge in enumerate(data["model"]["merges"]):
        pair = merge.split(" ") if isinstance(merge, str) else merge
        if data["model"]["vocab"]["".join(pair)] != 256 + i:
            raise ValueError("the vocabulary's ids are not in the order of its merges")
    from public_tokenizers import PATTERN

    enc = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return enc, tuple(special)


def token_ids(text: str, path: str) -> np.ndarray:
    enc, special = encoder(path)
    if any(s in text for s in special):  # their strings in a text are special tokens
        return np.array(enc.encode(text, allowed_special="all"), dtype="<u4")
    return enc.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


CHUNK_ROWS = 50_000  # pieces of one length that one chunk ranks, on average


def piece_starts(n: int, size: int) -> list[int]:
    """Where the pieces of n tokens begin: whole pieces last, the first takes what is over."""
    first = n % size or size
    return [0, *range(first, n, size)]


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), strings(b.column("text")).to_pylist(), strict=True):
                ids = np.append(token_ids(text, path), np.uint32(end)).astype("<u4")
                cuts = [*piece_starts(len(ids), size), len(ids)]
                rows += [(doc, k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _PIECES)


# --- the plan, on the histogram alone ---


def full_patterns(present: np.ndarray, size: int) -> np.ndarray:
    """Every one, two or three lengths that occur and together fill a sequence: rows (a, b, c), a >= b >= c, 0 for none."""
    have = np.zeros(size + 1, dtype=bool)
    have[present] = True
    out = [np.array([[size, 0, 0]])] if have[size] else []
    for a in present[::-1]:
        rest = size - int(a)
        if not 0 < rest:
            continue
        if rest <= a and have[rest]:
            out.append(np.array([[a, rest, 0]]))
        b = present[(present <= a) & (present * 2 >= rest) & (present < rest)]
        b = b[have[rest - b]]
        out.append(np.stack([np.full(len(b), a), b, rest - b], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative x that brings the patterns' use of each length near the histogram: accelerated projected gradient."""
    size = len(histogram) - 1
    real = patterns > 0
    weight = np.sqrt(np.arange(size + 1) / size)  # long pieces are the hard ones to place later
    weight[0] = 0

    def use(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns.ravel(), weights=(x[:, None] * real).ravel(), minlength=size + 1)

    # the largest eigenvalue of A'A, by the power method
    v = np.ones(len(patterns))
    for _ in range(20):
        v = ((weight**2 * use(v))[patterns] * real).sum(1)
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        slope = ((weight**2 * (use(y) - histogram))[patterns] * real).sum(1)
        new = np.maximum(0, y - slope / (top * 1.05))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def best_fit(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: patterns with their repeats."""
    size = len(histogram) - 1
    open_: list[list] = [[] for _ in range(size + 1)]  # by space left: [pattern, count]
    full = np.zeros(size + 1, dtype=np.int64)
    for length in np.flatnonzero(histogram)[::-1].tolist():
        left = int(histogram[length])
        while left:
            fits = np.flatnonzero(full[length:])
            if len(fits):
                space = length + int(fits[0])
                pattern, count = open_[space].pop()
                full[space] -= count
            else:
                space, pattern, count = size, (), left
            each = min(space // length, left)
            bins = min(count, left // each)
            if bins < count and pattern:
                open_[space].append([pattern, count - bins])
                full[space] += count - bins
            open_[space - each * length].append([(*pattern, *[length] * each), bins])
            full[space - each * length] += bins
            left -= bins * each
    return [(tuple(p), n) for group in open_ for p, n in group]


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeats that use the histogram (index: length) up exactly.

    Fitted counts are rounded to the nearest, but to one at least, and taken in falling order as far as the histogram goes: each pattern fills its sequences
    to the end, so what is rounded up costs nothing.  Best fit packs what is left; where it would need fewer sequences for all pieces, it packs them all."""
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    patterns = full_patterns(np.flatnonzero(histogram), size)
    out: list[tuple[tuple[int, ...], int]] = []
    if len(patterns):
        x = fit_counts(patterns, left.astype(float))
        some = np.flatnonzero(x > 0)
        for k in some[np.argsort(-x[some], kind="stable")].tolist():
            lengths = [v for v in patterns[k].tolist() if v]
            n = min(max(1, round(x[k])), *(int(left[v]) // lengths.count(v) for v in lengths))
            if n > 0:
                out.append((tuple(lengths), n))
                for v in lengths:
                    left[v] -= n
    whole, alone = out + best_fit(left), best_fit(histogram.astype(np.int64))
    return min(whole, alone, key=lambda packed: sum(n for _, n in packed))  # of equal ones the fitted


def slots(packed: list[tuple[tuple[int, ...], int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the pieces of each length, by rank: key (length << 40 | first rank), first sequence, offset; at most one row a place of a pattern."""
    used = [0] * (size + 1)
    rows, sequence = [], 0
    for lengths, n in packed:
        offset = 0
        for v in lengths:
            rows.append((v << 40 | used[v], sequence, offset))
            used[v] += n
            offset += v
        sequence += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()


def pack(spark: SparkSession, docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(spark, pieces(docs, path, size, end), "pieces")
    histogram = np.zeros(size + 1, dtype=np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most `size` rows
        histogram[length] = n
    keys, sequences, offsets = slots(plan(histogram), size)
    shared = spark.sparkContext.broadcast((keys, sequences, offsets))  # bounded by the number of patterns for `size`

    # the more pieces a length has, the more chunks it is ranked in
    chunks = F.array(*[F.lit(max(16, partitions(spark), -(-int(n) // CHUNK_ROWS))) for n in histogram])
    rows = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.element_at(chunks, F.col("length").cast("int") + 1).cast("long")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = rows.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")).select("length", "chunk", before.alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("inside", inside).join(ahead, ["length", "chunk"]).withColumn("rank", F.col("ahead") + F.col("inside"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = shared.value
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            key = length << 40 | b.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, key, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(place, f"{_PIECES}, sequence_id long, offset long")
