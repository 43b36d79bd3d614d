"""Questions from blocks of documents to shards of a key space, and the answers back.

A block is a set of documents (by a hash of identifier and text) of about BLOCK_BYTES of text.  It sorts its
keys, drops repeats and sends one packed row to each shard that it has keys for; the shard answers one bit for each key, in
the same order.  A block's work follows its keys, not the number of shards.  So a hot key crosses the network once for each block, however many rows hold it,
and no table of all keys is ever broadcast.  The text is shuffled into blocks once; Spark reuses that
exchange in every round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glasshouse.llm.common import BLOCK_BYTES, LANES, mix, partitions, text_bytes

QUESTIONS = "phase int, shard int, block int, entries binary"
#: Bytes of text for each shard of the key space, and the least for a block or shard of a small input.
SHARD_BYTES, LEAST_BYTES = 64 << 20, 1 << 20
ANSWERS = "phase int, shard int, block int, bits binary"


def blocked(spark: SparkSession, docs: DataFrame, carry: bool = False) -> tuple[DataFrame, int, int]:
    """(doc_id, text, block), with the other columns as a struct `carry` if asked for; the bytes of text; the number of shards."""
    total = text_bytes(docs)
    # blocks and shards follow the bytes; small inputs are spread over the partitions, but no thinner than LEAST_BYTES
    count = int(max(total // BLOCK_BYTES + 1, min(2 * partitions(spark), total // LEAST_BYTES + 1)))
    shards = 1 << int(max(total // SHARD_BYTES + 1, min(partitions(spark), total // LEAST_BYTES + 1)) - 1).bit_length()  # a power of two: a shard is a key's leading bits
    others = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("carry")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int")), total, shards


def pack_sorted(keys: np.ndarray, many: np.ndarray) -> bytes:
    """Sorted distinct keys below 2**62 with a flag each: differences, by byte planes, compressed."""
    step = np.diff(keys, prepend=np.uint64(0)) << np.uint64(1) | many.astype(np.uint64)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    step = np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)
    return np.cumsum(step >> np.uint64(1), dtype=np.uint64), (step & np.uint64(1)).astype(bool)


def distinct_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and which occur twice or more."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)]) > 1


def shard_runs(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """Each shard that occurs among sorted shard numbers, with the begin and end of its run."""
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
    return list(zip(shard[first].tolist(), first.tolist(), np.r_[first[1:], len(shard)].tolist() if len(first) else [], strict=True))


def cut_runs(cuts: np.ndarray) -> list[tuple[int, int, int]]:
    """The shards that are not empty, from where each begins and the last ends."""
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    return list(zip(some.tolist(), cuts[some].tolist(), cuts[some + 1].tolist(), strict=True))


def leading_runs(keys: np.ndarray, shards: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """The shards of sorted keys of `bits` bits, by their leading bits: looks for the shards among the keys, or for the keys' shards if there are fewer keys."""
    rest = np.uint64(bits - (shards.bit_length() - 1))
    if shards == 1:
        return [(0, 0, len(keys))] if len(keys) else []
    if len(keys) < shards:
        return shard_runs((keys >> rest).astype(np.int64))
    return cut_runs(np.r_[np.searchsorted(keys, np.arange(shards, dtype=np.uint64) << rest), len(keys)])


# --- first rounds: a count-min sketch, kept as its touched cells, sharded by cell ---


class Sketch:
    """Rows of 2**bits counters.  A block holds only the cells that it touched; a shard adds up a range of cells."""

    def __init__(self, total: int, shards: int, depth: int = 2, least_bits: int = 16):
        self.bits, self.shards, self.depth = max(least_bits, int(total).bit_length(), shards.bit_length()), shards, depth

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        return mix(keys + LANES[row % 2] + np.uint64(row)) >> np.uint64(64 - self.bits)

    def runs(self, cells: np.ndarray) -> list[tuple[int, int, int]]:
        """The shards of sorted cells."""
        return leading_runs(cells, self.shards, self.bits)

    def questions(self, block: int, keys: np.ndarray) -> pa.Table:
        rows: list[tuple] = []
        for row in range(self.depth):
            cells, many = distinct_counts(self.cells(keys, row))
            rows += [(row, s, block, pack_sorted(cells[a:b], many[a:b])) for s, a, b in self.runs(cells)]
        return table(rows, QUESTIONS)

    def repeated(self, keys: np.ndarray, answers: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Which keys have an estimate of two or more: never false for a key that does repeat."""
        out = np.ones(len(keys), dtype=bool)
        for row in range(self.depth):
            mine = self.cells(keys, row)
            order = np.argsort(mine)  # cheaper than a binary search for every key
            ordered = mine[order]
            new = np.r_[True, ordered[1:] != ordered[:-1]] if len(order) else np.zeros(0, dtype=bool)
            flags = answered(self.runs(ordered[new]), row, answers)
            out[order] &= flags[np.cumsum(new) - 1] if len(order) else flags
        return out


def merge_sketch(questions: pa.Table) -> pa.Table:
    """Adds up one shard of one row; answers which cells count two or more."""
    asked = [unpack_sorted(x) for x in questions.column("entries").to_pylist()]
    cells = np.concatenate([np.concatenate([c, c[m]]) for c, m in asked])
    known, many = distinct_counts(cells)
    twice = known[many]
    return replies(questions, [member(c, twice) for c, _ in asked])


# --- later rounds: exact records ---


def merge_least(questions: pa.Table) -> pa.Table:
    """Entries are records of two key lanes and a value; answers whether the key's least value anywhere is below the record's."""
    asked = [np.frombuffer(x, dtype=np.uint64).reshape(3, -1) for x in questions.column("entries").to_pylist()]
    one, two, value = (np.concatenate([a[i] for a in asked]) for i in range(3))
    value = value.view(np.int64)
    order = np.lexsort((value, two, one))
    first = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])] if len(order) else np.zeros(0, bool)
    least = value[order][np.flatnonzero(first)][np.cumsum(first) - 1] if len(order) else value
    below = np.zeros(len(order), dtype=bool)
    below[order] = least < value[order]
    return replies(questions, np.split(below, np.cumsum([a.shape[1] for a in asked])[:-1]))


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def replies(questions: pa.Table, bits: list[np.ndarray]) -> pa.Table:
    return pa.table({"phase": questions.column("phase"), "shard": questions.column("shard"), "block": questions.column("block"), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})


def answered(runs: list[tuple[int, int, int]], phase: int, answers: dict[tuple[int, int], bytes]) -> np.ndarray:
    """One flag for each key that was asked, in the order asked."""
    parts = [np.unpackbits(np.frombuffer(answers[phase, s], dtype=np.uint8), count=b - a).astype(bool) for s, a, b in runs]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)


def table(rows: list[tuple], schema: str) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def answer_map(answers: pa.Table) -> dict[tuple[int, int], bytes]:
    return dict(zip(zip(answers.column("phase").to_pylist(), answers.column("shard").to_pylist(), strict=True), answers.column("bits").to_pylist(), strict=True))


def ask(blocks: DataFrame, answers: DataFrame | None, questions: Callable[[int, pa.Table, dict], pa.Table]) -> DataFrame:
    """One round of questions; `questions(block, rows, answers so far)`."""
    return per_block(blocks, answers, questions, QUESTIONS)


def per_block(blocks: DataFrame, answers: DataFrame | None, work: Callable[[int, pa.Table, dict], pa.Table], schema: str | StructType) -> DataFrame:
    if answers is None:
        return blocks.groupBy("block").applyInArrow(lambda rows: work(rows.column("block")[0].as_py(), rows, {}), schema)

    def both(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in _empty(schema)})
        return work(rows.column("block")[0].as_py(), rows, answer_map(found))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(both, schema)


def _empty(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def answer(questions: DataFrame, merge: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return questions.groupBy("phase", "shard").applyInArrow(merge, ANSWERS)
