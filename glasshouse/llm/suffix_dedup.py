"""Removal of byte strings that occur twice, by a sparse suffix array built over range-partitioned buckets.

Every string of LENGTH bytes is tied to an anchor: the least hashed 8-byte token among its first SPREAD
tokens, leftmost of equals.  Equal strings have equal anchors, so whole runs of string starts share one, and
only what follows a repeated anchor needs sorting.

1. Anchors: a sharded sketch of the bytes after each anchor leaves the ones that may repeat.
2. Contexts: of those, the suffix that spans a whole run of starts is looked up.  If all runs with
   the same bytes after the anchor have the same context, that settles the run.
3. Suffixes: the other runs send the suffix of every start.

Suffix records are a leading token (the first 8 bytes, big-endian) and a 128-bit fingerprint of the bytes that
are compared.  Splitters sampled from the documents deal records to buckets by their leading tokens, ties by the fingerprint, so a
frequent token is shared between buckets while equal suffixes meet in one: no equal pair straddles a boundary.
A bucket sorts by multikey quicksort (leading token first, then only ties by what follows) and compares neighbours.
A block sends equal suffixes once, so a passage in a third of all rows costs a bucket one record a block.

Nulls: a null text is empty; a null doc_id stays null.  Rows that repeat a text are two places: both are removed.
Texts below LENGTH bytes lose nothing.  Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasshouse.llm.common import LANES, buffers, mix, steps, strings
from glasshouse.llm.exchange import QUESTIONS, Sketch, answer, answered, ask, blocked, cut_runs, leading_runs, member, merge_sketch, per_block, replies, shard_runs, table

LENGTH = 200
SPREAD = 64
CORE = LENGTH - SPREAD + 1  # bytes from an anchor on that every string tied to it contains
CHUNK = 1 << 16  # bytes of text that are worked on at a time: what is derived from them stays in a processor's cache
SAMPLE_BYTES, BUCKET_SAMPLE = 8 << 20, 8 << 10  # sampled text for the splitters: at least, and for each bucket (16 suffixes)
CONTEXT, GROUP, SUFFIX = 10, 11, 12  # phases of the questions after the sketch
_INVERSE = tuple(np.uint64(pow(int(m), -1, 1 << 64)) for m in LANES)
_powers: dict[int, tuple[np.ndarray, ...]] = {}


def powers(n: int) -> tuple[np.ndarray, ...]:
    """Powers of both multipliers and of their inverses, n of each at least."""
    if 0 not in _powers or len(_powers[0][0]) < n:
        size = max(n + n // 4, 2 * CHUNK)
        _powers[0] = tuple(np.r_[np.uint64(1), np.cumprod(np.full(size - 1, m, dtype=np.uint64))] for m in (*LANES, *_INVERSE))
    return _powers[0]


class Chunk:
    """Tokens and prefix fingerprints of the bytes of some texts."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        full = np.concatenate([raw, np.zeros(16 + -n % 8, dtype=np.uint8)])
        token = np.empty(n + 8 - n % 8, dtype=np.uint64)
        for j in range(8):
            token[j::8] = full[j : j + len(token)].view("<u8")[: len(token[j::8])]
        self.token = token[:n]
        self.gram = mix(self.token)
        one, two, self.back_one, self.back_two = powers(n + 1)
        self.sums = tuple(np.r_[np.uint64(0), np.cumsum(self.gram * p[:n], dtype=np.uint64)] for p in (one, two))

    def runs(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First start, last start and anchor of every run."""
        least = (self.gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(self.gram), dtype=np.uint64)
        width = 1
        while width < SPREAD:
            least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
            width *= 2
        starts = np.maximum(0, np.diff(offsets) - LENGTH + 1)
        at = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(offsets[:-1], starts)
        anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(at) else np.zeros(0, np.int64)
        return at[first], at[np.r_[first[1:], len(at)] - 1] if len(at) else at, anchor[first]

    def fingerprints(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for the bytes from start to stop, of 8 bytes or more."""
        return tuple(mix((s[stop - 7] - s[start]) * back[start]) for s, back in zip(self.sums, (self.back_one, self.back_two), strict=True))

    def leading(self, at: np.ndarray) -> np.ndarray:
        return self.token[at].byteswap()

    def cores(self, anchor: np.ndarray) -> np.ndarray:
        """The key of the bytes after each anchor."""
        return self.fingerprints(anchor, anchor + CORE)[0]

    def suffixes(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, leading token and fingerprint of every string that starts from begin to end."""
        size = end - begin + 1
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        return at, self.leading(at), *self.fingerprints(at, at + LENGTH)


def chunks(texts: pa.LargeStringArray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes, offsets in them and place of some texts after the other, CHUNK bytes or one text at a time."""
    raw, offsets = buffers(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], int(offsets[at])
        at = end


def _joined(parts: list[tuple[np.ndarray, ...]], kinds: tuple) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds))


class Runs:
    """All runs of a block: places, the key of the bytes after the anchor, and the context's record."""

    def __init__(self, texts: pa.LargeStringArray):
        parts = []
        for raw, offsets, base in chunks(texts):
            c = Chunk(raw)
            begin, end, anchor = c.runs(offsets)
            one, two = c.fingerprints(begin, end + LENGTH)
            shape = mix(((end - begin) * (1 << 20) + (anchor - begin)).astype(np.uint64))
            parts.append((begin + base, end + base, c.cores(anchor), c.leading(begin), one + shape, two ^ shape))
        u, i = np.uint64, np.int64
        self.begin, self.end, self.core, self.token, self.one, self.two = _joined(parts, (i, i, u, u, u, u))


# --- records ---


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """Multikey quicksort: orders by the first key, then only what is equal so far by the next."""
    order = np.argsort(keys[0], kind="quicksort")
    same = np.zeros(len(order), dtype=bool)
    if len(order):
        same[1:] = keys[0][order][1:] == keys[0][order][:-1]
    for k in keys[1:]:
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        if not len(tied):
            break
        group = np.cumsum(~same)[tied]
        own = order[tied]
        inner = np.lexsort((k[own], group))
        order[tied] = own[inner]
        new = k[order]
        same[1:] &= new[1:] == new[:-1]
    return order


def distinct_records(token: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Order, the number of each ordered row's distinct record, and the records with a flag for those that occur twice or more."""
    order = multikey_order(token, one, two)
    t, a, b = token[order], one[order], two[order]
    new = np.r_[True, (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(t) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    return order, np.cumsum(new) - 1, (t[new], a[new], b[new], np.diff(np.r_[first, len(t)]) > 1)


def record_runs(token: np.ndarray, one: np.ndarray, splitters: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """The buckets of ordered records: a record's bucket is the number of splitters up to it."""
    if len(token) >= len(splitters[0]):
        low, high = np.searchsorted(token, splitters[0]), np.searchsorted(token, splitters[0], side="right")
        for i in np.flatnonzero(low < high).tolist():  # the token of a splitter: the fingerprint decides
            low[i] += np.searchsorted(one[low[i] : high[i]], splitters[1][i])
        return cut_runs(np.r_[0, low, len(token)])
    bucket, high = np.searchsorted(splitters[0], token), np.searchsorted(splitters[0], token, side="right")
    for i in np.flatnonzero(bucket < high).tolist():
        bucket[i] += np.searchsorted(splitters[1][bucket[i] : high[i]], one[i], side="right")
    return shard_runs(bucket)


def pack_records(token: np.ndarray, one: np.ndarray, two: np.ndarray, many: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(np.diff(token, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()
    head = zstandard.ZstdCompressor(level=1).compress(planes)
    return len(head).to_bytes(4, "little") + len(token).to_bytes(4, "little") + head + one.tobytes() + two.tobytes() + np.packbits(many).tobytes()


def unpack_records(data: bytes) -> tuple[np.ndarray, ...]:
    size, n = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]), dtype=np.uint8).reshape(8, n)
    token = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)
    rest = data[8 + size :]
    return token, np.frombuffer(rest[: 8 * n], np.uint64), np.frombuffer(rest[8 * n : 16 * n], np.uint64), np.unpackbits(np.frombuffer(rest[16 * n :], np.uint8), count=n).astype(bool)


def record_questions(phase: int, block: int, records: tuple[np.ndarray, ...], splitters: tuple) -> list[tuple]:
    return [(phase, s, block, pack_records(*(r[a:b] for r in records))) for s, a, b in record_runs(records[0], records[1], splitters)]


def merge_records(questions: pa.Table) -> pa.Table:
    """One bucket: sorts its suffixes, compares neighbours, answers which occur twice or more."""
    asked = [unpack_records(x) for x in questions.column("entries").to_pylist()]
    token, one, two, many = (np.concatenate([a[i] for a in asked]) for i in range(4))
    order, group, (_, _, _, twice) = distinct_records(token, one, two)
    twice = twice | np.logical_or.reduceat(many[order], np.flatnonzero(np.r_[True, group[1:] != group[:-1]])) if len(order) else twice
    out = np.zeros(len(order), dtype=bool)
    out[order] = twice[group]
    return replies(questions, np.split(out, np.cumsum([len(a[0]) for a in asked])[:-1]))


def core_groups(runs: Runs, take: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the taken runs: sorted distinct cores, one context of each, whether a core has others, and each run's core."""
    order = np.lexsort((runs.one[take], runs.core[take]))
    core, context = runs.core[take][order], runs.one[take][order]
    first = np.flatnonzero(np.r_[True, core[1:] != core[:-1]]) if len(core) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(core)][: len(first)] - 1
    return core[first], context[first], context[first] != context[last], np.searchsorted(core[first], runs.core[take])


def merge_groups(questions: pa.Table) -> pa.Table:
    """Answers which cores have more than one context."""
    asked = [(np.frombuffer(x[: len(x) // 17 * 16], np.uint64).reshape(2, -1), np.frombuffer(x[len(x) // 17 * 16 :], np.uint8)) for x in questions.column("entries").to_pylist()]
    core, context = (np.concatenate([a[0][i] for a in asked]) for i in range(2))
    several = np.concatenate([a[1] for a in asked]).astype(bool)
    order = np.lexsort((context, core))
    c, x = core[order], context[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    last = np.r_[first[1:], len(c)] - 1
    group = np.searchsorted(c[first], core)
    many = (x[first] != x[last]) | np.logical_or.reduceat(several[order], first)
    return replies(questions, np.split(many[group], np.cumsum([a[0].shape[1] for a in asked])[:-1]))


def merge(questions: pa.Table) -> pa.Table:
    return merge_groups(questions) if questions.column("phase")[0].as_py() == GROUP else merge_records(questions)


# --- the operator ---


def sampled_splitters(docs: DataFrame, total: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Splitters for `buckets` from the suffixes of a hash sample of documents (whole texts), which follows the number of buckets.

    Half of them divide all of the sample's suffixes, half the distinct ones at anchors that repeat within the sample:
    what follows a very frequent passage is rare among all suffixes and common among those that are sent."""
    rate = max(1, total // max(SAMPLE_BYTES, BUCKET_SAMPLE * buckets))
    texts = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rate)) == 0).select(F.col("text").cast("string").alias("text"))

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            for raw, offsets, _ in chunks(strings(b.column("text"))):
                c = Chunk(raw)
                yield pa.RecordBatch.from_arrays([pa.array(c.cores(c.runs(offsets)[2]).view(np.int64))], names=["core"])

    # bounded by the sample: an anchor for every 32 bytes at most
    found = texts.mapInArrow(cores, "core long").groupBy("core").count().where("count > 1").select("core").toArrow().column("core").combine_chunks()
    repeated = np.sort(found.to_numpy(zero_copy_only=False).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            for raw, offsets, _ in chunks(strings(b.column("text"))):
                c = Chunk(raw)
                begin, end, anchor = c.runs(offsets)
                again = member(c.cores(anchor), repeated)
                for sent, runs, one_in in ((False, np.arange(len(begin)), 512), (True, np.flatnonzero(again), 16)):
                    _, token, one, _ = c.suffixes(begin[runs], end[runs])
                    pick = mix(one) % np.uint64(one_in) == 0
                    yield pa.RecordBatch.from_arrays([pa.array(token[pick].view(np.int64)), pa.array(one[pick].view(np.int64)), pa.array(np.full(int(pick.sum()), sent))], names=["token", "one", "sent"])

    rows = texts.mapInArrow(run, "token long, one long, sent boolean").distinct().toArrow()
    token, one = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64) for c in ("token", "one"))
    sent = rows.column("sent").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    half = (buckets - 1) // 2
    parts = [_quantiles(token[~sent], one[~sent], buckets - 1 - half), _quantiles(token[sent], one[sent], half)]
    token, one = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.lexsort((one, token))
    return token[order], one[order]


def _quantiles(token: np.ndarray, one: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n records that divide the ordered records evenly; without records, n even places of the token's range."""
    if not len(token):
        edges = np.array([(i << 64) // (n + 1) for i in range(1, n + 1)], dtype=np.uint64)
        return edges, np.zeros_like(edges)
    order = np.lexsort((one, token))
    at = order[np.arange(1, n + 1) * len(order) // (n + 1)]
    return token[at], one[at]


def remove_repeats(spark: SparkSession, docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the remaining bytes and the removed spans."""
    blocks, total, shards = blocked(spark, docs)
    sketch = Sketch(total, shards, depth=1)
    splitters = sampled_splitters(docs, total, shards)

    def first(block: int, rows: pa.Table, _: dict) -> pa.Table:
        return sketch.questions(block, Runs(strings(rows.column("text"))).core)

    def candidates(texts: pa.LargeStringArray, answers: dict) -> tuple:
        runs = Runs(texts)
        take = np.flatnonzero(sketch.repeated(runs.core, answers))
        return runs, take, distinct_records(runs.token[take], runs.one[take], runs.two[take]), core_groups(runs, take)

    def second(block: int, rows: pa.Table, answers: dict) -> pa.Table:
        _, _, (_, _, records), (core, context, several, _) = candidates(strings(rows.column("text")), answers)
        asked = record_questions(CONTEXT, block, records, splitters)
        asked += [(GROUP, s, block, core[a:b].tobytes() + context[a:b].tobytes() + several[a:b].astype(np.uint8).tobytes()) for s, a, b in leading_runs(core, shards)]
        return table(asked, QUESTIONS)

    def open_suffixes(texts: pa.LargeStringArray, answers: dict) -> tuple:
        """What the contexts settle, and the suffixes of the other runs."""
        runs, take, (order, group, records), (core, _, _, of) = candidates(texts, answers)
        several = answered(leading_runs(core, shards), GROUP, answers)[of]
        twice = np.zeros(len(take), dtype=bool)
        twice[order] = answered(record_runs(records[0], records[1], splitters), CONTEXT, answers)[group]
        begin, end = runs.begin[take[several]], runs.end[take[several]]  # in the order of the texts
        parts, seen = [], 0
        for raw, _, base in chunks(texts):
            stop = int(np.searchsorted(begin, base + len(raw)))
            if seen < stop:
                at, token, one, two = Chunk(raw).suffixes(begin[seen:stop] - base, end[seen:stop] - base)
                parts.append((at + base, token, one, two))
            seen = stop
        settled = take[twice & ~several]
        return runs.begin[settled], runs.end[settled], _joined(parts, (np.int64, np.uint64, np.uint64, np.uint64))

    def third(block: int, rows: pa.Table, answers: dict) -> pa.Table:
        _, _, (_, token, one, two) = open_suffixes(strings(rows.column("text")), answers)
        return table(record_questions(SUFFIX, block, distinct_records(token, one, two)[2], splitters), QUESTIONS)

    def last(block: int, rows: pa.Table, answers: dict) -> pa.Table:
        texts = strings(rows.column("text"))
        raw, offsets = buffers(texts)
        begin, end, (at, token, one, two) = open_suffixes(texts, answers)
        order, group, records = distinct_records(token, one, two)
        hit = at[order][answered(record_runs(records[0], records[1], splitters), SUFFIX, answers)[group]] if len(at) else at
        cover = np.zeros(len(raw) + 1, dtype=np.int32)
        for where, step in ((begin, 1), (end + LENGTH, -1), (hit, 1), (hit + LENGTH, -1)):
            np.add.at(cover, where, step)
        gone = np.cumsum(cover[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        opens[offsets[:-1][offsets[:-1] < len(raw)]] = gone[offsets[:-1][offsets[:-1] < len(raw)]]
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            part = gone[a:b]
            kept = raw[a:b][~part].tobytes()
            for k, v in zip(out, (b - a, int(part.sum()), int(opens[a:b].sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table({"doc_id": rows.column("doc_id"), **{k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True) if k != "kept" or with_text}})

    one = answer(ask(blocks, None, first), merge_sketch)
    two = one.unionByName(answer(ask(blocks, one, second), merge))
    three = two.unionByName(answer(ask(blocks, two, third), merge))
    return per_block(blocks, three, last, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
