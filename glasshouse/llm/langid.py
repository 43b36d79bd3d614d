"""Language identification with a linear-chain conditional random field over words.

Each word has affix features (its first and last one to three bytes), byte n-grams and itself as a
lexicon entry, all hashed into one weight table; labels of neighbouring words are tied by learned
transitions.  Forward-backward gives every word the probability of each language, so code-switched
text is labelled word by word; a document's score for a language is the mean over its words.
A document is one chain.  It is computed in pieces of PIECE words side by side: the product of each piece's transfer matrices
carries the state over its boundaries in both directions, so the result is that of the uncut chain.

The model is fitted on a bounded sample of labelled rows: at most `per_label` documents of each of MOST_LABELS
labels (more are an error), in the order of a hash of the identifier; repeated rows of an identifier are rows like others.  Whole texts are used, in runs of PIECE words; runs from documents of
different languages are spliced so that switching is learned.

Nulls: a null or empty text, or one without a letter, is `und` with score 0; rows with a null label are
never learned from.  Of labels that score alike the first in order wins.  Long texts are read whole.  With no label to learn at all every document is `und`.  Repeated rows get equal values.
Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glasshouse.llm.common import ASCII_LOWER, buffers, mix, steps, strings, word_spans

PIECE = 32
BITS = 17
PER_LABEL, MOST_LABELS = 250, 64  # bounds of what is fitted on: documents of a label, and labels
CELLS = 4 << 20  # numbers in the transfer matrices that exist at once
STEP = 1 << 18  # bytes of text labelled at once; a longer text is one step
UNKNOWN = "und"
_KINDS = 9  # word, 3 prefixes, 3 suffixes, bigrams, trigrams


def _slot(values: np.ndarray, kind: int) -> np.ndarray:
    return (mix(values * np.uint64(_KINDS) + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Pairs of (table slots, number of the word that each belongs to, or None if one for each word in order)."""
    low = ASCII_LOWER[raw].astype(np.uint64)
    size = stops - starts
    begin = np.cumsum(size) - size
    word = np.repeat(np.arange(len(starts)), size)
    within = np.arange(int(size.sum())) - begin[word]
    at = starts[word] + within
    taken = low[at]
    total = np.add.reduceat(mix(taken + np.uint64(257) * within.astype(np.uint64)), begin)
    yield _slot(total, 0), None
    for n in (1, 2, 3):
        head = np.zeros(len(starts), dtype=np.uint64)
        tail = head.copy()
        for j in range(n):
            head = head * np.uint64(257) + low[np.minimum(starts + j, stops - 1)] + np.uint64(1)
            tail = tail * np.uint64(257) + low[np.maximum(stops - 1 - j, starts)] + np.uint64(1)
        yield _slot(head, n), None
        yield _slot(tail, 3 + n), None
    pair = taken[:-1] * np.uint64(257) + taken[1:]
    inside = np.flatnonzero(within[1:] > 0)
    yield _slot(pair[inside], 7), word[inside]
    triple = pair[:-1] * np.uint64(257) + taken[2:]
    inside = np.flatnonzero(within[2:] > 1)
    yield _slot(triple[inside], 8), word[inside]


def emissions(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores of each word for each label.  N-gram scores are averaged over the word."""
    out = np.zeros((len(starts), weights.shape[1]), dtype=np.float32)
    if not len(starts):
        return out
    for slot, word in word_features(raw, starts, stops):
        if word is None:
            out += weights[slot]
        elif len(word):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[first, len(word)])
            out[word[first]] += np.add.reduceat(weights[slot], first, axis=0) / count[:, None].astype(np.float32)
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of padded chains (chain, place, label), the expected transitions, and the log of all partition sums.

    `enter` and `leave` are what comes over the boundaries of a chain that is a piece of a longer one: uniform and one if it is not."""
    n, t, k = scores.shape
    real = np.arange(t)[None, :] < lengths[:, None]
    top = scores.max(axis=2, keepdims=True)
    local = np.exp(scores - top)
    trans = np.exp(moves)
    alpha, norm = np.empty_like(local), np.ones((n, t), dtype=np.float64)
    now = local[:, 0] / k if enter is None else local[:, 0] * enter
    for i in range(t):
        if i:
            now = np.where(real[:, i, None], (alpha[:, i - 1] @ trans) * local[:, i], alpha[:, i - 1])
        s = now.sum(axis=1)
        norm[:, i] = np.where(real[:, i], s, 1)
        alpha[:, i] = now / s[:, None]
        now = alpha[:, i]
    beta = np.ones((n, k), dtype=local.dtype) if leave is None else leave
    marginal = np.empty_like(local)
    pairs = np.zeros((k, k))
    for i in range(t - 1, -1, -1):
        m = alpha[:, i] * beta
        marginal[:, i] = m / m.sum(axis=1, keepdims=True)
        if i:
            ahead = local[:, i] * beta
            use = real[:, i]
            joint = alpha[use, i - 1].T @ (ahead[use] / norm[use, i, None])
            pairs += joint * trans
            beta = np.where(use[:, None], (ahead @ trans.T) / norm[:, i, None], beta)
    marginal *= real[:, :, None]
    return marginal, pairs, float(np.log(norm)[real].sum() + top[:, :, 0][real].sum())


def products(scores: np.ndarray, begin: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The product of each piece's transfer matrices, scaled."""
    k = scores.shape[1]
    part = padded(scores, begin, lengths, PIECE)
    local = np.exp(part - part.max(axis=2, keepdims=True))
    now = np.eye(k, dtype=np.float32)[None] * local[:, 0, None, :]
    for i in range(1, PIECE):
        then = (now.reshape(-1, k) @ trans).reshape(now.shape) * local[:, i, None, :]
        done = i >= lengths
        if done.any():
            then[done] = now[done]
        now = then
        if i % 4 == 3:
            now /= now.max(axis=(1, 2), keepdims=True)
    return now


def boundaries(scores: np.ndarray, begin: np.ndarray, lengths: np.ndarray, text: np.ndarray, moves: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """What comes over both boundaries of each piece (begin, lengths, text that it is of) of chains that are whole texts.

    Products (labels x labels a piece) exist for one chunk of pieces at a time, at most `cells` numbers of them; what goes over a chunk's ends is one
    vector.  If there are several chunks their products are computed again on the way back."""
    n, k = len(begin), scores.shape[1]
    enter, leave = np.full((n, k), 1 / k), np.ones((n, k))
    if not n or not (text[1:] == text[:-1]).any():
        return enter, leave
    trans = np.exp(moves.astype(np.float64))
    unit = lambda v: v / v.sum(axis=-1, keepdims=True)
    size = max(16, cells // (k * k))
    chunks = [(a, min(a + size, n)) for a in range(0, n, size)]

    def runs(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """First piece and number of pieces of each text's run in the chunk, longest first: those with a next piece are a prefix."""
        first = np.flatnonzero(np.r_[True, text[a + 1 : b] != text[a : b - 1]]) + a
        count = np.diff(np.r_[first, b])
        order = np.argsort(-count, kind="stable")
        return first[order], count[order]

    product = None
    for a, b in chunks:
        if a and text[a] == text[a - 1]:
            enter[a] = unit(enter[a - 1] @ product[-1] @ trans)
        product = products(scores, begin[a:b], lengths[a:b], trans.astype(np.float32))
        start, count = runs(a, b)
        for r in range(1, int(count[0])):
            at = start[: int(np.searchsorted(-count, -r))] + r
            enter[at] = unit(np.einsum("nk,nkj->nj", enter[at - 1], product[at - 1 - a]) @ trans)
    for c in range(len(chunks) - 1, -1, -1):
        a, b = chunks[c]
        if c < len(chunks) - 1:
            if text[b] == text[b - 1]:
                leave[b - 1] = unit((product[0] @ leave[b]) @ trans.T)
            product = products(scores, begin[a:b], lengths[a:b], trans.astype(np.float32))
        start, count = runs(a, b)
        last = start + count - 1
        for r in range(1, int(count[0])):
            at = last[: int(np.searchsorted(-count, -r))] - r
            leave[at] = unit(np.einsum("nkj,nj->nk", product[at + 1 - a], leave[at + 1]) @ trans.T)
    return enter, leave


def pieces_of(first: np.ndarray, length: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of the pieces, in order; pieces do not cross texts."""
    count = np.diff(first)
    pieces = -(-count // length)
    text = np.repeat(np.arange(len(count)), pieces)
    place = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[:-1][text] + place * length
    return begin, np.minimum(length, first[1:][text] - begin), text


def padded(values: np.ndarray, begin: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    at = np.minimum(begin[:, None] + np.arange(width)[None, :], max(len(values) - 1, 0))
    return values[at]


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, moves: np.ndarray):
        self.labels, self.weights, self.moves = labels, weights, moves

    def word_probabilities(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each label for every word, and each text's first word."""
        raw, offsets = buffers(texts)
        starts, stops, first = word_spans(raw, offsets)
        scores = emissions(raw, starts, stops, self.weights)
        out = np.zeros_like(scores)
        begin, lengths, text = pieces_of(first)
        enter, leave = boundaries(scores, begin, lengths, text, self.moves)
        for a in range(0, len(begin), 1 << 14):
            b, n = begin[a : a + (1 << 14)], lengths[a : a + (1 << 14)]
            marginal, _, _ = forward_backward(padded(scores, b, n, PIECE), n, self.moves, enter[a : a + (1 << 14)], leave[a : a + (1 << 14)])
            real = np.arange(PIECE)[None, :] < n[:, None]
            out[(b[:, None] + np.arange(PIECE))[real]] = marginal[real]
        return out, first

    def predict(self, texts: pa.LargeStringArray) -> tuple[list[str], list[float]]:
        probabilities, first = self.word_probabilities(texts)
        labels, scores = [], []
        for text, a, b in zip(texts.to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            if a == b or not self.labels or not any(map(str.isalpha, text)):
                labels.append(UNKNOWN)
                scores.append(0.0)
                continue
            mean = probabilities[a:b].mean(axis=0, dtype=np.float64)
            k = int(mean.argmax())
            labels.append(self.labels[k])
            scores.append(float(min(1.0, max(0.0, mean[k]))))
        return labels, scores


def fit(texts: list[str], langs: list[str], rounds: int = 6, batch: int = 512, rate: float = 0.08, decay: float = 1e-6, seed: int = 7) -> Model:
    """Gradient ascent (Adam) on the likelihood of chains; some chains are spliced from two documents."""
    labels = sorted(set(langs))
    k = len(labels)
    weights, moves = np.zeros((1 << BITS, k), dtype=np.float32), np.zeros((k, k), dtype=np.float32)
    if not labels:
        return Model([], np.zeros((1 << BITS, 1), dtype=np.float32), np.zeros((1, 1), dtype=np.float32))
    arr = pa.array(texts, pa.large_string())
    raw, offsets = buffers(arr)
    starts, stops, first = word_spans(raw, offsets)
    gold = np.repeat(np.array([labels.index(x) for x in langs]), np.diff(first))
    draw = np.random.default_rng(seed)
    begin, lengths, _ = pieces_of(first)
    order = draw.permutation(len(begin))
    # every fourth chain takes the second half of another chain
    words, sizes = [], []
    for n, c in enumerate(order):
        own = np.arange(begin[c], begin[c] + lengths[c])
        if n % 4 == 3:
            other = order[n - 1]
            own = np.concatenate([own[: len(own) // 2 + 1], np.arange(begin[other] + lengths[other] // 2, begin[other] + lengths[other])])[:PIECE]
        words.append(own)
        sizes.append(len(own))
    moment = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    step = 0
    for _ in range(rounds):
        for a in range(0, len(words), batch):
            pick, n = words[a : a + batch], np.array(sizes[a : a + batch])
            flat = np.concatenate(pick)
            scores = emissions(raw, starts[flat], stops[flat], weights)
            at = np.cumsum(n) - n
            marginal, pairs, _ = forward_backward(padded(scores, at, n, PIECE), n, moves)
            real = np.arange(PIECE)[None, :] < n[:, None]
            error = -marginal[real]
            y = gold[flat]
            error[np.arange(len(flat)), y] += 1
            slope = np.zeros_like(weights)
            for slot, word in word_features(raw, starts[flat], stops[flat]):
                part = error if word is None else error[word] / np.bincount(word, minlength=len(flat))[word][:, None]
                for j in range(k):
                    slope[:, j] += np.bincount(slot, weights=part[:, j], minlength=1 << BITS).astype(np.float32)
            inner = np.ones(len(flat), dtype=bool)
            inner[at] = False
            to = np.flatnonzero(inner)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[to - 1], y[to]), 1)
            step += 1
            for value, grad, m, v in ((weights, slope / len(flat) - decay * weights, *moment[:2]), (moves, ((seen - pairs) / len(flat)).astype(np.float32), *moment[2:])):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    return Model(labels, weights, moves)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def train(spark: SparkSession, docs: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Fits on at most `per_label` rows of each label that are not held out; rows equal in identifier, label and text count once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    if rows.select("lang").distinct().count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "mark"))
    # rows without their texts first: each task keeps at most per_label of a label before they meet
    marked = rows.where(F.col("text").isNotNull()).withColumn("mark", F.xxhash64("text"))
    chosen = marked.select("doc_id", "lang", "mark").distinct().withColumn("place", place).where(F.col("place") <= per_label).select("doc_id", "lang", "mark")
    texts = marked.join(F.broadcast(chosen), ["doc_id", "lang", "mark"]).groupBy("doc_id", "lang", "mark").agg(F.first("text").alias("text"))
    sample = texts.orderBy("lang", F.xxhash64("doc_id"), "doc_id", "mark").collect()  # per_label rows a label
    return fit([r.text for r in sample], [r.lang for r in sample])


def identify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each document, from its text alone."""
    shared = spark.sparkContext.broadcast(model)  # 2**BITS weights a label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", STEP):
            labels, scores = shared.value.predict(strings(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(spark: SparkSession, docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents with a language: not `und`, and a score of `least` or more (that of evenly mixed text in four languages is below).  All columns pass unchanged."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", STEP):
            labels, scores = shared.value.predict(strings(b.column("text")))
            yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(labels, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
