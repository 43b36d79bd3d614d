"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that stand side by side inside no vocabulary token can never end up in one token,
so the place between them is a certain cut.  Each word falls into fragments at its certain cuts; the
fragments are merged independently, remembered, and their ids concatenated.  The rules around the
merges are those of the vocabulary file: the word pattern, the word-end mark and special tokens, whose strings in a
text become their ids before anything else, are read from it; its normalisation (NFC, runs of white space to one space, lower
case) is written here, by Python's tables, and left to the tokenizers library for texts with characters that these do not assign.  Decoding joins the tokens as the file's decoder does:
without one, by one space.

Nulls: a null text is empty and has no tokens; a null doc_id stays null.  Repeated rows get equal values.
Empty table: empty result.  Other columns are ignored.  Whole texts are encoded, however long.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasshouse.llm.common import steps, strings
from glasshouse.llm.packing import byte_alphabet

#: Unicode white space, as the file's patterns mean \\s.
_BLANK = "\t-\r \x85\xa0  -     　"
#: Control characters that str.split() takes for white space and the patterns do not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Entries that a worker remembers before it starts again.
REMEMBERED = 300_000


@lru_cache(maxsize=1)
def _unassigned() -> re.Pattern:
    """The characters up to U+FFFF that Python's Unicode tables do not assign (a set of these is one bitmap; wider ones are searched range by range)."""
    none = [c for c in range(0x10000) if unicodedata.category(chr(c)) == "Cn"]
    return re.compile("[" + "".join(re.escape(chr(c)) for c in none) + "]")


_WIDE = re.compile("[\U00010000-\U0010ffff]")


def unknown(text: str) -> bool:
    """Has the text a character that Python's tables do not assign?  Other tables may know some of them as letters, or their lower case."""
    if text.isascii():
        return False
    return bool(_unassigned().search(text)) or any(unicodedata.category(c) == "Cn" for c in _WIDE.findall(text))


class WordTokenizer:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        split = next(x for x in data["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace("\\s", _BLANK))
        self.blank = regex.compile(f"[{_BLANK}]+")
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.path, self.library = path, None
        self.inside: set[tuple[str, str]] = set()  # neighbours inside a token
        self.closing: set[tuple[str, str]] = set()  # neighbours at the end of a token that ends a word
        for token in self.vocab:
            last = bool(self.end) and token.endswith(self.end) and len(token) > len(self.end)
            body = token[: -len(self.end)] if last else token
            pairs = list(zip(body[:-1], body[1:], strict=True))
            if last and pairs:
                self.closing.add(pairs.pop())
            self.inside.update(pairs)
        self.fragments: dict[tuple[str, bool], list[str]] = {}
        self.chunks: dict[str, tuple[str, str, int]] = {}

    def cut(self, word: str) -> list[str]:
        """A word of byte-level letters, at its certain cuts."""
        if len(word) < 2:
            return [word]
        at = [i for i in range(1, len(word) - 1) if (word[i - 1], word[i]) not in self.inside]
        if (word[-2], word[-1]) not in (self.closing if self.end else self.inside):
            at.append(len(word) - 1)
        return [word[a:b] for a, b in zip([0, *at], [*at, len(word)], strict=True)]

    def merge(self, fragment: str, last: bool) -> list[str]:
        """The tokens of one fragment: the merge of lowest rank first, leftmost of equals."""
        parts: list[str] = list(fragment)
        if last:
            parts[-1] += self.end
        ranks, none = self.ranks, len(self.ranks)
        if len(parts) <= 64:
            order = [ranks.get(pair, none) for pair in zip(parts[:-1], parts[1:], strict=True)]
            while order and (best := min(order)) < none:
                at = order.index(best)
                parts[at] += parts.pop(at + 1)
                order.pop(at)
                if at:
                    order[at - 1] = ranks.get((parts[at - 1], parts[at]), none)
                if at < len(order):
                    order[at] = ranks.get((parts[at], parts[at + 1]), none)
            return parts
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if parts[i] != x or j < 0 or parts[j] != y:
                continue
            parts[i], parts[j] = x + y, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p]

    def word_tokens(self, word: str) -> list[str]:
        return self.letter_tokens(word if word.isascii() and word.isalnum() else "".join([self.letters[b] for b in word.encode("utf-8")]))

    def letter_tokens(self, letters: str) -> list[str]:
        """The tokens of a word in byte-level letters."""
        pieces, out = self.cut(letters), []
        for i, piece in enumerate(pieces):
            key = (piece, i == len(pieces) - 1)
            found = self.fragments.get(key)
            if found is None:
                if len(self.fragments) >= REMEMBERED:
                    self.fragments.clear()
                found = self.merge(*key)
                if len(piece) <= 64:
                    self.fragments[key] = found
            out += found
        return out

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # each letter alone: no final sigma
                text = text.replace("Σ", "σ")
        return text.lower()

    def foreign(self, text: str) -> list[tuple[str, str, int]]:
        """A text with characters that Python's tables do not know: its words as the tokenizers library finds them, by its own tables; merged here."""
        from tokenizers import Tokenizer

        self.library = self.library or Tokenizer.from_file(self.path)
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [(" ".join([str(self.vocab[t]) for t in tokens]), " ".join(tokens), len(tokens)) for tokens in (self.letter_tokens(w) for w, _ in words)]

    def chunk(self, chunk: str) -> tuple[str, str, int]:
        """Ids and tokens of text without white space, each joined by one space, and their number."""
        found = self.chunks.get(chunk)
        if found is None:
            tokens = [t for w in self.words.findall(chunk) for t in self.word_tokens(w)]
            found = " ".join([str(self.vocab[t]) for t in tokens]), " ".join(tokens), len(tokens)
            if len(self.chunks) >= REMEMBERED:
                self.chunks.clear()
            if len(chunk) <= 64:
                self.chunks[chunk] = found
        return found

    def parts(self, text: str) -> list[tuple[str, str, int]]:
        out, at = [], 0
        marks = list(self.marks.finditer(text)) if self.marks and any(s in text for s in self.special) else []
        for mark in [*marks, None]:
            plain = text[at : mark.start() if mark else len(text)]
            if unknown(plain):
                out += self.foreign(plain)
            else:
                plain = self.normalise(plain)
                pieces = self.blank.split(plain) if any(c in plain for c in _SEPARATORS) else plain.split()
                out += [p for p in map(self.chunk, pieces) if p[2]]
            if mark:
                out.append((str(self.special[mark[0]]), mark[0], 1))
                at = mark.end()
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.parts(text) for i in part[0].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for b in steps(batches, "text", 1 << 20):
            ids = [own.encode(t) for t in strings(b.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for b in steps(batches, "text", 1 << 20):
            count, ids, decoded = [], [], []
            for text in strings(b.column("text")).to_pylist():
                parts = own.parts(text)
                count.append(sum([p[2] for p in parts]))
                ids.append(hashlib.sha256(" ".join([p[0] for p in parts]).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
