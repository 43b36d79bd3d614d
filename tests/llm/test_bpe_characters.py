"""Every code point inside and at the ends of words, against the tokenizers library."""

import unicodedata

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from glasshouse.llm import bpe  # noqa: E402


def test_every_code_point():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.WordTokenizer(path)
    library.no_truncation()
    library.no_padding()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    word = lambda c: f"a{c}b1" if unicodedata.category(c) in ("Cn", "Co") else f"a{c}b1 {c}É{c}"
    texts = [" ".join(word(chr(c)) for c in points[a : a + 200]) for a in range(0, len(points), 200)]
    wrong = [hex(points[200 * i]) for i, (e, t) in enumerate(zip(library.encode_batch(texts, add_special_tokens=False), texts)) if e.ids != own.encode(t)]
    assert not wrong, wrong[:20]  # the first of 200 code points
