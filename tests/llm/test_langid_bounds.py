"""Bounds of language identification: rows it is fitted on, memory of long texts and many labels, ties."""

import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from glasshouse.llm import langid


@pytest.mark.parametrize("cells", [1, 16 * 50, 1 << 22])
def test_chunks_of_pieces_do_not_change_the_chain(cells):
    r = np.random.default_rng(3)
    k, sizes = 5, [700, 0, 33, 1500, 5, 64, 900]
    first = np.r_[0, np.cumsum(sizes)]
    scores, moves = r.normal(size=(first[-1], k)) * 3, r.normal(size=(k, k)) * 2
    begin, lengths, text = langid.pieces_of(first)
    enter, leave = langid.boundaries(scores, begin, lengths, text, moves, cells)
    marginal, _, _ = langid.forward_backward(langid.padded(scores, begin, lengths, langid.PIECE), lengths, moves, enter, leave)
    for a, n in zip(first[:-1], sizes):
        if n:
            want, _, _ = langid.forward_backward(scores[None, a : a + n], np.array([n]), moves)
            got = np.concatenate([marginal[i, : lengths[i]] for i in np.flatnonzero((begin >= a) & (begin < a + n))])
            assert np.allclose(got, want[0], atol=1e-5)


def test_fit_takes_rows_not_identifiers(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda texts, langs: seen.update(texts=texts, langs=langs))
    keep = next(i for i in range(50) if __import__("zlib").crc32(str(i).encode()) % 4 != 2)
    rows = [(keep, f"text {i} of one document", "en") for i in range(3000)] + [(keep, "the same", "de")] * 900 + [(keep, None, "fr"), (None, "x", "en"), (keep, "y", None)]
    langid.train(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert seen["langs"].count("en") == langid.PER_LABEL and seen["langs"].count("de") == 1 and "fr" not in seen["langs"]
    assert len(set(seen["texts"])) == langid.PER_LABEL + 1


def test_more_labels_than_allowed_is_an_error(spark):
    rows = [(i, "abc", f"l{j}") for j in range(langid.MOST_LABELS + 1) for i in range(8)]
    with pytest.raises(ValueError):
        langid.train(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_memory_of_a_long_text_with_all_labels():
    code = """
import resource, sys
import numpy as np, pyarrow as pa
from glasshouse.llm import langid
k = langid.MOST_LABELS
r = np.random.default_rng(1)
model = langid.Model([f"l{i:03}" for i in range(k)], r.normal(size=(1 << langid.BITS, k)).astype(np.float32), np.zeros((k, k), np.float32))
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
model.predict(pa.array(["some words of a text " * 10000], pa.large_string()))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 450  # MB; the products of all its pieces would be as much again


def test_ties_go_to_the_first_label():
    model = langid.Model(["aa", "bb"], np.zeros((1 << langid.BITS, 2), np.float32), np.zeros((2, 2), np.float32))
    assert model.predict(pa.array(["words that no label knows"], pa.large_string())) == (["aa"], [0.5])
