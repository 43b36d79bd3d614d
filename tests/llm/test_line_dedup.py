"""Shared lines against a brute force: hot lines over several partitions, nulls, ties, repeated rows, long texts."""

import hashlib
import random
from collections import defaultdict

import pytest
from glasshouse.llm import line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, mark string, keep int"


def brute(rows, least_chars=40, least_docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    low = float("-inf")
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(low if i is None else i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= least_chars and len(holders[key(x)]) >= least_docs and max(holders[key(x)]) != (low if i is None else i))]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **how):
    return sorted((tuple(r) for r in line_dedup.digests(spark, spark.createDataFrame(rows, SCHEMA), **how).collect()), key=repr)


def corpus():
    rng = random.Random(5)
    shared = [f"  {'Ab' * rng.randrange(15, 30)}é{i}\t" for i in range(12)]
    lines = [*shared, "", " ", "\x0b\x0c", "x" * 39, "x" * 40, "É" * 40, "é" * 40, " " + "y" * 39, "y" * 39 + "\r"]
    rows = [(i, "\n".join(rng.choice([*lines, rng.choice(shared).swapcase(), f"own {i} {'z' * 50}"]) for _ in range(rng.randrange(12))), "clash", 1) for i in range(120)]
    rows += [(None, "\n".join(shared[:4]), None, None), (None, None, None, None), (7, "", "", 0), (500, None, "", 0)]
    rows += rows[:9]  # repeated rows
    rows += [(3, "\n".join(shared) + "\nanother text of one identifier", "", 0)]
    rows += [(600, "\n".join(shared * 2000), "long", 0), (601, "w" * 300_000 + "\n" + shared[0], "long", 0)]
    return rows


def test_corpus(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("held", [1, 50])
def test_hot_line_over_many_partitions(spark, held):
    hot = "The same notice stands in most of the documents."
    rows = [(i, f"{hot}\n{i % 50} {'n' * 40}\n{hot.upper()}", "", 0) for i in range(900)]
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.execution.arrow.maxRecordsPerBatch": "20"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert got(spark, rows, held=held) == brute(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_bitmap_holds_lines_that_stay(spark):
    line = "q" * 45
    docs = spark.createDataFrame([(i, "\n".join(["a", line, "b"] * 4), "", 0) for i in range(6)], SCHEMA)
    found = {r.doc_id: r for r in line_dedup.keep_bitmaps(spark, docs).collect()}
    assert sorted(found) == [0, 1, 2, 3, 4] and found[2].n_dropped == 4
    assert line_dedup.lines_kept(found[2].keep, 14).tolist() == [True, False, True] * 4 + [True, True]
    assert line_dedup.lines_kept(None, 3).all()


def test_empty(spark):
    assert got(spark, []) == []
