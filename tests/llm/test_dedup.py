"""Deduplication operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from glasshouse.llm import simhash, suffix_dedup
from glasshouse.llm.components import components
from glasshouse.llm.exact_dedup import exact_groups
from glasshouse.llm.simhash import near_groups, text_fingerprints
from glasshouse.llm.substring_dedup import dedup_passages

SCHEMA = "doc_id long, text string, block string, digest int, carry int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], SCHEMA)


def corpus(seed=1, n=40):
    r = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(60)]
    passages = [" ".join(r.choices(words, k=30)) for _ in range(5)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "a" * 900), (4, "One two"), (5, "ONE two"), (6, "É"), (7, "é")]
    for i in range(8, n):
        parts = [r.choice([" ".join(r.choices(words, k=r.randint(1, 25))), r.choice(passages)]) for _ in range(r.randint(1, 4))]
        rows.append((i, r.choice([" ", "\n", "  "]).join(parts)))
    return rows + [(n, rows[10][1]), (n + 1, rows[10][1]), (n + 2, rows[12][1].upper() if rows[12][1] else ""), (n + 3, "x y z " * 3000)]


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOWER).encode())
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact(spark, digest):
    """Also with a digest so short that different texts share it: the bytes decide."""
    rows = corpus()
    want = {}
    for i, t in rows:
        want.setdefault((t or "").translate(LOWER), []).append(i)
    got = {r.doc_id: r for r in exact_groups(spark, frame(spark, rows), digest=digest).collect()}
    assert len(got) == len(rows)
    for members in want.values():
        for i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(members), len(members), i == max(members))
    if digest is None:
        assert got[5].digest == hashlib.sha256(b"one two").hexdigest()


def test_exact_edges(spark):
    assert exact_groups(spark, frame(spark, [])).count() == 0
    got = [tuple(r)[:4] for r in exact_groups(spark, frame(spark, [(None, "a"), (3, "a"), (3, "a"), (None, "b")])).collect()]
    assert sorted(got, key=str) == sorted([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, None, 1, True)], key=str)


def test_exact_state_goes_on(spark, tmp_path):
    """File by file, over two calls and a call made again: the state counts every row once."""
    rows = [r for r in corpus(11, 60) if r[0] is not None]
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    halves = rows[::2], rows[1::2]
    folder = f"file://{tmp_path}/state"
    for n, half in enumerate(halves):
        frame(spark, half).repartition(3).write.parquet(f"{tmp_path}/docs{n}")
    docs = [spark.read.parquet(f"file://{tmp_path}/docs{n}") for n in range(2)]
    exact_groups(spark, docs[0], files_per_batch=1, folder=folder, call="one").count()
    # as if the driver had been lost after the second table was written: the state takes it in on the next call
    for _ in range(2):
        got = {r.doc_id: r for r in exact_groups(spark, docs[1], files_per_batch=1, folder=folder, call="two").collect()}
        assert set(got) == {i for i, _ in halves[1]}
        for i, t in halves[1]:
            members = groups[(t or "").translate(LOWER)]
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(members), len(members), i == max(members))
            assert got[i].keep_file.split("/")[-2] == ("docs0" if any(max(members) == j for j, _ in halves[0]) else "docs1")


def test_exact_checks_the_bytes_of_earlier_calls(spark, tmp_path):
    short = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    for n in range(2):
        frame(spark, [(100 * n + i, f"text {n} {i}") for i in range(20)]).write.parquet(f"{tmp_path}/docs{n}")
    docs = [spark.read.parquet(f"file://{tmp_path}/docs{n}") for n in range(2)]
    one = docs[0].limit(1)
    exact_groups(spark, one, digest=short, folder=f"file://{tmp_path}/state").count()
    with pytest.raises(ValueError, match="earlier call"):
        exact_groups(spark, docs[1], digest=short, folder=f"file://{tmp_path}/state")


def test_marks_hold_every_key(spark):
    from glasshouse.llm.common import marks

    test = marks(spark, spark.range(0, 3000, 3).select(F.col("id").alias("key")))
    got = {r.id for r in spark.range(3000).where(test(F.col("id"))).collect()}
    assert set(range(0, 3000, 3)) <= got and len(got) < 1010
    none = marks(spark, spark.range(0).select(F.col("id").alias("key")))
    assert spark.range(100).where(none(F.col("id"))).count() == 0


def test_word_hashes_tell_words_apart():
    """Words on which polynomials modulo 2**64 collide (a sequence of a and b and its complement), and words of all lengths."""
    from glasshouse.llm.common import word_hashes

    morse = "".join("ab"[n.bit_count() % 2] for n in range(1024))
    words = [morse, morse.translate(str.maketrans("ab", "ba")), morse + "a", morse.translate(str.maketrans("ab", "ba")) + "a", *("x" * n for n in range(1, 40)), "abcdefgh", "hgfedcba", "abcdefghabcdefgi", "abcdefgiabcdefgh", "a\0", "a"]
    raw = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    for lane in word_hashes(raw, stops - [len(w) for w in words], stops):
        assert len(set(lane.tolist())) == len(words)


def test_fingerprints():
    rows = corpus(2)
    got = text_fingerprints(pa.array([t or "" for _, t in rows], pa.large_string()))
    assert [int(x) for x in got] == [fingerprint(t) for _, t in rows]


def test_near_groups(spark):
    r = random.Random(3)
    rows = corpus(4)
    long = " ".join(r.choices([f"t{i}" for i in range(300)], k=600)).split()
    for i in range(30):  # near copies that chain
        long[r.randrange(len(long))] = f"new{i}"
        rows.append((1000 + i, " ".join(long)))
    fps = {i: fingerprint(t) for i, t in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in near_groups(spark, frame(spark, rows)).collect()}
    assert got == {i: (fps[i], find(i)) for i in fps}
    assert len({find(i) for i in fps}) < len(fps) - 3


def test_near_edges(spark):
    assert near_groups(spark, frame(spark, [])).count() == 0
    assert {tuple(r) for r in near_groups(spark, frame(spark, [(None, "a b"), (5, None), (None, ""), (5, None)])).collect()} == {(None, xxhash.xxh64_intdigest(b"a b", 42) - 2**64 if xxhash.xxh64_intdigest(b"a b", 42) >= 2**63 else xxhash.xxh64_intdigest(b"a b", 42), None), (5, 0, 5), (None, 0, 5)}


def near_and_far(seed, n=300):
    """Pairs that differ in 4 bits, and pairs that differ in 3 to 6 whole bytes."""
    r = random.Random(seed)
    one = [r.getrandbits(64) for _ in range(n)]
    return one, [x ^ sum(1 << b for b in r.sample(range(64), 4)) if k % 2 else x ^ sum(r.randrange(1, 256) << 8 * b for b in r.sample(range(8), r.randint(3, 6))) for k, x in enumerate(one)]


def shared_bytes(a, b):
    return sum(a >> s & 255 == b >> s & 255 for s in range(0, 64, 8))


def test_lists_hold_every_pair_with_the_minimum():
    """At every depth of splitting, pairs of at most 4 differing bits meet; with whole bytes, so do all that share 4."""
    one, other = (np.array(x, dtype=np.uint64) for x in near_and_far(4))
    close = np.array([(int(a) ^ int(b)).bit_count() <= 4 for a, b in zip(one, other)])
    four = np.array([shared_bytes(int(a), int(b)) >= 4 for a, b in zip(one, other)])
    now = simhash.paths(1)
    for depth in range(1, 9):
        assert all(p.bit_count() == depth for p in now) and len(set(now)) == len(now)
        assert depth > 4 or now == sorted(simhash.paths(depth))
        meet = np.zeros(len(one), dtype=bool)
        for p in now:
            meet |= simhash.keys(one, p) == simhash.keys(other, p)
        assert meet[close].all() and (depth > 4 or meet[four].all())
        now = sorted({q for p in now for q in simhash.longer(p)})
    assert not now


def test_the_tally_rejects():
    """Pairs that meet in a list and share fewer than 4 positional bytes are tallied and go."""
    one, other = (np.array(x, dtype=np.uint64) for x in near_and_far(5))
    shared = np.array([shared_bytes(int(a), int(b)) for a, b in zip(one, other)])
    assert (simhash.tally(one ^ other) == shared).all()
    assert simhash.retained(one, other, 64).tolist() == (shared >= 4).tolist() and (shared < 4).any()
    assert simhash.retained(one, other).tolist() == [(int(a) ^ int(b)).bit_count() <= 4 for a, b in zip(one, other)]


def test_lists_keep_components():
    fps = np.array([0, 1, 3, 7, 15, 31, 1 << 40, (1 << 40) | 1, 0xFFFF << 8], dtype=np.uint64)
    a, b = simhash.long_list(fps)
    assert len(a) == 7 and all((int(x) ^ int(y)).bit_count() <= 4 for x, y in zip(a, b))
    x, y = simhash.short_lists(np.r_[fps, fps[:3]], np.array([0, 9, 12]))
    assert len(x) == 7 + 2 and set(x.tolist()) == {0}


@pytest.mark.parametrize(("level", "longest"), [(1, 4), (2, 8), (3, 2), (4, 1 << 20)])
def test_frequent_lists_are_split(spark, level, longest):
    """Links connect the same components whatever the lists' lengths, with dense groups that every split leaves together."""
    r = random.Random(9)
    fps = {r.getrandbits(64) for _ in range(40)} | {0x1234 ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(60)} | {5 << 32 | x for x in range(30)}
    root = {x: x for x in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def union(pairs):
        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x

    signed = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    got = [(p.a % 2**64, p.b % 2**64) for p in simhash.candidate_links(spark, signed, level, longest).collect()]
    union(got)
    found = {x: find(x) for x in fps}
    root = {x: x for x in fps}
    union((a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4)
    assert found == {x: find(x) for x in fps}


def test_near_groups_of_one_hot_fingerprint(spark, monkeypatch):
    """Copies beyond the bound of a hot key, null identifiers and clashing columns."""
    from glasshouse.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(100 + i, text) for i in range(30)] + [(3, text.upper()), (None, text), (4, "other words here now"), (5, "x " * 50_000)]
    got = [(r.doc_id, r.component_id) for r in near_groups(spark, frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(i, 3 if t.lower() == text else i) for i, t in rows], key=str)


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(20), 100 + r.randrange(20)) for _ in range(15)] + [(200, i) for i in range(201, 260)]
    root = {n: n for e in edges for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if any(n in e and e[0] != e[1] for e in edges)}


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_passages(rows, size=13):
    least = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def test_passages(spark):
    rows = corpus(6, 60)
    want = brute_passages(rows)
    assert sum(w[2] for w in want.values()) > 100
    assert {r.doc_id: tuple(r) for r in dedup_passages(spark, frame(spark, rows)).collect()} == {i: w[:4] for i, w in want.items()}
    left = {r.doc_id: r for r in dedup_passages(spark, frame(spark, rows), rewrite=True).collect()}
    for i, t in rows:
        _, n, gone, _, kept = want[i]
        assert (i not in left) if gone and gone == n else left[i].text == (kept if gone else t) and left[i].block == "clash"


def test_passages_edges(spark):
    assert dedup_passages(spark, frame(spark, [])).count() == 0
    text = " ".join(map(str, range(20)))
    got = sorted((r.doc_id is None, r.n_removed) for r in dedup_passages(spark, frame(spark, [(None, text), (7, text), (7, text)])).collect())
    assert got == [(False, 20), (False, 20), (True, 0)]
    assert [r.n_removed for r in dedup_passages(spark, frame(spark, [(7, text), (7, text)])).collect()] == [0, 0]


def test_passages_other_columns_and_widths(spark):
    """Columns named like the operator's own pass through; a window of any width; rows without identifier are spread over blocks."""
    rows = corpus(12, 50)
    docs = spark.createDataFrame([(t, i, i % 5, f"{i}", "c", 7, {"k": "v"}) for i, t in rows], "text string, doc_id long, n_removed int, block string, carry string, n_chars int, shard map<string, string>")
    left = dedup_passages(spark, docs, rewrite=True, length="n_chars")
    assert left.columns == docs.columns and [f.dataType for f in left.schema] == [f.dataType for f in docs.schema]
    want = brute_passages(rows)
    for r in left.collect():
        assert (r.n_removed, r.block, r.carry, r.shard) == (r.doc_id % 5, str(r.doc_id), "c", {"k": "v"}) and r.n_chars == (len(r.text) if want[r.doc_id][2] else 7)
    for size in (1, 2, 5, 16):
        assert {r.doc_id: tuple(r) for r in dedup_passages(spark, frame(spark, rows), window=size).collect()} == {i: w[:4] for i, w in brute_passages(rows, size).items()}
    from glasshouse.llm.exchange import blocked

    many = frame(spark, [(None, " ".join([str(n)] * 4000)) for n in range(200)])
    assert blocked(spark, many)[0].select("block").distinct().count() > 1


def brute_bytes(rows, n=suffix_dedup.LENGTH):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] = seen.get(b[i : i + n], 0) + 1
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_bytes(spark):
    r = random.Random(7)
    base = ["".join(r.choice("ab cdé") for _ in range(r.randint(150, 600))) for _ in range(15)]
    rows = [(1, None), (2, ""), (3, "a" * 1000), (4, "ab" * 300), (5, "x" * 199), (6, "y" * 200), (7, "y" * 200)]
    for i in range(50):
        s = r.choice(base)
        cut = r.randint(0, len(s))
        rows.append((100 + i, s[:cut] + r.choice(["", "#", "??"]) + s[cut:] + r.choice(["", r.choice(base)[r.randint(0, 80) :]])))
    want = brute_bytes(rows)
    assert {r.doc_id: tuple(r) for r in suffix_dedup.remove_repeats(spark, frame(spark, rows)).collect()} == want
    kept = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(spark, frame(spark, rows), with_text=True).collect()}
    assert all(hashlib.sha256(bytes(kept[i])).hexdigest() == want[i][4] for i in want)


def test_records_find_their_bucket():
    """With splitters that share a token, against a plain count of the splitters up to a record."""
    r = np.random.default_rng(3)
    splitters = sorted(zip(r.integers(0, 6, 20).tolist(), r.integers(0, 50, 20).tolist()))
    records = sorted(zip(r.integers(0, 8, 300).tolist(), r.integers(0, 60, 300).tolist()))
    token, one = (np.array([x[i] for x in records], dtype=np.uint64) for i in range(2))
    for part in (slice(None), slice(0, 300, 30), slice(0, 0)):  # more records than splitters, and fewer
        runs = suffix_dedup.record_runs(token[part], one[part], tuple(np.array([x[i] for x in splitters], dtype=np.uint64) for i in range(2)))
        got = [s for s, a, b in runs for _ in range(b - a)]
        assert got == [sum(k <= x for k in splitters) for x in records[part]]


def test_leading_runs():
    from glasshouse.llm.exchange import leading_runs

    r = np.random.default_rng(4)
    for bits, shards, n in ((64, 1, 5), (64, 8, 100), (20, 16, 7), (20, 16, 0), (64, 64, 64)):
        keys = np.sort(r.integers(0, 1 << min(bits, 63), n).astype(np.uint64) << np.uint64(1 if bits == 64 else 0))
        got = [s for s, a, b in leading_runs(keys, shards, bits) for _ in range(b - a)]
        assert got == [int(k) * shards >> bits for k in keys.tolist()]


def test_bytes_edges(spark):
    assert suffix_dedup.remove_repeats(spark, frame(spark, [])).count() == 0
    assert [r.n_removed for r in suffix_dedup.remove_repeats(spark, frame(spark, [(None, "z" * 150 + "q" * 60), (None, "z" * 150 + "q" * 60)])).collect()] == [210, 210]
