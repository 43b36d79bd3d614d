"""The pipeline on a small corpus, against what each stage must do."""

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    extra = spark.createDataFrame([(5000, "12 34 !", "en", "s", 7), (5001, None, "en", "s", 0), (5002, docs.first().text, "en", "s", 1), (5002, docs.first().text, "en", "s", 1)], docs.schema)
    all_docs = docs.unionByName(extra)
    all_docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        counts.append((name, now.count()))
        if name == "language_id":
            assert now.where("doc_id IN (5000, 5001)").count() == 0
        if name == "exact_dedup":
            assert now.where(now.text == docs.first().text).select("doc_id").collect() == [(5002,)]
            assert now.select("doc_id").distinct().count() == now.count()
    assert now.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash", "substring_dedup", "packing"]
    empty = all_docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_clashing_columns_and_ties(spark, tmp_path):
    """Columns named like the operators' own pass every stage; of rows with one doc_id the same one stays in any order of files."""
    text = " ".join(f"word{i} in the house of water" for i in range(12))
    names = "doc_id text lang n_chars n_removed _of _digest _keep _gone kept row id hash digest place key block component_id fp".split()
    rows = [(1, text), (1, text.upper()), (2, text + " and more"), (2, None), (None, "the one and only house"), (None, "THE one and only house"), (3, text)]
    made = [tuple({"doc_id": i, "text": t, "lang": "en", "n_chars": 5}.get(n, f"{n}{k}") for n in names) for k, (i, t) in enumerate(rows)]
    schema = ", ".join(f"{n} {({'doc_id': 'long', 'n_chars': 'long'}).get(n, 'string')}" for n in names)
    found = []
    for order in (made, made[::-1]):
        docs = spark.createDataFrame(order, schema).coalesce(1)
        out = []
        for name, stage in corpus_pipeline.STAGES[:-1]:
            path = str(tmp_path / f"{name}{len(found)}")
            done = stage(spark, docs, str(tmp_path))
            assert done.columns == names
            done.write.parquet(path)
            docs = spark.read.parquet(path)
            out.append(sorted((tuple(r) for r in docs.collect()), key=str))
        found.append(out)
    assert found[0] == found[1]
    kept = [(r[0], r[1]) for r in found[0][1]]
    assert (3, text) in kept and (2, text + " and more") in kept and sum(i is None for i, _ in kept) == 1 and len(kept) == 3


def test_one_row_of_a_case_tie(spark):
    docs = spark.createDataFrame([(1, "B b"), (1, "b B"), (1, "b b")], "doc_id long, text string")
    for order in (docs, docs.orderBy("text"), docs.orderBy("text", ascending=False)):
        assert [tuple(r) for r in corpus_pipeline.exact_dedup(spark, order.coalesce(1), "").collect()] == [(1, "B b")]


def brute_pieces(rows):
    """Plain Python for the stages after language ID: (doc_id, text) to rows of pieces, and how many documents each stage leaves."""
    import itertools
    import zlib

    import numpy as np
    import public_tokenizers
    from test_dedup import brute_passages, fingerprint

    from glasshouse.llm import packing

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = {}
    for i, t in rows:
        last[t.translate(lower)] = max(i, last.get(t.translate(lower), i))
    exact = {i: t for i, t in rows if last[t.translate(lower)] == i}
    fps, root = {i: fingerprint(t) for i, t in exact.items()}, {i: i for i in exact}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    near = [(i, t) for i, t in exact.items() if find(i) == i]
    cut = brute_passages(near)
    left = [(i, cut[i][4] if cut[i][2] else t) for i, t in near if not cut[i][2] or cut[i][2] < cut[i][1]]
    path, out = public_tokenizers.path("byte_bpe_50k.json"), []
    for i, t in left:
        ids = np.append(packing.token_ids(t, path), np.uint32(0)).astype("<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]  # whole pieces last
        out += [(i, k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    return sorted(out), [len(exact), len(near), len(left), sum(cut[i][2] > 0 for i, _ in near)]


def test_run_is_brute_force(spark, tmp_path):
    import random

    r = random.Random(8)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [tuple(x) for x in table.orderBy("doc_id").limit(120).collect()]
    long = [d for d in docs if 80 <= len(d[1].split()) <= 2000]
    extra = []
    for n, (_, text, lang, source, _) in enumerate(r.sample(long, 12)):
        words = text.split()
        near = " ".join([*words[:-1], f"changed{n}"])
        own = r.choice(long)[1].split()
        passage = " ".join([*own[::-1][:60], *words[20:50], *own[::-1][60:90]])
        extra += [(7000 + n, text, lang, source, len(text)), (7100 + n, text.upper() if text.isascii() else text, lang, source, len(text)), (7200 + n, near, lang, source, len(near)), (7300 + n, passage, lang, source, len(passage))]
    spark.createDataFrame([*docs, *extra, extra[0]], table.schema).write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(x) for x in corpus_pipeline.language_id(spark, now, str(tmp_path)).select("doc_id", "text").collect()]
    want, (exact, near, left, cut) = brute_pieces(rows)
    assert len(rows) > exact > near >= left > 50 and cut > 5  # each stage has something to do
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in got) == want
    places = {}
    for p in got:
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in places.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
