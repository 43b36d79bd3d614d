"""Text preparation: literal inputs and outputs."""

import pytest
from pyspark.sql import functions as F

from glasshouse.functions import html as H
from glasshouse.functions import text as T
from glasshouse.operators.lines import rebuild


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("text,n", [("Conforme o art. 6, X. Tratamos dados.", 1), ("Usamos dados. Tratamos dados.", 2), ("A Lei 13.709 de 2018.", 1), ("Direitos: Acesso; Correção (i) um (ii) dois", 5), ("", 0), ("Itens 1) Um 2.1) Dois", 3)])
def test_sentences(spark, text, n):
    assert len(one(spark, text, T.sentences)) == n


def test_sentence_trim_and_marks(spark):
    assert one(spark, "0 casos. 1 caso. Fim 1", T.sentences) == ["0 casos. 1 caso.", "Fim 1"]


@pytest.mark.parametrize("page,blocks", [("<ul><li>Confirmar tratamento</li><li>Acessar os dados</li></ul>", ["Confirmar tratamento", "Acessar os dados"]), ("<script>x</script><p>a &amp; b<br>c</p>", ["a & b", "c"]), ("", [])])
def test_blocks(spark, page, blocks):
    assert one(spark, page, T.html_blocks) == blocks and H.blocks_of(page) == blocks


def test_frames_keep_text():
    assert H.blocks_of('<iframe><span style="display: none;">&nbsp;</span></iframe>') == []
    assert H.blocks_of("<iframe>x</iframe>") == ["x"]


def test_rebuild(spark):
    def rebuild_lines(lines):
        rows = rebuild(spark.createDataFrame([(1, "\n".join(lines))], "k long, text string"), "k").collect()
        return rows[0].parts if rows else []

    assert rebuild_lines(["compartilha-", "mento de dados."]) == ["compartilhamento de dados."]
    head = "Prefeitura Municipal"
    assert all(head not in p for p in rebuild_lines([head, "Usamos dados.", head, "Tratamos dados.", head, "Fim."]))
    assert rebuild_lines(["Direitos", "a) acesso;", "b) correcao;"]) == ["Direitos", "a) acesso;", "b) correcao;"]


def test_rebuild_edges(spark):
    texts = ["1.\nPrimeiro item\nsegue.\n(ii)\nSegundo", "um\n(a) dois; \n\n tres\u00a0\nquatro.\n\u0007", "fim-", "", None, "(1)"]
    got = {r.k: r.parts for r in rebuild(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k").collect()}
    assert got == {0: ["1. Primeiro item segue.", "(ii) Segundo"], 1: ["um", "(a) dois;", "tres quatro."], 2: ["fim-"], 5: ["(1)"]}


@pytest.mark.parametrize(
    ("text", "want"),
    [("Direitos: (I) acesso; (II) correcao", ["Direitos:", "(I) acesso;", "(II) correcao"]), ("itens (cdi) juros", ["itens (cdi) juros"]), ("dados (A) um (b) dois (xl) tres", ["dados", "(A) um", "(b) dois (xl) tres"]), ("a (iv) b (xii) c", ["a", "(iv) b", "(xii) c"])],
)
def test_bracketed_marks(spark, text, want):
    assert one(spark, text, T.sentences) == want


def test_offsets_are_of_the_normalised_document(spark):
    segs = spark.createDataFrame([(1, 0, "A  b\u00a0 c"), (1, 1, " \u00a0 "), (1, 2, "É")], "k long, idx int, text string")
    assert [(r.idx, r.begin, r.end) for r in T.offsets(segs, "k").orderBy("idx").collect()] == [(0, 0, 5), (2, 6, 7)]


def test_counted_terms(spark):
    got = one(spark, "aa bb aa cc aa bb", lambda c: T.counted(T.terms(c, 2)))
    assert {x.term: x.n for x in got} == {"aa": 3, "bb": 2, "cc": 1, "aa bb": 2, "bb aa": 1, "aa cc": 1, "cc aa": 1}
    assert one(spark, "a", lambda c: T.counted(T.terms(c))) == []


def test_excerpts_by_a_shared_word(spark):
    from glasshouse.operators.citations import containing

    docs = spark.createDataFrame([(1, "the quick brown fox\njumps over"), (2, "quick brown"), (3, "xyz"), (4, None)], "d long, text string")
    parts = spark.createDataFrame([(10, "ick brown fox"), (11, "he quick brown fox\njum"), (12, "y"), (13, "k b"), (14, "brown quick brown")], "i long, part string")
    assert sorted((r.d, r.i) for r in containing(docs, "d", "text", parts, "i", "part").collect()) == [(1, 10), (1, 11), (1, 13), (2, 13), (3, 12)]


def test_numbers_without_one_task(spark):
    from pyspark.sql import functions as F

    from glasshouse.operators.joins import numbered

    rows = spark.createDataFrame([(i % 3 if i % 7 else None, f"n{i:03}") for i in range(100)], "a int, name string")
    got = {r.name: r.k for r in numbered(rows, [F.col("a"), F.substring("name", 1, 3)], [F.col("name")], "k").collect()}
    want = [n for _, n in sorted(((-1 if a is None else a, n) for a, n in rows.collect()))]
    assert [got[n] for n in want] == list(range(1, 101))


def test_useful_and_offsets(spark):
    long = "x" * 25
    segs = spark.createDataFrame([(1, 0, long), (1, 1, "other"), (1, 2, long), (1, 3, "")], "k int, idx int, text string")
    assert [r.idx for r in T.useful(segs, "k").orderBy("idx").collect() if r.is_useful] == [0]
    assert [(r.begin, r.end) for r in T.offsets(segs, "k").orderBy("idx").collect()] == [(0, 25), (26, 31), (32, 57)]


def test_language(spark):
    english = "The information that you share with us is used for the privacy policy. " * 8
    assert one(spark, english, T.is_own_language) is False
    assert one(spark, english[:300], T.is_own_language) is True
    assert one(spark, "Os dados que o senhor compartilha com a empresa. " * 12, T.is_own_language) is True


def test_small_functions(spark):
    assert one(spark, "Ação  É\x07 boa", T.clean) == "Ação É boa"
    assert one(spark, "Ação  É, boa", T.normalise) == "acao e, boa" == H.nfkd_lower("Ação  É, boa")
    assert one(spark, "Ação É, boa!", T.normalise_words) == "acao e boa"
    assert one(spark, "Ação É_x, 9!", T.normalise_ascii) == "acao e x 9"
    assert one(spark, "encarregado@x.com.br", T.mask_email) == "en***@x.com.br"
    assert one(spark, "a bb cc dd", T.terms) == ["bb", "cc", "dd", "bb cc", "cc dd", "bb cc dd"]
    assert one(spark, "a", T.terms) == []
    m = one(spark, "abc def ghi", lambda c: T.match_with_context(c, "def", 2))
    assert (m.match, m.position, m.snippet) == ("def", 4, "c def g")
    assert one(spark, "x", lambda c: T.safe_decode(F.lit(b"caf\xe9"))) == "café"
    assert one(spark, "mail a@b.co fim", T.redact) == "mail [correio] fim"
    assert one(spark, "abcdef", lambda c: T.locate_excerpt(c, F.lit("cd"))) == 2 and one(spark, "abc", lambda c: T.locate_excerpt(c, F.lit("zz"))) == -1


def test_excerpt_query_tries_longer_starts_first(spark, tmp_path):
    from glasshouse.plans.catalog import QUERIES

    excerpt = "a" * 50 + "b" * 30 + "c" * 40 + "d" * 20
    texts = [excerpt, "a" * 50 + " " + excerpt[:120], "a" * 50 + " " + excerpt[:80], "x" + "a" * 50]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, excerpt)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted((r.doc_id, r.place) for r in QUERIES["t16_locate_excerpt"](spark, str(tmp_path)).collect()) == [(0, 0), (1, 51), (2, 51), (3, 1)]


def test_excerpts_of_any_size(spark):
    import random

    from glasshouse.operators.citations import containing

    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abé x", k=rng.randrange(1, 9)))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(80)] + [(900, None), (901, ""), (902, "a" * 400), (903, "é")]
    parts = [(i, t[a : a + n], "clash") for i, (t, n) in enumerate((rng.choice(docs[:80])[1], n) for n in [1, 2, 3, 5, 7, 8, 11, 12, 20, 24, 30, 49, 50, 51, 90, 120] * 6) for a in [rng.randrange(40)]]
    parts += [(1000, None, ""), (1001, "", ""), (1002, "a" * 60, ""), (1003, "a" * 60, ""), (1004, "nowhere to be found at all, in no document whatever it is", "")]
    found = containing(spark.createDataFrame(docs, "d long, text string"), "d", "text", spark.createDataFrame(parts, "i long, part string, other string"), "i", "part")
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    want = sorted((d, i) for d, t in docs for i, p, _ in parts if t and p and p in t)
    assert sorted((r.d, r.i) for r in found.collect()) == want
    none = containing(spark.createDataFrame(docs, "d long, text string"), "d", "text", spark.createDataFrame([(1, "")], "i long, part string"), "i", "part")
    assert none.columns == ["d", "text", "i", "part"] and none.collect() == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_segments_meet_their_evidence_in_one_join(spark):
    from glasshouse.operators.evaluate import overlap_labels

    segs = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 11, 20), (2, 0, 0, 10), (None, 0, 0, 10)], "doc int, idx int, begin int, end int")
    ev = spark.createDataFrame([(1, 5, 10), (1, 9, 12), (2, 10, 30), (2, None, 5), (3, 0, 9), (None, 0, 10)], "doc int, e_begin int, e_end int")
    got = overlap_labels(segs, ev, "doc")
    assert sorted((r.doc or 0, r.idx, r.label) for r in got.collect()) == [(0, 0, 0), (1, 0, 1), (1, 1, 0), (2, 0, 0)]
    assert plan_of(got).count("Join ") <= 1


def test_texts_are_normalised_once(spark):
    from glasshouse.functions.text import offsets
    from glasshouse.operators.evaluate import divergent_marks

    rows = spark.createDataFrame([(1, 0, "Árvore ½ grande", True), (1, 1, "  ", True), (1, 2, "한 ação", False), (2, 0, "Árvore ½ grande", False)], "doc int, idx int, text string, label boolean")
    marks, placed = divergent_marks(rows, T.normalise_ascii(F.col("text")), "label", 5), offsets(rows, "doc")
    assert [(r.t, r.labels, r.n) for r in marks.collect()] == [("arvore 1 2 grande", 2, 2)]
    assert sorted((r.doc, r.idx, r.begin, r.end) for r in placed.collect()) == [(1, 0, 0, 17), (1, 2, 18, 26), (2, 0, 0, 17)]
    for df in (marks, placed):
        assert plan_of(df).count("translate(") <= 2  # the translation and the question whether it left anything
