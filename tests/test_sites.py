"""Sources, links, detection, store, outputs and protocols on small literal inputs."""

import gzip
import hashlib
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from glasshouse.functions import urls as U
from glasshouse.operators import detect as D
from glasshouse.operators import links as K
from glasshouse.operators import render as R
from glasshouse.operators import score as S
from glasshouse.operators import store
from glasshouse.plans import protocol as P
from glasshouse.sources import custody as C
from glasshouse.sources import evidence as V
from glasshouse.sources import lists as I


def test_listed_hosts(spark, tmp_path):
    f = tmp_path / "l.csv"
    f.write_text("dominio;estrato\na.com.br;x\nA.COM.BR;y\n;z\nsemponto;z\nHTTPS://Www.B.com.br/a/b;w\n")
    rows = I.read_list(spark, str(f), hashlib.sha256(f.read_bytes()).hexdigest()).orderBy("seq").collect()
    assert [(r.url, r.stratum) for r in rows] == [("https://a.com.br", "x"), ("https://www.b.com.br", "w")]
    with pytest.raises(ValueError, match="sha256"):
        I.read_list(spark, str(f), "0" * 64)
    g = tmp_path / "n.csv"
    g.write_text("nome,valor\na,b\n")
    with pytest.raises(ValueError, match="coluna_dominio"):
        I.read_list(spark, str(g))
    with pytest.raises(Exception):
        I.read_list(spark, str(tmp_path / "none.csv"))


def test_rank_list(spark, tmp_path):
    f = tmp_path / "r.csv.gz"
    f.write_bytes(gzip.compress(b"1,A.com.br\nx,b.br\n3\n4,\n5, c.gov.br\n6,d.com\n"))
    rows = I.ranked_domains(I.read_rank_lines(spark, str(f)), [".br"]).collect()
    assert [(r.rank, r.url, r.tld) for r in rows] == [(1, "https://a.com.br", ".com.br"), (5, "https://c.gov.br", ".gov.br")]
    with pytest.raises(ValueError):
        I.check_params("x", 0, [])
    with pytest.raises(ValueError):
        I.check_params("x", 1, ["br"])


def test_candidates(spark):
    cats = {"politica": ["privacidade"], "canal": ["titular"]}
    page = '<a href="/p1">Política de Privacidade</a><a href="/noticias/p2">privacidade</a><a href="https://fora.com/x" title="Privacidade">z</a><a href="mailto:a@b">titular</a><a href="p1#">titular</a>'

    def got(html, base, blockers=(), **how):
        pages = spark.createDataFrame([(1, base, html)], "page_id long, url string, html string")
        rows = K.candidates(pages, cats, list(blockers), **how).collect()
        return [(r.category, r.url, r.matched_against) for r in sorted(rows, key=lambda r: (list(cats).index(r.category), r.pos))]

    found = got(page, "https://www.s.com/a/", ["/noticias?/"], same_host=frozenset({"canal"}))
    assert [(c, u, s) for c, u, s in found] == [("politica", "https://www.s.com/p1", "text"), ("politica", "https://fora.com/x", "title"), ("canal", "https://www.s.com/a/p1", "text")]
    assert len(got('<a href="/a">titular</a><a href="/b">titular</a><a href="/c">titular</a>', "https://s.com", total=1)) == 1
    both = '<a href="/a">privacidade do titular</a><a href="/b">titular</a>'
    assert got(both, "https://s.com", total=1) == [("politica", "https://s.com/a", "text")]  # the total stops within an anchor
    assert got(both, "https://s.com", total=2) == [("politica", "https://s.com/a", "text"), ("canal", "https://s.com/a", "text"), ("canal", "https://s.com/b", "text")]
    assert got(both, "https://s.com", total=0) == [] and got(None, None) == [] and got('<a href="http://[x">titular</a>', "https://s.com") == []


def test_candidates_against_a_plain_loop(spark):
    import random
    import re
    from urllib.parse import urljoin

    rng = random.Random(8)
    cats, words = {"a": ["al+", "go"], "b": ["be", r"\bgo\b"], "c": ["é"]}, ["al", "be", "go", "É", "x", "goal", ""]
    pages = []
    for i in range(60):
        links = [(rng.choice([f"/{rng.choice(words)}{rng.randrange(4)}", "mailto:be", "", "//o.com/al"]), " ".join(rng.choices(words, k=2))) for _ in range(rng.randrange(12))]
        pages.append((i, f"https://s{i}.com/", "".join(f'<a href="{h}" title="{rng.choice(words)}">{t}</a>' for h, t in links)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for per, total in ((1, 2), (2, 3), (5, 50)):
        want = set()
        for i, base, html in pages:
            taken, urls = {c: [] for c in cats}, set()
            for h, title, t in re.findall('<a href="([^"]*)" title="([^"]*)">([^<]*)</a>', html):
                for c, ps in cats.items():
                    url = urljoin(base, h) if h else ""
                    if len(urls) < total and url.startswith("http") and len(taken[c]) < per and url not in taken[c] and any(re.search(p, v, re.I) for v in (t, title, h) for p in ps):
                        taken[c].append(url)
                        urls.add(url)
                        want.add((i, c, len(taken[c]) - 1, url))
        got = {(r.page_id, r.category, r.pos, r.url) for r in K.candidates(df, cats, [], per_category=per, total=total).collect()}
        assert got == want


def test_lookup_by_tails(spark):
    import random

    rng = random.Random(9)
    steps = ["a", "b", "index.html", "é", ""]
    path = lambda: "/" + "/".join(rng.choices(steps, k=rng.randrange(4)))
    pages = [(rng.choice(["s", "t", None]), rng.choice([path(), path(), f"https://x{path()}"]), i, "clash") for i in range(400)]
    wanted = [(rng.choice(["s", "t"]), f"https://x{path()}") for _ in range(80)]

    def plain(site, url):
        own = url.removeprefix("https://x") or "/"
        rank = lambda k: 0 if k == url else 1 if k == own else 2 if own != "/" and k != "/" and (own.endswith(k) or k.endswith(own)) else None
        return min(((rank(k), i, k) for s, k, i, _ in pages if s == site and rank(k) is not None), default=None)

    got = {(r.site, r.url): (r["rank"], r.seq, r.page_key) for r in K.lookup(spark.createDataFrame(wanted, "site string, url string"), spark.createDataFrame(pages, "site string, page_key string, seq long, url string")).collect()}
    assert got == {w: plain(*w) for w in wanted if plain(*w)}


def test_lookup_is_linear_in_the_pages_of_a_site(spark):
    from pyspark.sql import functions as F

    pages = spark.range(100_000).select(F.lit("s").alias("site"), F.concat(F.lit("/d"), F.col("id") % 1000, F.lit("/p"), F.col("id")).alias("page_key"), F.col("id").alias("seq"))
    wanted = pages.select("site", F.concat(F.lit("https://x/p"), F.col("seq")).alias("url"))
    found = K.lookup(wanted, pages)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert found.agg(F.count(F.lit(1)), F.count_if(F.col("page_key").endswith(F.substring("url", 10, 100)))).first()[:] == (100_000, 100_000)


def test_pdf_links(spark):
    rows = [(1, 0, "https://s/a/politica-privacidade.pdf", ""), (1, 1, "https://s/guia-lgpd.pdf", ""), (1, 2, "https://s/x.pdf", "Aviso de Privacidade"), (1, 3, "https://s/x.pdf", "LGPD"), (1, 4, "https://www.gstatic.com/privacy.pdf", ""), (1, 5, "https://s/p.html", "privacidade")]
    df = spark.createDataFrame(rows, "page_id int, seq int, url string, text string")
    assert [r.url for r in K.pdf_from_pages(df).orderBy("seq").collect()] == ["https://s/a/politica-privacidade.pdf", "https://s/x.pdf"]
    href = spark.createDataFrame([("https://x/\\public\\a.pdf",), ("///a//b",)], "h string").select(K.clean_href(F.col("h")).alias("h")).collect()
    assert [r.h for r in href] == ["https://x/public/a.pdf", "/a/b"]


def test_challenges(spark):
    rows = [("s", "https://www.S.com/Pol/", "CF-Mitigated", "Challenge"), ("s", "https://s.com/x", "server", "cloudflare"), ("s", "https://s.com/x", "x-datadome-cid", "1"), ("s", "https://s.com/y", "X-PX-Block", "")]
    found = K.challenges(spark.createDataFrame(rows, "site string, url string, name string, value string"))
    assert {r.page_key: r.marks for r in found.collect()} == {"s.com/pol": ["cf-mitigated"], "s.com/y": ["x-px-block"]}
    pages = spark.createDataFrame([("s", "https://s.com/pol"), ("s", "https://s.com/z")], "site string, url string")
    assert [r.url for r in K.blocked(pages, found).collect()] == ["https://s.com/pol"]
    assert [r.url for r in K.not_blocked(pages, found).collect()] == ["https://s.com/z"]


def policy(spark, candidates, pages, challenged=None, root=10):
    sites = spark.createDataFrame([("s", root)], "site string, root_bytes int")
    sel = spark.createDataFrame([("s", i, u, p) for i, (u, p) in enumerate(candidates)], "site string, pos int, url string, matched_pattern string")
    got = spark.createDataFrame([("s", k, i, b) for i, (k, b) in enumerate(pages)], "site string, page_key string, seq int, body string")
    ch = spark.createDataFrame([("s", k, ["x"]) for k in challenged], "site string, page_key string, marks array<string>") if challenged else None
    r = D.policy(sites, sel, got, ch).first()
    return r.state, r.confidence, r.method


def test_policy_ladder(spark):
    full, light = "lgpd finalidade encarregado " * 30, "apenas lgpd " * 60
    u = "https://s.com/politica-de-privacidade"
    assert policy(spark, [(u, "p")], [("/politica-de-privacidade", full)])[:2] == ("true", 0.95)
    assert policy(spark, [(u, "p")], [("/politica-de-privacidade", light)]) == ("true", 0.65, "subpage_selection+content_light_policy_link")
    assert policy(spark, [("https://s.com/privacidade.pdf", "p")], [])[2] == "subpage_selection+pdf_policy_link"
    assert policy(spark, [("https://s.com/sobre", r"\bprivacy\b")], [("/sobre", light)])[0] == "false"
    assert policy(spark, [(u, "p")], [], ["s.com/politica-de-privacidade"])[:2] == ("nao_coletado", 0.0)
    assert policy(spark, [(u, "p")], [("/outra", full)], root=0)[:2] == ("false", 0.0)


def test_channel():
    page = "<p>Contato: dpo@exemplo.com.br para exercer seus direitos</p>" + "x" * 500
    f = D.channel_features(page, "https://www.exemplo.com.br", {"encarregado"})
    assert (f["F1"], f["F2"], f["F4"], f["F7"], f["F8"]) == (1, 0, 1, 1, 1)
    assert D.channel_features("<p>Bem-vindo</p>", "https://x.com.br", set()) == {f"F{i}": 0 for i in range(1, 9)}
    assert D.channel_features(page, "https://outro.com.br", set())["F2"] == 1
    assert D.channel_features("<p>contato@x.com.br encarregado</p><form>", "https://x.com.br", set())["F3"] == 1
    assert D.channel_features("dpo@cloudflare.com", "https://x.com.br", set())["F1"] == 0


def test_channel_score(spark):
    row = spark.createDataFrame([(0,) * 8], ", ".join(f"F{i} int" for i in range(1, 9)))
    assert row.select(S.channel_probability().alias("p")).first().p == pytest.approx(0.0821567579, abs=1e-9)
    with pytest.raises(ValueError):
        S.channel_probability({"F1": F.lit(1)})
    pages = spark.createDataFrame([("s", "/z", "3"), ("s", "/", "1"), ("s", "/a", "2")], "site string, page_key string, body string")
    assert D.joined_pages(pages).first().page == "1\n2\n3"


@pytest.mark.parametrize("page,consent,want", [
    ("", False, (False, 0.0)), ('<div id="onetrust-banner-sdk">x</div>', False, (True, 0.95)), ("<p>x</p>", True, (True, 0.95)), ('<div class="cookie-bar">Este site usa cookies</div>', False, (True, 0.65)),
    ('<div class="cookie-bar" style="display: none">Este site usa cookies</div>', False, (False, 0.95)), ('<div hidden><div class="lgpd">aceitar cookies</div></div>', False, (False, 0.95)),
    ('<script src="https://cdn.termly.io/x.js"></script>', False, (True, 0.35)), ('<div class="cookie-bar">nada</div>', False, (True, 0.65)), ("<p>x</p>", False, (False, 0.95)),
])
def test_banner(page, consent, want):
    assert D.banner_verdict(page, consent)[:2] == want


def test_rules(spark):
    rows = spark.createDataFrame([("Usamos seus dados para enviar newsletter.",), ("Você pode solicitar a portabilidade.",), ("Não há transferência internacional de dados.",), ("Dados armazenados em servidores nos Estados Unidos.",)], "t string")
    got = rows.select(*[D.requirement(F.col("t"), v).alias(v) for v in ("finalidade", "direitos_titular", "transf_internacional")]).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, True, False), (False, False, False), (False, False, True)]


def test_chain_and_small_tables(spark):
    a = spark.createDataFrame([("s", 0, False, True), ("s", 1, False, False), ("s", 2, False, False), ("t", 0, True, True), ("u", 0, False, True)], "site string, step int, abort boolean, escalate boolean")
    assert {(r.site, r.step, r.outcome) for r in D.replay_chain(a).collect()} == {("s", 1, "accepted"), ("t", 0, "aborted"), ("u", 0, "exhausted")}
    assert ("JsRequiredError", "FetchError") in D.exception_closure() and ("FetchError", "FetchError") in D.exception_closure()
    c = spark.range(1).select(D.cookies(F.lit("a=b=c; Path=/x; HttpOnly; Domain=.y")).alias("c")).first().c
    assert (c.name, c.value, c.path, c.domain, c.httpOnly, c.secure) == ("a", "b=c", "/x", ".y", True, False)


RESULT = "run_id string, protocol_version string, domain_url string, variable_name string, value string, confidence double, audit_trail_json string, plugin_version string, computed_at int"


def results(spark, rows):
    return spark.createDataFrame([(r, "p", f"https://{d}", v, x, c, a, "1", t) for r, d, v, x, c, a, t in rows], RESULT)


def test_store(spark):
    old = results(spark, [("r1", "a", "v", "true", 0.9, "{}", 1), ("r1", "b", "v", '"nao_aplicavel"', 0.0, '{"extrapolacao": true}', 1)])
    new = results(spark, [("r1", "a", "v", "false", 0.8, "{}", 2), ("r2", "b", "v", "true", 0.9, "{}", 3)])
    now = store.upsert(old, new)
    assert now.count() == 3 and store.query(now, {"run_id": "r1", "domain_url": "https://a"}).first().value == "false"
    assert [r.domain_url for r in store.cohort_value(now, "v", " FALSE").collect()] == ["https://a"]
    assert [r.domain_url for r in store.cohort_flag(now).collect()] == ["https://b"]
    assert store.changes(now.where("run_id='r1'"), now.where("run_id='r2'")).count() == 1
    assert [r.s for r in spark.createDataFrame([("true",), ('"nao_coletado"',), ("0.7",), (None,)], "v string").select(store.state(F.col("v")).alias("s")).collect()] == ["true", "nao_coletado", "false", "false"]
    with pytest.raises(ValueError):
        store.criterion({"valor": 1, "mudanca": True})
    runs = spark.createDataFrame([("r1", 1, 2), ("r2", 2, 3), ("r3", 3, None)], "run_id string, started_at int, completed_at int")
    assert [r.domain_url for r in store.cohort(now, runs, {"mudanca": True}).collect()] == ["https://b"]
    assert [r.domain_url for r in store.cohort(now, runs, {"sem_resultado": "w", "limite": 5}).collect()] == ["https://b"]
    with pytest.raises(ValueError):
        store.check_collisions([{"variable": "v"}, {"variable": "v"}])
    with pytest.raises(ValueError):
        store.levels({"a": ["b"], "b": ["a"]})


def test_dependencies(spark):
    rows = spark.createDataFrame([("s", "p", "true", None, 0.9), ("s", "q", "true", None, 0.9), ("t", "p", "false", None, 0.9), ("t", "q", "true", None, 0.9), ("u", "p", "nao_coletado", None, 0.0), ("u", "q", "true", None, 0.9), ("w", "p", "nao_aplicavel", None, 0.0), ("w", "q", "false", None, 0.9)], "site string, variable_name string, state string, reason string, confidence double")
    got = store.resolve(rows, spark.createDataFrame([("q", "p")], "variable_name string, depends_on string")).where("variable_name = 'q'")
    assert {r.site: (r.state, r.reason) for r in got.collect()} == {"s": ("true", None), "t": ("nao_aplicavel", "precondicao_nao_satisfeita"), "u": ("nao_coletado", "dependencia_nao_coletada"), "w": ("nao_aplicavel", "precondicao_nao_satisfeita")}


def test_outputs(spark, tmp_path):
    audit = json.dumps({"n_sentencas_sinalizadas": 74, "n_segmentos_avaliados": 756, "motivo": "x", "sentencas": [{"posicao": 3, "escore": 0.5, "texto": "a"}]})
    rows = results(spark, [
        ("r", "sem.com", "politica", "false", 0.95, "{}", 1), ("r", "sem.com", "fin", '"nao_aplicavel"', 0.0, "{}", 1), ("r", "ruim.com", "politica", "true", 0.95, "{}", 1), ("r", "ruim.com", "fin", "false", 0.2, audit, 1),
        ("r", "nada.com", "politica", '"nao_coletado"', 0.0, '{"motivo": "dependencia_nao_coletada"}', 1), ("r", "nada.com", "fin", '"nao_coletado"', 0.0, '{"motivo": "robots_proibe"}', 2),
    ])
    wide = R.wide_rows(rows, ["politica", "fin"]).orderBy("ordem").collect()
    assert [r.dominio for r in wide] == ["sem.com", "ruim.com", "nada.com"] and wide[2].motivo == "robots_proibe"
    assert R.typed_rows(rows).where("n_segmentos_avaliados = 756").first().densidade_sinalizacao == 0.097884
    assert [tuple(r)[3:] for r in R.evidence_rows(rows).collect()] == [(3, 0.5, "a")]
    outputs = [{"name": n, "params": {"path": str(tmp_path / n), "variables": ["politica", "fin"]}} for n in ("csv", "csv_largo", "csv_evidencias", "parquet", "json")] + [{"name": "none", "params": {}}]
    done = R.render(rows, outputs, "r")
    assert [k for k, v in done.items() if v] == ["none"] and spark.read.parquet(str(tmp_path / "parquet")).count() == 6
    with pytest.raises(ValueError):
        R.render(rows, [])
    assert "| v | 1 |" in R.comparison_report([{"variable": "v", "tp": 1}], [], ["x"])


def test_custody(spark):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        for name, data in (("a.html", b"<p>1"), ("_index.json", json.dumps({"a.html": "/"}).encode())):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    arch = spark.createDataFrame([("t", buf.getvalue())], "tar_filename string, content binary")
    assert [(r.page_key, bytes(r.body)) for r in V.archive_pages(arch).collect()] == [("/", b"<p>1")]
    d = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "k int, o int, t string").groupBy("k").agg(V.sequence_digest(F.col("t"), F.col("o")).alias("d"))
    assert d.first().d == hashlib.sha256(b"a\0b\0").hexdigest()
    lines = spark.createDataFrame([("f", 0, "x a@b.co")], "file string, line_no int, line string")
    with pytest.raises(Exception, match="e-mail"):
        V.publishable(lines).collect()


def test_put_and_get(spark, tmp_path):
    folder = str(tmp_path / "store")
    pages = spark.createDataFrame([("a.com", 0, "/", b"<p>1"), ("a.com", 5000, "/x", None), ("b.com", 0, "/", b"2")], "domain_url string, seq int, page_key string, body binary")
    errors = spark.createDataFrame([("b.com", 2)], "domain_url string, errors_count int")
    one = C.put(spark, pages, folder, "r1", "p", errors)
    assert sorted((r.domain_url, r.n_pages, r.errors_count, r.protocol_version_hash) for r in one.collect()) == [("a.com", 2, 0, "p"), ("b.com", 1, 2, "p")]
    two = C.put(spark, pages.where("domain_url = 'b.com'"), folder, "r2")
    C.put(spark, pages.limit(0), folder, "r3")
    assert [r.valid for r in C.audit_chain(spark, folder).orderBy("line_no").collect()] == [True] * 3
    a = one.where("domain_url = 'a.com'")
    assert sorted((r.seq, r.page_key, r.body and bytes(r.body)) for r in C.get(spark, folder, a).collect()) == [(0, "/", b"<p>1"), (5000, "/x", None)]
    assert C.get(spark, folder, two).count() == 1
    with pytest.raises(Exception, match="no evidence of a.com"):
        C.get(spark, folder, a.withColumn("sha256", F.lit("0" * 64))).collect()
    with pytest.raises(ValueError, match="run_id"):
        C.put(spark, pages, folder, "")
    batch = two.first().batch  # pages that were changed afterwards
    pages.where("domain_url = 'b.com'").withColumn("body", F.lit(b"3")).withColumn("seq", F.col("seq").cast("long")).write.mode("overwrite").parquet(f"{folder}/pages/run_id=r2/batch={batch}")
    with pytest.raises(Exception, match="digest differs for b.com"):
        C.get(spark, folder, two).collect()
    spark.createDataFrame([("t", "0" * 64, "c.com", 1, 0)], "tar_filename string, sha256 string, domain_url string, n_pages long, errors_count long").write.mode("append").parquet(f"{folder}/manifest/run_id=r2/batch={batch}")
    assert [r.valid for r in C.audit_chain(spark, folder).orderBy("line_no").collect()] == [True, False, True]


def test_cached_list(spark, tmp_path):
    plain, folder = b"1,A.com.br\nx,b.br\n3\n4,\n5,c.gov.br\n", str(tmp_path / "cache")
    for name, data in (("p", plain), ("z", gzip.compress(plain))):
        f = tmp_path / name
        f.write_bytes(data)
        row = I.cache_list(spark, str(f), folder, name, 10).first()
        assert (row.received_as_gzip, row.received_bytes, row.byte_size) == (name == "z", len(data), len(row.content))
        assert row.sha256 == hashlib.sha256(row.content).hexdigest() and gzip.decompress(row.content) == plain
        f.unlink()
        again = I.cache_list(spark, str(f), folder, name, 10)  # a hit does not read the source
        assert again.first() == row
        assert [(r.rank, r.url) for r in I.ranked_domains(I.cached_lines(again)).collect()] == [(1, "https://a.com.br"), (5, "https://c.gov.br")]
    with pytest.raises(Exception, match="digest differs for list z"):
        I.cached_lines(again.withColumn("sha256", F.lit("x"))).collect()


def test_ratings(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>nota</t></is></c></row><row r="2"><c r="A2"><v>7</v></c></row><row r="3"><c r="A3"><v>8</v></c><c r="C3" t="s"><v>1</v></c></row>'
    f = tmp_path / "r.xlsx"
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="um" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>id</t></si><si><r><t>s</t></r><r><t>im</t></r></si></sst>')
    got = I.read_ratings(spark, str(f), "um")
    assert got.columns == ["id", "_1", "nota"] and sorted(map(tuple, got.collect())) == [("7", None, None), ("8", None, "sim")]
    with pytest.raises(ValueError, match="no sheet dois"):
        I.read_ratings(spark, str(f), "dois")
    g = tmp_path / "r.csv"
    g.write_text("\ufeffid;nota\n7;a,b\n8;\n")
    assert sorted(map(tuple, I.read_ratings(spark, str(g)).collect())) == [("7", "a,b"), ("8", "")]


def test_urls(spark):
    r = spark.createDataFrame([("https://www.X.com/A/b/",)], "u string").select(U.host(F.col("u")).alias("h"), U.page_key(F.col("u")).alias("k"), U.path(F.lit("http://x")).alias("p")).first()
    assert tuple(r) == ("www.x.com", "x.com/a/b", "/")


YAML = b"""
metadata: {protocol_version: p1}
repository: {name: x}
result_store: {name: x}
fetcher: {name: x}
tests:
- {name: toy_policy, variable: politica}
- {name: toy_text, variable: fin, params: {depende_de: [politica]}}
outputs: []
"""


def test_protocol(spark):
    @P.plugin("test", "toy_policy")
    def toy_policy(evidence, params):
        return evidence["pages"].select("site", F.when(F.col("body").contains("lgpd"), "true").otherwise("false").alias("state"), F.lit(0.95).alias("confidence"))

    @P.plugin("test", "toy_text")
    def toy_text(evidence, params):
        return evidence["pages"].select("site", F.lit("true").alias("state"), F.lit(0.7).alias("confidence"))

    proto = P.Protocol(YAML)
    pages = spark.createDataFrame([("a", "lgpd"), ("b", "x")], "site string, body string")
    sample = spark.createDataFrame([("a",), ("b",), ("c",)], "site string")
    rows = {(r.domain_url, r.variable_name): r.value for r in P.analyse(spark, proto, {"pages": pages}, "r", sample).collect()}
    assert rows == {("a", "politica"): "true", ("a", "fin"): "true", ("b", "politica"): "false", ("b", "fin"): '"nao_aplicavel"', ("c", "politica"): '"nao_coletado"', ("c", "fin"): '"nao_coletado"'}
    with pytest.raises(ValueError):
        P.Protocol(b"metadata: {}")
    with pytest.raises(KeyError):
        P.resolve("test", "none")
    assert "csv_largo" in P.list_plugins()["output"] and "sha256: abc" in proto.declare_list("abc")


def test_models(spark, tmp_path):
    docs = spark.createDataFrame([(i, "usamos dados pessoais para marketing" if i % 2 else "bem vindo ao site da empresa", i % 2) for i in range(12)], "id long, text string, y int")
    from glasshouse.operators import train as M

    vocabulary, intercept = M.fit_text(docs, "id", "y")
    p = {r.id: r.probability for r in S.probabilities(docs.unionByName(spark.createDataFrame([(99, "", 0)], docs.schema)), ["id"], vocabulary, intercept).collect()}
    assert min(p[i] for i in range(1, 12, 2)) > max(p[i] for i in range(0, 12, 2))
    assert p[99] == pytest.approx(1 / (1 + 2.718281828459045 ** -intercept))
    sha = S.write_model(vocabulary.select("term", "idf", "coef"), {"kind": "text", "version": "1"}, str(tmp_path / "m"))
    again, meta = S.read_model(spark, str(tmp_path / "m"), sha, "text", "1")
    assert again.count() == vocabulary.count()
    for wrong in ({"sha256": "0" * 64}, {"kind": "dense"}, {"version": "2"}):
        with pytest.raises(ValueError):
            S.read_model(spark, str(tmp_path / "m"), **wrong)
    assert S.coverage(docs.limit(1), ["id"], vocabulary).first().coverage == 1.0
