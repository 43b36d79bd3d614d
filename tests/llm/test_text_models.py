"""Tokens, packing, language, media, pages and licences."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from glasshouse.llm import bpe, html_extract, langid, license_scan, media, packing  # noqa: E402

SCHEMA = "doc_id long, text string, ids int, piece string, media string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash", "clash") for i, t in rows], SCHEMA)


def odd_texts(n=400, seed=1):
    r = random.Random(seed)
    letters = "abzAZ'\"sStTdDlrevm0129 \t\n\x0b\x1c\x85\xa0.,!<|>éÉÑßİıΣς中文١²Ⅷ́‍ 　😀ǅ"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(n)] + ["<|endoftext|>x<|startoftext|> Y", "", "x" * 3000, "ab" * 2000 + "!" * 300, "don't 'started it's ''s I'LL"]


def test_bpe_is_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    theirs, own = Tokenizer.from_file(path), bpe.WordTokenizer(path)
    for t in odd_texts():
        want = theirs.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want
        assert own.decode(want) == theirs.decode(want, skip_special_tokens=False) == " ".join(p[1] for p in own.parts(t))


def test_bpe_cuts_are_certain():
    own = bpe.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for token in list(own.vocab)[:5000]:
        if token.endswith("</w>") and len(token) > 4:
            assert own.cut(token[:-4]) == [token[:-4]]


def test_bpe_columns(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, None), (None, ""), (2, "Hello, world"), (2, "Hello, world")]
    got = bpe.digests(frame(spark, rows), path).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256) for r in got if r.doc_id != 2] == [(0, empty)] * 2
    ids = bpe.encode(frame(spark, rows), path).where("doc_id = 2").first()
    assert got[-1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids.ids)).encode()).hexdigest()
    assert bpe.digests(frame(spark, []), path).count() == 0


def test_byte_ids_are_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    for t in odd_texts(seed=2):
        assert packing.token_ids(t, path).tolist() == theirs.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("make", [lambda r: (r.lognormal(6.5, 1, 3000) + 1).astype(int), lambda r: r.integers(1, 5000, 2000), lambda r: np.full(700, 700), lambda r: np.array([], dtype=int)])
def test_plan_uses_the_histogram_up(make):
    h = np.zeros(2049, dtype=np.int64)
    for n in make(np.random.default_rng(3)):
        cuts = [*packing.piece_starts(int(n), 2048), int(n)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            h[b - a] += 1
    used, count = np.zeros_like(h), 0
    for lengths, n in packing.plan(h):
        assert 0 < sum(lengths) <= 2048 and n > 0
        count += n
        for v in lengths:
            used[v] += n
    assert (used == h).all()
    alone = sum(n for _, n in packing.best_fit(h))
    assert count <= alone * 1.01 + 1


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(["lorem", "ipsum", "dolor", "amet"], k=r.choice([0, 3, 50, 400, 900, 3000])))) for i in range(60)] + [(100, None), (None, "x"), (5, "repeated"), (5, "repeated")]
    got = packing.pack(spark, frame(spark, rows), path).collect()
    places = {}
    for p in got:
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in places.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    for i, t in rows[:60]:
        ids = np.append(packing.token_ids(t, path), np.uint32(0)).astype("<u4")
        mine = sorted((p.piece, p.start, p.length, p.ids_crc32) for p in got if p.doc_id == i and i != 5)
        if i != 5:
            assert [m[1] for m in mine] == packing.piece_starts(len(ids), 2048)
            assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in mine)
            assert all(m[2] == 2048 for m in mine[1:])
    assert len(places) <= 1.05 * math.ceil(sum(p.length for p in got) / 2048) + 1
    assert packing.pack(spark, frame(spark, []), path).count() == 0


def brute_marginals(scores, moves):
    import itertools

    n, k = scores.shape
    total, out = 0.0, np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        p = math.exp(sum(scores[i, path[i]] for i in range(n)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += p
        for i, y in enumerate(path):
            out[i, y] += p
    return out / total, math.log(total)


def test_forward_backward():
    r = np.random.default_rng(5)
    scores, moves, lengths = r.normal(size=(2, 5, 3)), r.normal(size=(3, 3)), np.array([5, 3])
    got, _, logz = langid.forward_backward(scores, lengths, moves)
    want = [brute_marginals(scores[i, : lengths[i]], moves) for i in range(2)]
    for i in range(2):
        assert np.allclose(got[i, : lengths[i]], want[i][0])
    # the start is uniform over the labels, which takes a constant from each chain
    assert logz == pytest.approx(sum(w[1] for w in want) - 2 * math.log(3))


def test_pieces_are_the_uncut_chain():
    """Texts of one and of many pieces, word by word as the whole chain has it."""
    r = np.random.default_rng(8)
    k, sizes = 4, [0, 1, 31, 32, 33, 64, 65, 200, 0, 997]
    first = np.r_[0, np.cumsum(sizes)]
    scores, moves = r.normal(size=(first[-1], k)) * 3, r.normal(size=(k, k)) * 2
    begin, lengths, text = langid.pieces_of(first)
    enter, leave = langid.boundaries(scores, begin, lengths, text, moves)
    got = np.zeros_like(scores)
    marginal, _, _ = langid.forward_backward(langid.padded(scores, begin, lengths, langid.PIECE), lengths, moves, enter, leave)
    for i, (a, n) in enumerate(zip(begin, lengths)):
        got[a : a + n] = marginal[i, :n]
    for a, n in zip(first[:-1], sizes):
        if n:
            want, _, _ = langid.forward_backward(scores[None, a : a + n], np.array([n]), moves)
            assert np.allclose(got[a : a + n], want[0])


def sentences(lang, n, seed):
    r = random.Random(seed)
    words = {"en": "the and of thing with house water would there".split(), "de": "der und nicht haus wasser über straße möchte dort".split()}[lang]
    return [" ".join(r.choices(words, k=40)) for _ in range(n)]


def test_language(spark):
    model = langid.fit(sentences("en", 30, 1) + sentences("de", 30, 2), ["en"] * 30 + ["de"] * 30)
    labels, scores = model.predict(pa.array([*sentences("en", 5, 3), *sentences("de", 5, 4), "", "123 !"], pa.large_string()))
    assert labels == ["en"] * 5 + ["de"] * 5 + ["und"] * 2 and min(scores[:10]) > 0.8 and scores[10:] == [0.0, 0.0]
    mixed = pa.array([sentences("en", 1, 5)[0] + " " + sentences("de", 1, 6)[0]], pa.large_string())
    p, _ = model.word_probabilities(mixed)
    assert (p[:35].argmax(1) == 1).all() and (p[45:].argmax(1) == 0).all()  # labels are in order: de, en
    rows = [(i, t) for i, t in enumerate(sentences("en", 10, 7))] + [(50, None), (51, " 12 "), (None, "the house")]
    got = {r.doc_id: r for r in langid.identify(spark, frame(spark, rows), model).collect()}
    assert got[3].lang_pred == "en" and got[50].lang_pred == "und" and got[None].held_out is False
    assert got[3].held_out == (zlib.crc32(b"3") % 4 == 2)
    assert langid.identify(spark, frame(spark, []), model).count() == 0
    none = langid.fit([], [])
    assert none.predict(pa.array(["abc"], pa.large_string())) == (["und"], [0.0])
    kept = langid.keep_identified(spark, frame(spark, rows), model)
    assert kept.columns == ["doc_id", "text", "ids", "piece", "media"] and kept.count() == 11


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(spark, docs, per_label=60)
    rows = langid.identify(spark, docs, model).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95


@pytest.mark.parametrize("data", [b"", b"a" * 576, bytes(range(255)) * 5, "é中".encode() * 400])
def test_media_round_trip(data):
    avi = media.store(data)
    samples, micros = media.read_samples(avi)
    assert samples.tobytes() == data + b"\xff" * (len(samples) * 576 - len(data)) and micros == 40000
    place, size = media.riff_frames(avi)[0][-1]
    head = media.frame_head()
    luma = media.decode_luma(media.Tables(head), avi[place + len(head) : place + size - 2])  # the general decoder agrees, pixel by pixel
    assert luma.shape == (192, 192) and (luma.reshape(24, 8, 24, 8) == samples[-1].reshape(24, 1, 24, 1)).all()


def coded_gradient(width=16, height=16):
    """A small baseline frame with AC coefficients, written bit by bit with one flat Huffman table."""
    import struct

    seg = media._segment
    symbols = bytes(range(12)) + bytes([0x11, 0x21, 0xF0, 0x12])
    table = bytes([0] * 4 + [16] + [0] * 11) + symbols  # sixteen codes of five bits
    head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([4] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0])) + seg(0xC4, b"\x00" + table) + seg(0xC4, b"\x10" + table) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    bits = ""
    for dc in (3, -2, 1, 0):
        n = abs(dc).bit_length()
        bits += format(symbols.index(n), "05b") + (format(dc if dc > 0 else dc + (1 << n) - 1, f"0{n}b") if n else "")
        bits += format(symbols.index(0x02), "05b") + "10"  # first AC coefficient: 2
        bits += format(symbols.index(0), "05b")
    bits += "1" * (-len(bits) % 8)
    return head, int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")


def test_general_frames(spark):
    head, coded = coded_gradient()
    luma = media.decode_luma(media.Tables(head), coded)
    x = np.arange(8)
    wave = 8 * np.sqrt(1 / 8) * np.sqrt(2 / 8) * np.cos((2 * x + 1) * np.pi / 16)
    assert luma.shape == (16, 16) and np.allclose(luma[0, :8], np.rint(128 + 12 / 8 + wave), atol=1)
    avi = media.write_avi([head + coded + b"\xff\xd9"] * 3, 16, 16)
    samples, _ = media.read_samples(avi)
    assert samples.shape == (3, 4)
    rows = spark.createDataFrame([(1, avi), (2, None), (3, b"RIFFxxxx"), (4, avi[:100])], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.scan_media(rows).collect()}
    assert got[1].n_frames == 3 and got[1].shots == 1 and got[2].n_frames is None and got[3].error and got[4].error


def test_usual_tables_restarts_and_thumbnails():
    """A frame without its own tables, one in restart intervals and one with a whole frame inside of a segment, beside the plain one."""
    import struct

    for kind in media.USUAL:
        body = media.usual_table(kind)
        assert sum(body[1:17]) == len(body) - 17 == (12 if kind < 16 else 162) and len(set(body[17:])) == len(body) - 17
    seg = media._segment
    quant, shape, scan = seg(0xDB, b"\0" + bytes([8] * 64)), seg(0xC0, struct.pack(">BHHB", 8, 8, 32, 1) + bytes([1, 0x11, 0])), seg(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    tables = seg(0xC4, media.usual_table(0x00)) + seg(0xC4, media.usual_table(0x10))
    codes = {(n, media.Tables(b"\xff\xd8" + quant + shape + tables + scan).codes[0][n]): None for n in media.Tables(b"\xff\xd8" + quant + shape + tables + scan).codes[0]}
    dc = {symbol: format(code, f"0{n}b") for (n, code), symbol in codes}

    def coded(differences):
        bits = ""
        for d in differences:
            n = abs(d).bit_length()
            bits += dc[n] + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "") + "1010"  # end of block
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")

    levels = [5, -3, 60, 60]
    plain = coded(np.diff([0, *levels]).tolist())
    inside = b"\xff\xd8" + quant + tables + shape + scan + b"x\xff\xd9"
    frames = [
        b"\xff\xd8" + quant + tables + shape + scan + plain, b"\xff\xd8" + quant + shape + scan + plain, b"\xff\xd8" + seg(0xE0, inside) + quant + shape + scan + plain,
        b"\xff\xd8" + quant + seg(0xDD, b"\0\1") + shape + scan + b"".join(coded([v]) + bytes([0xFF, 0xD0 + i]) for i, v in enumerate(levels))[:-2],
    ]
    samples, _ = media.read_samples(media.write_avi([f + b"\xff\xd9" for f in frames], 32, 8))
    assert samples.tolist() == [[128 + v for v in levels]] * 4


def test_several_riff_parts():
    one = media.store(b"a" * 576 * 3)
    frames, _ = media.riff_frames(one)
    chunks = b"".join(media._chunk(b"00dc", one[a : a + n]) for a, n in frames[:2])
    two = one + media._chunk(b"RIFF", b"AVIX" + media._chunk(b"LIST", b"movi" + media._chunk(b"LIST", b"rec " + chunks)))
    assert media.read_samples(two)[0].tobytes() == b"a" * 576 * 5


def test_damaged_media_give_an_error():
    """Cut short and with bytes changed, own frames and general ones: a reason or a result, never an exception."""
    r = random.Random(3)
    head, coded = coded_gradient()
    for data in (media.store(b"some text" * 300), media.write_avi([head + coded + b"\xff\xd9"] * 3, 16, 16)):
        for _ in range(250):
            x = bytearray(data[: r.randint(0, len(data))] if r.random() < 0.5 else data)
            for _ in range(r.randint(0, 6)):
                if x:
                    x[r.randrange(len(x))] = r.randrange(256)
            out = media._scanned(bytes(x), False)
            assert out.get("error") or out["n_frames"] >= 0
    zero = bytearray(head)
    zero[zero.index(b"\xff\xc0") + 11] = 0  # sampling factors
    assert media._scanned(media.write_avi([bytes(zero) + coded + b"\xff\xd9"], 16, 16), False)["error"]


def test_long_text_round_trip(spark):
    text = "\u00e9long " * 150_000
    r = media.digests(frame(spark, [(1, text)])).first()
    assert r.n_bytes == len(text.encode()) and r.payload_sha256 == hashlib.sha256(text.encode() + b"\xff" * (-len(text.encode()) % 576)).hexdigest()
    assert r.clips[0].start_s == 0 and r.clips[-1].end_s == pytest.approx(r.n_frames * 0.04) and len(r.clips) == r.shots


def test_shots(spark):
    calm, other = np.full((1, 576), 10, np.uint8), np.full((1, 576), 200, np.uint8)
    found, diff = media.shots(np.concatenate([calm] * 10 + [other] * 7 + [calm] * 5))
    assert found == [(0, 9), (10, 16), (17, 21)] and diff.max() == 1
    scanned = media.scan_media(media.to_media(frame(spark, [(1, "ab" * 3000), (2, None)])))
    assert media.clip_rows(scanned).where("doc_id = 2").count() == 1
    assert media.digests(frame(spark, [])).count() == 0
    r = media.digests(frame(spark, [(1, "é" * 300), (None, None), (1, "é" * 300)])).collect()
    assert (r[0].n_bytes, r[0].payload_bytes, r[1].n_bytes, r[1].payload_bytes) == (600, 1152, 0, 576)
    assert r[0].payload_sha256 == hashlib.sha256("é".encode() * 300 + b"\xff" * 552).hexdigest() and r[0].feature == r[2].feature


PAGE = '<html><head><title>x</title></head><body><header><h1>Site</h1></header><nav><a href="/">Menu {n}</a></nav><div class="cookie-notice">We use cookies</div>{main}<div class="comments"><p>Comment {n}</p></div><aside>Side {n}</aside><form><label>Mail</label></form><footer>Imprint</footer></body></html>'


def test_pages(spark):
    rows = []
    for n in range(30):
        body = f"<h2>Title {n} &amp; more</h2><p>First <i>pa</i>ragraph number {n}\n with text that is long enough.<p>Second {n * 7} &lt;b&gt;</p>"
        rows.append((n, f"https://a.com/{n}", PAGE.format(n=n, main=f"<article>{body}</article>")))
        rows.append((100 + n, f"https://b.com/{n}", PAGE.format(n=n, main=f'<div class="content">{body}<div class="sponsored">Buy {n}</div></div><div>Always the same line</div>')))
    rows += [(900, "https://c.com/x", None), (901, None, "just text"), (902, "https://d.com", PAGE.format(n=1, main="<main><p>Only page</p></main>"))] + [(903 + i, "https://e.com/copy", PAGE.format(n=1, main="<article><p>Copied page</p></article>")) for i in range(25)]
    got = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")).collect()}
    for n in range(30):
        want = f"Title {n} & more First paragraph number {n} with text that is long enough. Second {n * 7} <b>"
        assert got[n].text == want and got[100 + n].text == want and got[n].n_chars == len(want)
    assert (got[900].text, got[901].text, got[902].text, got[910].text) == ("", "just text", "Only page", "Copied page")
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tree_matching():
    tree = lambda s: html_extract.Group([html_extract.parse(s)])
    a, b = tree("<div><p>x</p><ul><li>1<li>2</ul></div>"), tree("<div><ul><li>1</ul><p>x</p></div>")
    assert html_extract.similarity(a, a) == 5 and html_extract.similarity(a, b) == 4
    assert [x is None for x, _ in html_extract.match(a.children[0].children, b.children[0].children)].count(True) == 1


def test_all_page_articles(spark):
    """Brute force on generated pages: the article's blocks, by plain patterns."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"(?s)<article>(.*?)(</article>|<footer>|$)", r.html)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1)>|<br>", " ", article))).split())


def test_licences(spark):
    texts = [
        ("/a/LICENSE", "Some words\nReleased under the MIT License."), ("/a/b/c/x.py", "print(1)"), ("/a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"), ("/z/q.py", None), ("noroot", ""),
        ("/a/other.txt", "This work is licensed under the GNU General Public License, version 3."), (None, "Licensed under CC BY 4.0."), ("/a/b/c/x.py", "print(1)"), ("/a/d/w.py", "the license of this thing is unknown to all of us"),
    ]
    files = spark.createDataFrame([(i, p, t, "clash") for i, (p, t) in enumerate(texts)], "id long, path string, text string, dir string")
    got = {r.id: r for r in license_scan.scan(spark, files).collect()}
    assert [got[i].own for i in range(9)] == ["MIT", None, "Apache-2.0", None, None, "GPL-3.0", "CC-BY-4.0", None, None]
    assert (got[1].license, got[1].inherited_from, got[1].distance) == ("Apache-2.0", "/a/b", 1) and (got[8].license, got[8].inherited_from, got[8].distance) == ("MIT", "/a", 1)
    assert got[3].license is None and got[4].license is None and got[7].license == "Apache-2.0" and len(got) == 9
    assert license_scan.scan(spark, files.where("false")).count() == 0
    # brute force: every line against every template
    n = len(texts)
    df = Counter(t for _, x in texts for t in {u for line in (x or "").split("\n") for u in license_scan.terms(line)})
    idf = lambda t: math.log((1 + n) / (1 + (df[t] if any(t in license_scan.terms(x) for _, x in license_scan.TEMPLATES) else 0))) + 1

    def unit(x):
        v = {t: c * idf(t) for t, c in Counter(license_scan.terms(x)).items()}
        norm = math.sqrt(sum(w * w for w in v.values())) or 1
        return {t: w / norm for t, w in v.items()}

    for i, (_, text) in enumerate(texts):
        best = max(sum(w * unit(t).get(k, 0) for k, w in unit(line).items()) for line in (text or "").split("\n") for _, t in license_scan.TEMPLATES)
        assert (got[i].score is None) == (best < 0.8) and (got[i].score is None or got[i].score == pytest.approx(best, abs=1e-6))


def test_licence_headers_over_lines_and_whole_files(spark):
    def wrapped(text):
        import textwrap

        return "\n".join("# " + line for line in textwrap.wrap(text, 60))

    by = [k for k, (name, text) in enumerate(license_scan.TEMPLATES) if len(text) > 100]
    texts = [(f"/h/{k}/x.py", "import os\n" + wrapped(license_scan.TEMPLATES[k][1]) + "\nprint(1)") for k in by]
    full = dict(license_scan.full_texts())
    texts += [(f"/f/{name}/LICENSE", "Copyright 2020 A. Holder\n" + text) for name, text in full.items()]
    texts += [("/p/x.txt", "This tool is made by us and released under the MIT License. All other rights stay with us."), ("/f/GPL-2.0/src/x.py", "print(1)"), ("/n/LICENSE", "You may ask us for a license of this software.")]
    got = {r.path: r for r in license_scan.scan(spark, spark.createDataFrame([(i, *r) for i, r in enumerate(texts)], "id long, path string, text string")).collect()}
    assert [got[f"/h/{k}/x.py"].own for k in by] == [license_scan.TEMPLATES[k][0] for k in by] and all(got[f"/h/{k}/x.py"].line == 1 for k in by)
    assert {n: got[f"/f/{n}/LICENSE"].own for n in full} == {n: n for n in full}
    assert got["/p/x.txt"].own == "MIT" and got["/n/LICENSE"].own is None
    assert (got["/f/GPL-2.0/src/x.py"].license, got["/f/GPL-2.0/src/x.py"].distance) == ("GPL-2.0", 1)


def test_licence_tags(spark):
    texts = [(f"/{k}/x.c", f"/* SPDX-License-Identifier: {n} */\nint x;") for k, n in enumerate(["MIT", "Apache-2.0", "GPL-3.0-or-later", "BSD-2-Clause", "Zlib"])] + [("/long/x.c", "word " * 200_000 + "SPDX-License-Identifier: ISC")]
    got = {r.path: r.own for r in license_scan.scan(spark, spark.createDataFrame([(i, *r) for i, r in enumerate(texts)], "id long, path string, text string")).collect()}
    assert [got[p] for p, _ in texts] == ["MIT", "Apache-2.0", "GPL-3.0", "BSD-2-Clause", None, "ISC"]


def words(n, count=12):
    r = random.Random(n)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(count))


def extracted(spark, pages):
    rows = [(n, "https://h.com/x", PAGE.format(n=n, main=main)) for n, main in enumerate(pages)]
    return [r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).orderBy("page_id").collect()]


def test_html_layout_beside_articles(spark):
    """A second layout without article keeps its text; the template decides, not the element."""
    got = extracted(spark, [f"<article><p>{words(n)}</p></article>" if n % 3 else f'<div class="story"><p>{words(n)}</p></div>' for n in range(30)])
    assert got == [words(n) for n in range(30)]


def test_html_two_layouts_without_articles(spark):
    got = extracted(spark, [f'<div class="post"><p>{words(n, 40)}</p></div>' if n % 7 else f'<div class="story"><p>{words(n)}</p></div><div>Always the same line</div>' for n in range(42)])
    assert got == [words(n, 40) if n % 7 else words(n) for n in range(42)]


def test_html_copies_are_no_template(spark):
    copy = words(0)
    got = extracted(spark, [f'<div class="post"><p>{copy if n < 8 else words(n)}</p><div class="day">Day {n}</div></div>' for n in range(10)])
    assert got == [f"{copy if n < 8 else words(n)} Day {n}" for n in range(10)]


def test_html_constant_lines_are_counted_exactly(spark):
    """A line on all pages of a long slot goes, however many texts the slot has."""
    line = "Read more of this in our printed edition"
    got = extracted(spark, ["<article>" + "".join(f"<p>{words(100 * n + i)}</p>" for i in range(15)) + f"<p>{line}</p></article>" for n in range(60)])
    assert got == [" ".join(words(100 * n + i) for i in range(15)) for n in range(60)]


INNER = '<div class="entry-header"><h1>Head {w}</h1></div><section class="comments-policy"><p>Policy {w}</p></section><p class="promo-code">Code {w}</p><div class="share-price">Price {w}</div><p><a href="/x">Linked {w}</a></p><math><mi>{w}</mi></math><header>Part {w}</header><p>{long}</p>'


@pytest.mark.parametrize("box", ["<article>{}</article>", '<div class="post">{}</div>', "<div>{}</div>"])
def test_html_keeps_what_an_article_names_like_furniture(spark, box):
    """Headings, policies, codes, prices, linked paragraphs and formulas of an article stay; whole names, notices and comments go."""
    outer = '<div class="site-notice"><p>Notice {w}</p></div>{box}<div class="comments-area"><h2>{w}</h2><p>Says {w}</p></div>'
    pages = []
    for n in range(12):
        inner = INNER.replace("{w}", words(1000 + n, 2)).replace("{long}", words(n, 40)) + f'<div class="advert">Buy {n}</div><div class="comments"><p>Own {n}</p></div><form>Mail {n}</form>'
        pages.append(outer.replace("{w}", words(2000 + n, 2)).replace("{box}", box.format(inner)))
    want = [" ".join([f"{x} {words(1000 + n, 2)}".strip() for x in ("Head", "Policy", "Code", "Price", "Linked", "", "Part")] + [words(n, 40)]) for n in range(12)]
    assert extracted(spark, pages) == want


def test_html_headline_beside_the_content(spark):
    """A heading that differs between pages is content in any header; one that is the same on all is not (PAGE has one)."""
    got = extracted(spark, [f'<div class="entry"><div class="entry-header"><h1>{words(n, 3)}</h1></div><div class="entry-content"><p>{words(n + 50, 30)}</p></div></div>' for n in range(9)])
    assert got == [f"{words(n, 3)} {words(n + 50, 30)}" for n in range(9)]


def test_html_is_the_same_under_any_partitioning(spark, monkeypatch):
    """Irregular pages in other orders and partitions, folded in one step or in several."""
    r = random.Random(6)
    rows = []
    for n in range(120):
        parts = [r.choice([f"<p>{words(n * 50 + k)}</p>", f'<div class="box{r.choice("abcdef")}"><h2>{words(k, 2)}</h2><ul><li>{words(n + k, 4)}</ul></div>', "<table><tr><td>Same cell</table>", f"<section><p>{words(n, 5)}</p></section>"]) for k in range(r.randint(1, 7))]
        rows.append((n, f"https://h{n % 2}.com/x", PAGE.format(n=n, main="".join(parts))))
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = {tuple(x) for x in html_extract.main_text(docs.coalesce(1)).collect()}
    monkeypatch.setattr(html_extract, "FOLD", 1000)
    assert one == {tuple(x) for x in html_extract.main_text(docs.orderBy(docs.page_id.desc()).repartition(7)).collect()}
    monkeypatch.setattr(html_extract, "FOLD", 8)
    many = {tuple(x) for x in html_extract.main_text(docs.repartition(3)).collect()}
    assert many == {tuple(x) for x in html_extract.main_text(docs.coalesce(1)).collect()} and len(many) == 120 and sum(len(x[2]) > 10 for x in many) > 100


def test_html_deep_and_long_pages(spark):
    """Ten thousand levels, unclosed or not, and two million characters."""
    deep = "<div>" * 10_000 + "<p>Deep text</p>" + "</div>" * 10_000 + "<p>After it</p>"
    open_ = "<section><div>" * 5_000 + "Open text"
    long = "".join(f"<p>{words(n)}</p>" for n in range(20_000))
    got = extracted(spark, [deep, f"<p>{open_}", f"<article>{long}</article>"])
    assert got[0].startswith("Deep text After it") and "Open text" in got[1] and got[2] == " ".join(words(n) for n in range(20_000))


def test_html_constant_is_one_rule():
    """By Wilson's lower bound, for any number of bodies."""
    least = {m: min(n for n in range(1, m + 1) if html_extract.constant(n, m)) for m in (3, 4, 20, 1000, 100_000)}
    assert least == {3: 3, 4: 4, 20: 14, 1000: 527, 100_000: 50_261} and not html_extract.constant(2, 2)
