"""Markup is taken in pieces: Python's memory follows neither the batch nor its number of pages."""

import tracemalloc

import pyarrow as pa

from glasshouse.functions import html as H
from glasshouse.operators import links

PAGE = "<p>Some visible words</p>" + "".join(f'<a href="/page/{i}" title="t">link {i}</a>' for i in range(200))


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def batch(n):
    return pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": ["http://h.example.com/"] * n, "html": pa.array([PAGE] * (n - 2) + [None, ""], pa.string())})


def test_visible_text_of_a_large_batch(monkeypatch):
    monkeypatch.setattr(H, "STEP_BYTES", 1 << 16)
    few, many = batch(20), batch(100)
    assert peak(lambda: H.visible.func(many.column("html"))) < 1.5 * peak(lambda: H.visible.func(few.column("html")))


def test_links_of_a_large_batch(monkeypatch):
    monkeypatch.setattr(H, "STEP_BYTES", 1 << 16)
    few, many = batch(20), batch(100)
    assert peak(lambda: sum(b.num_rows for b in links.anchor_rows([many]))) < 1.5 * peak(lambda: sum(b.num_rows for b in links.anchor_rows([few])))


def test_pieces_give_every_page(monkeypatch, spark):
    monkeypatch.setattr(H, "STEP_BYTES", 100)
    texts = ["<p>a</p>", None, "", "<b>x</b>" * 100, "<p>z</p>y"] * 5
    assert H.each(pa.array(texts), H.visible_of, pa.string()).to_pylist() == [H.visible_of(t) for t in texts]
    assert H.each(pa.array(texts)[3:9], H.visible_of, pa.string()).to_pylist() == [H.visible_of(t) for t in texts[3:9]]
    assert H.each(pa.array([], pa.string()), H.visible_of, pa.string()).to_pylist() == []
    rows = spark.createDataFrame([(i, "http://h.example.com/", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    got = {r.page_id: (r.v, r.b) for r in rows.select("page_id", H.visible("html").alias("v"), H.blocks("html").alias("b")).collect()}
    assert got == {i: (H.visible_of(t), H.blocks_of(t)) for i, t in enumerate(texts)}
