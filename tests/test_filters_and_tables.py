"""Text filters, font profiles, catalogs of tables, extracted documents, flat contents, and orders."""

from __future__ import annotations

import html
import json

import pytest
from pyspark.sql import functions as F

from foliant.operators import assembly, catalogs, filters, fonts, recipients, toc, usage, volumes
from foliant.sources import container
from tests.test_volumes import book, page, read, write

CASES = [
    ("bidi-cleanup", '<p><span dir="rtl">a <b>b</b></span> c<span dir="ltr" class="x">d</span><span dir="auto">e</span></p>', '<p>a <b>b</b> c<span dir="ltr" class="x">d</span><span dir="auto">e</span></p>'),
    ("docx-cleanup", "<div><p><span>a</span><span><span>b</span></span>c</p></div><h2> <br />x<br /></h2><h1><span> </span></h1>t", "<p>abc</p><h2>x</h2>t"),
    ("empty-blocks", "<p> </p><p>a</p>b<p><br /></p><p><img /></p><p><span> </span></p>c", "<p>a</p>b<p><img /></p>c"),
    ("arabic-punctuation", "<p>ا ، ب؟   ج</p> ؛  د", "<p>ا، ب؟ ج</p>؛ د"),
    ("docx-header-pagebreaks", "<h1>a</h1><h3>b</h3><h2>c</h2><p>d</p><h1>e</h1>", f"<h1>a</h1><h3>b</h3>{filters.PAGE_BREAK.replace('></p>', ' />')}<h2>c</h2><p>d</p>{filters.PAGE_BREAK.replace('></p>', ' />')}<h1>e</h1>"),
    ("rtl-wrap", "a<p>b</p>c", '<div dir="rtl" lang="ar">a<p>b</p>c</div>'),
]


@pytest.mark.parametrize(("name", "before", "after"), CASES)
def test_filters(name, before, after):
    assert filters.applied(before, [name]) == after and filters.applied(after, [name]) == after


def test_filtered_pages(spark):
    rows = [(1, "<p> </p><p>a ،</p>", ["empty-blocks", "arabic-punctuation"]), (2, "<p>", ["rtl-wrap"]), (3, None, ["rtl-wrap"]), (4, "<p>x</p>", []), (5, "<p>x</p>", None), (6, "x", ["unknown", "rtl-wrap"])]
    out = filters.filtered(spark.createDataFrame(rows, "id INT, html STRING, filters ARRAY<STRING>"))
    assert {r.id: r.html for r in out.collect()} == {1: "<p>a،</p>", 2: "<p>", 3: None, 4: "<p>x</p>", 5: "<p>x</p>", 6: '<div dir="rtl" lang="ar">x</div>'}


def test_fonts(spark):
    folders = [
        ("amiri", 0, json.dumps({"label": "Amiri", "family": "Old"}), ["regular.ttf"]), ("amiri", 1, json.dumps({"regular": "b.otf", "family": 'A"m', "x": None}), ["a.ttf", "b.otf", "x-bold.ttf"]),
        ("my_font", 1, "[1]", ["z.TTF", "my-bold.ttf", "readme.txt"]), ("unsafe", 1, json.dumps({"regular": "../x.ttf", "family": "U"}), ["u.otf"]), ("Bad-Name", 0, None, ["regular.ttf"]), ("none", 0, None, ["x.txt"]), ("nofamily", 0, "no json", ["regular.ttf"]), ("noto_naskh_arabic", 0, json.dumps({"family": "N", "fallback": "sans"}), ["regular.otf"]),
    ]
    df = spark.createDataFrame(folders, "profile STRING, root INT, manifest STRING, files ARRAY<STRING>")
    families = spark.createDataFrame([("my_font", 1, "z.TTF", "Zed"), ("my_font", 1, "my-bold.ttf", "Zed Bold"), ("amiri", 1, "x-bold.ttf", 'A"m')], "profile STRING, root INT, file STRING, family STRING")
    found = fonts.profiles(df, families)
    rows = fonts.in_order(found).collect()
    assert [(r.id, r.label, r.family, r.regular, r.bold, r.bold_family, r.fallback) for r in rows] == [
        ("noto_naskh_arabic", "Noto Naskh Arabic", "N", "regular.otf", None, None, "sans"), ("amiri", "Amiri", 'A"m', "b.otf", "x-bold.ttf", 'A"m', "serif"),
        ("my_font", "My Font", "Zed", "z.TTF", "my-bold.ttf", "Zed Bold", "serif"), ("unsafe", "Unsafe", "U", "u.otf", None, None, "serif"),
    ]
    css = {r.id: r.css for r in fonts.style_sheet(found).collect()}
    assert css["amiri"] == 'body, p, div, li, td, th, blockquote, span {\n  font-family: "A\\"m", serif !important;\n}\n'
    assert css["my_font"].endswith('\nb, strong, h1, h2, h3, h4, h5, h6 {\n  font-family: "Zed Bold", "Zed", serif !important;\n}\n')
    assert [(r.value, r.label) for r in fonts.menu(found).orderBy("place").collect()] == [("default", "default_label"), ("noto_naskh_arabic", "noto_naskh_arabic_label"), ("amiri", "amiri_label"), ("my_font", "My Font"), ("unsafe", "Unsafe")]


def test_catalogs(spark, rows):
    tables = {"b1": spark.range(5), "t1": spark.createDataFrame([(1, "x")], "id INT, tit STRING"), "e": spark.range(0)}
    assert rows(catalogs.headers(spark, tables)) == [("b1", 0, "id"), ("e", 0, "id"), ("t1", 0, "id"), ("t1", 1, "tit")]
    assert rows(catalogs.row_counts(tables)) == [("b1", 5), ("e", 0), ("t1", 1)]
    ragged = spark.createDataFrame([("a", [1, 2, 3], ["x"]), ("b", None, [])], "book STRING, id ARRAY<INT>, text ARRAY<STRING>")
    assert rows(catalogs.zipped(ragged, ["id", "text"])) == [("a", 0, 1, "x"), ("a", 1, 2, None), ("a", 2, 3, None)]


def test_book_metadata(spark):
    values = [
        ("a", "Main", 0, "BkId", 0, "7"), ("a", "Main", 0, "Bk", 1, " Title "), ("a", "Main", 0, "Auth", 2, "X & Y"), ("a", "Main", 0, "Betaka", 3, "line 1\nline 2"), ("a", "main", 1, "title", 0, "no"),
        ("b", "main", 0, "xname", 0, ""), ("b", "t2", 2, "BETAKA2", 0, "second"), ("b", "t1", 1, "my_betaka", 3, "<p>first<br></p>"), ("c", "other", 0, "title", 0, "no"),
    ]
    names = spark.createDataFrame([("a", "a.bok"), ("b", "b.MDB"), ("c", "c d.bok")], "book STRING, name STRING")
    out = {r.book: r for r in catalogs.book_metadata(spark.createDataFrame(values, "book STRING, table STRING, table_pos INT, column STRING, pos INT, value STRING"), names).collect()}
    assert (out["a"].title, out["a"].author) == ("Title", "X & Y") and out["a"].about == "<div>\n<h1>Title</h1>\n<p>المؤلف: X &amp; Y</p>\n<p>line 1</p><p>line 2</p>\n</div>"
    assert (out["b"].title, out["b"].author) == ("b", "") and "<p>first<br /></p>" in out["b"].about and (out["c"].title, out["c"].about) == ("c d", "<div>\n<h1>c d</h1>\n\n\n</div>")


def test_extracted_documents(spark):
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "book STRING, page INT")
    blocks = [("a", 1, 50.0, 9.0, 0, "second\nline\n\nthird's"), ("a", 1, 10.0, 5.0, 0, "first & <b>"), ("a", 1, 20.0, 0.0, 1, "picture"), ("a", 3, 1.0, 1.0, 0, " \n"), ("a", 2, 1.0, 9.0, 0, "right"), ("a", 2, 1.0, 2.0, 0, "left"), ("b", 1, 1.0, 1.0, 0, "  \n ")]
    titles = spark.createDataFrame([("a", 'T "x"'), ("b", "B"), ("c", "C")], "book STRING, title STRING")
    out = {r.book: r for r in catalogs.extracted(pages, spark.createDataFrame(blocks, "book STRING, page INT, top DOUBLE, left DOUBLE, kind INT, text STRING"), titles).collect()}
    paras = ["first & <b>", "second line", "third's"]
    body = "\n".join([*(f"<p>{html.escape(p)}</p>" for p in paras), "<hr />", "<p>left</p>", "<p>right</p>", "<hr />", "<hr />"])
    assert out["a"].html == f'<html><head><meta charset="utf-8"><title>{html.escape(chr(84) + " " + chr(34) + "x" + chr(34))}</title></head><body>{body}</body></html>' and out["a"].error is None
    assert [(out[k].html, out[k].error) for k in "bc"] == [(None, catalogs.NO_TEXT)] * 2
    (packed,) = container.packed(catalogs.archive_entries(catalogs.extracted(pages, spark.createDataFrame(blocks, "book STRING, page INT, top DOUBLE, left DOUBLE, kind INT, text STRING"), titles))).collect()
    assert packed.book == "a"


def test_flat_contents(spark, tmp_path, rows):
    nested = '<nav id="toc"><ol><li><a href="a.xhtml">A</a><ol><li><a href="b.xhtml">B</a><ol><li><a href="c.xhtml">C</a></li></ol></li></ol></li><li><a href="d.xhtml">D</a></li></ol></nav>'
    ncx = '<?xml version="1.0"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint id="x"><navLabel><text>A</text></navLabel><content src="a.xhtml"/><navPoint id="y"><navLabel><text>B</text></navLabel><content src="b.xhtml"/></navPoint></navPoint></navMap></ncx>'
    write(tmp_path / "a.epub", book() | {"OEBPS/nav.xhtml": page(nested), "OEBPS/toc.ncx": ncx})
    out = volumes.flat_contents(read(spark, tmp_path))
    assert rows(container.toc_rows(out), "source", "path", "text") == [("nav", [1], "A"), ("nav", [2], "B"), ("nav", [3], "C"), ("nav", [4], "D"), ("ncx", [1], "A"), ("ncx", [2], "B")]
    text = {r.name: bytes(r.content).decode() for r in out.collect()}
    assert 'id="num_2" playOrder="2"' in text["OEBPS/toc.ncx"]
    write(tmp_path / "a.epub", text)
    assert {r.name: bytes(r.content).decode() for r in volumes.flat_contents(read(spark, tmp_path)).collect()} == text


def test_orders(spark, tmp_path):
    chats = spark.createDataFrame([(k, "u" if k % 3 else "") for k in (5, 2, 9, 1, 7)], "user_id LONG, user_name STRING").repartition(3)
    assert [r.user_id for r in recipients.recipients(chats, None, recipients.Filters()).collect()] == [1, 2, 5, 7, 9]
    assert [r.user_id for r in recipients.recipients(chats, None, recipients.Filters(username_only=True)).collect()] == [1, 2, 5, 7]
    items = spark.createDataFrame([("a", 1, 5, None), ("a", 2, 3, None), ("a", 3, 5, None), ("b", 1, 5, 1), ("b", 2, 3, None)], "book STRING, pos INT, page INT, level INT")
    assert [(r.book, r.pos) for r in toc.by_page(items).orderBy("book", "place").collect()] == [("a", 2), ("a", 1), ("a", 3), ("b", 1), ("b", 2)]
    events = spark.createDataFrame([(1, "x" * 3000, 0, "2024-01-02 03:04:05"), (2, None, 5, "2024-01-03 00:00:00")], "user_id LONG, error_message STRING, output_size_bytes LONG, created_at STRING").withColumn("created_at", F.to_timestamp_ntz("created_at"))
    path = str(tmp_path / "log")
    for _ in range(2):
        usage.appended(events, path)
    log = spark.read.parquet(path)
    assert log.count() == 4 and log.where("day = '2024-01-02'").agg(F.max(F.length("error_message")), F.max("output_size_bytes")).first() == (2000, None)


def test_assembled_books(spark, tmp_path, rows):
    """Books from tables of text and contents: with levels, without, without contents, without text."""
    about = [("a", "Title", "X", "<p>about</p>"), ("b", "B", "", ""), ("c", "C", "", ""), ("d", "D", "", ""), ("e", "E", "", "")]
    books = spark.createDataFrame(about, "book STRING, title STRING, author STRING, about STRING")
    text = [("a", 1, "one", 10, 5, "2"), ("a", 2, "two & more", 20, 6, "2"), ("a", 3, "three", 30, 7, "2"), ("b", 1, "x", 1, 1, None), ("b", 2, "y", 2, 2, None), ("c", 1, "سورة الفاتحة\nnow", 1, 1, "1"), ("c", 2, "z", 2, 2, "1"), ("d", 1, "p", 1, 3, None), ("e", 1, " ", 1, 1, None)]
    contents = [("a", 1, 10, "Part", 1), ("a", 2, 20, "Chapter", 2), ("a", 3, 30, "Next", 1), ("b", 1, 2, "Later", None), ("b", 2, 1, "First", None)]
    out = assembly.assembled(books, spark.createDataFrame(text, "book STRING, pos INT, text STRING, id LONG, page LONG, part STRING"), spark.createDataFrame(contents, "book STRING, pos INT, start LONG, text STRING, level LONG"))
    for r in container.packed(out).collect():
        (tmp_path / f"{r.book}.epub").write_bytes(r.content)
    entries = read(spark, tmp_path)
    nodes = container.toc_rows(entries).where("source = 'nav' AND (page > 0 OR href LIKE '%/text/%')")
    listed = [(r.book, len(r.path), r.text, r.page or r.href[-8:-6], r.anchor) for r in nodes.orderBy("book", "node").collect()]
    assert listed == [("a", 1, "Part", 1, "toc_10"), ("a", 2, "Chapter", 2, "toc_20"), ("a", 1, "Next", 3, "toc_30"), ("b", 1, "First", "01", "toc_1"), ("b", 1, "Later", "02", "toc_2"), ("c", 1, "سورة الفاتحة", 1, None), ("d", 1, "صفحة 3", "01", None)]
    names = {(r.book, r.name.rsplit("/", 1)[1]) for r in entries.where("name LIKE '%/text/%'").collect()}
    assert names == {("a", "page_2_01.xhtml"), ("a", "page_2_02.xhtml"), ("a", "page_2_03.xhtml"), ("b", "page_01.xhtml"), ("b", "page_02.xhtml"), ("c", "page_1_01.xhtml"), ("c", "page_1_02.xhtml"), ("d", "page_01.xhtml")}
    pages = {r.name: bytes(r.content).decode() for r in entries.where("book = 'a'").collect()}
    assert '<a id="toc_20"></a><p>two &amp; more</p></div><div class="text-center">الجزء: 2 - الصفحة: 6</div>' in pages["OEBPS/text/page_2_02.xhtml"] and "<p>about</p>" in pages["OEBPS/info.xhtml"]
