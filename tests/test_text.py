from __future__ import annotations

import datetime
import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.functions import encodings
from foliant.functions import text as T
from foliant.operators import assembly, footnotes
from foliant.plans import catalog
from foliant.streaming import requests


@pytest.fixture
def apply(spark):
    def run(function, *values):
        df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k INT, t STRING")
        return [r[0] for r in df.orderBy("k").select(function(F.col("t"))).collect()]

    return run


def test_scalars(apply):
    assert apply(T.escape_xml, "a&<\"'>", None) == ["a&amp;&lt;&quot;&apos;&gt;", None]
    assert apply(T.ascii_digits, "٣۴5") == ["345"]
    assert apply(T.to_integer, " ١٢ ", "۳4", "-1", "x", "", None) == [12, 34, None, None, None, None]
    assert apply(lambda c: T.integer_or(c, 7), "-3", " 12 ", "x", None) == [-3, 12, 7, 7]
    assert apply(T.strip_tags, "<p>a <b>b</b>\n c</p>") == ["a b c"]
    assert apply(T.close_void_tags, "<br><BR/><img src='x'><p>") == ["<br /><BR /><img src='x' /><p>"]
    assert apply(T.file_name, ' a/:*b?  "c" ') == ["a_b_ _c_"]
    assert apply(T.normal_language, " AR_eg ", None) == ["ar-eg", ""]
    assert apply(T.volume_language, "AR_eg", "fa", None) == ["ar", "en", "en"]
    assert apply(lambda c: T.text_direction(T.volume_language(c), F.lit("")), "fa", "ar") == ["ltr", "rtl"]
    assert apply(T.single_spaces, "a  b   c") == ["a b c"]
    assert apply(T.arabic_punctuation, "نعم ، لا؟  نعم") == ["نعم، لا؟ نعم"]
    assert apply(T.command_errors, "x\nConversion error: bad *thing*\nDEBUG - Conversion error: no") == ["Conversion error: bad thing"]
    assert apply(lambda c: T.merged_errors(c, F.lit(""), F.lit("b")), "a", None) == ["a\nb", "b"]
    assert apply(lambda c: T.page_of_file(c, F.lit(0)), "x/page_1_02.xhtml", "PAGE1_7.XHTML", "a.xhtml") == [2, 7, 0]
    once = apply(T.right_to_left_css, "p{}")
    assert once[0].startswith("* {direction: rtl") and apply(T.right_to_left_css, once[0]) == once


def test_lines(apply):
    assert apply(T.blocks, "a\nb\n\n \nc\r\nd", "", "\n\nx") == [["a b", "c d"], [], ["x"]]
    assert apply(T.plain_lines, " a \n\n b\r\nc", "", None) == [["a", "b", "c"], [], []]
    long = "x" * 200 + " 1 - " + "y" * 40 + " ٢ - z"
    assert apply(T.plain_lines, long, long[:210]) == [["x" * 200, "1 - " + "y" * 40, "٢ - z"], [long[:210].strip()]]
    assert apply(T.paragraphs, "a & b\nc", "<p>x</p>\ny", " ") == [["<p>a &amp; b</p>", "<p>c</p>"], ["<p>x</p>\ny"], []]
    assert apply(lambda c: T.without_empty(F.split(c, ",")), "a, ,b") == [["a", "b"]]


def test_plain_lines_of_all_documents(spark, tmp_path):
    rng = random.Random(3)
    words = ["word", "12 - item", "x1 - y", "٣ – بند", "9999 — last", "12345 - no", "7-tight", "end"]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 60]))) for _ in range(rng.randint(1, 5))) for _ in range(60)] + ["", None]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id LONG, text STRING").write.parquet(str(tmp_path / "documents.parquet"))

    def twin(text):
        out = []
        for line in filter(None, map(str.strip, (text or "").split("\n"))):
            parts = [x.strip() for x in re.split(r"(?=(?:^|\s)(?:[0-9]{1,4}|[٠-٩]{1,4})\s*[-–—]\s+)", line) if x.strip()]
            out += parts if len(line) >= 220 and len(parts) >= 2 else [line]
        return out

    digest = lambda t: hashlib.sha256("\n".join(twin(t)).encode()).hexdigest()
    want = [(k, len(twin(t)), None if t is None else len(re.sub(r"\s", "", t)), digest(t)) for k, t in rows]
    assert any(len(line) >= 220 and re.search(r"\s12 - ", line) for t in texts for line in (t or "").split("\n"))
    assert sorted(map(tuple, catalog.plain_lines(spark, str(tmp_path)).collect())) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE text IS NOT NULL")
    assert sorted(con.execute(catalog.ORACLE_SQL["plain_lines"]).fetchall()) == [w for w in want if w[2] is not None]


def test_headings_once(spark):
    df = spark.createDataFrame([(["a", "a", "b", "a"],), ([],)], "h ARRAY<STRING>")
    assert [r[0] for r in df.select(T.headings_once(F.col("h"))).collect()] == [["a", "b", "a"], []]


def test_encodings(spark):
    arabic = "مرحبا بالعالم الكبير"
    mojibake = arabic.encode("cp1256").decode("latin-1")
    df = spark.createDataFrame([("plain letters".encode("utf-16le"), mojibake), (arabic.encode("cp1256"), "déjà vu"), (b"\x00k", "a\0b ک"), (None, None)], "b BINARY, t STRING")
    got = df.select(encodings.decoded(F.col("b")), encodings.repaired(F.col("t"))).collect()
    assert [r[0] for r in got][:2] == ["plain letters", arabic] and got[3][0] == ""
    assert [r[1] for r in got] == [arabic, "déjà vu", "ab ـ", None]


def linked_numbers(spark, text, notes):
    df = spark.createDataFrame([(text, notes)], "t STRING, n ARRAY<STRING>").select("t", footnotes.markers(F.col("t")).alias("m"), F.transform("n", lambda x: F.struct(*[p.alias(k) for p, k in zip(footnotes.marker_parts(x), ("number", "caret", "bracket"), strict=True)])).alias("n"))
    row = df.select("m", footnotes.links(F.col("n"), F.col("m")).alias("l")).first()
    return [None if k is None else row.m[k].start for k in row.l]


def test_linking(spark):
    by_number = "مرجع (٨٠) ثم الحاشية (١)"
    assert linked_numbers(spark, by_number, ["(١)"]) == [by_number.index("(١)")]
    verse = "شهيد (٥٣)﴾، قوله (^١) ثم"
    assert linked_numbers(spark, verse, ["(^١)"]) == [verse.index("(^١)")]
    only = "﴿والليل (٢) إذا يغشى﴾"
    assert linked_numbers(spark, only, ["(٢)"]) == [only.index("(٢)")]
    assert linked_numbers(spark, "a (1) b [1] c (1)", ["[1]", "(1)", "(1)"]) == [8, 14, None]


def test_markers_and_links(spark):
    df = spark.createDataFrame([("😀a (1) b [^٢] c",), ("none",)], "t STRING").select("t", footnotes.markers(F.col("t")).alias("m"))
    first, second = df.collect()
    assert [(m.start, m.end, m.number, m.caret, m.bracket) for m in first.m] == [(3, 6, "1", False, "paren"), (9, 13, "2", True, "square")] and second.m == []
    text = df.select(footnotes.linked(F.col("t"), F.col("m"), F.array(F.lit(None).cast("int"), F.lit(5))).alias("x")).first().x
    assert text == '😀a (1) b <a href="#fn5" epub:type="noteref" role="doc-noteref" id="fnref5" class="fn nu">[^٢]</a> c'


def test_notes(spark, rows):
    blocks = [(1, 0, "<p class=\"hamesh\">(١) first<br />more<br/>(2) second</p>"), (1, 1, "<p>3 - plain</p>"), (2, 0, "<p>=carried<br />on<br />[1] own</p>"), (3, 0, "<p>no number</p>"), (4, 0, "<p>(1) a<br/>2 - not a note</p>")]
    got = rows(footnotes.notes(spark.createDataFrame(blocks, "page INT, block INT, html STRING")), "page", "note_id", "number", "content")
    assert got == [(1, 1, "(١)", "first<br />more"), (1, 2, "(2)", "second"), (1, 3, "3", "plain"), (2, 0, None, "=carried<br />on"), (2, 1, "[1]", "own"), (4, 1, "(1)", "a<br />2 - not a note")]
    shown = spark.range(1).select(footnotes.aside(F.lit(2), F.lit("(٢)"), F.lit("x")), footnotes.aside(F.lit(0), F.lit(None).cast("string"), F.lit("=y"))).first()
    assert tuple(shown) == ('<aside id="fn2" epub:type="footnote"><a href="#fnref2" class="nu">(٢)</a><span> x</span></aside>', '<aside id="fn0" epub:type="footnote"><span>=y</span></aside>')


def test_continuations(spark, rows):
    pages = [("a", 1, "n1", None), ("a", 2, None, "c2"), ("a", 3, None, None), ("a", 4, "n4", "c4"), ("a", 5, None, "c5"), ("b", 1, None, "c1"), ("b", 2, None, "c2")]
    got = rows(footnotes.carried_back(spark.createDataFrame(pages, "book STRING, page_no INT, last_note STRING, continuation STRING")))
    assert got == [
        ("a", 1, "n1<br />c2<br />c4", None, False), ("a", 2, None, None, True), ("a", 3, None, None, False), ("a", 4, "n4<br />c5", None, True), ("a", 5, None, None, True),
        ("b", 1, "=c1<br />c2", "c1", False), ("b", 2, None, None, True),
    ]


def test_assembled_pages(spark, rows):
    data = [("b", 0, "intro\nline", 5, 1, "1"), ("b", 1, "first\nسورة الفاتحة\nx\n1 - item", 7, 2, "جزء"), ("b", 2, "  ", 8, 3, None), ("b", 3, "<p>html</p>", None, None, None)]
    rows_ = spark.createDataFrame(data, "book STRING, pos INT, text STRING, id LONG, page LONG, part STRING")
    paged = assembly.pages(rows_, spark.createDataFrame([("b", 7)], "book STRING, id LONG"), split_numbered=True)
    got = rows(paged, "page_number", "pos", "page", "part", "anchored", "text_html")
    assert [g[:5] for g in got] == [(1, 0, 1, 1, True), (2, 1, 2, None, False), (3, 1, 2, None, True), (4, 1, 2, None, False), (5, 3, 0, None, False)]
    assert got[2][5].startswith('<div><a id="toc_7"></a><p>سورة الفاتحة</p><p>x</p></div><div class="text-center">الجزء: جزء - الصفحة: 2') and got[4][5] == "<div><p>html</p></div>"
    ids = assembly.page_of_ids(paged)
    assert rows(ids, "id", "page_number", "snippet") == [(5, 1, "intro\nline"), (7, 3, "first\nسورة الفاتحة")]
    entries = spark.createDataFrame([("b", 0, 7, " سورة الفاتحة ", 2), ("b", 1, 7, "سورة الفاتحة", 2), ("b", 2, 0, "start", 3), ("b", 3, 99, "gone", 2), ("b", 4, 7, "الجزء الأول", 2)], "book STRING, pos INT, start LONG, text STRING, level LONG")
    assert rows(assembly.mapped_toc(assembly.raw_toc(entries), ids), "text", "page", "anchor", "level") == [("start", 1, "", 2), ("سورة الفاتحة", 3, "toc_7", 1)]
    assert rows(assembly.automatic_toc(paged), "text", "page_number") == [("سورة الفاتحة", 3)]


def test_catalog_of_tables(spark, rows):
    catalog = spark.createDataFrame([("k", "b2", 5), ("k", "B1", 5), ("k", "t1", 9), ("k", "t2", 1), ("k", "Main", 99), ("l", "b7", 1), ("l", "t3", 2), ("l", "t4", 2)], "book STRING, table STRING, rows INT")
    content = assembly.content_table(catalog, "b")
    assert rows(content) == [("k", "B1"), ("l", "b7")]
    assert rows(assembly.toc_table(catalog, content)) == [("k", "t1"), ("l", "t3")]
    assert assembly.text_column(["id", "a", "b"], spark.createDataFrame([(0, 1, None, "x")], "pos INT, id INT, a STRING, b STRING")) == "b"


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_request_lives(spark, rows):
    df = spark.createDataFrame([("a", at(0)), ("a", at(1800)), ("a", at(3601)), ("b", at(5))], "request STRING, at TIMESTAMP_NTZ")
    assert rows(requests.lives(df)) == [("a", at(0), at(1800), 2), ("a", at(3601), at(3601), 1), ("b", at(5), at(5), 1)]
    queue = spark.createDataFrame([("first", 0.0), ("second", 100.0)], "id STRING, queued_at DOUBLE")
    assert rows(requests.remaining(queue, 100.0, 60), "id") == [("second",)]


def test_request_stream(spark, tmp_path, rows):
    steps = [[("a", at(0), "open", "epub"), ("b", at(1), "touch", None)], [("a", at(50), "touch", None), ("c", at(60), "open", "pdf")], [("c", at(100), "take", None), ("a", at(400), "touch", None)], [("z", at(900), "open", "md")], [("z", at(901), "take", None)]]
    schema = "request STRING, at TIMESTAMP, action STRING, input STRING"
    source = tmp_path / "in"
    source.mkdir()
    stream = requests.tracked(spark.readStream.schema(schema).parquet(str(source)), 100).writeStream.format("memory").queryName("outcomes").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for step in steps:
            spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(str(source))
            stream.processAllAvailable()
    finally:
        stream.stop()
    got = sorted((r.request, r.outcome) for r in spark.sql("SELECT * FROM outcomes").collect())
    assert got == [("a", "expired"), ("a", "opened"), ("a", "refreshed"), ("a", "rejected"), ("b", "rejected"), ("c", "opened"), ("c", "taken"), ("z", "opened"), ("z", "taken")]


def test_sessions_over_a_stream(spark, tmp_path):
    schema = "request STRING, at TIMESTAMP"
    source = tmp_path / "in"
    spark.createDataFrame([("a", at(0)), ("a", at(1800)), ("b", at(10))], schema).coalesce(1).write.parquet(str(source))
    stream = requests.live_sessions(spark.readStream.schema(schema).parquet(str(source))).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        stream.processAllAvailable()
        spark.createDataFrame([("z", at(90_000))], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream.processAllAvailable()
    finally:
        stream.stop()
    got = sorted((r.request, r.accesses) for r in spark.sql("SELECT * FROM sessions").collect())
    assert got == [("a", 2), ("b", 1)]


def naive_roles(nodes):
    """Roles, notes and targets of one page's (kind, text), by walking."""
    import re

    marked = lambda n: n[0] == "p" and re.match(r"\s*(\(\^?\d+\)|\[\^?\d+\])", n[1] or "") is not None
    out = {k: ["rule" if n[0] == "hr" else "body", None, None] for k, n in enumerate(nodes)}
    count = 0
    for k, (kind, _) in enumerate(nodes):
        if kind != "hr":
            continue
        after = k + 1
        if after < len(nodes) and nodes[after][0] == "p" and not marked(nodes[after]) and (nodes[after][1] or "").strip().startswith("=") and (nodes[after][1] or "").strip()[1:].strip():
            back = next((j for j in range(k - 1, -1, -1) if marked(nodes[j]) or (nodes[j][0] == "aside" and nodes[j][1].rstrip(" ").endswith("="))), None)
            out[after] = ["continuation", None, None if back is None or marked(nodes[back]) else back]
            after += 1
        while after < len(nodes) and marked(nodes[after]):
            count += 1
            out[after] = ["note", count, None]
            after += 1
    return out


def test_ruled_sections(spark):
    import random

    rng = random.Random(4)
    kinds = [("hr", None), ("p", "(1) note"), ("p", "text (2)"), ("p", "= goes on"), ("p", "="), ("aside", "open ="), ("aside", "closed"), ("p", " [3] note"), ("p", None)]
    pages = {p: [rng.choice(kinds) for _ in range(rng.randint(1, 14))] for p in range(80)}
    df = spark.createDataFrame([(p, k, *n) for p, nodes in pages.items() for k, n in enumerate(nodes)], "page INT, pos INT, kind STRING, text STRING")
    got = {(r.page, r.pos): [r.role, r.note_id, r.target] for r in footnotes.ruled_sections(df).collect()}
    assert got == {(p, k): v for p, nodes in pages.items() for k, v in naive_roles(nodes).items()}


def test_options_as_json(spark):
    import json

    from foliant.operators import routing
    from foliant.plans import domains

    row = routing.with_defaults(spark.createDataFrame([("a", "b")], "input STRING, output STRING")).select(routing.options_json()).first()
    assert json.loads(row[0]) == domains.OPTION_DEFAULTS
