from __future__ import annotations

import io
import random
import zipfile

from pyspark.sql import functions as F

from foliant.operators import structure, toc
from foliant.sources import container

NAMES = ["OEBPS/content.opf", "OEBPS/Text/page_1.xhtml", "OEBPS/Text/page_2.xhtml", "OEBPS/Text/page_3.xhtml", "OEBPS/Text/intro.xhtml", "OEBPS/Text/book_info.xhtml", "OEBPS/nav.xhtml"]
ITEMS = [("intro", "Text/intro.xhtml"), ("book_info", "Text/book_info.xhtml"), ("page_2", "Text/page_2.xhtml"), ("page_1", "Text/Page_1.xhtml"), ("page_1", "Text/page_1.xhtml"), ("page_3", "Text/page_3.xhtml"), ("page_4", "Text/page_4.xhtml"), ("nav", "nav.xhtml")]


def test_repair(spark):
    entries = spark.createDataFrame([("b", k, n) for k, n in enumerate(NAMES)], "book STRING, pos INT, name STRING")
    items = spark.createDataFrame([("b", k, i, h, "OEBPS") for k, (i, h) in enumerate(ITEMS)], "book STRING, pos INT, id STRING, href STRING, directory STRING")
    spine = spark.createDataFrame([("b", k, i) for k, i in enumerate(["page_2", "page_1", "page_1", "page_3", "page_4"])], "book STRING, pos INT, idref STRING")
    manifest, order = structure.repaired(items, spine, entries)
    found = [(r.id, r.href) for r in manifest.orderBy("pos").collect()]
    assert [i for i, _ in found if i.startswith("page")] == ["page_1", "page_2", "page_3"]
    assert dict(found)["page_1"] == "Text/page_1.xhtml" and len(found) == 6
    assert [r.idref for r in order.orderBy("pos").collect()] == ["intro", "book_info", "page_1", "page_2", "page_3"]
    reading = structure.reading_order(spine, items.withColumn("media_type", F.lit("application/xhtml+xml")), entries)
    assert [r.name.rsplit("/", 1)[1] for r in reading.orderBy("pos").collect()] == ["page_2.xhtml", "page_1.xhtml", "page_3.xhtml", "intro.xhtml", "book_info.xhtml", "nav.xhtml"]


def test_paths(spark):
    import posixpath

    paths = ["a/b/../c", "./x", "../y", "a/../../z", "", "a//b/./c/", ".."]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p STRING").select(structure.normal_path(F.col("p"))).collect()]
    assert got == [posixpath.normpath(p) for p in paths]


def test_volumes(spark, rows):
    def split(pages, starts):
        a = spark.createDataFrame([("b", p) for p in pages], "book STRING, page_number INT")
        return rows(toc.volumes(a, spark.createDataFrame([("b", s) for s in starts], "book STRING, page INT")), "page_number", "volume")

    assert split([1, 2, 3, 4], [1, 3]) == [(1, 1), (2, 1), (3, 2), (4, 2)]
    assert split([1, 2, 3], [2]) == []
    assert split([1, 2, 3, 4], [2, 2, 4, 9]) == [(1, 1), (2, 2), (3, 2), (4, 3)]
    assert split([1, 2, 3, 4], [3, 3, 4, 0]) == [(1, 1), (2, 1), (3, 2), (4, 3)]


def walk(tree, above=(), out=None, counter=None):
    out, counter = [] if out is None else out, counter or [0]
    for page, children in tree:
        counter[0] += 1
        here = (*above, counter[0])
        out.append((here, page))
        walk(children, here, out, counter)
    return out


def random_tree(rng, depth=3):
    return [(rng.choice([None, None, rng.randint(1, 9)]), random_tree(rng, depth - 1) if depth and rng.random() < 0.6 else []) for _ in range(rng.randint(0, 3))]


def first_page(tree):
    return next((p or first_page(c) for p, c in tree if p or first_page(c)), None)


def naive_resolved(tree, path=(), counter=None):
    """(path, page) of nodes that have a page, or a descendant with one."""
    out, counter = [], counter or [0]
    for page, children in tree:
        counter[0] += 1
        here = (*path, counter[0])
        below = naive_resolved(children, here, counter)
        page = page or first_page(children)
        if page:
            out.append((here, page))
        out += below
    return out


def naive_cut(tree, low, high, parent=None, out=None, counter=None):
    out, counter = [] if out is None else out, counter or [0]
    for page, children in tree:
        counter[0] += 1
        node, inside = counter[0], page is not None and low <= page <= high
        if inside:
            out.append((node, parent))
        naive_cut(children, low, high, node if inside else parent, out, counter)
    return out


def test_trees_against_recursion(spark):
    rng = random.Random(3)
    trees = {b: random_tree(rng) for b in range(120)}
    data = [(b, path[-1], list(path), page, None) for b, tree in trees.items() for path, page in walk(tree)]
    nodes = spark.createDataFrame(data, "book INT, node INT, path ARRAY<INT>, page INT, href STRING")
    none = spark.createDataFrame([], "book INT, href STRING, page INT")
    resolved = {(r.book, r.node): (r.page, r.parent) for r in toc.resolved(nodes, none).collect()}
    assert resolved == {(b, path[-1]): (page, path[-2] if len(path) > 1 else None) for b, tree in trees.items() for path, page in naive_resolved(tree)}
    ranges = spark.createDataFrame([(b, 1, 3, 6) for b in trees], "book INT, part INT, first INT, last INT")
    cut = sorted((r.book, r.node, r.parent or 0) for r in toc.cut(nodes, ranges).collect())
    assert cut == sorted((b, n, p or 0) for b, tree in trees.items() for n, p in naive_cut(tree, 3, 6))


def test_nesting_forms_agree(spark, rows):
    rng = random.Random(5)
    items = spark.createDataFrame([(b, p, rng.choice([None, -1, 1, 2, 3, 4])) for b in range(60) for p in range(rng.randint(1, 14))], "book INT, pos INT, level INT")
    by_levels = toc.nested_by_levels(items, 4)
    assert rows(toc.nested(items)) == rows(by_levels.drop("path"))
    walked = toc.with_paths(by_levels.drop("path").withColumnRenamed("pos", "node"), 4)
    assert rows(walked, "book", "node", "path") == rows(by_levels, "book", "pos", "path")


def test_depths_beyond_what_is_said(spark):
    import pytest

    deep = spark.createDataFrame([("b", k, k) for k in range(1, 6)], "book STRING, pos INT, level INT")
    with pytest.raises(Exception, match="beyond 4"):
        toc.nested_by_levels(deep, 4).collect()
    nodes = toc.nested_by_levels(deep, 5).drop("path").withColumnRenamed("pos", "node")
    with pytest.raises(Exception, match="deeper than 4"):
        toc.with_paths(nodes, 4).collect()
    assert toc.with_paths(nodes, 5).where("node = 5").first()["path"] == [1, 2, 3, 4, 5]


def test_exchanges_are_few(spark):
    """One scan of the log in a snapshot, one window and no join for paths, two joins for letter case."""
    import datetime

    from foliant.operators import usage
    from foliant.sources import proxies

    sf = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    events = proxies.conversion_events(spark, sf)
    assert plan(usage.log_summary(events, datetime.datetime(2024, 6, 1), 30, 5)).count("FileScan") == 1
    items = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey AS book", "o_orderkey AS pos", "CAST(o_orderkey % 5 + 1 AS INT) AS level", "'a' AS directory", "'b' AS href")
    paths = plan(toc.nested_by_levels(items, 5))
    assert paths.count("Window [") == 1 and "Join" not in paths
    names = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey AS book", "l_comment AS name" if "l_comment" in spark.read.parquet(f"{sf}/lineitem.parquet").columns else "l_returnflag AS name")
    assert plan(structure.with_fixed_case(items, names)).count("Join") == 2


def archive(entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, content in entries:
            z.writestr(name, content)
    return buffer.getvalue()


OPF = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="p" href="a.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" properties="nav"/></manifest><spine><itemref idref="p"/></spine></package>'
NAV = '<html xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="landmarks"><ol><li><a href="x.xhtml">no</a></li></ol></nav><nav epub:type="toc"><ol><li><a href="text/page_1_02.xhtml#chap-2">Two</a></li><li><span>Part</span><ol><li><a href="b.xhtml">B</a></li></ol></li></ol></nav></body></html>'
NCX = '<ncx><navMap><navPoint><navLabel><text>One</text></navLabel><content src="page_1_1.xhtml"/><navPoint><navLabel><text>In</text></navLabel><content src="c.xhtml#x"/></navPoint></navPoint></navMap></ncx>'


def test_container_round_trip(spark, tmp_path, rows):
    (tmp_path / "a.epub").write_bytes(archive([("OEBPS/a.xhtml", "old"), ("mimetype", "application/epub+zip"), ("OEBPS/content.opf", OPF), ("broken.opf", "<x"), ("OEBPS/nav.xhtml", NAV), ("OEBPS/toc.ncx", NCX)]))
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    entries = container.read_entries(spark, str(tmp_path))
    package = container.package_rows(entries)
    assert rows(package, "kind", "pos", "id", "href") == [("item", 0, "p", "a.xhtml"), ("item", 1, "n", "nav.xhtml"), ("itemref", 0, "p", None)]
    nodes = rows(container.toc_rows(entries), "source", "node", "path", "text", "page", "href", "anchor")
    assert nodes == [
        ("nav", 1, [1], "Two", 2, None, "chap-2"), ("nav", 2, [2], "Part", None, None, None), ("nav", 3, [2, 3], "B", None, "OEBPS/b.xhtml", None),
        ("ncx", 1, [1], "One", 1, None, None), ("ncx", 2, [1, 2], "In", None, "OEBPS/c.xhtml", "x"),
    ]
    new = entries.where("name LIKE '%a.xhtml'").select("book", "name", F.lit("new").cast("binary").alias("content"))
    (out,) = container.packed(container.replaced(entries, new)).collect()
    with zipfile.ZipFile(io.BytesIO(out.content)) as z:
        assert z.namelist()[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED
        assert z.read("OEBPS/a.xhtml") == b"new" and len(z.namelist()) == 6


def test_text_of_bytes():
    assert container.text_of("é".encode()) == "é"
    assert container.text_of(b'<?xml version="1.0" encoding="iso-8859-1"?><a>\xe9</a>').endswith("<a>é</a>")
    assert container.text_of(b"a\xff") == "a" and container.text_of(None) == ""


def test_books_round_trip(spark, tmp_path, rows):
    """Volumes of a book are packed, read again and lead where they should."""
    from foliant.operators import render

    books = spark.createDataFrame([("b", "Title & co", "A", "<p>about</p>", "ar", "")], "book STRING, title STRING, author STRING, about STRING, language STRING, direction STRING")
    pages = spark.createDataFrame([("b", k, f"p{k}", f"<p>text {k}</p>") for k in range(1, 5)], "book STRING, page_number INT, title STRING, text_html STRING")
    starts = spark.createDataFrame([("b", 1), ("b", 3)], "book STRING, page INT")
    volume_books, volume_pages = render.volume_books(books, toc.volumes(pages, starts))
    nodes = spark.createDataFrame([("b/1", [1], "one", 1, None, "a"), ("b/1", [1, 1], "in", 2, None, ""), ("b/1", [2], "<two>", 2, None, None), ("b/2", [1], "three", 3, None, None)], "book STRING, path ARRAY<INT>, text STRING, page INT, href STRING, anchor STRING")
    packed = container.packed(render.book_entries(volume_books, volume_pages, nodes)).collect()
    assert [r.book for r in sorted(packed)] == ["b/1", "b/2"]
    for r in packed:
        (tmp_path / f"{r.book.replace('/', '-')}.epub").write_bytes(r.content)
    entries = container.read_entries(spark, str(tmp_path)).withColumn("book", F.regexp_extract("book", "b-[12]", 0))
    own = ["بطاقة الكتاب", "فهرس الموضوعات"]
    assert [r[0] for r in rows(container.toc_rows(entries).where("source = 'nav'"), "text", "page")] == sorted(["<two>", "in", "one", "three"] + own * 2, key=lambda x: repr((x,)))
    assert rows(container.toc_rows(entries).where("source = 'ncx' AND book = 'b-1' AND page > 0"), "path", "page", "anchor") == [([3, 4], 2, None), ([3], 1, "a"), ([5], 2, None)]
    package = container.package_rows(entries).where("kind = 'itemref'")
    assert rows(package, "book", "id") == [("b-1", "info"), ("b-1", "page_1_01"), ("b-1", "page_1_02"), ("b-2", "info"), ("b-2", "page_1_03"), ("b-2", "page_1_04")]
    text = {r.name: container.text_of(bytes(r.content)) for r in entries.where("book = 'b-2'").collect()}
    assert 'lang="ar" dir="rtl"' in text["OEBPS/text/page_1_03.xhtml"] and "<title>Title &amp; co - 2</title>" in text["OEBPS/nav.xhtml"] and 'page-progression-direction="rtl"' in text["OEBPS/content.opf"]


def test_small_rules(spark, rows):
    from foliant.operators import render

    people = spark.createDataFrame([(" A ", " B", None, True), ("", "B", None, True), (None, None, "T ", False)], "f STRING, l STRING, t STRING, p BOOLEAN")
    assert [r[0] for r in people.select(render.chat_name(F.col("f"), F.col("l"), F.col("t"), F.col("p"))).collect()] == ["A B", " B", "T "]
    files = spark.createDataFrame([(26_214_400, False), (26_214_401, False), (99_999_999, True)], "size LONG, is_admin BOOLEAN")
    assert rows(render.accepted_sizes(files), "size") == [(26_214_400,), (99_999_999,)]
    buttons = spark.createDataFrame([("r", k) for k in range(5)], "request STRING, pos INT")
    assert rows(render.button_rows(buttons, 3), "row", "column") == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert [r[0] for r in spark.createDataFrame([(True, False), (False, True), (False, False)], "a BOOLEAN, b BOOLEAN").select(render.chat_type(F.col("a"), F.col("b"))).collect()] == [0, 1, 2]
    options = spark.createDataFrame([("epub", "docx", True, -1)], "input STRING, output STRING, pandoc_toc BOOLEAN, pandoc_heading_shift INT")
    from foliant.operators import routing

    full = routing.with_defaults(options)
    assert full.select(render.pandoc_arguments()).first()[0] == ["--standalone", "--toc", "--shift-heading-level-by", "-1"]


def test_package_entry(spark, rows):
    from foliant.operators import structure as s

    names = [("a", 0, "x/Book.opf"), ("a", 1, "content.opf"), ("b", 0, "CONTENT.OPF"), ("c", 0, "z.opf"), ("c", 1, "b.OPF"), ("d", 0, "no.txt")]
    roots = spark.createDataFrame([("a", 0, "gone.opf"), ("a", 1, "/x/book.opf "), ("b", 0, "")], "book STRING, at INT, path STRING")
    assert rows(s.package_entry(roots, spark.createDataFrame(names, "book STRING, pos INT, name STRING"))) == [("a", "x/Book.opf"), ("b", "CONTENT.OPF"), ("c", "b.OPF")]
