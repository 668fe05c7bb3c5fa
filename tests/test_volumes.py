"""Containers end to end: metadata, broken files, volumes, repairs of whole books, files written."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import structure, volumes
from foliant.sources import container

SPACE = 'xmlns="http://www.w3.org/1999/xhtml"'
BOX = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="{}"/></rootfiles></container>'


def page(body, extra=""):
    return f'<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html {SPACE}{extra}><head><title>t</title></head><body>{body}</body></html>'


def package(items, refs, meta="<dc:title>Title</dc:title><dc:creator>A &amp; B</dc:creator><dc:language>ar</dc:language><dc:identifier>id-1</dc:identifier>", spine=""):
    rows = "".join(f'<item id="{i}" href="{h}" media-type="{m}"{p}/>' for i, h, m, p in items)
    return f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{meta}</metadata><manifest>{rows}</manifest><spine{spine}>{"".join(f"<itemref idref={chr(34)}{r}{chr(34)}/>" for r in refs)}</spine></package>'


X = "application/xhtml+xml"
NAV = '<nav epub:type="toc" id="toc"><ol><li><a href="text/page_1_01.xhtml">One</a><ol><li><a href="text/page_1_02.xhtml#x">In one</a></li></ol></li><li>Part<ol><li><a href="text/page_1_03.xhtml">Two</a></li></ol></li></ol></nav>'


def book(opf="OEBPS/content.opf", nav=("nav", "nav.xhtml", ' properties="nav"'), css=True, base="OEBPS/"):
    up = "" if base else "OEBPS/"
    items = [("info", f"{up}info.xhtml", X, ""), (nav[0], f"{up}{nav[1]}", X, nav[2]), ("pic", f"{up}images/c.svg", "image/svg+xml", ' properties="cover-image"'), *[(f"p{k}", f"{up}text/page_1_0{k}.xhtml", X, "") for k in range(1, 5)]]
    files = {"mimetype": "application/epub+zip", "META-INF/container.xml": BOX.format(opf), "OEBPS/info.xhtml": page("<p>about <b>it</b></p>"), f"OEBPS/{nav[1]}": page(NAV, ' xmlns:epub="http://www.idpf.org/2007/ops"'), "OEBPS/images/c.svg": "<svg/>", "META-INF/x/": "", "other.bin": "\x01"}
    if css:
        items.append(("css", f"{up}styles.css", "text/css", ""))
        files["OEBPS/styles.css"] = "body{color:red}"
    files[opf] = package(items, [nav[0], "p1", "p2", "p3", "p4"])
    return files | {f"OEBPS/text/page_1_0{k}.xhtml": page(f'<h2>Head {k}</h2><h2>Head {k}</h2><p>text {k} <img src="../images/c.svg"/></p>') for k in range(1, 5)}


def write(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)


def read(spark, folder):
    return container.read_entries(spark, str(folder)).withColumn("book", F.regexp_extract("book", r"([^/]+)\.epub$", 1))


def split(spark, tmp_path, files):
    write(tmp_path / "book.epub", files)
    out = {}
    for r in volumes.split(read(spark, tmp_path)).collect():
        out.setdefault(r.volume, {})[r.name] = bytes(r.content).decode()
    return out


@pytest.mark.parametrize("case", ["plain", "root", "custom nav", "no styles"])
def test_volumes_of_a_book(spark, tmp_path, case):
    kind = {"plain": {}, "root": {"opf": "content.opf", "base": ""}, "custom nav": {"nav": ("toc", "toc.xhtml", ' properties="nav"')}, "no styles": {"css": False}}[case]
    out = split(spark, tmp_path, book(**kind))
    assert sorted(out) == [1, 2]
    pages = {k: sorted(n for n in files if "/text/" in n) for k, files in out.items()}
    assert pages == {1: ["OEBPS/text/page_1_01.xhtml", "OEBPS/text/page_1_02.xhtml"], 2: ["OEBPS/text/page_1_03.xhtml", "OEBPS/text/page_1_04.xhtml"]}
    for k, files in out.items():
        opf, nav = files["OEBPS/content.opf"], files["OEBPS/nav.xhtml"]
        assert f"<dc:title>Title - {k}</dc:title>" in opf and "<dc:creator>A &amp; B</dc:creator>" in opf and '"id">id-1<' in opf and "<dc:language>ar</dc:language>" in opf
        assert 'page-progression-direction="rtl"' in opf and '<itemref idref="nav"/>' in opf and 'href="images/c.svg" media-type="image/svg+xml" properties="cover-image"' in opf and "toc.xhtml" not in opf
        assert files["OEBPS/images/c.svg"] == "<svg/>" and files["other.bin"] == "\x01" and "META-INF/x/" not in files
        assert files["OEBPS/styles.css"] == ("body{line-height:1.7;margin:1.5rem}" if case == "no styles" else "body{color:red}")
        assert "<p>about <b>it</b></p>" in files["OEBPS/info.xhtml"] and "html:" not in files["OEBPS/info.xhtml"]
        assert ("One" in nav, "In one" in nav, "Two" in nav) == ((k == 1), (k == 1), (k == 2))
        assert ("page_1_02.xhtml#x" in files["OEBPS/toc.ncx"]) == (k == 1)
    assert "<title>Head 1</title>" in out[1]["OEBPS/text/page_1_01.xhtml"] and 'href="../styles.css"' in out[1]["OEBPS/text/page_1_01.xhtml"] and '<img src="../images/c.svg" />' in out[1]["OEBPS/text/page_1_01.xhtml"]
    assert "<ol><li>" in out[2]["OEBPS/nav.xhtml"] and "Part" in out[2]["OEBPS/nav.xhtml"]


def test_books_without_volumes(spark, tmp_path):
    one = book()
    one["OEBPS/nav.xhtml"] = page('<nav id="toc"><ol><li><a href="text/page_1_01.xhtml">One</a></li></ol></nav>')
    write(tmp_path / "one.epub", one)
    write(tmp_path / "bad.epub", book() | {"OEBPS/content.opf": '<!DOCTYPE p [<!ENTITY x "y">]><package/>'})
    write(tmp_path / "none.epub", {"a": "b"})
    assert volumes.split(read(spark, tmp_path)).count() == 0


def test_pages_without_a_spine(spark, tmp_path):
    files = book()
    files["OEBPS/content.opf"] = files["OEBPS/content.opf"].replace('idref="p', 'idref="q')
    assert sorted(split(spark, tmp_path, files)) == [1, 2]


def test_metadata_and_pages(spark, tmp_path):
    write(tmp_path / "a.epub", book() | {"OEBPS/text/page_1_03.xhtml": "<broken"})
    entries = read(spark, tmp_path)
    found = container.packages(entries, structure.package_entry(container.rootfiles(entries), entries))
    (r,) = found.collect()
    assert (r.title, r.author, r.language, r.identifier, r.direction, r.toc_page, r.directory, len(r["items"]), len(r.spine)) == ("Title", "A & B", "ar", "id-1", "", True, "OEBPS", 8, 5)
    items = container.manifest(found)
    assert {i.id: (i.path, i.href, i.nav, i.info, i.page, i.style, i.asset) for i in items.collect()}["pic"] == ("OEBPS/images/c.svg", "images/c.svg", False, False, False, False, True)
    names = volumes.page_entries(found, items, entries)
    pages = {p.page_number: p for p in container.page_rows(entries, names).collect()}
    assert sorted(pages) == [1, 2, 4] and pages[4].titles == ["Head 4"] and pages[4].text_html.startswith("<h2>Head 4</h2>")
    assert {(x.what, x.entry) for x in volumes.resources(found, items, entries).collect()} == {("info", "OEBPS/info.xhtml"), ("nav", "OEBPS/nav.xhtml"), ("style", "OEBPS/styles.css")}


def test_files_that_cannot_be_read(spark, tmp_path):
    write(tmp_path / "good.epub", {"a": "1", "b": "2" * 1000})
    data = bytearray((tmp_path / "good.epub").read_bytes())
    (tmp_path / "cut.epub").write_bytes(bytes(data[:40]))
    locked = bytearray(data)
    for signature, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.find(signature) + at] |= 1  # the first entry says that it is encrypted
    (tmp_path / "locked.epub").write_bytes(bytes(locked))
    (tmp_path / "text.epub").write_bytes(b"no container")
    names = sorted((r.book.rsplit("/", 1)[1], r.name) for r in container.read_entries(spark, str(tmp_path)).collect())
    assert names == [("good.epub", "a"), ("good.epub", "b"), ("locked.epub", "b")]
    errors = sorted((r.book.rsplit("/", 1)[1], r.name) for r in container.read_errors(spark, str(tmp_path)).collect())
    assert errors == [("cut.epub", None), ("locked.epub", "a"), ("text.epub", None)]


def test_footnotes_of_a_container(spark, tmp_path):
    files = book() | {
        "OEBPS/text/page_1_01.xhtml": page('<div><p>x (1)</p><hr /><p class="hamesh">(1) note</p></div>'), "OEBPS/text/page_1_02.xhtml": page("<p>. . .</p>"),
        "OEBPS/text/page_1_03.xhtml": page('<div><p>y</p><hr /><p class="hamesh">= more</p></div>'),
    }
    write(tmp_path / "a.epub", files)
    entries = read(spark, tmp_path)
    new = {r.name: bytes(r.content).decode() for r in volumes.with_standard_footnotes(entries).collect()}
    assert "note<br />more</span></aside>" in new["OEBPS/text/page_1_01.xhtml"] and 'xmlns:epub="http://www.idpf.org/2007/ops"' in new["OEBPS/text/page_1_01.xhtml"] and "<?xml" in new["OEBPS/text/page_1_01.xhtml"]
    assert "more" not in new["OEBPS/text/page_1_03.xhtml"] and "hamesh" not in new["OEBPS/text/page_1_03.xhtml"]
    changed = {k for k in files if k in new and new[k] != files[k]}
    assert changed == {"OEBPS/text/page_1_01.xhtml", "OEBPS/text/page_1_03.xhtml"}
    write(tmp_path / "a.epub", new)
    again = {r.name: bytes(r.content).decode() for r in volumes.with_standard_footnotes(read(spark, tmp_path)).collect()}
    assert again == {k: v for k, v in new.items()}


def test_right_to_left(spark, tmp_path):
    write(tmp_path / "a.epub", book())
    new = {r.name: bytes(r.content).decode() for r in volumes.right_to_left(read(spark, tmp_path)).collect()}
    assert 'page-progression-direction="rtl"' in new["OEBPS/content.opf"] and new["OEBPS/styles.css"] == "* {direction: rtl !important;}\nbody{color:red}"
    write(tmp_path / "a.epub", new)
    assert {r.name: bytes(r.content).decode() for r in volumes.right_to_left(read(spark, tmp_path)).collect()} == new


def test_files_are_written(spark, tmp_path):
    write(tmp_path / "book.epub", book())
    packed = container.packed(volumes.split(read(spark, tmp_path)))
    named = packed.select(F.concat(F.regexp_replace("book", "/", " - "), F.lit(".epub")).alias("name"), "content")
    out = container.saved(named, str(tmp_path / "out")).collect()
    assert sorted(r.name for r in out) == [volumes.volume_file("book", k) for k in (1, 2)]
    with zipfile.ZipFile(tmp_path / "out" / "book - 1.epub") as z:
        assert z.namelist()[0] == "mimetype" and z.testzip() is None
    assert not list((tmp_path / "out").glob("*.part")) and volumes.volume_file("a/b:c  d", 3) == "a_b_c d - 3.epub"


def test_paths_in_containers(spark):
    import posixpath

    cases = [("OEBPS", "text/a.xhtml"), ("OEBPS", "../images/c.svg"), ("", "a/./b"), ("OEBPS", "../../x"), ("a/b", ".."), ("", ""), ("OEBPS/text", "../styles.css"), ("OEBPS", "OEBPS/x")]
    df = spark.createDataFrame(cases, "d STRING, h STRING")
    got = [tuple(r) for r in df.select(T.zip_path(F.col("d"), F.col("h")), T.relative_path(F.col("d"), F.col("h"))).collect()]

    def relative(start, target):
        if not target:
            return ""
        out = posixpath.relpath(target, start=start or ".")
        return target if out == "." else out

    inside = lambda d, h: ".." not in posixpath.normpath(h).split("/")
    assert [g[0] for g in got] == [posixpath.normpath(f"/{d}/{h}").lstrip("/") for d, h in cases]
    assert [g[1] for g, c in zip(got, cases, strict=True) if inside(*c)] == [relative(d, h) for d, h in cases if inside(d, h)]


def test_repair_of_a_container(spark, tmp_path):
    items = [("intro", "Text/intro.xhtml", X, ""), ("page_2", "Text/page_2.xhtml", X, ""), ("page_1", "Text/PAGE_1.xhtml", X, ""), ("page_1", "text/Page_1.xhtml", X, ""), ("page_3", "Text/page_3.xhtml", X, ""), ("page_4", "Text/page_4.xhtml", X, ""), ("c", "s.css", "text/css", "")]
    opf = package(items, ["page_3", "page_2", "page_1", "page_1", "page_4"])
    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        for name, content in [("mimetype", "application/epub+zip"), ("OEBPS/content.opf", "old"), ("OEBPS/content.opf", opf), ("OEBPS/s.css", ""), ("OEBPS/Text/intro.xhtml", page("i")), *[(f"OEBPS/Text/page_{k}.xhtml", page(str(k))) for k in (1, 2, 3)]]:
            z.writestr(name, content)
    out = volumes.repaired(read(spark, tmp_path))
    names = [r.name for r in out.collect()]
    assert len(names) == len(set(names)) == 7
    chosen = out.where("name LIKE '%.opf'").select("book", F.col("name").alias("entry"))
    (r,) = container.packages(out, chosen).collect()
    assert [(i.id, i.href) for i in r["items"]] == [("intro", "Text/intro.xhtml"), ("page_1", "Text/page_1.xhtml"), ("page_2", "Text/page_2.xhtml"), ("page_3", "Text/page_3.xhtml"), ("c", "s.css")]
    assert [s.idref for s in r.spine] == ["intro", "page_1", "page_2", "page_3"] and r.title == "Title"
    (done,) = container.packed(out).collect()
    (tmp_path / "a.epub").write_bytes(done.content)
    again = {x.name: bytes(x.content) for x in volumes.repaired(read(spark, tmp_path)).collect()}
    assert again == {x.name: bytes(x.content) for x in out.collect()}
