from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliant.operators import routing
from foliant.plans import domains as D


@pytest.fixture(scope="module")
def matrix(spark):
    found: dict[str, list[str]] = {}
    for r in routing.routes(D.input_formats(spark), D.output_formats(spark)).orderBy("output_pos").collect():
        found.setdefault(r.input, []).append(r.output)
    return found


def test_sizes():
    assert (len(D.INPUTS), len(D.CALIBRE_OUTPUTS), len(D.PANDOC_ONLY_OUTPUTS)) == (57, 21, 10)
    assert set(D.OPTION_VALUES) | set(D.BOOLEAN_OPTIONS) == set(D.OPTION_DEFAULTS)


def test_outputs(matrix):
    assert "md" not in matrix["md"] and "epub" in matrix["epub"] and "docx" not in matrix["docx"]
    assert matrix["csv"] == matrix["tsv"] and not set(matrix["csv"]) & {"pdf", "kfx", "mobi"}
    assert matrix["doc"] == D.CALIBRE_OUTPUTS + D.PANDOC_ONLY_OUTPUTS
    assert matrix["mobi"] == D.CALIBRE_OUTPUTS
    assert "rst" not in matrix["rst"] and "typ" not in matrix["typst"]


def plans(spark, requests):
    df = routing.with_defaults(spark.createDataFrame([r + (None,) * (6 - len(r)) for r in requests], "input STRING, output STRING, conversion_backend STRING, force_rtl BOOLEAN, epub_split_volumes BOOLEAN, smarten_punctuation BOOLEAN"))
    return [tuple(r) for r in df.select(routing.backend().alias("b"), routing.plan().alias("p")).collect()]


def test_backends_and_plans(spark):
    got = plans(spark, [
        ("docx", "epub"), ("docx", "epub", "pandoc"), ("docx", "epub", "pandoc", False, False, True), ("csv", "docx"), ("docx", "md"), ("docx", "pdf", None, True),
        ("epub", "epub"), ("epub", "epub", None, None, True), ("epub", "epub", None, None, None, True), ("doc", "kfx"), ("pdf", "kfx"), ("kfx", "epub"), ("txt", "kfx"), ("mobi", "kfx"), ("bok", "epub"),
    ])
    assert got == [
        ("calibre", "calibre"), ("pandoc", "pandoc"), ("calibre", "calibre"), ("pandoc", "pandoc"), ("pandoc", "pandoc"), ("calibre", "epub, right to left, pdf"),
        ("calibre", "none"), ("calibre", "split volumes"), ("calibre", "rebuild epub"), ("calibre", "none"), ("calibre", "extract pages, epub, to kfx"), ("calibre", "from kfx"), ("calibre", "none"), ("calibre", "to kfx"), ("calibre", "assemble"),
    ]


def test_supported_names(spark):
    names = [("a.EPUB",), ("b.tar.gz",), ("pdf",), ("",), (None,), ("x.",)]
    assert [r[0] for r in spark.createDataFrame(names, "n STRING").select(routing.is_supported(F.col("n"))).collect()] == [True, False, True, False, False, False]


def test_persisted_options(spark):
    text = '{"force_rtl":"yes","change_justification":"wide","line_height":250,"options_context":"invalid","fix_epub":true,"flat_toc":true,"pdf_paper_size":"a4","pdf_font_profile":"unknown","conversion_backend":"unknown","x":1}'
    columns = routing.persisted_options(F.col("t"), F.col("input"))
    df = spark.createDataFrame([(text, "pdf"), ('{"force_rtl":1,"kfx_pages":0,"line_height":125.0}', "epub"), ("[]", "pdf")], "t STRING, input STRING").select(*[c.alias(n) for n, c in columns.items()])
    first, second, third = [r.asDict() for r in df.collect()]
    assert first == D.OPTION_DEFAULTS | {"pdf_paper_size": "a4"}
    assert second == D.OPTION_DEFAULTS | {"kfx_pages": 0}
    assert third == D.OPTION_DEFAULTS


def test_option_menu(spark):
    clicks = [(1, "rtl", "1"), (2, "flat_toc", "1"), (3, "line_height", "150"), (4, "line_height", "151"), (5, "pandoc_heading_shift", "promote"), (6, "kfx_pages", "none"), (7, "rtl", "x")]
    log = spark.createDataFrame([(i, "pdf", *c) for i in (1, 2) for c in clicks] + [(2, "pdf", 4, "reset", "")], "request INT, input STRING, seq INT, key STRING, value STRING")
    got = {(r.request, r.option): r.value for r in routing.options_after(routing.option_events(log)).collect()}
    assert got == {(1, "force_rtl"): "true", (1, "line_height"): "150", (1, "pandoc_heading_shift"): "-1", (1, "kfx_pages"): "null", (2, "pandoc_heading_shift"): "-1", (2, "kfx_pages"): "null"}


def test_effective_options(spark):
    everything = {n: True for n in D.BOOLEAN_OPTIONS} | {"line_height": 150, "conversion_backend": "pandoc"}
    df = spark.createDataFrame([("docx", "epub"), ("epub", "pdf"), ("epub", "docx")], "input STRING, output STRING").withColumns({k: F.lit(v) for k, v in everything.items()})
    a, b, c = [r.asDict() for r in routing.with_defaults(df).select(*[c.alias(n) for n, c in routing.effective_options().items()]).collect()]
    assert a["conversion_backend"] == "pandoc" and a["force_rtl"] and a["pandoc_toc"] and a["line_height"] is None and not a["fix_epub"] and not a["pdf_no_cover"]
    assert b["conversion_backend"] == "calibre" and b["fix_epub"] and b["pdf_no_cover"] and b["force_rtl"] and not b["pandoc_toc"] and not b["smarten_punctuation"]
    assert c["docx_header_pagebreaks"] and c["docx_arabic_reference"] and not c["compress_cover"]
