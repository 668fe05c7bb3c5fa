"""Dimension tables of formats, routes and options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# File types that can be read.
INPUTS = (
    "azw azw3 azw4 azw8 adoc asciidoc cb7 cbc cbr cbz chm csv djv djvu docm docx doc kepub epub fb2 fbz htm html htmlz ipynb kfx kfx-zip kpf lit lrf md mobi "
    "mediawiki odt opf org pdb pml pptx prc rb rst rtf snb tcr tex textile tsv txt txtz t2t typ typst xlsx xhtml bok pdf"
).split()
# File types that each backend can write.
CALIBRE_OUTPUTS = "azw3 docx epub fb2 htmlz kepub kfx lit lrf mobi oeb pdb pdf pmlz rb rtf snb tcr txt txtz zip".split()
PANDOC_ONLY_OUTPUTS = "adoc html md odt org pptx rst tex typ typst".split()
# Input types that only one backend reads, and that both read.
PANDOC_ONLY_INPUTS = "adoc asciidoc csv ipynb mediawiki org pptx rst t2t tex textile tsv typ typst xlsx".split()
SHARED_INPUTS = "docx epub fb2 htm html md odt rtf txt xhtml".split()
# Names of file types as pandoc's readers and writers.
READERS = {
    "adoc": "asciidoc", "asciidoc": "asciidoc", "csv": "csv", "docx": "docx", "epub": "epub", "fb2": "fb2", "htm": "html", "html": "html", "ipynb": "ipynb", "md": "gfm",
    "mediawiki": "mediawiki", "odt": "odt", "org": "org", "pptx": "pptx", "rst": "rst", "rtf": "rtf", "t2t": "t2t", "tex": "latex", "textile": "textile", "tsv": "tsv",
    "txt": "markdown", "typ": "typst", "typst": "typst", "xlsx": "xlsx", "xhtml": "html",
}
WRITERS = {
    "adoc": "asciidoc", "docx": "docx", "epub": "epub", "html": "html5", "md": "gfm+raw_html", "odt": "odt", "org": "org", "pptx": "pptx", "rst": "rst", "tex": "latex",
    "txt": "plain", "typ": "typst", "typst": "typst",
}
# Outputs for which pandoc takes an option.
RTL_OUTPUTS = "docx epub html md".split()
TOC_OUTPUTS = "docx epub html md rst tex typ typst".split()
NUMBERED_OUTPUTS = "docx epub html tex".split()
# Types on either side of KFX conversions.
KFX_SOURCES = "epub opf mobi doc docx kpf kfx-zip".split()
KFX_INPUTS = "azw8 kfx kfx-zip".split()
# The sets behind the option menus, where ``doc`` counts as shared.
MENU_SHARED_INPUTS = ["doc", *SHARED_INPUTS]
MENU_SHARED_OUTPUTS = "docx epub txt".split()
POLISH_OUTPUTS = "azw3 epub kepub".split()
COMMON_OUTPUTS = "azw3 docx epub fb2 htmlz kepub lit lrf mobi oeb pdb pmlz rb rtf snb tcr txt txtz zip".split()
# Options with their defaults, and the values that the others may take.
OPTION_DEFAULTS: dict[str, bool | int | str | None] = {
    "force_rtl": False, "compress_cover": False, "fix_epub": False, "flat_toc": False, "smarten_punctuation": False, "change_justification": "original", "line_height": None,
    "remove_paragraph_spacing": False, "kfx_doc_type": "doc", "kfx_pages": None, "options_context": "docx", "docx_page_size": "default", "docx_no_toc": False, "docx_header_pagebreaks": False,
    "epub_version": "default", "epub_inline_toc": False, "epub_remove_background": False, "epub_split_volumes": False, "epub_standardize_footnotes": False, "pdf_paper_size": "default",
    "pdf_font_profile": "default", "pdf_page_numbers": False, "pdf_no_cover": True, "pdf_no_chapter_pagebreak": False, "conversion_backend": "calibre", "pandoc_toc": False,
    "pandoc_number_sections": False, "pandoc_heading_shift": 0, "docx_arabic_reference": False,
}
OPTION_VALUES: dict[str, list[int | str | None]] = {
    "change_justification": ["original", "left", "justify"], "line_height": [None, 125, 150, 175, 200], "kfx_doc_type": ["doc", "book"], "kfx_pages": [None, 0],
    "options_context": ["docx", "epub", "pdf", "kfx"], "docx_page_size": ["default", "letter", "a4"], "epub_version": ["default", "2", "3"], "pdf_paper_size": ["default", "letter", "a4"],
    "pdf_font_profile": ["default"], "conversion_backend": ["calibre", "pandoc"], "pandoc_heading_shift": [0, -1, 1],
}
EPUB_ONLY_OPTIONS = "fix_epub flat_toc epub_standardize_footnotes epub_split_volumes".split()
# Menu keys of options, where they differ from the option, and words for some values.
MENU_KEYS = {"rtl": "force_rtl", "smarten": "smarten_punctuation"}
MENU_WORDS: dict[tuple[str, str], int | str | None] = {("line_height", "default"): None, ("kfx_pages", "none"): None, ("kfx_pages", "auto"): 0, ("pandoc_heading_shift", "default"): 0, ("pandoc_heading_shift", "promote"): -1, ("pandoc_heading_shift", "demote"): 1}

BOOLEAN_OPTIONS = [k for k, v in OPTION_DEFAULTS.items() if isinstance(v, bool)]


def input_formats(spark: SparkSession) -> DataFrame:
    """One row for each input type: its reader, and which backends read it."""
    rows = [(k, t, READERS.get(t), t in PANDOC_ONLY_INPUTS, t in READERS) for k, t in enumerate(INPUTS)]
    return spark.createDataFrame(rows, "pos INT, input STRING, reader STRING, pandoc_only BOOLEAN, pandoc_reads BOOLEAN")


def output_formats(spark: SparkSession) -> DataFrame:
    """One row for each output type: its writer, and which backends write it."""
    rows = [(k, t, WRITERS.get(t), t in CALIBRE_OUTPUTS, t in WRITERS) for k, t in enumerate(CALIBRE_OUTPUTS + PANDOC_ONLY_OUTPUTS)]
    return spark.createDataFrame(rows, "pos INT, output STRING, writer STRING, calibre_writes BOOLEAN, pandoc_writes BOOLEAN")
