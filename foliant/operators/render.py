"""From rows to files: contents, pages and packages of books, and arguments of converters.

Markup is built by column functions; a nested list is written from rows in
document order alone, as the tags between two neighbours follow from their depths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.plans import domains as D

# Labels of generated pages.
LABELS = {"ar": {"title": "كتاب", "page": "صفحة", "info": "بطاقة الكتاب", "toc": "فهرس الموضوعات"}, "en": {"title": "Book", "page": "Page", "info": "Book Info", "toc": "Table of Contents"}}
# The style sheet and the container of a package.
STYLES = "body{line-height:1.7;margin:1.5rem}"
CONTAINER = '<?xml version="1.0" encoding="utf-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n'


EPUB_SPACE = ' xmlns:epub="http://www.idpf.org/2007/ops"'


def _concat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def label(language: Column, name: str) -> Column:
    return F.when(language == "ar", LABELS["ar"][name]).otherwise(LABELS["en"][name])


def page_file(number: Column, last: Column, part: Column | None = None) -> Column:
    """File name of a page: its part (1 where parts aren't told, none where a page has none) and its number with zeros, one digit wider than the last page's."""
    prefix = F.lit("page_1_") if part is None else F.coalesce(_concat("page_", part.cast("string"), "_"), F.lit("page_"))
    return _concat(prefix, F.lpad(number.cast("string"), F.length(last.cast("string")) + 1, F.lit("0")), ".xhtml")


def link_target(page: Column, file: Column, href: Column, anchor: Column) -> Column:
    """Where an entry leads: its page's file, else its own target, else a name made from its page; with its anchor."""
    target = F.coalesce(file, F.nullif(T.strip(F.coalesce(href, F.lit(""))), F.lit("")), _concat("text/page_", F.coalesce(page, F.lit(0)).cast("string"), ".xhtml"))
    mark = T.strip(F.coalesce(anchor, F.lit("")))
    return F.when(mark != "", _concat(target, "#", mark)).otherwise(target)


def rendered_toc(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """book, ``nav`` (nested list items) and ``ncx`` (nested points) of nodes (book, path, text, page, href, anchor); ``files`` has (book, page, file)."""
    linked = nodes.join(files.select("book", "page", "file"), ["book", "page"], "left")
    order = Window.partitionBy("book").orderBy("path")
    depth = F.size("path")
    rows = linked.select(
        "book", "path", depth.alias("depth"), F.coalesce(F.lag(depth).over(order), F.lit(0)).alias("before"), F.lead(depth).over(order).alias("after"), (F.row_number().over(order) - 1).alias("index"),
        T.escape_xml(F.coalesce("text", F.lit(""))).alias("label"), link_target(F.col("page"), F.col("file"), F.col("href"), F.col("anchor")).alias("target"),
    )
    up = F.greatest(F.col("depth") - F.coalesce("after", F.lit(0)), F.lit(0))
    deeper = F.coalesce(F.col("after") > F.col("depth"), F.lit(False))
    opened = F.when(F.col("depth") > F.col("before"), "<ol>").otherwise("")
    # Closing an item closes its list too where the next one stands higher.
    closed = F.when(deeper, "").when(F.col("after").isNull(), F.repeat(F.lit("</li></ol>"), F.col("depth"))).otherwise(_concat(F.repeat(F.lit("</li></ol>"), up), "</li>"))
    points = F.when(deeper, "").otherwise(F.repeat(F.lit("</navPoint>"), F.when(F.col("after").isNull(), F.col("depth")).otherwise(up + 1)))
    nav = _concat(opened, '<li><a href="', F.col("target"), '">', F.col("label"), "</a>", closed)
    ncx = _concat('<navPoint id="nav_', F.col("index").cast("string"), '"><navLabel><text>', F.col("label"), '</text></navLabel><content src="', F.col("target"), '"/>', points)
    pieces = rows.select("book", F.struct("path", nav.alias("nav"), ncx.alias("ncx")).alias("s")).groupBy("book").agg(F.array_sort(F.collect_list("s")).alias("all"))
    return pieces.select("book", F.array_join(F.transform("all", lambda x: x["nav"]), "").alias("nav"), F.array_join(F.transform("all", lambda x: x["ncx"]), "").alias("ncx"))


# Fixed values below: elements, attributes and identifiers that the formats of pages, navigation, NCX and package documents ask for.
def xhtml(title: Column, body: Column, stylesheet: Column | str, language: Column, direction: Column, attributes: Column | str = "") -> Column:
    """A whole XHTML document."""
    return _concat(
        '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml"', attributes, ' lang="', T.escape_xml(language), '" dir="', T.escape_xml(direction), '">\n',
        '<head> <meta charset="utf-8" /><title>', T.escape_xml(title), '</title> <link rel="stylesheet" href="', stylesheet if isinstance(stylesheet, str) else T.escape_xml(stylesheet), '" /> </head>\n<body> ', body, " </body>\n</html>\n",
    )


def navigation(title: Column, language: Column, direction: Column, items: Column, stylesheet: Column | str) -> Column:
    """The navigation document around nested list items, behind links to the page about the book and to itself."""
    own = _concat('<ol><li><a href="info.xhtml">', T.escape_xml(label(language, "info")), '</a></li><li><a href="nav.xhtml">', T.escape_xml(label(language, "toc")), "</a></li>")
    listed = F.when(items != "", _concat(own, F.substring(items, F.lit(5), F.length(items)))).otherwise(_concat(own, "</ol>"))
    body = _concat('<nav epub:type="toc" id="toc"><h1>', T.escape_xml(label(language, "toc")), "</h1>", listed, "</nav>")
    return xhtml(title, body, stylesheet, language, direction, EPUB_SPACE)


def ncx(title: Column, language: Column, points: Column, identifier: Column) -> Column:
    own = lambda name, target: _concat(f'<navPoint id="{target.split(".")[0]}"><navLabel><text>', T.escape_xml(label(language, name)), f'</text></navLabel><content src="{target}"/></navPoint>')
    return _concat(
        '<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta content="', T.escape_xml(identifier), '" name="dtb:uid"/></head><docTitle><text>',
        T.escape_xml(title), "</text></docTitle><navMap>", own("info", "info.xhtml"), own("toc", "nav.xhtml"), points, "</navMap></ncx>\n",
    )


def package(title: Column, author: Column, language: Column, direction: Column, identifier: Column, files: Column, stylesheet: Column | str = "styles.css", toc_page: Column | None = None, assets: Column | None = None) -> Column:
    """The package document; ``files`` is the array of page files in reading order, ``assets`` one of (href, media_type, properties)."""
    name = lambda f: F.replace(f, F.lit(".xhtml"), F.lit(""))
    items = F.array_join(F.transform(files, lambda f: _concat('<item id="', name(f), '" href="text/', f, '" media-type="application/xhtml+xml"/>')), "")
    refs = F.array_join(F.transform(files, lambda f: _concat('<itemref idref="', name(f), '"/>')), "")
    creator = F.when(author != "", _concat("<dc:creator>", T.escape_xml(author), "</dc:creator>")).otherwise("")
    nav = F.when(toc_page, '<itemref idref="nav"/>').otherwise("") if toc_page is not None else ""
    others: Column | str = ""
    if assets is not None:
        marked = lambda a: F.when(a["properties"] != "", _concat(' properties="', T.escape_xml(a["properties"]), '"')).otherwise("")
        others = F.array_join(F.transform(assets, lambda a, k: _concat('<item id="a', (k + 1).cast("string"), '" href="', T.escape_xml(a["href"]), '" media-type="', T.escape_xml(a["media_type"]), '"', marked(a), "/>")), "")
    return _concat(
        '<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">', T.escape_xml(identifier),
        "</dc:identifier><dc:title>", T.escape_xml(title), "</dc:title>", creator, "<dc:language>", language, '</dc:language></metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>',
        '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="css" href="', stylesheet if isinstance(stylesheet, str) else T.escape_xml(stylesheet), '" media-type="text/css"/><item id="info" href="info.xhtml" media-type="application/xhtml+xml"/>', items, others,
        '</manifest><spine toc="ncx" page-progression-direction="', direction, '"><itemref idref="info"/>', nav, refs, "</spine></package>\n",
    )


#: What a book may have beside its required columns, and what stands for it.
BOOK_DEFAULTS = {"identifier": "string", "style_path": "string", "style": "binary", "toc_page": "boolean", "assets": "array<struct<href:string,media_type:string,properties:string>>"}


def book_entries(books: DataFrame, pages: DataFrame, toc: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Container entries (book, pos, name, content) of books (book, title, author, about, language, direction), pages (book, page_number, title, text_html) and nodes of contents.

    A book may bring its identifier, its style sheet (style_path, style), whether the navigation
    is read as a page (toc_page), its pages their ``part``, and files of its own: ``assets`` for its manifest, ``extra``
    (book, name, content) for its container, but for names that are made here.  A book
    without contents gets one entry for each page.  Hand the result to ``sources.container.packed``;
    volumes are books of their own.
    """
    language, direction = T.volume_language(F.col("language")), T.page_direction(F.col("direction"))
    given = books.withColumns({n: F.lit(None).cast(t) for n, t in BOOK_DEFAULTS.items() if n not in books.columns})
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), label(language, "title"))
    identifier = F.coalesce(F.nullif("identifier", F.lit("")), _concat("book-", F.sha1(F.concat_ws("|", F.col("book").cast("string"), title))))
    about = given.select(
        "book", title.alias("title"), F.coalesce("author", F.lit("")).alias("author"), F.coalesce("about", F.lit("")).alias("about"), language.alias("language"), T.text_direction(language, direction).alias("direction"), identifier.alias("identifier"),
        F.when(F.col("style").isNotNull(), F.coalesce("style_path", F.lit("OEBPS/styles.css"))).otherwise("OEBPS/styles.css").alias("style_path"), F.coalesce("style", F.encode(F.lit(STYLES), "UTF-8")).alias("style"), F.coalesce("toc_page", F.lit(False)).alias("toc_page"),
        F.filter(F.coalesce("assets", F.array().cast(BOOK_DEFAULTS["assets"])), lambda a: (a["href"] != "") & (a["media_type"] != "")).alias("assets"),
    )
    numbered = pages.withColumn("file", page_file(F.col("page_number"), F.max("page_number").over(Window.partitionBy("book")), F.col("part") if "part" in pages.columns else None))
    files = numbered.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "file"))), lambda x: x["file"]).alias("files"))
    nodes = toc.select("book", "path", "text", "page", "href", "anchor")
    bare = numbered.join(nodes.select("book").distinct(), "book", "left_anti").join(about.select("book", "language"), "book")
    none = F.lit(None).cast("string")
    listed = bare.select("book", F.array(F.col("page_number").cast("int")).alias("path"), _concat(label(F.col("language"), "page"), " ", F.col("page_number").cast("string")).alias("text"), F.col("page_number").alias("page"), none.alias("href"), none.alias("anchor"))
    contents = rendered_toc(nodes.unionByName(listed), numbered.select("book", F.col("page_number").alias("page"), _concat("text/", F.col("file")).alias("file")))
    whole = about.join(files, "book").join(contents, "book", "left")
    c = F.col
    lang, way, style = c("language"), c("direction"), T.relative_path(F.lit("OEBPS"), c("style_path"))
    text = lambda x: F.encode(x if isinstance(x, Column) else F.lit(x), "UTF-8")
    parts = [
        (F.lit("mimetype"), text("application/epub+zip")), (F.lit("META-INF/container.xml"), text(CONTAINER)), (c("style_path"), c("style")),
        (F.lit("OEBPS/content.opf"), text(package(c("title"), c("author"), lang, way, c("identifier"), c("files"), style, c("toc_page"), F.filter("assets", lambda a: T.zip_path(F.lit("OEBPS"), a["href"]) != c("style_path"))))),
        (F.lit("OEBPS/info.xhtml"), text(xhtml(label(lang, "info"), c("about"), style, lang, way))), (F.lit("OEBPS/nav.xhtml"), text(navigation(c("title"), lang, way, F.coalesce("nav", F.lit("")), style))), (F.lit("OEBPS/toc.ncx"), text(ncx(c("title"), lang, F.coalesce("ncx", F.lit("")), c("identifier")))),
    ]
    fixed = whole.select("book", F.explode(F.array(*[F.struct(F.lit(k).alias("pos"), n.alias("name"), x.alias("content")) for k, (n, x) in enumerate(parts)])).alias("e")).select("book", "e.*")
    named = numbered.select("book", "page_number", "file", "text_html", F.col("title").alias("heading")).join(about, "book")
    spaced = F.when(c("text_html").contains("epub:type="), EPUB_SPACE).otherwise("")
    body = xhtml(F.coalesce(F.nullif("heading", F.lit("")), "title"), c("text_html"), T.relative_path(F.lit("OEBPS/text"), c("style_path")), lang, way, spaced)
    paged = named.select("book", (F.col("page_number") + len(parts)).cast("int").alias("pos"), _concat("OEBPS/text/", c("file")).alias("name"), text(body).alias("content"))
    made = fixed.unionByName(paged)
    if extra is None:
        return made
    own = extra.join(made.select("book", "name"), ["book", "name"], "left_anti").join(about.select("book"), "book", "left_semi")
    place = F.lit(1 << 30) + F.dense_rank().over(Window.partitionBy("book").orderBy("name"))
    return made.unionByName(own.select("book", place.cast("int").alias("pos"), "name", "content"))


def volume_books(books: DataFrame, paged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Books and pages of volumes (from ``toc.volumes``): each volume is a book named ``<book>/<volume>`` with the volume in its title."""
    name = _concat(F.col("book").cast("string"), "/", F.col("volume").cast("string"))
    pages = paged.withColumn("_v", name).drop("book").withColumnRenamed("_v", "book")
    volumes = paged.select("book", "volume").distinct().join(books, "book")
    return volumes.withColumns({"title": F.trim(_concat(F.col("title"), " - ", F.col("volume").cast("string"))), "book": name}), pages


def _flags(*options: tuple[Column, list[Column | str]]) -> Column:
    """The words of those options whose condition holds, in order."""
    return F.flatten(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.array(*[F.lit(w) if isinstance(w, str) else w.cast("string") for w in words])) for c, words in options]), lambda x: x.isNotNull()))


# Fixed values below: words of the converters' command lines, and names of filters and preparations.
def calibre_arguments() -> Column:
    """Calibre's arguments for a route with its option columns; fonts depend on files and are left to the caller."""
    c = F.col
    to = lambda kind: c("output") == kind
    return _flags(
        (c("smarten_punctuation"), ["--smarten-punctuation"]), (c("remove_paragraph_spacing"), ["--remove-paragraph-spacing"]), (c("change_justification") != "original", ["--change-justification", c("change_justification")]), (c("line_height").isNotNull(), ["--minimum-line-height", c("line_height")]),
        (to("docx"), ["--filter-css", "float"]), (to("docx") & (c("docx_page_size") != "default"), ["--docx-page-size", c("docx_page_size")]), (to("docx") & c("docx_no_toc"), ["--docx-no-toc"]),
        (to("epub") & (c("epub_version") != "default"), ["--epub-version", c("epub_version")]), (to("epub") & c("epub_inline_toc"), ["--epub-inline-toc"]), (to("epub") & c("epub_remove_background"), ["--filter-css", "background,background-color,background-image"]),
        (to("pdf") & (c("pdf_paper_size") != "default"), ["--paper-size", c("pdf_paper_size")]), (to("pdf") & c("pdf_page_numbers"), ["--pdf-page-numbers"]), (to("pdf") & c("pdf_no_cover"), ["--pdf-no-cover"]), (to("pdf") & c("pdf_no_chapter_pagebreak"), ["--chapter-mark", "none"]),
    )


def pandoc_arguments() -> Column:
    c = F.col
    toc = c("pandoc_toc") & c("output").isin(*D.TOC_OUTPUTS)
    numbers = c("pandoc_number_sections") & c("output").isin(*D.NUMBERED_OUTPUTS)
    return _flags((toc | numbers, ["--standalone"]), (toc, ["--toc"]), (numbers, ["--number-sections"]), (c("pandoc_heading_shift") != 0, ["--shift-heading-level-by", c("pandoc_heading_shift")]))


def pandoc_filters() -> Column:
    """The text filters that a pandoc route runs, in order."""
    c, out = F.col, F.col("output")
    return _flags(
        (c("input") == "docx", ["docx-cleanup"]), (F.lit(True), ["empty-blocks"]), (F.lit(True), ["arabic-punctuation"]), (out == "md", ["bidi-cleanup"]),
        (c("docx_header_pagebreaks") & (out == "docx"), ["docx-header-pagebreaks"]), (c("force_rtl") & out.isin(*D.RTL_OUTPUTS), ["rtl-wrap"]),
    )


def preparation(backend: Column) -> Column:
    """What is done to an EPUB before it is converted; the text direction for Calibre only."""
    c, epub = F.col, F.col("input") == "epub"
    return _flags((epub & (backend == "calibre") & c("force_rtl"), ["right to left"]), (epub & c("fix_epub"), ["repair"]), (epub & c("flat_toc"), ["flatten contents"]), (epub & c("epub_standardize_footnotes"), ["standardise footnotes"]))


def page_breaks(blocks: DataFrame, shift: int = 0) -> DataFrame:
    """Blocks (book, pos, level; null for no heading) with ``breaks``: headings of shifted level 1 or 2 but the first."""
    top = (F.col("level") + shift).between(1, 2)
    seen = F.sum(F.coalesce(top, F.lit(False)).cast("int")).over(Window.partitionBy("book").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("breaks", F.coalesce(top, F.lit(False)) & (seen > 1))


def chat_name(first: Column, last: Column, title: Column, is_person: Column) -> Column:
    """A person's names, each without blanks around it, the last one after a space; else the title."""
    after = F.when(last != "", _concat(" ", F.trim(last))).otherwise("")
    return F.when(is_person, F.concat(F.when(first != "", F.trim(first)).otherwise(""), after)).otherwise(title)


def chat_type(is_private: Column, is_group: Column) -> Column:
    """0 for a person, 1 for a group, 2 for a channel."""
    return F.when(is_private, 0).when(is_group, 1).otherwise(2)


def translated(messages: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``messages`` (language, message) with ``shown``: the dictionary's text, else the message; repeated spaces become one."""
    asked = messages.withColumn("language", F.coalesce(F.nullif("language", F.lit("")), F.lit("en")))
    known = asked.join(dictionary.select("language", "message", "text"), ["language", "message"], "left")
    return known.withColumn("shown", T.single_spaces(F.coalesce("text", "message"))).drop("text")


def accepted_sizes(files: DataFrame) -> DataFrame:
    """Files (size, is_admin) that may be converted (fixed value: 26,214,400 bytes; administrators have no limit)."""
    return files.where((F.col("size") <= 26_214_400) | F.col("is_admin"))


def button_rows(buttons: DataFrame, per_row: int) -> DataFrame:
    """``buttons`` (request, pos) with ``row`` and ``column`` of a keyboard."""
    k = F.row_number().over(Window.partitionBy("request").orderBy("pos")) - 1
    return buttons.withColumns({"row": F.floor(k / per_row).cast("int"), "column": (k % per_row).cast("int")})
