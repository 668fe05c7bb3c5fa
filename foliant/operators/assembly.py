"""Books from tables: pages from rows of text, a table of contents from rows of starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import render, toc
from foliant.sources.stored import stored

# Rows of a preview, and the margin from which printed page numbers are preferred.
PREVIEW_ROWS, PAGE_MARGIN = 80, 50


def content_table(catalog: DataFrame, prefix: str) -> DataFrame:
    """book and table: the largest table whose name starts with ``prefix``; of equals the first name."""
    named = catalog.where(F.startswith(F.lower("table"), F.lit(prefix)))
    return named.groupBy("book").agg(F.min(F.struct((-F.col("rows")).alias("_n"), "table")).alias("x")).select("book", F.col("x.table").alias("table"))


def toc_table(catalog: DataFrame, content: DataFrame) -> DataFrame:
    """book and table: the ``t`` table with the suffix of the content table, else the largest one."""
    same = catalog.join(content.select("book", F.concat(F.lit("t"), F.substring("table", 2, 1 << 30)).alias("table")), ["book", "table"], "left_semi").select("book", F.col("table").alias("same"))
    return content_table(catalog, "t").join(same, "book", "full_outer").select("book", F.coalesce("same", "table").alias("table"))


def text_column(columns: list[str], samples: DataFrame) -> str | None:
    """``nass``, else the first column with text in the first 50 rows of ``samples`` (by pos)."""
    if "nass" in columns:
        return "nass"
    head = samples.orderBy("pos").limit(50).agg(*[F.count(F.col(c)).alias(c) for c in columns if c != "pos" and samples.schema[c].dataType.simpleString() == "string"]).first()
    return next((c for c in columns if head and c in head.asDict() and head[c]), None)


def page_column(preview: DataFrame) -> DataFrame:
    """book and ``page_column`` of previews (book, pos, hno, page): ``hno`` where its largest number is far beyond that of ``page``."""
    first = Window.partitionBy("book").orderBy("pos")
    head = preview.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= PREVIEW_ROWS)
    most = head.groupBy("book").agg(F.coalesce(F.max("hno"), F.lit(0)).alias("h"), F.coalesce(F.max("page"), F.lit(0)).alias("p"))
    return most.select("book", F.when(F.col("h") > F.greatest(F.lit(PAGE_MARGIN), F.col("p") + PAGE_MARGIN), "hno").otherwise("page").alias("page_column"))


def raw_toc(rows: DataFrame) -> DataFrame:
    """Entries (book, pos, start, text, level) that can be used: text and start are there, no part headings, each (start, level, text) once; levels start at 1."""
    clean = rows.withColumn("text", T.strip(F.col("text"))).where("text <> '' AND start IS NOT NULL").where(~F.col("text").rlike(T.PART_HEADING))
    # Level 0 and no level are one key.
    first = Window.partitionBy("book", "start", "text", F.nullif("level", F.lit(0))).orderBy("pos")
    once = clean.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    least = F.min("level").over(Window.partitionBy("book"))
    return once.withColumn("level", F.when(least != 1, F.col("level") - least + 1).otherwise(F.col("level")))


def chunks(text: Column, split_numbered: Column) -> Column:
    """Arrays of paragraphs: one array, or one from each heading or numbered line on."""
    lines = T.plain_lines(text)
    none = F.array().cast("array<array<string>>")
    cut = F.aggregate(
        lines,
        none,
        lambda done, x: F.when((F.size(done) == 0) | T.is_heading(x) | T.starts_numbered(x), F.concat(done, F.array(F.array(x)))).otherwise(
            F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(done, F.lit(-1)), F.array(x))))
        ),
    )
    tagged = F.transform(cut, lambda part: F.transform(part, lambda x: F.concat(F.lit("<p>"), T.escape_xml(x), F.lit("</p>"))))
    whole = T.paragraphs(text)
    return F.when(split_numbered & ~T.looks_like_html(text), tagged).when(F.size(whole) > 0, F.array(whole)).otherwise(none)


def pages(rows: DataFrame, toc_starts: DataFrame, split_numbered: bool) -> DataFrame:
    """Pages of rows (book, pos, text, id, page, part): page_number, page, part, text_html, with the row's id, and ``anchored`` where its entry leads.

    ``toc_starts`` has (book, id).  A row that an entry starts from gets an
    anchor in its first chunk with a heading, else in its first.
    """
    marked = rows.withColumn("text", T.strip(F.replace("text", F.lit("\0"), F.lit("")))).where("text <> ''")
    marked = marked.join(toc_starts.select("book", "id").distinct().withColumn("_starts", F.lit(True)), ["book", "id"], "left")
    marked = marked.withColumn("_chunks", chunks(F.col("text"), F.lit(split_numbered)))
    head = F.array_position(F.transform("_chunks", lambda c: T.is_heading(T.strip_tags(F.get(c, 0)))), F.lit(True))
    anchor = F.when(head > 0, head - 1).otherwise(0)
    parted = marked.withColumns({"_anchor": anchor, "_part": T.to_integer(F.col("part"))})
    exploded = parted.select("book", "pos", "id", "page", "_starts", "_anchor", "_part", "part", F.posexplode("_chunks").alias("chunk", "paras"))
    shown = F.coalesce(F.col("_part").cast("string"), T.strip(F.col("part")), F.lit(""))
    foot = T.footer(shown, F.coalesce("page", F.lit(0)))
    is_anchor = F.coalesce("_starts", F.lit(False)) & (F.col("chunk") == F.col("_anchor"))
    link = F.when(is_anchor, F.concat(F.lit('<a id="toc_'), F.col("id"), F.lit('"></a>'))).otherwise("")
    body = F.concat(F.lit("<div>"), link, F.array_join("paras", ""), F.lit("</div>"))
    html = T.close_void_tags(F.when(foot != "", F.concat(body, F.lit('<div class="text-center">'), foot, F.lit("</div>"))).otherwise(body))
    leads = F.col("id").isNotNull() & (~F.coalesce("_starts", F.lit(False)) | is_anchor)
    number = F.row_number().over(Window.partitionBy("book").orderBy("pos", "chunk"))
    return exploded.select("book", "pos", "chunk", number.alias("page_number"), F.coalesce("page", F.lit(0)).alias("page"), F.col("_part").alias("part"), html.alias("text_html"), "id", leads.alias("anchored"), "paras")


def page_of_ids(paged: DataFrame) -> DataFrame:
    """book, id, the last page it leads to, and the first two lines of its first row."""
    last = paged.where("anchored").groupBy("book", "id").agg(F.max("page_number").alias("page_number"))
    first = paged.where("id IS NOT NULL").withColumn("_row", F.min("pos").over(Window.partitionBy("book", "id"))).where("pos = _row")
    lines = F.transform(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "paras"))), lambda x: x["paras"])), 1, 2), T.strip_tags)
    snippets = first.groupBy("book", "id").agg(T.strip(F.array_join(lines, "\n")).alias("snippet"))
    return last.join(snippets, ["book", "id"], "full_outer")


# A chapter heading, and the commentary on it.
CHAPTER, COMMENTARY = "سورة ", "تفسير "


def mapped_toc(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries (from ``raw_toc``) with the page their start leads to; start 0 leads to page 1, others without a page go.

    A chapter is named as its commentary where the page begins so; each (page, level, text) stays once.
    """
    joined = entries.join(ids.select("book", F.col("id").alias("start"), "page_number", "snippet"), ["book", "start"], "left")
    page = F.coalesce("page_number", F.when(F.col("start") == 0, 1))
    longer = F.concat(F.lit(COMMENTARY), F.col("text"))
    named = F.when(F.startswith("text", F.lit(CHAPTER)) & F.coalesce(F.contains("snippet", longer), F.lit(False)), longer).otherwise(F.col("text"))
    anchor = F.when(F.col("start") == 0, "").otherwise(F.concat(F.lit("toc_"), F.col("start")))
    rows = joined.select("book", "pos", page.alias("page"), named.alias("text"), anchor.alias("anchor"), "level").where("page IS NOT NULL")
    first = Window.partitionBy("book", "page", "text", F.nullif("level", F.lit(0))).orderBy("pos")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def automatic_toc(paged: DataFrame) -> DataFrame:
    """book, page_number and text of pages whose first paragraph is a heading of at most 100 characters, each text once."""
    first = T.strip_tags(F.regexp_extract("text_html", r"(?is)<p[^>]*>([\s\S]*?)</p>", 1))
    heads = paged.select("book", "page_number", first.alias("text")).where((F.col("text") != "") & (F.length("text") <= T.LONGEST_TITLE) & T.is_heading(F.col("text")))
    return heads.groupBy("book", "text").agg(F.min("page_number").alias("page_number"))


def book_contents(paged: DataFrame, mapped: DataFrame) -> DataFrame:
    """Nodes (book, path, text, page, href, anchor) of books: their mapped entries, nested where some have levels, else by page; where there are none the headings of their pages; else all pages.

    ``paged`` comes from ``pages``, ``mapped`` from ``mapped_toc``.
    """
    shape = ("book", "node", "path", "text", "page", "anchor")
    known = toc.by_page(mapped).withColumn("pos", F.col("place"))
    leveled = known.groupBy("book").agg(F.max("level").alias("deepest"))
    flat = known.join(leveled.where("deepest IS NULL"), "book", "left_semi").select("book", F.col("pos").alias("node"), F.array("pos").alias("path"), "text", "page", "anchor")
    nested = toc.nested(known.join(leveled.where("deepest IS NOT NULL"), "book", "left_semi").select("book", "pos", "level", "text", "page", "anchor"))
    trees = toc.with_ancestors(nested.withColumnRenamed("pos", "node")).select(*shape)
    heads = automatic_toc(paged).join(leveled, "book", "left_anti")
    by_head = heads.select("book", F.col("page_number").alias("node"), F.array("page_number").alias("path"), "text", F.col("page_number").alias("page"), F.lit("").alias("anchor"))
    bare = paged.join(leveled, "book", "left_anti").join(heads.select("book").distinct(), "book", "left_anti")
    # Fixed value: the label of a page.
    by_page = bare.select("book", F.col("page_number").alias("node"), F.array("page_number").alias("path"), F.concat(F.lit("صفحة "), F.col("page").cast("string")).alias("text"), F.col("page_number").alias("page"), F.lit("").alias("anchor"))
    out = flat.unionByName(trees)
    return out.unionByName(by_head).unionByName(by_page).select("book", "path", "text", "page", F.lit(None).cast("string").alias("href"), "anchor")


def assembled(books: DataFrame, rows: DataFrame, toc_rows: DataFrame, split_numbered: bool = False, toc_page: bool = False) -> DataFrame:
    """Container entries of books from their tables: metadata (book, title, author, about: ``catalogs.book_metadata``), rows of text (book, pos, text, id, page, part) and of contents (book, pos, start, text, level).

    Hand the result to ``sources.container.packed``.  A book without text has no entries.
    """
    entries = stored(raw_toc(toc_rows))
    starts = entries.where("start <> 0").select("book", F.col("start").alias("id")).distinct()
    paged = stored(pages(rows, starts, split_numbered))
    mapped = stored(mapped_toc(entries, page_of_ids(paged)))
    nodes = stored(book_contents(paged, mapped))
    told = books.select("book", "title", "author", "about", F.lit("ar").alias("language"), F.lit("rtl").alias("direction"), F.lit(toc_page).alias("toc_page"))
    shown = paged.select("book", "page_number", F.lit(None).cast("string").alias("title"), "text_html", "part")
    return render.book_entries(told.join(paged.select("book").distinct(), "book", "left_semi"), shown, nodes)
