"""Databases of books as catalogs of tables: headers, counts, ragged columns, and what their tables say about a book.

Edge cases: a table without columns has no header row and counts its rows; columns of unequal length are padded
with nulls; a book without a main table has its name as title and nothing else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T


def headers(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table, pos and column of all tables, from their metadata alone."""
    rows = [(name, pos, column) for name, df in tables.items() for pos, column in enumerate(df.columns)]
    return spark.createDataFrame(rows, "table STRING, pos INT, column STRING")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table and rows; a Parquet table is counted from its footers."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(1).alias("one")).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()])


def zipped(columns: DataFrame, names: list[str]) -> DataFrame:
    """Rows (book, pos, and a value of each name) of tables whose columns come as arrays of unequal length (book, and an array of each name)."""
    arrays = F.arrays_zip(*[F.coalesce(F.col(n), F.array().cast(columns.schema[n].dataType)).alias(n) for n in names])
    return columns.select("book", F.posexplode(arrays).alias("pos", "row")).select("book", "pos", "row.*")


# Names of the main table, and words by which its columns are told.
MAIN = ("Main", "main")
TITLE, AUTHOR, CARD = ("title", "book", "bk", "name"), ("author", "auth"), ("betaka", "card", "about")


def _picked(words: tuple[str, ...]) -> Column:
    """The value of the first column whose name is one of ``words``, else of the first one that holds one of them."""
    low = F.lower("column")
    holds = reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    rank = F.when(low.isin(*words), F.col("pos")).when(holds, F.col("pos") + (1 << 20))
    return T.strip(F.coalesce(F.min_by(F.when(rank.isNotNull(), F.coalesce("value", F.lit(""))), rank), F.lit("")))


def book_metadata(values: DataFrame, names: DataFrame) -> DataFrame:
    """book, title, author and about (markup) of books (book, name).

    ``values`` (book, table, table_pos, column, pos, value) has the first value of every column.  The card is taken from the
    main table, else from the first table with a column that is named so.
    """
    main = values.where(F.col("table").isin(*MAIN))
    chosen = main.groupBy("book").agg(F.min("table").alias("table"))  # the capital goes first
    told = main.join(chosen, ["book", "table"], "left_semi").groupBy("book").agg(_picked(TITLE).alias("title"), _picked(AUTHOR).alias("author"), _picked(CARD).alias("card"))
    cards = values.where(F.lower("column").contains(CARD[0])).groupBy("book").agg(T.strip(F.coalesce(F.min_by(F.coalesce("value", F.lit("")), F.struct("table_pos", "pos")), F.lit(""))).alias("other"))
    rows = names.join(told, "book", "left").join(cards, "book", "left")
    bare = F.regexp_replace("name", r"(?i)\.(bok|mdb|accdb)$", "")
    known = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    rows = rows.select("book", T.strip(F.coalesce(known("title"), bare)).alias("title"), F.coalesce("author", F.lit("")).alias("author"), F.coalesce(known("card"), known("other"), F.lit("")).alias("card"))
    by = F.when(F.col("author") != "", F.concat(F.lit(f"<p>{T.AUTHOR_LABEL}"), T.escape_xml(F.col("author")), F.lit("</p>"))).otherwise("")
    card = T.close_void_tags(F.array_join(T.paragraphs(F.col("card")), ""))
    about = F.concat(F.lit("<div>\n<h1>"), T.escape_xml(F.col("title")), F.lit("</h1>\n"), by, F.lit("\n"), card, F.lit("\n</div>"))
    return rows.select("book", "title", "author", about.alias("about"))


# Fixed value: what is said of a document without text.
NO_TEXT = "No extractable text found in PDF (scanned/image PDF)."


def extracted(pages: DataFrame, blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """book, html and error of documents (book, title) from pages (book, page) and their text blocks (book, page, top, left, kind, text; kind 0 is text).

    Blocks go by page, then from top to bottom and from left to right; each page ends with a rule.  A document
    without visible text has no html but an error.
    """
    escaped = lambda x: F.replace(T.escape_xml(x), F.lit("&apos;"), F.lit("&#x27;"))
    good = blocks.where((F.col("kind") == 0) & (F.coalesce("text", F.lit("")) != "")).withColumn("paras", T.blocks(F.regexp_replace("text", "\r\n?|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")))
    tagged = F.transform("paras", lambda p: F.concat(F.lit("<p>"), escaped(p), F.lit("</p>")))
    lines = good.select("book", "page", F.lit(0).alias("last"), "top", "left", tagged.alias("lines"), F.aggregate("paras", F.lit(0), lambda n, p: n + T.visible_length(p)).alias("seen"))
    zero = F.lit(0.0)
    rules = pages.select("book", "page", F.lit(1).alias("last"), zero.alias("top"), zero.alias("left"), F.array(F.lit("<hr />")).alias("lines"), F.lit(0).alias("seen"))
    rows = lines.withColumns({"top": F.col("top").cast("double"), "left": F.col("left").cast("double")}).unionByName(rules)
    whole = rows.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("page", "last", "top", "left", "lines"))).alias("all"), F.sum("seen").alias("seen"))
    joined = titles.join(whole, "book", "left")
    body = F.regexp_replace(F.array_join(F.flatten(F.transform("all", lambda r: r["lines"])), "\n"), r"\s+$", "")
    html = F.concat(F.lit('<html><head><meta charset="utf-8"><title>'), escaped(F.col("title")), F.lit("</title></head><body>"), body, F.lit("</body></html>"))
    some = F.coalesce(F.col("seen"), F.lit(0)) > 0
    return joined.select("book", F.when(some, html).alias("html"), F.when(~some, NO_TEXT).alias("error"))


def archive_entries(documents: DataFrame) -> DataFrame:
    """Container entries (book, pos, name, content) of documents with html, for ``sources.container.packed``."""
    return documents.where("html IS NOT NULL").select("book", F.lit(0).alias("pos"), F.lit("index.html").alias("name"), F.encode("html", "UTF-8").alias("content"))
