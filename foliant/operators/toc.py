"""Tables of contents as rows, and the volumes they cut a book into.

A node has ``book``, ``node`` (its place in document order) and ``parent`` (a
node, or null at the top), or ``path``, its places from the top down.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _level(levels: int | None = None) -> Column:
    """The level of an item, 1 where it is null or less; more than ``levels`` is an error."""
    level = F.when(F.coalesce("level", F.lit(0)) > 0, F.col("level")).otherwise(1)
    return level if levels is None else F.when(level > levels, F.raise_error(F.lit(f"an item has a level beyond {levels}")).cast("int")).otherwise(level.cast("int"))


def nested(items: DataFrame) -> DataFrame:
    """``items`` (book, pos, level) with ``parent``, the last earlier item of a smaller level.

    Levels may be any numbers; a book's items pass once, in order, with the items that are still open on a stack.
    A level that is null or below 1 counts as 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, above = None, []
        for batch in batches:
            parents = []
            for of, level, pos in zip(*(batch.column(c).to_pylist() for c in ("book", "level_", "pos")), strict=True):
                if of != book:
                    book, above = of, []
                while above and above[-1][0] >= level:
                    above.pop()
                parents.append(above[-1][1] if above else None)
                above.append((level, pos))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parents, batch.schema.field("pos").type)], names=[*batch.schema.names, "parent"])

    ordered = items.withColumn("level_", _level().cast("long")).repartition("book").sortWithinPartitions("book", "pos")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    return ordered.mapInArrow(run, f"{fields}, parent {items.schema['pos'].dataType.simpleString()}").drop("level_")


def nested_by_levels(items: DataFrame, levels: int) -> DataFrame:
    """As ``nested`` where levels are at most ``levels``, with ``path`` too: one running maximum for each level, constant memory for each book, no join.

    The items above one are the last earlier items of smaller levels, but for those that an item of a still smaller level followed.
    """
    before = Window.partitionBy("book").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = items.withColumn("level_", _level(levels))
    rows = rows.withColumns({f"last_{k}": F.max(F.when(F.col("level_") == k, F.col("pos"))).over(before) for k in range(1, levels)})
    above: Column = F.array().cast(f"array<{items.schema['pos'].dataType.simpleString()}>")
    greatest: Column = F.lit(None).cast(items.schema["pos"].dataType)
    parts = []
    for k in range(1, levels):
        last = F.col(f"last_{k}")
        parts.append(F.when((F.col("level_") > k) & last.isNotNull() & (greatest.isNull() | (last > greatest)), last))
        greatest = F.greatest(greatest, last)
    path = F.concat(F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else above, F.array("pos"))
    return rows.withColumn("path", path).select(*items.columns, F.try_element_at("path", F.lit(-2)).alias("parent"), "path")


def with_ancestors(nodes: DataFrame) -> DataFrame:
    """``nodes`` (book, node, parent), in which a parent comes before its children, with ``path``: a book's nodes pass once, however deep they are."""
    kind = nodes.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, above = None, []
        for batch in batches:
            paths = []
            for of, node, parent in zip(*(batch.column(c).to_pylist() for c in ("book", "node", "parent")), strict=True):
                if of != book:
                    book, above = of, []
                while above and above[-1] != parent:
                    above.pop()
                above.append(node)
                paths.append(list(above))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(batch.schema.field("node").type))], names=[*batch.schema.names, "path"])

    ordered = nodes.repartition("book").sortWithinPartitions("book", "node")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    return ordered.mapInArrow(run, f"{fields}, path array<{kind}>")


def by_page(items: DataFrame) -> DataFrame:
    """``items`` (book, pos, page, level) with ``place`` from 1: as they stand, but by page (equal pages as they stand) in books where no item has a level."""
    levels = F.count("level").over(Window.partitionBy("book"))
    rows = items.withColumn("_page", F.when(levels == 0, F.col("page")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("book").orderBy("_page", "pos"))).drop("_page")


def flattened(nodes: DataFrame) -> DataFrame:
    """Nodes in document order (arrays of places sort like the walk), with ``play_order`` from 1."""
    return nodes.withColumn("play_order", F.row_number().over(Window.partitionBy("book").orderBy("path")))


def with_paths(nodes: DataFrame, depth: int) -> DataFrame:
    """``nodes`` (book, node, parent) of any origin with ``path``, the nodes from the top down; a node deeper than ``depth`` is an error."""
    up = nodes.select(F.col("book").alias("_book"), F.col("node").alias("_node"), F.col("parent").alias("_above"))
    out = nodes.withColumns({"path": F.array("node"), "_next": F.col("parent")})
    for _ in range(depth - 1):
        grown = out.join(up, (F.col("book") == F.col("_book")) & (F.col("_next") == F.col("_node")), "left")
        longer = F.when(F.col("_next").isNotNull(), F.concat(F.array("_next"), F.col("path"))).otherwise(F.col("path"))
        out = grown.withColumns({"path": longer, "_next": F.col("_above")}).drop("_book", "_node", "_above")
    kind = nodes.schema["node"].dataType.simpleString()
    return out.withColumn("path", F.when(F.col("_next").isNotNull(), F.raise_error(F.lit(f"a node is deeper than {depth}")).cast(f"array<{kind}>")).otherwise(F.col("path"))).drop("_next")


def page_aliases(pages: DataFrame) -> DataFrame:
    """book, href and page: every way a link may name a page's entry (book, page_number, name, and pos where reading order differs); the first page wins."""
    order = "pos" if "pos" in pages.columns else "page_number"
    clean = F.lower(F.btrim(F.trim("name"), F.lit("/")))
    stripped = F.when(F.startswith(clean, F.lit("oebps/")), F.substring(clean, 7, 1 << 30))
    outside = F.when(~F.startswith(clean, F.lit("oebps/")), F.concat(F.lit("../"), clean))
    rows = pages.where(clean != "").select("book", "page_number", F.col(order).alias("_at"), F.explode(F.array_distinct(F.filter(F.array(clean, stripped, outside), lambda x: x.isNotNull()))).alias("href"))
    return rows.groupBy("book", "href").agg(F.min_by("page_number", "_at").alias("page"))


def resolved(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Nodes (book, node, path, page, href) that lead to a page, with ``page`` and ``parent``.

    A node has its own page, else that of its href, else that of its first kept
    descendant in document order; a node without any goes, and its children
    with it, as none of them has a page.
    """
    own = nodes.withColumn("_href", F.lower(F.trim("href"))).join(aliases.select("book", F.col("href").alias("_href"), F.col("page").alias("_found")), ["book", "_href"], "left")
    own = own.withColumn("_page", F.when(F.col("page") > 0, F.col("page")).otherwise(F.col("_found"))).drop("_href", "_found")
    offers = own.where("_page > 0").select("book", F.col("node").alias("_giver"), F.col("_page").alias("_given"), F.explode("path").alias("node"))
    best = offers.groupBy("book", "node").agg(F.min_by("_given", "_giver").alias("_first"))
    kept = own.join(best, ["book", "node"])
    parent = F.try_element_at(F.col("path"), F.lit(-2))
    return kept.withColumns({"page": F.when(F.col("_page") > 0, F.col("_page")).otherwise(F.col("_first")), "parent": parent}).drop("_page", "_first")


def cut(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each range (book, part, first, last), the nodes (book, node, path, page) whose page lies in it, under their nearest ancestor that does."""
    inside = nodes.join(ranges, "book").where("page BETWEEN first AND last")
    steps = inside.select("book", "part", F.col("node").alias("_child"), F.explode("path").alias("node")).where("node <> _child")
    kept = inside.select("book", "part", "node")
    nearest = steps.join(kept, ["book", "part", "node"]).groupBy("book", "part", "_child").agg(F.max("node").alias("parent")).withColumnRenamed("_child", "node")
    return inside.drop("parent", "first", "last").join(nearest, ["book", "part", "node"], "left")


def volumes(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """``pages`` (book, page_number) with ``volume``, the number of the start (book, page) whose range they fall into.

    The first start reaches back to the first page, starts beyond the last page
    and below 1 don't count, equal starts leave gaps in the numbers, and a book
    with fewer than two volumes has none.  Each page finds its start as the
    last one at or before it, in one pass over both: no range join.
    """
    bounds = pages.groupBy("book").agg(F.min("page_number").alias("_min"), F.max("page_number").alias("_max"))
    order = Window.partitionBy("book").orderBy("page")
    counted = starts.join(bounds, "book").where("page > 0 AND page <= _max").withColumn("_k", F.row_number().over(order))
    counted = counted.withColumn("page", F.when(F.col("_k") == 1, F.least("page", "_min")).otherwise(F.col("page")))
    events = counted.select("book", F.col("page").alias("_at"), F.lit(0).alias("_kind"), F.col("_k").cast("long").alias("_k"), F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in pages.schema) + ">").alias("_row"))
    events = events.unionByName(pages.select("book", F.col("page_number").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_k"), F.struct(*pages.columns).alias("_row")))
    upto = Window.partitionBy("book").orderBy("_at", "_kind", "_k").rowsBetween(Window.unboundedPreceding, 0)
    placed = events.withColumn("volume", F.max("_k").over(upto)).where("_kind = 1 AND volume IS NOT NULL")
    whole = Window.partitionBy("book")
    return placed.withColumns({"_low": F.min("volume").over(whole), "_high": F.max("volume").over(whole)}).where("_low < _high").select("_row.*", "volume")


def volume_bounds(paged: DataFrame) -> DataFrame:
    """book, volume, first and last page number, and pages, of the result of ``volumes``."""
    return paged.groupBy("book", "volume").agg(F.min("page_number").alias("first"), F.max("page_number").alias("last"), F.count("*").alias("pages"))


def within_cap(bounds: DataFrame, cap: int = 35) -> DataFrame:
    """``bounds`` of books with at most ``cap`` volumes; the other books have none (fixed value: 35)."""
    return bounds.withColumn("_n", F.count("*").over(Window.partitionBy("book"))).where(F.col("_n") <= cap).drop("_n")


def better_toc(nav: DataFrame, ncx: DataFrame, last_pages: DataFrame) -> DataFrame:
    """For each book the rows of ``nav``, or of ``ncx`` where nav has none or strictly fewer top-level pages in the book (book, last)."""

    def usable(toc: DataFrame, name: str) -> DataFrame:
        good = F.col("parent").isNull() & (F.col("page") > 0) & (F.col("page") <= F.col("last"))
        return toc.join(last_pages, "book").groupBy("book").agg(F.count_if(good).alias(name), F.count("*").alias(f"{name}_all"))

    both = usable(nav, "v").join(usable(ncx, "x"), "book", "full_outer")
    pick = both.select("book", (F.col("v_all").isNull() | (F.coalesce("x", F.lit(-1)) > F.col("v"))).alias("_ncx"))
    from_nav = nav.join(pick.where("NOT _ncx"), "book", "left_semi")
    return from_nav.unionByName(ncx.join(pick.where("_ncx"), "book", "left_semi"))
