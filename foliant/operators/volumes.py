"""Whole books in containers: splitting them into volumes, and repairs of their markup.

Each step is an operator on tables (``structure``, ``toc``, ``render``) around the
parsers of ``sources.container``; books meet on the key ``book`` only.  What parsers give,
and what several steps read, is a written table (``sources.stored``).

Edge cases: a book without a package document that can be parsed, without pages, or with
fewer than two volumes gives nothing; pages that can't be parsed are left out of volumes,
and stay as they are in repairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import footnote_pages, render, structure, toc
from foliant.sources import container
from foliant.sources.stored import stored


def page_entries(found: DataFrame, items: DataFrame, entries: DataFrame) -> DataFrame:
    """book, pos (from 1) and name of the pages: those of the spine, in its order; where it names none, all XHTML files in a text folder, by name."""
    by_id = items.where("id <> ''").groupBy("book", "id").agg(F.max_by(F.struct("path", "page"), "pos").alias("x"))
    spine = found.select("book", F.explode("spine").alias("s")).select("book", F.col("s.pos").alias("pos"), F.col("s.idref").alias("id"))
    paths = spine.join(by_id, ["book", "id"]).where("x.page").select("book", "pos", F.col("x.path").alias("candidate"))
    named = structure.find_entry(paths.select("book", F.col("pos").alias("what"), F.lit(0).alias("at"), "candidate"), entries)
    from_spine = named.groupBy("book", F.col("entry").alias("name")).agg(F.min("what").alias("at"))
    low = F.lower("name")
    others = entries.where(low.contains("/text/") & F.endswith(low, F.lit(".xhtml"))).select("book", "name").distinct().join(from_spine.select("book").distinct(), "book", "left_anti").join(found.select("book"), "book", "left_semi")
    rows = from_spine.unionByName(others.select("book", "name", F.lit(0).alias("at")))
    return rows.select("book", F.row_number().over(Window.partitionBy("book").orderBy("at", "name")).alias("pos"), "name")


def resources(found: DataFrame, items: DataFrame, entries: DataFrame) -> DataFrame:
    """book, what (info, nav, ncx or style) and entry of a book's own documents: the manifest's, else those in the usual places."""
    late = 1 << 30
    # Of style sheets those with the id ``css`` go first, the last one before others.
    rank = F.when(F.lower("id") == "css", -F.col("pos") - 1).otherwise(F.col("pos"))
    first = [items.where(kind).groupBy("book").agg(F.min_by("path", "pos").alias("candidate")).select("book", F.lit(kind).alias("what"), F.lit(0).alias("at"), "candidate") for kind in ("info", "nav", "ncx")]
    styles = items.where("style").select("book", F.lit("style").alias("what"), rank.cast("int").alias("at"), F.col("path").alias("candidate"))
    usual = [("info", "info.xhtml", True), ("info", "OEBPS/info.xhtml", False), ("nav", "nav.xhtml", True), ("nav", "OEBPS/nav.xhtml", False), ("ncx", "toc.ncx", True), ("ncx", "OEBPS/toc.ncx", False), ("style", "styles.css", True), ("style", "OEBPS/styles.css", False), ("style", "styles.css", False)]
    places = F.array(*[F.struct(F.lit(what).alias("what"), F.lit(late + k).alias("at"), (F.concat_ws("/", F.nullif("directory", F.lit("")), F.lit(name)) if inside else F.lit(name)).alias("candidate")) for k, (what, name, inside) in enumerate(usual)])
    rows = found.select("book", F.explode(places).alias("p")).select("book", "p.*")
    for part in (*first, styles):
        rows = rows.unionByName(part)
    return structure.find_entry(rows, entries)


def best_toc(entries: DataFrame, own: DataFrame, pages: DataFrame) -> DataFrame:
    """Nodes of a book's contents that lead to a page, from its navigation or its NCX file."""
    nodes = stored(container.toc_rows(entries, own.where("what IN ('nav', 'ncx')").select("book", F.col("what").alias("source"), F.col("entry").alias("name"))))
    aliases = toc.page_aliases(pages.select("book", "page_number", "name", "pos"))
    last = pages.groupBy("book").agg(F.max("page_number").alias("last"))
    # Both kinds of contents are resolved at once, as books of their own.
    of = F.struct("book", "source")
    both = stored(toc.resolved(nodes.withColumn("book", of).drop("source"), aliases.withColumn("source", F.explode(F.array(F.lit("nav"), F.lit("ncx")))).withColumn("book", of).drop("source")))
    found = [both.where(F.col("book.source") == source).withColumn("book", F.col("book.book")) for source in ("nav", "ncx")]
    return toc.better_toc(*found, last)


def split(entries: DataFrame) -> DataFrame:
    """Container entries (book, volume, pos, name, content) of the volumes of each book in ``entries`` (from ``container.read_entries``).

    ``book`` is the name of the volume, ``<book>/<volume>``; each top-level entry of the contents begins a
    volume.  A volume has its pages, its part of the contents, and all files that the splitting doesn't make anew.
    """
    entries = stored(structure.unique_entries(entries))
    chosen = structure.package_entry(container.rootfiles(entries), entries)
    found = stored(container.packages(entries, chosen))
    items = container.manifest(found)
    names, own = stored(page_entries(found, items, entries)), stored(resources(found, items, entries))
    pages = stored(container.page_rows(entries, names))
    nodes = stored(best_toc(entries, own, pages))
    paged = stored(toc.volumes(pages, nodes.where("parent IS NULL").select("book", "page")))
    bounds = toc.volume_bounds(paged).select("book", F.col("volume").alias("part"), "first", "last")
    about = container.bodies(entries, own.where("what = 'info'").select("book", F.col("entry").alias("name"))).select("book", F.col("body").alias("about"))
    style = container.contents(entries, own.where("what = 'style'").select("book", F.col("entry").alias("name"))).select("book", F.col("name").alias("style_path"), F.col("content").alias("style"))
    taken = names.select("book", F.lower("name").alias("lower"))
    assets = items.where("asset").withColumn("lower", F.lower("path")).join(taken, ["book", "lower"], "left_anti")
    listed = assets.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "href", "media_type", "properties"))), lambda a: F.struct(a["href"].alias("href"), a["media_type"].alias("media_type"), a["properties"].alias("properties"))).alias("assets"))
    books = found.join(paged.select("book").distinct(), "book", "left_semi").drop("items", "spine", "entry", "directory").join(about, "book", "left").join(style, "book", "left").join(listed, "book", "left")
    volume_books, volume_pages = render.volume_books(books, paged.select("book", "volume", "page_number", F.get("titles", F.lit(0)).alias("title"), "text_html"))
    volume_books, volume_pages = stored(volume_books), stored(volume_pages)
    kept = stored(toc.cut(nodes, bounds))
    # Paths within the range: a node hangs on its nearest ancestor there.
    inside = kept.select("book", "part", F.col("node").alias("above"))
    steps = kept.select("book", "part", "node", "text", "page", "href", "anchor", F.explode("path").alias("above")).join(inside, ["book", "part", "above"])
    cut = steps.groupBy("book", "part", "node", "text", "page", "href", "anchor").agg(F.array_sort(F.collect_list("above")).alias("path"))
    name = F.concat_ws("/", "book", F.col("part").cast("string"))
    contents = stored(cut.select(name.alias("book"), "path", "text", "page", "href", "anchor"))
    excluded = own.where("what <> 'style'").select("book", F.col("entry").alias("name")).unionByName(names.select("book", "name")).unionByName(chosen.select("book", F.col("entry").alias("name")))
    others = structure.passed_through(entries, excluded).select("book", "name", "content")
    extra = others.join(volume_books.select(F.regexp_replace("book", "/[0-9]+$", "").alias("of"), F.col("book").alias("volume_book")), F.col("of") == F.col("book")).select(F.col("volume_book").alias("book"), "name", "content")
    made = render.book_entries(volume_books, volume_pages, contents, extra)
    return made.withColumn("volume", F.substring_index("book", "/", -1).cast("int"))


def volume_file(stem: str, volume: int | str) -> str:
    """The name of a volume's file, for ``container.saved``."""
    import re

    return re.sub(r"\s+", " ", re.sub(r'[/:*?"<>|]+', "_", f"{stem} - {volume}.epub")).strip()


def _pages_in_order(entries: DataFrame) -> DataFrame:
    found = stored(container.packages(entries, structure.package_entry(container.rootfiles(entries), entries)))
    items = found.select("book", "directory", F.explode("items").alias("i")).select("book", "directory", "i.pos", "i.id", "i.href", "i.media_type")
    spine = found.select("book", F.explode("spine").alias("s")).select("book", "s.pos", "s.idref")
    return stored(structure.reading_order(spine, items, entries))


def with_standard_footnotes(entries: DataFrame) -> DataFrame:
    """``entries`` with the footnotes of all pages, in reading order, as linked asides; everything else is as it was."""
    entries = stored(entries)
    pages = _pages_in_order(entries)
    bodies = container.bodies(entries, pages.select("book", "name")).join(pages, ["book", "name"])
    done = footnote_pages.standardised_pages(bodies.select("book", F.col("pos").alias("page_no"), F.col("body").alias("html"))).where("changed")
    new = container.with_bodies(entries, done.join(pages, (done["book"] == pages["book"]) & (done["page_no"] == pages["pos"])).select(done["book"], "name", "html"))
    return container.replaced(entries, new)


def repaired(entries: DataFrame) -> DataFrame:
    """``entries``, each name once, whose package documents have a repaired manifest and spine (see ``structure.repaired``); books without both stay."""
    entries = stored(structure.unique_entries(entries))
    found = stored(container.packages(entries, structure.package_entry(container.rootfiles(entries), entries)).where((F.size("items") > 0) & (F.size("spine") > 0)))
    items = found.select("book", "directory", F.explode("items").alias("i")).select("book", "directory", "i.pos", "i.id", "i.href", F.col("i.pos").alias("at"))
    spine = found.select("book", F.explode("spine").alias("s")).select("book", "s.pos", "s.idref")
    manifest = stored(structure.repaired_manifest(items, entries))
    order = structure.repaired_spine(spine, manifest)
    listed = manifest.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "at", "href"))), lambda x: F.struct(x["at"].alias("at"), x["href"].alias("href"))).alias("items"))
    read = order.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idref"))), lambda x: x["idref"]).alias("spine"))
    none = F.array().cast("array<string>")
    new = found.select("book", "entry").join(listed, "book").join(read, "book", "left").withColumn("spine", F.coalesce("spine", none))
    return container.replaced(entries, container.with_packages(entries, new))


def right_to_left(entries: DataFrame) -> DataFrame:
    """``entries`` whose books read from right to left: in the spine of the package and in all style sheets; doing so twice changes nothing."""
    entries = stored(entries)
    turned = container.with_direction(entries, structure.package_entry(container.rootfiles(entries), entries))
    css = entries.where(F.endswith("name", F.lit(".css"))).withColumn("text", F.decode("content", "ISO-8859-1"))
    styled = css.select("book", "name", F.encode(T.right_to_left_css(F.col("text")), "ISO-8859-1").alias("content"))
    return container.replaced(entries, turned.unionByName(styled))


def flat_contents(entries: DataFrame) -> DataFrame:
    """``entries`` whose navigation documents and NCX files have one level, in document order; points are numbered anew."""
    entries = stored(entries)
    low = F.col("name")
    chosen = entries.where(F.endswith(low, F.lit("nav.xhtml")) | F.endswith(low, F.lit("toc.ncx")))
    first = chosen.groupBy("book", F.endswith("name", F.lit(".ncx")).alias("ncx")).agg(F.min_by("name", "pos").alias("name"))
    return container.replaced(entries, container.with_flat_contents(entries, first.select("book", "name")))
