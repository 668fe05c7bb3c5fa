"""Repair of containers, manifests and reading orders.

Rows belong to a ``book`` and stand in the order of ``pos``; every window and
join has ``book`` as an equality key, so books spread over the cluster and no
operator needs more than one book's rows of one table at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import normal_path

# Fixed value: the id of a numbered page.
PAGE_ID = r"^page_([0-9]+)$"


def unique_entries(entries: DataFrame) -> DataFrame:
    """Of entries (book, pos, name) with one name the last stays, in its place."""
    last = Window.partitionBy("book", "name").orderBy(F.desc("pos"))
    return entries.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def needs_cleanup(entries: DataFrame) -> DataFrame:
    """book and ``dirty``: a name stands twice, or the mimetype (last entry of that name) is compressed."""
    by_name = entries.groupBy("book", "name").agg(F.count("*").alias("n"), F.max_by("compress_type", "pos").alias("how"))
    return by_name.groupBy("book").agg((F.max("n") > 1).alias("twice"), F.coalesce(F.bool_or((F.col("name") == "mimetype") & (F.col("how") != 0)), F.lit(False)).alias("packed")).select("book", (F.col("twice") | F.col("packed")).alias("dirty"))


def resolved(directory: Column, href: Column) -> Column:
    """The paths an href may mean: below the package's directory, then as it stands; its fragment is left out."""
    base = F.regexp_replace(F.substring_index(href, "#", 1), r"^\./", "")
    bare = normal_path(base)
    return F.when(directory != "", F.array_distinct(F.array(normal_path(F.concat(directory, F.lit("/"), base)), bare))).otherwise(F.array(bare))


def with_fixed_case(items: DataFrame, entries: DataFrame) -> DataFrame:
    """``items`` (book, pos, directory, href) with ``exists`` and ``href`` in the letter case of the container.

    An href whose path is there stays.  Else the first of its paths that equals
    exactly one entry name but for case is taken, relative to the directory.
    """
    # One row for all entries that differ in case only; items meet it by each of their (at most two) paths.
    alike = entries.groupBy("book", F.lower("name").alias("lower")).agg(F.collect_set("name").alias("names"))
    paths = resolved(F.col("directory"), F.col("href"))
    joined = items.withColumns({"_one": F.get(paths, F.lit(0)), "_two": F.get(paths, F.lit(1))})
    for path in ("_one", "_two"):
        joined = joined.withColumn("lower", F.lower(path)).join(alike.withColumnRenamed("names", f"{path}_names"), ["book", "lower"], "left").drop("lower")
    there = lambda path: F.coalesce(F.array_contains(f"{path}_names", F.col(path)), F.lit(False))
    only = lambda path: F.when(F.size(f"{path}_names") == 1, F.get(f"{path}_names", F.lit(0)))
    joined = joined.withColumns({"as_is": there("_one") | there("_two"), "near": F.coalesce(only("_one"), only("_two"))})
    fragment = F.when(F.instr("href", "#") > 0, F.expr("substring(href, instr(href, '#'))")).otherwise(F.lit(""))
    fragment = F.when(fragment == "#", F.lit("")).otherwise(fragment)
    inside = (F.col("directory") != "") & F.startswith("near", F.concat("directory", F.lit("/")))
    relative = F.when(inside, F.expr("substring(near, length(directory) + 2)")).otherwise(F.col("near"))
    changed = ~F.col("as_is") & F.col("near").isNotNull()
    columns = [F.when(changed, F.concat(relative, fragment)).otherwise(F.col("href")).alias(c) if c == "href" else F.col(c) for c in items.columns if c != "exists"]
    return joined.select(*columns, F.coalesce(F.col("as_is") | changed, F.lit(False)).alias("exists"))


def unique_items(items: DataFrame) -> DataFrame:
    """Of manifest items (book, pos, id, exists) with one id the last stays, but one that exists goes before one that doesn't; items without id all stay."""
    named = F.col("id").isNotNull() & (F.col("id") != "")
    best = Window.partitionBy("book", "id", F.when(~named, F.col("pos"))).orderBy(F.desc("exists"), F.desc("pos"))
    return items.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def live_items(items: DataFrame) -> DataFrame:
    """Without items of text folders whose file isn't there (items with an id and an href only)."""
    dead = ~F.col("exists") & F.coalesce(F.col("id") != "", F.lit(False)) & F.exists(resolved(F.col("directory"), F.col("href")), lambda p: F.lower(F.concat(F.lit("/"), p)).contains("/text/"))
    return items.where(~F.coalesce(dead, F.lit(False)))


def pages_in_order(rows: DataFrame, name: str) -> DataFrame:
    """Rows named ``page_<n>`` are sorted by n among the places they hold; other rows keep theirs.  ``pos`` is the new place."""
    number = F.regexp_extract(name, PAGE_ID, 1)
    marked = rows.withColumn("_page", F.when(number != "", number.cast("decimal(38,0)")))
    paged, others = marked.where("_page IS NOT NULL"), marked.where("_page IS NULL").drop("_page")
    place = Window.partitionBy("book").orderBy("pos")
    rank = Window.partitionBy("book").orderBy("_page", "pos")
    slots = paged.select("book", F.col("pos").alias("_slot"), F.row_number().over(place).alias("_k"))
    sorted_pages = paged.withColumn("_k", F.row_number().over(rank)).drop("pos", "_page")
    moved = sorted_pages.join(slots, ["book", "_k"]).withColumnRenamed("_slot", "pos").drop("_k")
    return others.unionByName(moved.select(*others.columns))


def clean_spine(spine: DataFrame, items: DataFrame) -> DataFrame:
    """Spine rows (book, pos, idref) that name an item, each idref once, at its first place."""
    known = spine.join(items.select("book", F.col("id").alias("idref")).distinct(), ["book", "idref"], "left_semi")
    first = Window.partitionBy("book", "idref").orderBy("pos")
    return known.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


# Front matter, in reading order.
FRONT = ("titlepage", "intro", "book_info")


def with_front_matter(spine: DataFrame, items: DataFrame) -> DataFrame:
    """The spine with existing front matter that it lacks put before the first ``page_`` row (else at the end); ``pos`` counts from 0."""
    rank = F.array_position(F.array(*map(F.lit, FRONT)), F.col("id")).cast("int")
    missing = items.where(F.col("id").isin(*FRONT) & F.col("exists")).select("book", F.col("id").alias("idref"), rank.alias("_front")).join(spine.select("book", "idref"), ["book", "idref"], "left_anti")
    starts = spine.groupBy("book").agg(F.coalesce(F.min(F.when(F.startswith("idref", F.lit("page_")), F.col("pos"))), F.max("pos") + 1).alias("_at"))
    added = missing.join(starts, "book", "left").select("book", "idref", F.coalesce("_at", F.lit(0)).alias("_at"), "_front")
    both = spine.select("book", "idref", F.col("pos").alias("_at"), F.lit(99).alias("_front")).unionByName(added)
    order = Window.partitionBy("book").orderBy("_at", "_front")
    return both.select("book", (F.row_number().over(order) - 1).alias("pos"), "idref")


def repaired_manifest(items: DataFrame, entries: DataFrame) -> DataFrame:
    """Manifest items after all repairs, in this order: letter case, duplicates, dead items, page order."""
    return pages_in_order(live_items(unique_items(with_fixed_case(items, entries))), "id")


def repaired_spine(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """The spine by a repaired manifest: known items once each, front matter, page order."""
    return pages_in_order(with_front_matter(clean_spine(spine, manifest), manifest), "idref")


def repaired(items: DataFrame, spine: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest and spine after all repairs."""
    manifest = repaired_manifest(items, entries)
    return manifest, repaired_spine(spine, manifest)


# Entries that a rewrite generates itself.
GENERATED = ("mimetype", "meta-inf/container.xml", "oebps/content.opf", "oebps/styles.css", "oebps/info.xhtml", "oebps/nav.xhtml", "oebps/toc.ncx")


def passed_through(entries: DataFrame, excluded: DataFrame) -> DataFrame:
    """Entries that are copied as they are: no folders, nothing generated, none of ``excluded`` (book, name) in any letter case."""
    files = entries.where(~F.endswith("name", F.lit("/")) & ~F.lower("name").isin(*GENERATED)).withColumn("_lower", F.lower("name"))
    return files.join(excluded.select("book", F.lower("name").alias("_lower")), ["book", "_lower"], "left_anti").drop("_lower")


def find_entry(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """For each (book, what), the entry that the first of its candidates (at, candidate) names: exactly, else but for case (then the last entry of that name)."""
    cleaned = candidates.withColumn("_name", F.btrim(F.trim("candidate"), F.lit("/"))).where("_name <> ''").withColumn("_lower", F.lower("_name"))
    names = unique_entries(entries)
    exact = names.select("book", F.col("name").alias("_name"), F.col("name").alias("_exact"))
    folded = names.groupBy("book", F.lower("name").alias("_lower")).agg(F.max_by("name", "pos").alias("_folded"))
    joined = cleaned.join(exact, ["book", "_name"], "left").join(folded, ["book", "_lower"], "left").where("_folded IS NOT NULL")
    return joined.groupBy("book", "what").agg(F.min_by(F.coalesce("_exact", "_folded"), "at").alias("entry"))


def reading_order(spine: DataFrame, items: DataFrame, entries: DataFrame) -> DataFrame:
    """(X)HTML entries in reading order: those of the spine, then the others as they lie in the container; ``pos`` counts from 0."""
    kind = F.lower(F.coalesce("media_type", F.lit("")))
    readable = items.where(((kind == "") | kind.contains("html")) & F.coalesce(F.col("href") != "", F.lit(False)) & F.coalesce(F.col("id") != "", F.lit(False)))
    by_id = readable.groupBy("book", "id").agg(F.max_by(F.struct("href", "directory"), "pos").alias("x")).select("book", F.col("id").alias("idref"), F.col("x.href").alias("href"), F.col("x.directory").alias("directory"))
    fixed = with_fixed_case(spine.join(by_id, ["book", "idref"]), entries)
    paths = fixed.where("exists").select("book", "pos", F.posexplode(resolved(F.col("directory"), F.col("href"))).alias("at", "name"))
    there = paths.join(entries.select("book", "name").distinct(), ["book", "name"], "left_semi").groupBy("book", "pos").agg(F.min_by("name", "at").alias("name"))
    html = unique_entries(entries).where(F.lower("name").rlike(r"\.(xhtml|html|htm)$"))
    both = there.select("book", "name", F.lit(0).alias("_src"), "pos").unionByName(html.select("book", "name", F.lit(1).alias("_src"), "pos"))
    first = both.groupBy("book", "name").agg(F.min(F.struct("_src", "pos")).alias("_at"))
    order = Window.partitionBy("book").orderBy("_at")
    return first.select("book", (F.row_number().over(order) - 1).alias("pos"), "name")


def package_entry(rootfiles: DataFrame, entries: DataFrame) -> DataFrame:
    """book and entry of each package document: the first rootfile (book, at, path) that is there, else a default place, else the first ``.opf`` by name."""
    books = entries.select("book").distinct()
    named = rootfiles.select("book", F.col("at").cast("int").alias("at"), F.col("path").alias("candidate"))
    usual = books.select("book", F.posexplode(F.array(F.lit("OEBPS/content.opf"), F.lit("content.opf"))).alias("_k", "candidate")).select("book", (F.col("_k") + (1 << 30)).alias("at"), "candidate")
    found = find_entry(named.unionByName(usual).withColumn("what", F.lit("package")), entries).select("book", F.col("entry").alias("_found"))
    any_opf = entries.where(F.lower("name").endswith(".opf")).groupBy("book").agg(F.min("name").alias("_any"))
    joined = books.join(found, "book", "left").join(any_opf, "book", "left")
    return joined.select("book", F.coalesce("_found", "_any").alias("entry")).where("entry IS NOT NULL")
