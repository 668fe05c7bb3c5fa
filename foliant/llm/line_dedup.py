"""Operator 1: line deduplication by site-relative frequency (DataFrame functions only).

A line is boilerplate on a host if the share of the host's pages that contain
it is above ``ratio`` and it stands on ``min_pages`` of them at least.  Pages
are counted per (host, line digest) with map-side partial aggregation, so a hot
host or line costs one row per task; text moves once, for the final join.

Lines end at a line feed and are compared without the spaces, tabs and carriage
returns around them; blank lines are neither counted nor dropped.  A line
counts once for a page, however often it stands there.

Edge cases: null text is empty text and stays null where nothing is dropped;
null hosts form one host; every repeated row is a page; a page may lose all its
lines and is then empty, not gone; an empty table gives no rows; other columns
pass through ``drop_boilerplate`` unchanged, whatever their names, but for those
that the two counts replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r"
#: A line on more than this share of a host's pages is boilerplate; one page alone says nothing.
RATIO, MIN_PAGES = 0.08, 2


def line_key(line: Column) -> Column:
    """128 bits naming a line; null for a blank one."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(7), bare).alias("b")))


def _keys(text: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(F.split(text, "\n", -1), line_key)), lambda k: k.isNotNull())


def boilerplate(docs: DataFrame, ratio: float, min_pages: int, host: str = "source", text: str = "text") -> DataFrame:
    """host, key, pages and share of every boilerplate line of ``docs``."""
    totals = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("total"))
    lines = docs.select(F.col(host).alias("host"), F.explode(_keys(F.col(text))).alias("key"))
    counts = lines.groupBy("host", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    joined = counts.join(totals, counts.host.eqNullSafe(totals.host)).select(counts.host, "key", "pages", (F.col("pages") / F.col("total")).alias("share"))
    return joined.where(F.col("share") > ratio)


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, doc_id: str = "doc_id", host: str = "source", text: str = "text", counts: tuple[str, str] | None = ("lines_total", "lines_dropped")) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; two columns named ``counts`` (in place of any of these names) tell how many lines there were and went."""
    known = boilerplate(docs, ratio, min_pages, host, text).select(F.col("host").alias("on"), F.col("key").alias("known"))
    lines = docs.select(F.col(doc_id).alias("id"), F.col(host).alias("of"), F.explode(_keys(F.col(text))).alias("line"))
    hits = lines.join(known, lines["of"].eqNullSafe(known["on"]) & (lines["line"] == known["known"]), "left_semi")
    # As many keys as the host has boilerplate lines at most.
    drops = hits.groupBy("id", "of").agg(F.collect_set("line").alias("drop"))
    # A row travels as one value, so that no name of its columns can clash with those made here.
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("row_id"), F.col(host).alias("row_of"))
    joined = rows.join(drops, rows["row_id"].eqNullSafe(drops["id"]) & rows["row_of"].eqNullSafe(drops["of"]), "left").select("row", "drop")
    body = F.col("row").getField(text)
    split = F.split(body, "\n", -1)
    kept = F.filter(split, lambda line: ~F.coalesce(F.array_contains("drop", line_key(line)), F.lit(False)))
    clean = joined.select("row", F.when(F.col("drop").isNotNull(), kept).alias("kept"))
    changed = F.col("kept").isNotNull()
    columns = [F.when(changed, F.array_join("kept", "\n")).otherwise(body).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in {n.lower() for n in counts or ()}]
    if counts:
        columns += [F.when(body.isNull(), 0).otherwise(F.size(split)).cast("long").alias(counts[0]), F.when(changed, F.size(split) - F.size("kept")).otherwise(0).cast("long").alias(counts[1])]
    return clean.select(*columns)
