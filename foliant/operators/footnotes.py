"""Footnotes of book pages: finding markers and notes, linking them, and carrying continuations back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import ARABIC_DIGITS, ASCII_DIGITS, strip

# Fixed value: a reference to a note, in either kind of brackets.
MARKER = r"(\(\^?\p{Nd}+\)|\[\^?\p{Nd}+\])"
# A note line starts with a bracketed number, or, where a block has none, with a plain one.
EXPLICIT_NOTE = r"(?s)^\s*((?:\(\s*\^?\p{Nd}+\s*\))|(?:\[\s*\^?\p{Nd}+\s*\]))(.*)$"
PLAIN_NOTE = r"(?s)^\s*(\p{Nd}+)(?:\s*[-–—.:،)]\s*|\s+)(.*)$"
# Brackets around a verse.
VERSE_OPEN, VERSE_CLOSE = "﴿", "﴾"


def marker_parts(marker: Column) -> tuple[Column, Column, Column]:
    """Number in ASCII digits, whether it has a caret, and the kind of its brackets."""
    body = F.trim(marker)
    number = F.translate(F.regexp_extract(body, r"\p{Nd}+", 0), ARABIC_DIGITS, ASCII_DIGITS)
    bracket = F.when(F.startswith(body, F.lit("[")), "square").when(F.startswith(body, F.lit("(")), "paren").otherwise("plain")
    return number, F.contains(body, F.lit("^")), bracket


def markers(text: Column) -> Column:
    """Array of all reference markers of a paragraph: start, end (exclusive), marker, number, caret, bracket, verse.

    A marker is in a verse if a verse bracket is open before it, or if its nearest visible neighbour is one.
    """
    found = F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))
    gaps = F.split(text, MARKER, -1)
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), F.slice(gaps, F.lit(2), F.size(found)).alias("after"), found.alias("marker"))
    kind = "struct<start:int,end:int,marker:string,number:string,caret:boolean,bracket:string,verse:boolean>"
    count = lambda x, mark: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))

    def step(s: Column, x: Column) -> Column:
        # Only what lies between two markers is looked at, so a text is read once.
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["marker"])
        opened = s["opened"] + count(x["gap"], VERSE_OPEN) - count(x["gap"], VERSE_CLOSE)
        beside = (F.regexp_extract(x["gap"], r"(\S)\s*$", 1) == VERSE_OPEN) | (F.regexp_extract(x["after"], r"^\s*(\S)", 1) == VERSE_CLOSE)
        number, caret, bracket = marker_parts(x["marker"])
        one = F.struct(start.alias("start"), end.alias("end"), x["marker"].alias("marker"), number.alias("number"), caret.alias("caret"), bracket.alias("bracket"), ((opened > 0) | beside).alias("verse")).cast(kind)
        return F.struct(end.alias("at"), opened.alias("opened"), F.concat(s["out"], F.array(one)).alias("out"))

    return F.aggregate(rows, F.struct(F.lit(0).alias("at"), F.lit(0).alias("opened"), F.array().cast(f"array<{kind}>").alias("out")), step, lambda s: s["out"])


def links(notes: Column, candidates: Column) -> Column:
    """For each note (number, caret, bracket), in order, the index of its candidate (number, caret, bracket, verse), or null.

    Only candidates after the last one taken count.  Of those with the note's
    number, one with the same caret goes first, then one with the same
    bracket, then one outside a verse or with a caret, then the earliest.
    """
    at = F.transform(candidates, lambda c, k: F.struct(k.alias("k"), c.alias("c")))

    def pick(cursor: Column, note: Column) -> Column:
        fit = F.filter(at, lambda x: (x["k"] >= cursor) & (x["c"]["number"] == note["number"]))
        ranked = F.transform(fit, lambda x: F.struct((x["c"]["caret"] != note["caret"]).alias("a"), (x["c"]["bracket"] != note["bracket"]).alias("b"), (x["c"]["verse"] & ~x["c"]["caret"]).alias("v"), x["k"].alias("k")))
        return F.array_min(ranked)["k"]

    return F.aggregate(
        notes,
        F.struct(F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("out")),
        lambda s, note: F.get(F.transform(F.array(pick(s["cursor"], note)), lambda p: F.struct(F.coalesce(p + 1, s["cursor"]).alias("cursor"), F.concat(s["out"], F.array(p)).alias("out"))), F.lit(0)),
        lambda s: s["out"],
    )


def note_lines(blocks: DataFrame) -> DataFrame:
    """Lines of note blocks (page, block, html): page, block, line, text, first (starts with ``=``), explicit and plain starts."""
    bare = F.regexp_replace(F.regexp_replace(strip(F.col("html")), r"(?is)^<\s*(?:\w+:)?p\b[^>]*>", ""), r"(?is)</\s*(?:\w+:)?p\s*>\s*$", "")
    lines = F.filter(F.transform(F.split(bare, r"(?i)</?(?:\w+:)?br\s*/?>"), strip), lambda x: x != "")
    explicit = F.exists(lines, lambda x: x.rlike(EXPLICIT_NOTE))
    rows = blocks.select("page", "block", explicit.alias("_explicit"), F.startswith(F.get(lines, 0), F.lit("=")).alias("_continues"), F.posexplode(lines).alias("line", "text"))
    pattern = F.when(F.col("text").rlike(EXPLICIT_NOTE), "explicit").when(~F.col("_explicit") & F.col("text").rlike(PLAIN_NOTE), "plain")
    carried = F.col("_continues") & (F.col("line") == 0)
    return rows.withColumn("_start", F.when(~carried, pattern))


def notes(blocks: DataFrame) -> DataFrame:
    """Notes of pages (page, note_id, number, content): numbered through all blocks of a page; note 0 is what continues a note of an earlier page."""
    rows = note_lines(blocks)
    page = Window.partitionBy("page").orderBy("block", "line")
    block = Window.partitionBy("page", "block").orderBy("line")
    begun = F.col("_start").isNotNull().cast("int")
    rows = rows.withColumns({"_id": F.sum(begun).over(page), "_own": F.sum(begun).over(block)})
    rows = rows.withColumn("note_id", F.when(F.col("_own") > 0, F.col("_id")).when(F.col("_continues"), F.lit(0)).cast("long")).where("note_id IS NOT NULL")
    last = F.max(F.when(F.col("note_id") == 0, F.col("block"))).over(Window.partitionBy("page"))
    rows = rows.withColumn("_last", last).where("note_id > 0 OR block = _last")
    pattern = lambda k: F.when(F.col("_start") == "explicit", F.regexp_extract("text", EXPLICIT_NOTE, k)).when(F.col("_start") == "plain", F.regexp_extract("text", PLAIN_NOTE, k))
    rows = rows.withColumns({"_number": pattern(1), "_text": F.coalesce(strip(pattern(2)), F.col("text"))})
    pieces = F.transform(F.array_sort(F.collect_list(F.when(F.col("_text") != "", F.struct("block", "line", F.col("_text").alias("t"))))), lambda x: x["t"])
    return rows.groupBy("page", "note_id").agg(F.max("_number").alias("number"), F.array_join(pieces, "<br />").alias("content"))


def aside(note_id: Column, number: Column, content: Column) -> Column:
    """The markup of a note."""
    body = F.when(content != "", F.concat(F.lit(" "), content)).otherwise("")
    numbered = F.concat(F.lit('<aside id="fn'), note_id, F.lit('" epub:type="footnote"><a href="#fnref'), note_id, F.lit('" class="nu">'), number, F.lit("</a><span>"), body, F.lit("</span></aside>"))
    return F.when(note_id == 0, F.concat(F.lit('<aside id="fn0" epub:type="footnote"><span>'), content, F.lit("</span></aside>"))).otherwise(numbered)


def linked(text: Column, found: Column, ids: Column) -> Column:
    """``text`` with the markers of ``found`` (as from ``markers``) that have an id in ``ids`` (same order, null for none) turned into links, from the right."""
    pairs = F.filter(F.arrays_zip(found.alias("m"), ids.alias("id")), lambda x: x["id"].isNotNull())
    anchor = lambda x: F.concat(F.lit('<a href="#fn'), x["id"], F.lit('" epub:type="noteref" role="doc-noteref" id="fnref'), x["id"], F.lit('" class="fn nu">'), x["m"]["marker"], F.lit("</a>"))
    return F.aggregate(F.reverse(pairs), text, lambda t, x: F.concat(F.substring(t, F.lit(1), x["m"]["start"]), anchor(x), F.substring(t, x["m"]["end"] + 1, F.length(t))))


def renumbered(pages: DataFrame) -> DataFrame:
    """``pages`` (book, page_no, n_notes) with ``first_note``, so that numbers run through the book."""
    before = Window.partitionBy("book").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("first_note", F.coalesce(F.sum("n_notes").over(before), F.lit(0)) + 1)


def carried(pages: DataFrame) -> DataFrame:
    """Pages (book, page_no, has_note, continuation, …) with ``moved``, whether a page gives its continuation away, and ``more``, what it is given, in page order.

    A continuation goes to the nearest earlier page that has a note; with none
    before it, it stays, and may be continued itself.
    """
    before = Window.partitionBy("book").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    given, has = F.col("continuation").isNotNull(), F.coalesce("has_note", F.lit(False))
    rows = pages.withColumn("_any", F.coalesce(F.max(has | given).over(before), F.lit(False)))
    rows = rows.withColumn("_anchor", F.when(has | (given & ~F.col("_any")), F.col("page_no")))
    rows = rows.withColumn("_target", F.when(given, F.last("_anchor", ignorenulls=True).over(before)))
    pieces = F.array_sort(F.collect_list(F.struct("page_no", "continuation")))
    more = rows.where("_target IS NOT NULL").groupBy("book", F.col("_target").alias("page_no")).agg(F.array_join(F.transform(pieces, lambda x: x["continuation"]), "<br />").alias("more"))
    return rows.withColumn("moved", F.col("_target").isNotNull()).drop("_any", "_anchor", "_target").join(more, ["book", "page_no"], "left")


def carried_back(pages: DataFrame) -> DataFrame:
    """Pages (book, page_no, last_note, continuation) with continuations moved to the last note of the nearest earlier page that has one (see ``carried``)."""
    rows = carried(pages.select("book", "page_no", "last_note", "continuation", F.col("last_note").isNotNull().alias("has_note")))
    stays = F.when(~F.col("moved"), F.col("continuation"))
    own = F.coalesce(F.col("last_note"), F.concat(F.lit("="), stays))
    text = F.when(F.col("more").isNull(), own).otherwise(F.concat_ws("<br />", F.nullif(own, F.lit("")), F.col("more")))
    return rows.select("book", "page_no", text.alias("last_note"), stays.alias("continuation"), "moved")


def ruled_sections(nodes: DataFrame) -> DataFrame:
    """Roles of a page's nodes (page, pos, kind, text), where notes follow rules (kind ``hr``) instead of standing in blocks of their own.

    Directly after a rule come, if at all, a paragraph that starts with ``=``
    (role ``continuation``) and then notes, paragraphs (kind ``p``) that start
    with a marker, up to the first other node; the rest is ``body``.
    ``section`` counts rules: a note belongs to the rule before it, body text to
    the rule that ends it.  Notes are numbered through the page, and ``target``
    is the place of the open footnote (kind ``aside``, text ending with ``=``) that a
    continuation belongs to: the nearest one before the rule, unless a note stands between.
    """
    order = Window.partitionBy("page").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rule = F.col("kind") == "hr"
    marked = (F.col("kind") == "p") & F.coalesce(F.col("text").rlike(r"^\s*" + MARKER), F.lit(False))
    rows = nodes.withColumns({"_rules": F.sum(rule.cast("int")).over(upto), "_marked": marked})
    # The nearest node before that closes (a note) or opens (an unfinished footnote) the way back, as of each rule.
    way = F.when(F.col("_marked"), F.lit(-1)).when((F.col("kind") == "aside") & F.rtrim("text").endswith("="), F.col("pos"))
    rows = rows.withColumn("_way", F.last(way, ignorenulls=True).over(upto))
    group = Window.partitionBy("page", "_rules").orderBy("pos")
    rows = rows.withColumns({"_k": F.row_number().over(group) - 1, "_open": F.first("_way").over(group)})
    continues = (F.col("_rules") > 0) & (F.col("_k") == 1) & (F.col("kind") == "p") & ~F.col("_marked") & F.coalesce(F.length(F.regexp_extract("text", r"(?s)^\s*=\s*(.*\S)", 1)) > 0, F.lit(False))
    rows = rows.withColumn("_continues", continues)
    stops = (F.col("_k") > 0) & ~F.col("_marked") & ~F.col("_continues")
    is_note = F.col("_marked") & (F.col("_rules") > 0) & ~F.coalesce(F.max(stops).over(group.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    rows = rows.withColumn("role", F.when(F.col("kind") == "hr", "rule").when(F.col("_continues"), "continuation").when(is_note, "note").otherwise("body"))
    number = F.sum((F.col("role") == "note").cast("int")).over(upto)
    section = F.when(F.col("role") == "body", F.col("_rules") + 1).otherwise(F.col("_rules"))
    return rows.select("page", "pos", "role", section.cast("int").alias("section"), F.when(F.col("role") == "note", number).cast("int").alias("note_id"), F.when(F.col("_continues") & (F.col("_open") >= 0), F.col("_open")).alias("target"))
