"""Operator 6: secret scan with corpus-wide ownership frequency (DataFrame functions only).

Every text is scanned once for three base kinds (assignments, access keys, hex
runs) and for generic key-like strings.  The digest of each candidate value is
counted by repositories (here: documents of an owner) and by owners over the
whole corpus.  A value that more than ``max_owners`` owners or more than
``max_repositories`` repositories hold is a copied example; one that is held by
few and looks random is live.  Base spans are always reported, with that verdict;
generic strings are reported only where the corpus shows them to be
owner-specific and live-looking.

Offsets are code points, ends exclusive.  Only candidates, never texts, are
shuffled for the counts, and counting is two-step ((value, owner), then value),
so that one value in a third of all rows costs a row per task and owner.

Edge cases: null text is empty text without spans; a null owner counts as one
owner; repeated rows (same doc_id and text) share their verdicts; null ids
stay; an empty table gives no rows; ``redact`` passes other columns through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.store import written

KINDS = ("assign", "access", "hex", "generic")
_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
# (pattern, group of the value, shortest value, cheap test for a text to hold one)
_PATTERNS = {
    "assign": (_HEAD + r"""\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8, _HEAD),
    # A run that is too short as a whole holds no longer one, so the minimum can stand in the pattern.
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16, "AKIA[A-Z0-9]{12}"),
    "hex": (r"[0-9a-f]{32,}", 0, 32, "[0-9a-f]{32}"),
    "generic": (r"[A-Za-z0-9+/_-]{24,}", 0, 24, "[A-Za-z0-9+/_-]{24}"),
}
SPAN = "struct<start:long,kind:int,end:long,from:long,a:long,b:long,varied:boolean>"
_MATCH = "struct<gap:int,match:int,value:string>"
#: Elements folded at a time: an array that grows by one element is copied each time.
FOLD = 256


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of the longs in ``values`` (a column that is computed already) what ``join`` makes of 0 and all before it; time is nearly linear."""
    zero = F.lit(0).cast("long")
    grown = lambda items, first: F.slice(F.aggregate(items, F.array(first), lambda out, x: F.concat(out, F.array(join(F.element_at(out, -1), x)))), F.lit(1), F.size(items))
    part = lambda k: F.slice(values, k * FOLD + 1, F.lit(FOLD))
    parts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / FOLD).cast("int"))
    firsts = grown(F.transform(parts, lambda k: F.aggregate(part(k), zero, lambda out, x: join(out, x))), zero)
    whole = F.flatten(F.transform(F.arrays_zip(parts.alias("k"), firsts.alias("first")), lambda p: grown(part(p["k"]), p["first"])))
    return F.when(F.size(values) > 0, whole).otherwise(_none("bigint"))


def _matches(text: Column, kind: str) -> Column:
    """The matches of one kind, in order, with the length of the gap before each."""
    pattern, group, _, hint = _PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"), values.alias("value"))
    lengths = F.transform(rows, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("match"), x["value"].alias("value")))
    return F.when(text.rlike(hint), lengths.cast(f"array<{_MATCH}>")).otherwise(_none(_MATCH))


def _spans(rows: Column, at: Column, kind: str) -> Column:
    """Spans of one kind from its matches and the places where their gaps begin."""

    def span(x: Column) -> Column:
        begin, value = x["at"] + x["row"]["gap"], x["row"]["value"]
        end = begin + x["row"]["match"]
        mixed = value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= 6)
        if kind == "generic":
            mixed = mixed & value.rlike("[a-z]") & value.rlike("[A-Z]")
        return F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.cast("long").alias("end"), (end - F.length(value)).cast("long").alias("from"), F.xxhash64(value).alias("a"), F.xxhash64(F.lit(7), value).alias("b"), mixed.alias("varied"))

    placed = F.filter(F.arrays_zip(rows.alias("row"), at.alias("at")), lambda x: F.length(x["row"]["value"]) >= _PATTERNS[kind][2])
    return F.transform(placed, span).cast(f"array<{SPAN}>")


def candidates(docs: DataFrame, doc_id: str = "doc_id", owner: str = "source", text: str = "text") -> DataFrame:
    """doc_id, h1 and h2 (naming the text), owner, base and generic spans of every row; generic ones keep clear of base ones."""
    body = F.coalesce(F.col(text), F.lit(""))
    known = ["doc_id", "owner", "h1", "h2"]
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(owner).alias("owner"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(7), body).alias("h2"), *[_matches(body, k).alias(k) for k in KINDS])
    widths = found.select(*known, *KINDS, *[F.transform(k, lambda x: (x["gap"] + x["match"]).cast("long")).alias(f"{k}_wide") for k in KINDS])
    placed = widths.select(*known, *[_spans(F.col(k), before(F.col(f"{k}_wide"), lambda x, y: x + y), k).alias(k) for k in KINDS])
    spans = placed.select(*known, F.array_sort(F.concat(*KINDS[:3])).alias("base"), F.filter(KINDS[3], lambda s: s["varied"]).alias("extra"))
    clear = F.filter("extra", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return spans.withColumn("extra", F.when(F.size("extra") > 0, clear).otherwise(F.col("extra")))


def scanned(found: DataFrame, max_owners: int = 2, max_repositories: int = 20) -> DataFrame:
    """``found`` (from ``candidates``) with ``spans``: all reported spans, each with ``owners``, ``documents`` and ``live``."""
    rows = found.where((F.size("base") > 0) | (F.size("extra") > 0)).select("doc_id", "h1", "h2", "owner", F.explode(F.concat("base", "extra")).alias("s")).distinct()
    by_owner = rows.select("doc_id", "owner", F.col("s.a").alias("a"), F.col("s.b").alias("b")).distinct().groupBy("a", "b", "owner").agg(F.count("*").alias("n"))
    counts = by_owner.groupBy("a", "b").agg(F.count("*").alias("owners"), F.sum("n").alias("documents"))
    judged = rows.join(counts, (rows.s["a"] == counts.a) & (rows.s["b"] == counts.b))
    live = (F.col("owners") <= max_owners) & (F.col("documents") <= max_repositories) & F.col("s.varied")
    reported = judged.where((F.col("s.kind") < 3) | live)
    spans = reported.groupBy("doc_id", "h1", "h2").agg(F.array_sort(F.collect_set(F.struct("s.start", "s.kind", "s.end", "s.from", "owners", "documents", live.alias("live")))).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "spans")
    return found.join(spans, found.doc_id.eqNullSafe(spans._id) & (found.h1 == spans._h1) & (found.h2 == spans._h2), "left").drop("_id", "_h1", "_h2")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined; empty for none."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ","), F.lit(""))


def scan(docs: DataFrame, max_owners: int = 2, max_repositories: int = 20) -> DataFrame:
    """One row for each document: counts by kind, the base spans' digest, all spans, and how many are live."""
    found = written(candidates(docs), "secrets")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned(found, max_owners, max_repositories).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.coalesce(F.size(F.filter("spans", lambda s: s["live"])), F.lit(0)).cast("long").alias("n_live"),
    )


#: Code points in a block of text: a place is found by counting within one block.
BLOCK = 4096


def _between(blocks: Column, start: Column, stop: Column) -> Column:
    """Code points ``start`` to ``stop`` (exclusive) of a text given in ``blocks``."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((stop - 1) / BLOCK).cast("int")
    head = F.substring(F.get(blocks, first), (start % BLOCK).cast("int") + 1, F.least(stop - start, F.lit(BLOCK)).cast("int"))
    body = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.substring(F.get(blocks, last), F.lit(1), (stop - last * BLOCK).cast("int"))
    return F.when(stop <= start, "").when(first == last, head).otherwise(F.concat(head, body, tail))


def redact(docs: DataFrame, mark: str = "<SECRET>", max_owners: int = 2, max_repositories: int = 20) -> DataFrame:
    """``docs`` with the value of every reported span replaced by ``mark``; rows and other columns are unchanged."""
    # All rows are written: a filter before that would compute the spans twice.
    found = written(candidates(docs), "secrets").where((F.size("base") > 0) | (F.size("extra") > 0))
    spans = scanned(found, max_owners, max_repositories).where(F.col("spans").isNotNull()).select(F.col("doc_id").alias("id"), F.col("h1").alias("a"), F.col("h2").alias("b"), "spans").distinct()
    # A row travels as one value, so that no name of its columns can clash with those made here.
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64(body).alias("row_a"), F.xxhash64(F.lit(7), body).alias("row_b"))
    joined = rows.join(spans, rows["row_id"].eqNullSafe(spans["id"]) & (rows["row_a"] == spans["a"]) & (rows["row_b"] == spans["b"]), "left").select("row", "spans")
    places = F.array_sort(F.transform("spans", lambda s: F.struct(s["from"].alias("start"), s["end"].alias("end"))))
    text = F.col("row")["text"]
    cut = F.when(F.col("spans").isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    sorted_ = joined.select("row", cut.alias("blocks"), places.alias("places")).withColumn("ends", F.transform("places", lambda s: s["end"]))
    # Where two overlap, the later one is hidden with the earlier one if it begins inside.
    reached = sorted_.select("row", "blocks", "places", before(F.col("ends"), F.greatest).alias("reached"))
    open_ = F.filter(F.arrays_zip("places", "reached"), lambda x: x["places"]["start"] >= x["reached"])
    gaps = reached.select("row", "blocks", F.transform(open_, lambda x: _between(F.col("blocks"), x["reached"], x["places"]["start"])).alias("gaps"), F.array_max(F.transform("places", lambda s: s["end"])).alias("last"))
    hidden = F.concat(F.array_join(F.transform("gaps", lambda g: F.concat(g, F.lit(mark))), ""), _between(F.col("blocks"), F.col("last"), F.length(text)))
    return gaps.select(*[F.when(F.col("blocks").isNotNull(), hidden).otherwise(text).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
