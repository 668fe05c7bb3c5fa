"""Scalar text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits of three scripts, languages written from right to left, languages of volumes, void tags.
ARABIC_DIGITS, PERSIAN_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"
RTL_LANGUAGES = ("ar", "dv", "fa", "he", "ku", "ps", "sd", "ug", "ur", "yi")
VOLUME_LANGUAGES = ("ar", "en")
VOID_TAGS = "br|hr|img|input|meta|link|area|base|col|embed|source|track|wbr"
# First words of a heading (chapter, commentary on a chapter), of a part, and the phrase put on a line of its own.
HEADING = r"^(?:تفسير\s+سورة|سورة)\s+"
PART_HEADING = r"^الجزء\s+"
OPENING = "بسم الله الرحمن الرحيم"
PART_LABEL, PAGE_LABEL, AUTHOR_LABEL = "الجزء: ", "الصفحة: ", "المؤلف: "
# Lines from this length are split before numbers; longest title taken from a page.
LONG_LINE, LONGEST_TITLE = 220, 100
# A number that begins an item, in digits of any script, and a line that begins so.
_NUMBER = r"(?:[0-9]{1,4}|[٠-٩]{1,4}|[۰-۹]{1,4})\s*[-–—]\s+"
NUMBERED_LINE = r"^(?:[0-9٠-٩۰-۹]{1,4})\s*[-–—]\s+"


def escape_xml(text: Column) -> Column:
    """The five XML special characters as entities."""
    out = text
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def strip(text: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normal_language(tag: Column) -> Column:
    return F.replace(F.lower(strip(F.coalesce(tag, F.lit("")))), F.lit("_"), F.lit("-"))


def volume_language(tag: Column) -> Column:
    """The primary language where volumes know it, else English."""
    primary = F.substring_index(normal_language(tag), "-", 1)
    return F.when(primary.isin(*VOLUME_LANGUAGES), primary).otherwise("en")


def page_direction(value: Column) -> Column:
    low = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when(low.isin("rtl", "ltr"), low).otherwise("")


def text_direction(language: Column, direction: Column) -> Column:
    """The given direction, else that of the language."""
    rtl = F.substring_index(normal_language(language), "-", 1).isin(*RTL_LANGUAGES)
    return F.when(direction.isin("rtl", "ltr"), direction).when(rtl, "rtl").otherwise("ltr")


def ascii_digits(text: Column) -> Column:
    return F.translate(text, ARABIC_DIGITS + PERSIAN_DIGITS, ASCII_DIGITS * 2)


def to_integer(text: Column) -> Column:
    """A whole number in digits of any of three scripts, white space around it allowed; else null."""
    good = text.rlike(r"^\s*[0-9٠-٩۰-۹]+\s*$")
    return F.when(good, ascii_digits(F.regexp_replace(text, r"\s", "")).try_cast("bigint"))


def integer_or(text: Column, fallback: int) -> Column:
    """A signed ASCII whole number, else ``fallback``."""
    return F.coalesce(F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("bigint")), F.lit(fallback).cast("bigint"))


def strip_tags(html: Column) -> Column:
    """Text without tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"(?U)\s+", " "))


# Fixed values in the patterns below: void tags, characters that file systems refuse, tags that tell markup, names of page files, marks of punctuation.
def close_void_tags(html: Column) -> Column:
    return F.regexp_replace(html, rf"(?i)<({VOID_TAGS})(\s[^>]*)?/?>", "<$1$2 />")


def file_name(text: Column) -> Column:
    """Characters that file systems refuse become one underscore, white space collapses."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r'[/:*?"<>|]+', "_"), r"(?U)\s+", " "))


def looks_like_html(text: Column) -> Column:
    return text.rlike(r"(?i)</?(p|br|div|span|h[1-6]|font)\b")


def is_heading(text: Column) -> Column:
    return text.rlike(HEADING)


def starts_numbered(text: Column) -> Column:
    return text.rlike(NUMBERED_LINE)


def plain_lines(text: Column) -> Column:
    """Nonempty lines of a plain text; a long line is cut before numbered items if that gives two parts or more."""
    body = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    body = F.regexp_replace(strip(body), OPENING + r"\s+(?=سورة|تفسير\s+سورة)", OPENING + "\n")
    body = F.regexp_replace(body, r"(?<!^)(\s+)(?=تفسير\s+سورة\s+)", "\n")
    nonempty = lambda parts: F.filter(F.transform(parts, strip), lambda x: x != "")
    pieces = lambda line: nonempty(F.split(line, rf"(?=(?:^|[\s ]){_NUMBER})"))
    return F.flatten(F.transform(nonempty(F.split(body, "\n+")), lambda line: F.when((F.length(line) >= LONG_LINE) & (F.size(pieces(line)) >= 2), pieces(line)).otherwise(F.array(line))))


def paragraphs(text: Column) -> Column:
    """Markup as it stands, or a paragraph for each line of a plain text."""
    body = strip(F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit("")))
    lines = F.transform(plain_lines(body), lambda x: F.concat(F.lit("<p>"), escape_xml(x), F.lit("</p>")))
    return F.when(body == "", F.array().cast("array<string>")).when(looks_like_html(body), F.array(body)).otherwise(lines)


def footer(part: Column, page: Column) -> Column:
    """Part and page, as far as known."""
    return F.concat_ws(" - ", F.when(part != "", F.concat(F.lit(PART_LABEL), part)), F.when(page != 0, F.concat(F.lit(PAGE_LABEL), page.cast("string"))))


def page_of_file(name: Column, fallback: Column) -> Column:
    """The number in a page file's name (``page_1_07.xhtml``, ``page1_7.xhtml``), else ``fallback``."""
    found = F.regexp_extract(F.substring_index(name, "/", -1), r"(?i)^(?:page_\d+_|page\d+_)(\d+)\.xhtml$", 1)
    return F.when(found != "", found.try_cast("bigint")).otherwise(fallback)


def blocks(text: Column) -> Column:
    """Paragraphs of extracted text: a blank line ends one, its lines are joined by spaces."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), strip)
    grouped = F.split(F.array_join(F.transform(lines, lambda x: F.when(x == "", F.lit("\x1e")).otherwise(x)), "\x1f"), "(?:\x1f?\x1e)+\x1f?")
    return F.filter(F.transform(grouped, lambda x: F.trim(F.replace(x, F.lit("\x1f"), F.lit(" ")))), lambda x: x != "")


def visible_length(text: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def without_empty(items: Column) -> Column:
    """Blocks with something to see."""
    return F.filter(items, lambda x: x.rlike(r"(?U)\S"))


def merged_errors(*errors: Column) -> Column:
    """Nonempty messages, one a line."""
    return F.array_join(F.filter(F.array(*errors), lambda x: x.isNotNull() & (x != "")), "\n")


def single_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " {2,}", " ")


def arabic_punctuation(text: Column) -> Column:
    """No white space before an Arabic comma, semicolon or question mark, one space instead of several after it."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+([،؛؟])", "$1"), r"([،؛؟])\s{2,}", "$1 ")


# Fixed value: the rule put before style sheets.
RTL_RULE = "* {direction: rtl !important;}\n"


def right_to_left_css(css: Column) -> Column:
    """``css`` behind the rule unless its first 300 characters have it; applying it twice changes nothing."""
    return F.when(F.lower(F.substring(css, 1, 300)).contains("direction: rtl !important"), css).otherwise(F.concat(F.lit(RTL_RULE), css))


def command_errors(log: Column) -> Column:
    """The failure messages of a converter's log, one a line, without asterisks; empty for none."""
    lines = F.filter(F.split(log, r"\r?\n"), lambda x: ~(x.contains(":fixme:") | x.contains("DEBUG -") | x.contains("INFO -")))
    # Fixed value: the two forms of a failure message.
    pattern = r"(Conversion Failure Reason\s+\*{5,}\s+[E0-9]+:.*|Conversion error: .*)"
    found = F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(pattern), F.lit(1))
    return F.replace(F.array_join(F.transform(found, strip), "\n"), F.lit("*"), F.lit(""))


def headings_once(headings: Column) -> Column:
    """Headings without immediate repetitions."""
    marks = F.sequence(F.lit(1), F.greatest(F.size(headings), F.lit(1)))
    kept = F.filter(F.transform(marks, lambda k: F.when((k == 1) | ~F.get(headings, k - 1).eqNullSafe(F.get(headings, k - 2)), F.get(headings, k - 1))), lambda x: x.isNotNull())
    return F.when(F.size(headings) > 0, kept).otherwise(F.array().cast("array<string>"))


def normal_path(path: Column) -> Column:
    """A relative POSIX path without empty, ``.`` and resolvable ``..`` segments; ``.`` where nothing is left."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    climb = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p)),
    )
    joined = F.array_join(climb, "/")
    return F.when(joined == "", ".").otherwise(joined)


def zip_path(directory: Column, href: Column) -> Column:
    """The entry that an href means in a directory; it never leaves the container."""
    flat = normal_path(F.concat(directory, F.lit("/"), href))
    return F.when(flat == ".", "").otherwise(F.regexp_replace(flat, r"^(?:\.\./)+(?:\.\.$)?|^\.\.$", ""))


def relative_path(directory: Column, target: Column) -> Column:
    """``target`` as seen from ``directory``; the target itself where both are the same or it is empty."""
    parts = lambda path: F.filter(F.split(normal_path(path), "/"), lambda p: ~p.isin("", "."))
    one, two = parts(directory), parts(target)
    same = F.filter(F.transform(F.arrays_zip(one.alias("a"), two.alias("b")), lambda x: x["a"].eqNullSafe(x["b"])), lambda x: x.isNotNull())
    differ = F.array_position(same, F.lit(False))
    shared = F.when(differ > 0, differ - 1).otherwise(F.size(same)).cast("int")
    path = F.concat(F.array_repeat(F.lit(".."), F.size(one) - shared), F.slice(two, shared + 1, F.greatest(F.size(two) - shared, F.lit(0))))
    return F.when(F.size(path) == 0, target).otherwise(F.array_join(path, "/"))
