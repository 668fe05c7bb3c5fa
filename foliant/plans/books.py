"""Queries over whole books: containers, their parts, pages with footnotes, filters, fonts, catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import catalogs, filters, fonts, footnote_pages, render, structure, toc, volumes
from foliant.plans.catalog import LINES, query, sql_escaped
from foliant.sources import container
from foliant.sources import proxies as P
from foliant.sources.stored import stored

_ESCAPED = sql_escaped("text")
#: Turns as pages: their markup as it is written, and as a parser gives it back.
_PAGES = f"""pg AS (SELECT conv_id AS book, turn + 1 AS n, max(turn + 1) OVER (PARTITION BY conv_id) AS hi, '<p>' || {_ESCAPED} || '</p>' AS html, '<p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' AS parsed FROM conversations)"""
_HEAD = """'<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<!DOCTYPE html>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml"{space} lang="ar" dir="rtl">' || chr(10) || '<head> <meta charset="utf-8" /><title>' || {title} || '</title> <link rel="stylesheet" href="{up}styles.css" /> </head>' || chr(10) || '<body> ' || {body} || ' </body>' || chr(10) || '</html>' || chr(10)"""
_OWN = """'<ol><li><a href="info.xhtml">بطاقة الكتاب</a></li><li><a href="nav.xhtml">فهرس الموضوعات</a></li>'"""


def _entries_sql(books: str) -> str:
    """All entries of ``books`` (key, title, and a list of pages f (file), h (markup), n) as SQL."""
    nav = _HEAD.format(space=' xmlns:epub="http://www.idpf.org/2007/ops"', title="title", up="", body=f"""'<nav epub:type="toc" id="toc"><h1>فهرس الموضوعات</h1>' || {_OWN} || array_to_string(list_transform(p, lambda x: '<li><a href="text/' || x.f || '">x</a></li>'), '') || '</ol></nav>'""")
    ncx = """'<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta content="' || id || '" name="dtb:uid"/></head><docTitle><text>' || title || '</text></docTitle><navMap><navPoint id="info"><navLabel><text>بطاقة الكتاب</text></navLabel><content src="info.xhtml"/></navPoint><navPoint id="nav"><navLabel><text>فهرس الموضوعات</text></navLabel><content src="nav.xhtml"/></navPoint>' || array_to_string(list_transform(p, lambda x, i: '<navPoint id="nav_' || (i - 1) || '"><navLabel><text>x</text></navLabel><content src="text/' || x.f || '"/></navPoint>'), '') || '</navMap></ncx>' || chr(10)"""
    opf = """'<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">' || id || '</dc:identifier><dc:title>' || title || '</dc:title><dc:language>ar</dc:language></metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="css" href="styles.css" media-type="text/css"/><item id="info" href="info.xhtml" media-type="application/xhtml+xml"/>' || array_to_string(list_transform(p, lambda x: '<item id="' || replace(x.f, '.xhtml', '') || '" href="text/' || x.f || '" media-type="application/xhtml+xml"/>'), '') || '</manifest><spine toc="ncx" page-progression-direction="rtl"><itemref idref="info"/>' || array_to_string(list_transform(p, lambda x: '<itemref idref="' || replace(x.f, '.xhtml', '') || '"/>'), '') || '</spine></package>' || chr(10)"""
    box = """'<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>' || chr(10)"""
    fixed = [("mimetype", "'application/epub+zip'"), ("META-INF/container.xml", box), ("OEBPS/styles.css", "'body{line-height:1.7;margin:1.5rem}'"), ("OEBPS/content.opf", opf), ("OEBPS/info.xhtml", _HEAD.format(space="", title="'بطاقة الكتاب'", up="", body="''")), ("OEBPS/nav.xhtml", nav), ("OEBPS/toc.ncx", ncx)]
    parts = " UNION ALL ".join(f"SELECT key, '{name}' AS name, {content} AS content FROM {books}" for name, content in fixed)
    page = f"SELECT key, 'OEBPS/text/' || x.f AS name, {_HEAD.format(space='', title='title', up='../', body='x.h')} AS content FROM (SELECT key, title, unnest(p) AS x FROM {books})"
    return f"{parts} UNION ALL {page}"


_FILE = "'page_1_' || lpad(n::VARCHAR, (length(hi::VARCHAR) + 1)::INT, '0') || '.xhtml'"


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as books in containers: book, pos, name and content of their entries."""
    turns = P.table(spark, sf_dir, "conversations")
    pages = turns.select(F.col("conv_id").alias("book"), (F.col("turn") + 1).alias("page_number"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("<p>"), T.escape_xml(F.col("text")), F.lit("</p>")).alias("text_html"))
    books = turns.select(F.col("conv_id").alias("book")).distinct().select("book", F.lit("T").alias("title"), F.lit("").alias("author"), F.lit("").alias("about"), F.lit("ar").alias("language"), F.lit("").alias("direction"))
    nodes = pages.select("book", F.array("page_number").alias("path"), F.lit("x").alias("text"), F.col("page_number").alias("page"), F.lit(None).cast("string").alias("href"), F.lit("").alias("anchor"))
    return render.book_entries(books, pages, nodes).withColumn("book", F.col("book").cast("string"))


def _digests(entries: DataFrame) -> DataFrame:
    return entries.select("book", "name", F.sha2("content", 256).alias("content"))


@query(f"""WITH {_PAGES}, b AS (SELECT book::VARCHAR AS key, 'T' AS title, 'book-' || sha1(book || '|T') AS id, list({{'f': {_FILE}, 'h': html}} ORDER BY n) AS p FROM pg GROUP BY book), e AS ({_entries_sql('b')})
SELECT key AS book, name, sha256(content) AS content FROM e""")
def book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of every book that is written."""
    return _digests(_books(spark, sf_dir))


@query(f"""WITH {_PAGES}, v AS (SELECT book, n, row_number() OVER (PARTITION BY book ORDER BY n) AS v, count(*) OVER (PARTITION BY book) AS all_, parsed, n AS hi FROM pg),
b AS (SELECT book || '/' || v AS key, 'T - ' || v AS title, 'book-' || sha1(book || '|T') AS id, [{{'f': {_FILE}, 'h': parsed}}] AS p FROM v WHERE all_ > 1), e AS ({_entries_sql('b')})
SELECT key AS book, name, sha256(content) AS content FROM e""")
def volume_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of every volume that books are split into: each page is one, as the contents name each."""
    return _digests(volumes.split(_books(spark, sf_dir)))


@query(f"""WITH {_PAGES} SELECT book::VARCHAR AS book, 'OEBPS/content.opf' AS entry, 'T' AS title, '' AS author, 'book-' || sha1(book || '|T') AS identifier, 'ar' AS language, 'rtl' AS direction, false AS toc_page, (4 + count(*))::INT AS n_items, (1 + count(*))::INT AS n_spine FROM pg GROUP BY book""")
def package_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = stored(_books(spark, sf_dir))
    found = container.packages(entries, structure.package_entry(container.rootfiles(entries), entries))
    return found.select("book", "entry", "title", "author", "identifier", "language", "direction", "toc_page", F.size("items").alias("n_items"), F.size("spine").alias("n_spine"))


@query(f"""WITH {_PAGES}, f AS (SELECT book, n, {_FILE} AS f, parsed FROM pg) SELECT book::VARCHAR AS book, 'OEBPS/text/' || f AS name, n AS page_number, parsed AS text_html FROM f""")
def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = stored(_books(spark, sf_dir))
    pages = entries.where("name LIKE '%/text/%'").select("book", "pos", "name")
    return container.page_rows(entries, pages).select("book", "name", "page_number", "text_html")


_ANCHOR = """'<a href="#fn' || k || '" epub:type="noteref" role="doc-noteref" id="fnref' || k || '" class="fn nu">(' || pos || ')</a>'"""


@query(f"""WITH {LINES}, ln AS (SELECT l_orderkey AS page, pos, l_partkey % 3 > 0 AS noted, CASE WHEN l_partkey % 3 > 0 THEN sum((l_partkey % 3 > 0)::INT) OVER (PARTITION BY l_orderkey ORDER BY pos) END::INT AS k FROM li),
pa AS (SELECT page, string_agg('w' || pos || ' ' || CASE WHEN noted THEN {_ANCHOR} ELSE '(' || pos || ')' END, ' ' ORDER BY pos) AS body,
 string_agg('w' || pos || ' (' || pos || ')', ' ' ORDER BY pos) AS plain, list({{'k': k, 'pos': pos}} ORDER BY pos) FILTER (noted) AS notes FROM ln GROUP BY page),
g AS (SELECT o_custkey AS book, page, body, plain, coalesce(notes, []) AS notes, len(coalesce(notes, [])) > 0 AS has, CASE WHEN page % 4 = 0 THEN 'more ' || page END AS cont FROM pa JOIN orders ON o_orderkey = page),
f AS (SELECT *, coalesce(bool_or(has OR cont IS NOT NULL) OVER w, false) AS before_ FROM g WINDOW w AS (PARTITION BY book ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, CASE WHEN has OR (cont IS NOT NULL AND NOT before_) THEN page END AS anchor FROM f), t AS (SELECT *, CASE WHEN cont IS NOT NULL THEN max(anchor) OVER (PARTITION BY book ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS target FROM a),
m AS (SELECT target AS page, string_agg(cont, '<br />' ORDER BY page) AS more FROM t WHERE target IS NOT NULL GROUP BY target),
j AS (SELECT t.*, more, cont IS NOT NULL AND target IS NULL AS stays FROM t LEFT JOIN m ON m.page = t.page)
SELECT book, page AS page_no, CASE WHEN NOT has AND cont IS NULL THEN '<div><p>' || plain || '</p><hr /></div>' ELSE '<div><p>' || body || '</p><hr />' || CASE WHEN NOT has AND NOT stays THEN '' ELSE '<div class="hamesh">' ||
 CASE WHEN stays THEN '<aside id="fn0" epub:type="footnote"><span>=' || cont || CASE WHEN NOT has AND more IS NOT NULL THEN '<br />' || more ELSE '' END || '</span></aside>' ELSE '' END ||
 array_to_string(list_transform(notes, lambda x: '<aside id="fn' || x.k || '" epub:type="footnote"><a href="#fnref' || x.k || '" class="nu">(' || x.pos || ')</a><span>' || CASE WHEN x.k = len(notes) AND more IS NOT NULL THEN 'note ' || x.pos || '<br />' || more ELSE ' note ' || x.pos END || '</span></aside>'), '') || '</div>' END || '</div>' END AS html,
 has OR cont IS NOT NULL AS changed FROM j""")
def footnotes_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of their customer's book: each line is a word with a reference, two in three have a note, every fourth page continues an earlier note."""
    lines = P.numbered_lines(spark, sf_dir)
    ordered = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", x.alias("x")))), lambda y: y["x"]), " ")
    word = F.concat(F.lit("w"), "pos", F.lit(" ("), "pos", F.lit(")"))
    note = F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("("), "pos", F.lit(") note "), "pos"))
    notes = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", note.alias("x")))), lambda y: y["x"].isNotNull()), lambda y: y["x"])
    pages = lines.groupBy(F.col("l_orderkey").alias("page_no")).agg(ordered(word).alias("body"), notes.alias("notes"))
    more = F.when(F.col("page_no") % 4 == 0, F.array(F.concat(F.lit("=more "), "page_no"))).otherwise(F.array().cast("array<string>"))
    block = F.concat(more, "notes")
    shown = F.when(F.size(block) > 0, F.concat(F.lit('<p class="hamesh">'), F.array_join(block, "<br />"), F.lit("</p>"))).otherwise("")
    html = F.concat(F.lit("<div><p>"), "body", F.lit("</p><hr />"), shown, F.lit("</div>"))
    books = P.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("page_no"))
    return footnote_pages.standardised_pages(pages.join(books, "page_no").select("book", "page_no", html.alias("html")))


@query(f"""SELECT conv_id, turn, '<div dir="rtl" lang="ar"><h2>t</h2><p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p></div>' AS html FROM conversations""")
def filtered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in spans and divisions that say nothing, among empty paragraphs."""
    html = F.concat(F.lit('<div><h2> t<br /></h2><p> </p><p><span><span dir="rtl">'), T.escape_xml(F.col("text")), F.lit("</span></span></p></div>"))
    names = F.array(*map(F.lit, ("docx-cleanup", "empty-blocks", "bidi-cleanup", "rtl-wrap")))
    return filters.filtered(P.table(spark, sf_dir, "conversations").select("conv_id", "turn", html.alias("html"), names.alias("filters"))).drop("filters")


@query("""SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 3 = 0 THEN 'L' || c_custkey ELSE 'F' || c_custkey END AS label, 'Fam "' || c_nationkey || '"' AS family, CASE WHEN c_custkey % 2 = 0 THEN 'regular.ttf' ELSE 'a' || c_nationkey || '.otf' END AS regular,
sha256('body, p, div, li, td, th, blockquote, span {' || chr(10) || '  font-family: "Fam \\"' || c_nationkey || '\\"", serif !important;' || chr(10) || '}' || chr(10)) AS css FROM customer""")
def font_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as folders of fonts: a manifest names the family, some the label; the regular file is found by its name, or as the only font."""
    key = F.col("c_custkey")
    told = F.when(key % 3 == 0, F.create_map(F.lit("family"), F.concat(F.lit('Fam "'), "c_nationkey", F.lit('"')), F.lit("label"), F.concat(F.lit("L"), key))).otherwise(F.create_map(F.lit("family"), F.concat(F.lit('Fam "'), "c_nationkey", F.lit('"'))))
    files = F.when(key % 2 == 0, F.array(F.lit("z.ttf"), F.lit("regular.ttf"))).otherwise(F.array(F.lit("x.txt"), F.concat(F.lit("a"), "c_nationkey", F.lit(".otf"))))
    folders = P.table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), key).alias("profile"), F.lit(0).alias("root"), F.to_json(told).alias("manifest"), files.alias("files"))
    none = folders.select("profile", "root", F.lit("").alias("file"), F.lit("").alias("family")).where("false")
    found = fonts.profiles(folders, none)
    return found.join(fonts.style_sheet(found), "id").select(F.substring("id", F.lit(2), F.length("id")).alias("id"), "label", "family", "regular", F.sha2("css", 256).alias("css"))


_TABLES = ("nation", "orders", "lineitem", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in _TABLES))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.row_counts({t: P.table(spark, sf_dir, t) for t in _TABLES})


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", (row_number() OVER () - 1)::INT AS pos, column_name AS \"column\" FROM (DESCRIBE {t})" for t in _TABLES))
def table_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.headers(spark, {t: P.table(spark, sf_dir, t) for t in _TABLES})


@query(f"""WITH {LINES}, a AS (SELECT l_orderkey AS book, list(l_partkey ORDER BY pos) AS id, list(l_suppkey ORDER BY pos) FILTER (pos % 2 = 0) AS page FROM li GROUP BY l_orderkey), x AS (SELECT book, unnest(range(len(id)))::INT AS pos, id, page FROM a)
SELECT book, pos, id[pos + 1] AS id, page[pos + 1] AS page FROM x""")
def ragged_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda c, keep: F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", c))), keep), lambda x: x[c])
    columns = P.numbered_lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("book")).agg(listed("l_partkey", lambda x: F.lit(True)).alias("id"), listed("l_suppkey", lambda x: x["pos"] % 2 == 0).alias("page"))
    return catalogs.zipped(columns, ["id", "page"])


@query("""SELECT c_custkey AS book, CASE WHEN c_custkey % 4 = 0 THEN 'book ' || c_custkey ELSE c_name END AS title, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS author,
 '<div>' || chr(10) || '<h1>' || CASE WHEN c_custkey % 4 = 0 THEN 'book ' || c_custkey ELSE c_name END || '</h1>' || chr(10) || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '<p>المؤلف: ' || c_mktsegment || '</p>' END || chr(10) || CASE WHEN c_custkey % 4 = 1 THEN '' ELSE '<p>card ' || c_custkey || '</p>' END || chr(10) || '</div>' AS about FROM customer""")
def book_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as books: one in four has no main table, one in four no card."""
    key = F.col("c_custkey")
    rows = F.array(
        F.struct(F.lit("Main").alias("table"), F.lit(0).alias("table_pos"), F.lit("xBk").alias("column"), F.lit(0).alias("pos"), F.col("c_name").alias("value")), F.struct(F.lit("Main").alias("table"), F.lit(0).alias("table_pos"), F.lit("Auth").alias("column"), F.lit(1).alias("pos"), F.col("c_mktsegment").alias("value")),
        F.struct(F.lit("t1").alias("table"), F.lit(1).alias("table_pos"), F.lit("my_Betaka").alias("column"), F.lit(0).alias("pos"), F.concat(F.lit("card "), key).alias("value")),
    )
    kept = F.filter(rows, lambda x: ((x["table"] != "Main") | (key % 4 != 0)) & ((x["table"] != "t1") | (key % 4 != 1)))
    customers = P.table(spark, sf_dir, "customer")
    values = customers.select(key.alias("book"), F.explode(kept).alias("v")).select("book", "v.*")
    return catalogs.book_metadata(values, customers.select(key.alias("book"), F.concat(F.lit("book "), key, F.lit(".bok")).alias("name")))


@query(f"""WITH t AS (SELECT conv_id AS book, turn, '<p>' || replace({sql_escaped("trim(regexp_replace(text, '\\s+', ' ', 'g'))")}, '&apos;', '&#x27;') || '</p>' AS x, length(regexp_replace(text, '\\s', '', 'g')) AS seen FROM conversations), g AS (SELECT book, string_agg(x || chr(10) || '<hr />', chr(10) ORDER BY turn) AS body, sum(seen) AS seen FROM t GROUP BY book)
SELECT book, CASE WHEN seen > 0 THEN sha256('<html><head><meta charset="utf-8"><title>T</title></head><body>' || body || '</body></html>') END AS html, CASE WHEN seen = 0 THEN '{catalogs.NO_TEXT}' END AS error FROM g""")
def extracted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as blocks of a document, a page each."""
    turns = P.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("page"), F.regexp_replace("text", r"\s+", " ").alias("text"))
    blocks = turns.select("book", "page", F.lit(0.0).alias("top"), F.lit(0.0).alias("left"), F.lit(0).alias("kind"), "text")
    done = catalogs.extracted(turns.select("book", "page"), blocks, turns.select("book", F.lit("T").alias("title")).distinct())
    return done.select("book", F.sha2("html", 256).alias("html"), "error")


@query(f"""WITH {LINES}, i AS (SELECT l_orderkey AS book, pos, l_suppkey % 5 AS page, CASE WHEN l_orderkey % 2 = 0 AND l_partkey % 3 = 0 THEN 1 END AS level FROM li)
SELECT book, pos, (row_number() OVER (PARTITION BY book ORDER BY CASE WHEN lv = 0 THEN page END, pos))::INT AS place FROM (SELECT *, count(level) OVER (PARTITION BY book) AS lv FROM i)""")
def entries_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when((F.col("l_orderkey") % 2 == 0) & (F.col("l_partkey") % 3 == 0), 1)
    return toc.by_page(P.numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("book"), "pos", (F.col("l_suppkey") % 5).alias("page"), level.alias("level"))).select("book", "pos", "place")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN trim(o_orderpriority) WHEN o_orderkey % 3 = 1 THEN trim(o_orderpriority) || ' ' || o_orderstatus ELSE trim(o_orderpriority) END AS name, CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE 0 END::INT AS kind FROM orders""")
def chat_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chats: persons with one or two names, and groups with a title."""
    person, last = F.col("o_orderkey") % 3 < 2, F.when(F.col("o_orderkey") % 3 == 1, F.col("o_orderstatus")).otherwise("")
    name = render.chat_name(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")), last, F.trim("o_orderpriority"), person)
    return P.table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"), render.chat_type(person, ~person).alias("kind"))


@query("SELECT o_orderkey, (o_totalprice * 200)::BIGINT AS size FROM orders WHERE (o_totalprice * 200)::BIGINT <= 26214400 OR o_orderkey % 5 = 0")
def accepted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = P.table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 200).cast("long").alias("size"), (F.col("o_orderkey") % 5 == 0).alias("is_admin"))
    return render.accepted_sizes(files).select("o_orderkey", "size")


@query(f"""WITH {LINES} SELECT l_orderkey AS request, pos, ((pos - 1) // 3)::INT AS "row", ((pos - 1) % 3)::INT AS "column" FROM li""")
def keyboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.button_rows(P.numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("request"), "pos"), 3)


@query("""SELECT doc_id, sha256(regexp_replace(regexp_replace(text || ' ، x؟   y ؛z', '\\s+([،؛؟])', '\\1', 'g'), '([،؛؟])\\s{2,}', '\\1 ', 'g')) AS mended FROM documents""")
def mended_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.arabic_punctuation(F.concat("text", F.lit(" ، x؟   y ؛z"))), 256).alias("mended"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Conversion error: bad ' || event_id || chr(10) || 'b' WHEN event_id % 4 = 1 THEN 'b' ELSE 'a' || chr(10) || 'b' END AS said,
 CASE WHEN event_id % 4 = 0 THEN 'Conversion error: bad ' || event_id ELSE '' END AS errors FROM events""")
def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of a converter, of which one in four tells a failure among lines that don't count; and messages joined."""
    log = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("INFO - Conversion error: no\nx Conversion error: *bad* "), "event_id", F.lit("  \nend"))).otherwise("all is well")
    errors = T.command_errors(log)
    first = F.when(F.col("event_id") % 4 == 0, errors).when(F.col("event_id") % 4 == 1, F.lit("")).otherwise("a")
    return P.table(spark, sf_dir, "events").select("event_id", T.merged_errors(first, F.lit(None).cast("string"), F.lit("b")).alias("said"), errors.alias("errors"))


@query(f"""WITH {LINES}, m AS (SELECT l_orderkey AS book, pos, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'i' || pos END AS id, CASE WHEN l_suppkey % 2 = 0 THEN 'Text/' ELSE 'img/' END || pos || '.x' AS href, l_returnflag = 'N' AS exists FROM li)
SELECT book, pos, id, href FROM m WHERE NOT (NOT exists AND id <> '' AND href LIKE 'Text/%')""")
def live_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.concat(F.when(F.col("l_suppkey") % 2 == 0, "Text/").otherwise("img/"), "pos", F.lit(".x"))
    rows = P.numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("book"), "pos", F.when(F.col("l_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("i"), "pos")).alias("id"), href.alias("href"), F.lit("OEBPS").alias("directory"), (F.col("l_returnflag") == "N").alias("exists"))
    return structure.live_items(rows).select("book", "pos", "id", "href")
