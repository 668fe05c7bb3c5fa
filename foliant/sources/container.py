"""ZIP containers as tables of entries, and tables of entries as containers.

Files come through Spark's ``binaryFile`` reader, so any Hadoop file system
works; a container is opened inside a task, one file at a time.

Edge cases: a file that is no container, and an entry that can't be read (encrypted,
cut off, of an unknown method), are a row of ``read_errors`` and no entry; markup that
is not well-formed or that declares entities gives no rows.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.sources import markup
from foliant.sources.markup import local, text_of

ENTRIES = "book string, pos int, name string, compress_type int, content binary"


def _scanned(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for book, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for pos, info in enumerate(archive.infolist()):
                            try:
                                rows.append((book, pos, info.filename, info.compress_type, archive.read(info), None))
                            except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError) as error:
                                rows.append((book, pos, info.filename, info.compress_type, None, f"{type(error).__name__}: {error}"))
                except (zipfile.BadZipFile, struct.error, ValueError, OSError) as error:
                    rows = [(book, -1, None, None, None, f"{type(error).__name__}: {error}")]
                yield pd.DataFrame(rows, columns=["book", "pos", "name", "compress_type", "content", "error"]).astype({"compress_type": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(unzip, f"{ENTRIES}, error string")


def read_entries(spark: SparkSession, path: str, pattern: str = "*.epub") -> DataFrame:
    """All entries that can be read of all containers below ``path``, in the order of their directories."""
    return _scanned(spark, path, pattern).where("error IS NULL").drop("error")


def read_errors(spark: SparkSession, path: str, pattern: str = "*.epub") -> DataFrame:
    """book, name (null for a whole file) and error of what can't be read."""
    return _scanned(spark, path, pattern).where("error IS NOT NULL").select("book", "name", "error")


def saved(files: DataFrame, folder: str) -> DataFrame:
    """Writes files (name, content) below ``folder``, any place that Arrow's file systems reach, once this is evaluated: name, path and size of each.

    A file appears under its name when it is whole, so a task that runs twice does no harm.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if re.match(r"^\w+:", folder) else f"file://{folder}")
        for batch in batches:
            rows = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                path = posixpath.join(root, name)
                system.create_dir(posixpath.dirname(path), recursive=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, path)
                rows.append((name, path, len(content)))
            yield pd.DataFrame(rows, columns=["name", "path", "size"])

    return files.select("name", "content").mapInPandas(write, "name string, path string, size long")


def contents(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (book, name) with the content of the last entry of that name; empty where there is none."""
    # Only what is wanted is gathered, not whole containers.
    last = entries.join(wanted.select("book", "name").distinct(), ["book", "name"], "left_semi").groupBy("book", "name").agg(F.max_by("content", "pos").alias("content"))
    return wanted.join(last, ["book", "name"], "left").withColumn("content", F.coalesce("content", F.lit(b"")))


def packed(entries: DataFrame) -> DataFrame:
    """book and content: one container for each book, the mimetype first and stored, other entries deflated in order."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").drop_duplicates("name", keep="last")
        first = rows["name"] == "mimetype"
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, content in pd.concat([rows[first], rows[~first]])[["name", "content"]].itertuples(index=False):
                info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
                archive.writestr(info, content)
        return pd.DataFrame({"book": [rows["book"].iloc[0]], "content": [buffer.getvalue()]})

    return entries.select("book", "pos", "name", "content").groupBy("book").applyInPandas(pack, "book string, content binary")


def replaced(entries: DataFrame, replacements: DataFrame) -> DataFrame:
    """``entries`` with new content for those in ``replacements`` (book, name, content)."""
    new = replacements.select("book", "name", F.col("content").alias("_new"))
    return entries.join(new, ["book", "name"], "left").withColumn("content", F.coalesce("_new", "content")).select(*entries.columns)


def _parsed(entries: DataFrame, run: Callable[[tuple], list[tuple]], columns: list[str], schema: str) -> DataFrame:
    """Rows that ``run`` makes of each (named) row of ``entries``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = pd.DataFrame([r for row in batch.itertuples(index=False) for r in run(row)], columns=columns)
            yield frame.astype({c: "Int64" for c in columns if c in ("page", "page_number")})

    return entries.mapInPandas(parse, schema)


def rootfiles(entries: DataFrame) -> DataFrame:
    """book, at and path of the package documents that each book's container file names."""

    def run(row: tuple) -> list[tuple]:
        root = markup.tree(row.content)
        paths = [markup.attribute(e, "full-path") for e in root.iter() if local(e) == "rootfile"] if root is not None else []
        return [(row.book, at, path) for at, path in enumerate(p for p in paths if p)]

    chosen = entries.where(F.lower("name") == "meta-inf/container.xml").groupBy("book").agg(F.max_by("content", F.struct(F.col("name") == "META-INF/container.xml", "pos")).alias("content"))
    return _parsed(chosen, run, ["book", "at", "path"], "book string, at int, path string")


_DC = "http://purl.org/dc/elements/1.1/"
PACKAGES = (
    "book string, entry string, directory string, title string, author string, identifier string, language string, direction string, toc_page boolean, "
    "items array<struct<pos:int,id:string,href:string,media_type:string,properties:string>>, spine array<struct<pos:int,idref:string>>"
)


def _package(row: tuple) -> list[tuple]:
    root = markup.tree(row.content)
    if root is None:
        return []
    part = {}
    for e in root.iter():
        part.setdefault(local(e), e)
    told: dict[str, str] = {}
    for e in part.get("metadata", ()):
        if isinstance(e.tag, str) and e.tag.startswith(f"{{{_DC}}}") and (e.text or "").strip():
            told.setdefault(local(e), e.text.strip())
    value = lambda e, name: (e.get(name) or "").strip()
    items = [(k, *(value(e, n) for n in ("id", "href", "media-type", "properties"))) for k, e in enumerate(x for x in part.get("manifest", ()) if local(x) == "item")]
    spine = [(k, value(e, "idref")) for k, e in enumerate(x for x in part.get("spine", ()) if local(x) == "itemref")]
    navs = {i for _, i, href, kind, p in items if i and href and kind and ("nav" in p.lower().split() or i.lower() == "nav" or href.lower().rsplit("/", 1)[-1] == "nav.xhtml")} or {"nav"}
    direction = markup.attribute(part["spine"], "page-progression-direction").lower() if "spine" in part else ""
    toc_page = "spine" not in part or any(idref in navs for _, idref in spine)
    columns = ["pos", "id", "href", "media_type", "properties"]
    return [(row.book, row.name, posixpath.dirname(row.name), *(told.get(k, "") for k in ("title", "creator", "identifier", "language")), direction if direction in ("rtl", "ltr") else "", toc_page, [dict(zip(columns, i, strict=True)) for i in items], [dict(zip(["pos", "idref"], i, strict=True)) for i in spine])]


def packages(entries: DataFrame, chosen: DataFrame) -> DataFrame:
    """Metadata, manifest and spine of the package document of each book in ``chosen`` (book, entry); books whose document can't be parsed have none."""
    names = [c.strip().split(" ")[0] for c in PACKAGES.split(", ")]
    return _parsed(contents(entries, chosen.select("book", F.col("entry").alias("name"))), _package, names, PACKAGES)


def manifest(found: DataFrame) -> DataFrame:
    """Manifest items of ``found`` (from ``packages``) that have an href and a media type: book, pos, id, media_type, properties, path, href (as seen from OEBPS), and what they are: nav, info, ncx, page, style, asset."""
    rows = found.select("book", "directory", F.explode("items").alias("i")).select("book", "directory", "i.*").where("href <> '' AND media_type <> ''")
    low, key = F.lower("href"), F.lower("id")
    named = lambda name: (low == name) | F.endswith(low, F.lit(f"/{name}"))
    path = T.zip_path(F.col("directory"), F.col("href"))
    rows = rows.withColumns({"path": path, "nav": F.array_contains(F.split(F.lower("properties"), r"\s+"), "nav") | (key == "nav") | named("nav.xhtml"), "info": (key == "info") | named("info.xhtml")})
    rows = rows.withColumns({"ncx": (key == "ncx") | (F.col("media_type") == "application/x-dtbncx+xml") | named("toc.ncx"), "page": F.col("media_type").isin("application/xhtml+xml", "text/html") & ~F.col("nav") & ~F.col("info"), "style": F.col("media_type") == "text/css"})
    rows = rows.withColumn("href", T.relative_path(F.lit("OEBPS"), F.col("path")))
    low = F.lower("href")
    own = key.isin("info", "nav", "ncx", "css") | F.col("nav") | F.col("info") | low.isin("info.xhtml", "nav.xhtml", "toc.ncx", "styles.css") | (F.col("page") & F.startswith(low, F.lit("text/")))
    return rows.withColumn("asset", ~own).drop("directory")


PAGES = "book string, pos int, name string, page_number bigint, text_html string, titles array<string>"
_PAGE = re.compile(r"^(?:page_\d+_|page\d+_)(\d+)\.xhtml$", re.IGNORECASE)


def page_rows(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Body markup, headings (without immediate repetitions) and number of pages (book, pos from 1, name); the number is in the file's name, else it is ``pos``.  Pages that can't be parsed go."""

    def run(row: tuple) -> list[tuple]:
        root = markup.tree(row.content)
        body = markup.body_of(root) if root is not None else None
        if body is None:
            return []
        titles: list[str] = []
        for e in body.iter():
            title = "".join(e.itertext()).strip() if re.fullmatch("h[1-6]", local(e)) else ""
            if title and titles[-1:] != [title]:
                titles.append(title)
        number = _PAGE.match(posixpath.basename(row.name))
        return [(row.book, row.pos, row.name, int(number[1]) if number else row.pos, markup.inner(body).strip(), titles)]

    names = [c.split(" ")[0] for c in PAGES.split(", ")]
    return _parsed(contents(entries, pages.select("book", "pos", "name")), run, names, PAGES)


def bodies(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """book, name and body markup of documents (book, name); empty where there is none."""

    def run(row: tuple) -> list[tuple]:
        root = markup.tree(row.content)
        body = markup.body_of(root) if root is not None else None
        return [(row.book, row.name, "" if body is None else markup.inner(body).strip())]

    return _parsed(contents(entries, wanted.select("book", "name")), run, ["book", "name", "body"], "book string, name string, body string")


def with_bodies(entries: DataFrame, new: DataFrame) -> DataFrame:
    """book, name and content of documents with new body markup (book, name, html); those that can't be parsed go, so they stay as they are."""

    def run(row: tuple) -> list[tuple]:
        root = markup.tree(row.content)
        body = markup.body_of(root) if root is not None else None
        if body is None or row.html is None or not markup.set_inner(body, row.html):
            return []
        return [(row.book, row.name, markup.document(root, text_of(row.content).lstrip().startswith("<?xml")).encode())]

    return _parsed(contents(entries, new.select("book", "name", "html")), run, ["book", "name", "content"], "book string, name string, content binary")


def with_direction(entries: DataFrame, chosen: DataFrame) -> DataFrame:
    """book, name and content of the package documents of ``chosen`` (book, entry) whose spine doesn't run from right to left yet, so that it does."""

    def run(row: tuple) -> list[tuple]:
        root = markup.tree(row.content)
        spine = next((e for e in root.iter() if local(e) == "spine"), None) if root is not None else None
        if spine is None or spine.get("page-progression-direction") == "rtl":
            return []
        spine.set("page-progression-direction", "rtl")
        space = root.tag[1:].split("}")[0] if root.tag.startswith("{") else ""
        if space:
            ET.register_namespace("", space)
        return [(row.book, row.name, ET.tostring(root, encoding="utf-8", xml_declaration=text_of(row.content).lstrip().startswith("<?xml")))]

    return _parsed(contents(entries, chosen.select("book", F.col("entry").alias("name"))), run, ["book", "name", "content"], "book string, name string, content binary")


def with_packages(entries: DataFrame, new: DataFrame) -> DataFrame:
    """book, name and content of package documents with another manifest and spine.

    ``new`` (book, entry, items: array of (at, href) with the item's old place, spine: array of idrefs) says what they hold, in order.
    """

    def run(row: tuple) -> list[tuple]:
        root = markup.tree(row.content)
        if root is None:
            return []
        part = {local(e): e for e in reversed(list(root.iter()))}
        old = [e for e in part["manifest"] if local(e) == "item"]
        refs = {e.get("idref"): e for e in reversed([e for e in part["spine"] if local(e) == "itemref"])}
        for item in row.items_:
            old[item["at"]].set("href", item["href"])
        part["manifest"][:] = [old[item["at"]] for item in row.items_]
        name = old[0].tag[: -len("item")] + "itemref" if old else "itemref"
        part["spine"][:] = [refs[i] if i in refs else ET.Element(name, {"idref": i}) for i in row.spine]
        space = root.tag[1:].split("}")[0] if root.tag.startswith("{") else ""
        if space:
            ET.register_namespace("", space)
        ET.register_namespace("dc", _DC)
        return [(row.book, row.name, ET.tostring(root, encoding="utf-8", xml_declaration=text_of(row.content).lstrip().startswith("<?xml")))]

    wanted = new.select("book", F.col("entry").alias("name"), F.col("items").alias("items_"), "spine")
    return _parsed(contents(entries, wanted), run, ["book", "name", "content"], "book string, name string, content binary")


def _flat_points(root: ET.Element) -> None:
    top = next((e for e in root.iter() if local(e) == "navmap"), None)
    if top is None:
        return
    points = [e for e in top.iter() if local(e) == "navpoint"]
    for number, point in enumerate(points, 1):
        point[:] = [e for e in point if local(e) != "navpoint"]
        point.attrib.clear()
        point.attrib.update({"id": f"num_{number}", "playOrder": str(number)})
    top[:] = points


def _flat_list(root: ET.Element) -> None:
    navs = [e for e in root.iter() if local(e) == "nav"]
    nav = next(filter(_is_toc, navs), navs[0] if navs else None)
    top = next((e for e in nav.iter() if local(e) == "ol"), None) if nav is not None else None
    if top is None:
        return
    items = [e for e in top.iter() if local(e) == "li"]
    for item in items:
        item[:] = [e for e in item if local(e) != "ol"]
    top[:] = items


def with_flat_contents(entries: DataFrame, chosen: DataFrame) -> DataFrame:
    """book, name and content of navigation documents and NCX files (book, name) with a single level."""

    def run(row: tuple) -> list[tuple]:
        root = markup.tree(row.content)
        if root is None:
            return []
        (_flat_points if row.name.endswith(".ncx") else _flat_list)(root)
        space = root.tag[1:].split("}")[0] if root.tag.startswith("{") else ""
        if space and space != markup.XHTML:
            ET.register_namespace("", space)
            return [(row.book, row.name, ET.tostring(root, encoding="utf-8", xml_declaration=text_of(row.content).lstrip().startswith("<?xml")))]
        return [(row.book, row.name, markup.document(root, text_of(row.content).lstrip().startswith("<?xml")).encode())]

    return _parsed(contents(entries, chosen), run, ["book", "name", "content"], "book string, name string, content binary")


PACKAGE = "book string, entry string, kind string, pos int, id string, href string, media_type string, properties string"


def package_rows(entries: DataFrame) -> DataFrame:
    """Manifest items and spine rows (kind ``item`` and ``itemref``, its idref as id) of each book's last package file that can be read."""
    told = lambda value: F.nullif(value, F.lit(""))
    last = _parsed(entries.where(F.endswith("name", F.lit(".opf"))).select("book", "pos", "name", "content"), lambda row: [(*_package(row)[0], row.pos)] if _package(row) else [], [*(c.strip().split(" ")[0] for c in PACKAGES.split(", ")), "at"], f"{PACKAGES}, at int")
    last = last.where((F.size("items") > 0) & (F.size("spine") > 0)).groupBy("book").agg(F.max_by(F.struct("entry", "items", "spine"), "at").alias("p")).select("book", "p.*")
    none = F.lit(None).cast("string")
    items = F.transform("items", lambda i: F.struct(F.lit("item").alias("kind"), i["pos"].alias("pos"), told(i["id"]).alias("id"), told(i["href"]).alias("href"), told(i["media_type"]).alias("media_type"), told(i["properties"]).alias("properties")))
    spine = F.transform("spine", lambda i: F.struct(F.lit("itemref").alias("kind"), i["pos"].alias("pos"), told(i["idref"]).alias("id"), none.alias("href"), none.alias("media_type"), none.alias("properties")))
    return last.select("book", "entry", F.explode(F.concat(items, spine)).alias("r")).select("book", "entry", "r.*")


TOC = "book string, source string, node int, path array<int>, text string, page bigint, href string, anchor string"


def _link(href: str, base: str) -> tuple[int | None, str | None, str | None] | None:
    """(page, href, anchor) of a link; nothing for a link without a path."""
    path, _, anchor = href.strip().partition("#")
    target = posixpath.normpath(posixpath.join(base, path)) if path else "."
    if target == ".":
        return None
    found = _PAGE.match(posixpath.basename(target))
    page = int(found[1]) if found else 0
    return (page or None, None if page else target, anchor.strip() or None)


def _is_toc(nav: ET.Element) -> bool:
    for key, value in nav.attrib.items():
        name = re.split("[}:]", key)[-1].lower()
        words = value.lower().split()
        if (name == "id" and value.strip().lower() == "toc") or (name == "role" and "doc-toc" in words) or (name == "type" and "toc" in words):
            return True
    return False


def _unlisted(element: ET.Element) -> Iterator[ET.Element | str]:
    """Elements and text of a list item, in order, without the lists inside it."""
    yield element.text or ""
    for child in element:
        if local(child) not in ("ol", "ul"):
            yield child
            yield from _unlisted(child)
        yield child.tail or ""


def _walk_list(ol: ET.Element, base: str, above: list[int], out: list, counter: list[int]) -> None:
    for li in (e for e in ol if local(e) == "li"):
        label = list(_unlisted(li))
        anchor = next((e for e in label if not isinstance(e, str) and local(e) == "a"), None)
        text = " ".join("".join(x for x in label if isinstance(x, str)).split())
        link = _link(anchor.get("href", ""), base) if anchor is not None else None
        if anchor is not None:
            text = "".join(anchor.itertext()).strip() or text
        inner = next((e for e in li if local(e) in ("ol", "ul")), None)
        here = above
        if link or inner is not None:
            counter[0] += 1
            here = [*above, counter[0]]
            out.append((here, text, *(link or (None, None, None))))
        if inner is not None:
            _walk_list(inner, base, here, out, counter)


def _walk_points(parent: ET.Element, base: str, above: list[int], out: list, counter: list[int]) -> None:
    for point in (e for e in parent if local(e) == "navpoint"):
        label = next((e for e in point if local(e) == "navlabel"), None)
        words = next((e for e in label.iter() if local(e) == "text"), label) if label is not None else None
        source = next((e.get("src", "") for e in point if local(e) == "content"), "")
        counter[0] += 1
        here = [*above, counter[0]]
        out.append((here, "".join(words.itertext()).strip() if words is not None else "", *(_link(source, base) or (None, None, None))))
        _walk_points(point, base, here, out, counter)


def toc_rows(entries: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Nodes of the navigation documents (source ``nav``) and NCX files (``ncx``): node counts in document order, path has the nodes from the top.

    ``chosen`` (book, source, name) tells which entries these are; without it they are told by their names.
    """

    def run(row: tuple) -> list[tuple]:
        root = markup.tree(row.content)
        if root is None:
            return []
        out: list = []
        base = posixpath.dirname(row.name)
        if row.source == "ncx":
            top = next((e for e in root.iter() if local(e) == "navmap"), None)
            if top is not None:
                _walk_points(top, base, [], out, [0])
        else:
            navs = [e for e in root.iter() if local(e) == "nav"]
            nav = next(filter(_is_toc, navs), navs[0] if navs else None)
            top = next((e for e in nav.iter() if local(e) in ("ol", "ul")), None) if nav is not None else None
            if top is not None:
                _walk_list(top, base, [], out, [0])
        return [(row.book, row.source, path[-1], path, *rest) for path, *rest in out]

    if chosen is None:
        named = entries.where(F.lower("name").rlike(r"\.ncx$|nav[^/]*\.xhtml$"))
        files = named.select("book", F.when(F.lower("name").endswith(".ncx"), "ncx").otherwise("nav").alias("source"), "name", "content")
    else:
        files = contents(entries, chosen.select("book", "source", "name"))
    return _parsed(files, run, [c.split(" ")[0] for c in TOC.split(", ")], TOC)
