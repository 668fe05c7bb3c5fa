"""Text filters over the markup of pages, by the names that ``render.pandoc_filters`` gives them.

Edge cases: null markup and markup that can't be parsed stay as they are; a filter without a name here does nothing;
each filter changes nothing the second time, but for page breaks and the wrapper, which are put once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree.ElementTree import Element

import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.sources.markup import fragment, inner, local

# Fixed value: what breaks a page.
PAGE_BREAK = '<p style="page-break-before:always"></p>'


def _unwrap(parent: Element, at: int) -> int:
    """Puts what a child holds in the child's place; the number of elements that came."""
    child = parent[at]
    kids, before = list(child), child.text or ""
    if kids:
        kids[-1].tail = (kids[-1].tail or "") + (child.tail or "")
    else:
        before += child.tail or ""
    if at:
        parent[at - 1].tail = (parent[at - 1].tail or "") + before
    else:
        parent.text = (parent.text or "") + before
    parent[at : at + 1] = kids
    return len(kids)


def _each(parent: Element, test: Callable[[Element], bool]) -> None:
    """Unwraps all descendants that pass the test, from the inside out."""
    at = 0
    while at < len(parent):
        _each(parent[at], test)
        at += _unwrap(parent, at) if test(parent[at]) else 1


def _visible(element: Element) -> bool:
    """Whether an element shows something: text, or an element that isn't a line break."""
    return bool("".join(element.itertext()).strip()) or any(local(e) not in ("br", "span") for e in element.iter() if e is not element)


def _drop(parent: Element, test: Callable[[Element], bool]) -> None:
    for at in reversed(range(len(parent))):
        child = parent[at]
        _drop(child, test)
        if test(child):
            child.text = None
            child[:] = []
            _unwrap(parent, at)


def direction_spans(root: Element) -> None:
    """Spans that say nothing but a direction go, their text stays."""
    _each(root, lambda e: local(e) == "span" and set(e.attrib) == {"dir"} and e.get("dir") in ("rtl", "ltr"))


def bare_containers(root: Element) -> None:
    """Spans and divisions without attributes go, their contents stay; headings lose blanks at both ends, and empty ones go."""
    _each(root, lambda e: local(e) in ("span", "div") and not e.attrib)
    heading = re.compile("h[1-6]")
    for e in root.iter():
        if heading.fullmatch(local(e)):
            while len(e) and local(e[0]) == "br" and not (e.text or "").strip():
                _unwrap(e, 0)
            while len(e) and local(e[-1]) == "br" and not (e[-1].tail or "").strip():
                _unwrap(e, len(e) - 1)
            e.text = (e.text or "").lstrip() or None
            if len(e):
                e[-1].tail = (e[-1].tail or "").rstrip() or None
            elif e.text:
                e.text = e.text.rstrip()
    _drop(root, lambda e: bool(heading.fullmatch(local(e))) and not len(e) and not (e.text or "").strip())


def empty_paragraphs(root: Element) -> None:
    _drop(root, lambda e: local(e) == "p" and not _visible(e))


def arabic_punctuation(root: Element) -> None:
    """No white space before an Arabic comma, semicolon or question mark, one space instead of several after it."""

    def mended(text: str | None) -> str | None:
        return re.sub(r"([،؛؟])\s{2,}", r"\1 ", re.sub(r"\s+([،؛؟])", r"\1", text)) if text else text

    for e in root.iter():
        e.text, e.tail = mended(e.text) if isinstance(e.tag, str) else e.text, mended(e.tail)


def page_breaks(root: Element) -> None:
    """A page break before each heading of the first two levels but the first."""
    seen = False
    for at in [k for k, e in enumerate(list(root)) if re.fullmatch("h[12]", local(e))][::-1]:
        earlier = any(re.fullmatch("h[12]", local(e)) for e in root[:at])
        broken = at > 0 and root[at - 1].get("style") == "page-break-before:always"
        seen = seen or earlier
        if earlier and not broken:
            root.insert(at, fragment(PAGE_BREAK)[0])


def wrapped(root: Element) -> None:
    """Everything in a division from right to left."""
    if len(root) == 1 and local(root[0]) == "div" and root[0].get("dir") == "rtl" and not (root.text or "").strip():
        return
    box = Element("div", {"dir": "rtl", "lang": "ar"})
    box.text, box[:] = root.text, list(root)
    root.text, root[:] = None, [box]


# The names of the filters.
FILTERS: dict[str, Callable[[Element], None]] = {
    "docx-cleanup": bare_containers, "empty-blocks": empty_paragraphs, "arabic-punctuation": arabic_punctuation, "bidi-cleanup": direction_spans, "docx-header-pagebreaks": page_breaks, "rtl-wrap": wrapped,
}


def applied(html: str | None, names: list[str] | None) -> str | None:
    """The markup after the named filters, in order."""
    root = None if html is None else fragment(html)
    if root is None or not names:
        return html
    for name in names:
        if name in FILTERS:
            FILTERS[name](root)
    return inner(root)


def filtered(pages: DataFrame) -> DataFrame:
    """``pages`` (…, html, filters: array of names) with ``html`` after the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = [applied(h, f) for h, f in zip(batch.column("html").to_pylist(), batch.column("filters").to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("html"), "html", pa.array(html, batch.schema.field("html").type))

    return pages.mapInArrow(run, pages.schema)
