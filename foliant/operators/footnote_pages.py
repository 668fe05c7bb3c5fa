"""Footnotes in the markup of whole pages: every page becomes one in which notes are asides, linked from the text.

A page is rewritten inside a task, from its own markup alone; what one page's
note continues from another is then moved by ``footnotes.carried``.

Edge cases: markup that can't be parsed, null and pages without notes stay as they
are; notes without a marker in the text join the last linked note; rewriting twice
changes nothing more; what follows a block of notes stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import takewhile
from xml.etree.ElementTree import Element, SubElement

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import footnotes
from foliant.sources.markup import EPUB, attribute, fragment, inner, local, outer, set_inner

# Digits, a reference in the text, starts of a note with and without brackets, line breaks, brackets around a verse, the joint of lines.
_DIGITS = "[٠-٩0-9]+"
_REFERENCE = re.compile(rf"\(\^?{_DIGITS}\)|\[\^?{_DIGITS}\]")
_BRACKETED = re.compile(rf"\s*(\(\s*\^?{_DIGITS}\s*\)|\[\s*\^?{_DIGITS}\s*\])(.*)", re.DOTALL)
_PLAIN = re.compile(rf"\s*({_DIGITS})(?:\s*[-–—.:،)]\s*|\s+)(.*)", re.DOTALL)
_BREAK = re.compile(r"</?(?:\w+:)?br\s*/?>", re.IGNORECASE)
_VERSE = "﴿", "﴾"
_JOINT = "<br />"
_ASCII = str.maketrans("٠١٢٣٤٥٦٧٨٩", "0123456789")
_TYPE = f"{{{EPUB}}}type"


@dataclass(frozen=True)
class Mark:
    """What a marker says: number, caret, kind of brackets."""

    number: str
    caret: bool
    bracket: str

    @classmethod
    def read(cls, marker: str) -> Mark:
        digits = re.search(_DIGITS, marker)
        return cls(digits[0].translate(_ASCII) if digits else "", "^" in marker, {"(": "paren", "[": "square"}.get(marker.strip()[:1], "plain"))


@dataclass
class Note:
    marker: str
    lines: list[str] = field(default_factory=list)

    def line(self) -> str:
        """The note as a line of another one."""
        joint = " " if self.marker[:1] in "([" and self.marker[-1:] in ")]" else " - "
        return joint.join(x for x in (self.marker, _JOINT.join(self.lines)) if x)


def read_notes(blocks: list[str]) -> tuple[list[str], list[Note]]:
    """Lines that continue an earlier page's note (the last block that begins with ``=`` gives them), and the notes, of the inner markup of note blocks."""
    continued: list[str] = []
    found: list[Note] = []
    for block in blocks:
        lines = [x.strip() for x in _BREAK.split(block) if x.strip()]
        # Plain numbers begin notes only where no line of the block has brackets.
        starts = [_BRACKETED] if any(map(_BRACKETED.match, lines)) else [_PLAIN]
        current: list[str] | None = None
        for k, line in enumerate(lines):
            begins = None if k == 0 and line.startswith("=") else next(filter(None, (s.match(line) for s in starts)), None)
            if begins:
                found.append(Note(begins[1], [begins[2].strip()] if begins[2].strip() else []))
                current = found[-1].lines
            elif k == 0 and line.startswith("="):
                current = continued = [line]
            elif current is not None:
                current.append(line)
    return continued, found


@dataclass(frozen=True)
class Reference:
    paragraph: int
    start: int
    end: int
    mark: Mark
    verse: bool


def references(paragraphs: list[str]) -> list[Reference]:
    """All markers in the markup of paragraphs, in order."""
    out = []
    for k, html in enumerate(paragraphs):
        opened = scanned = 0
        for m in _REFERENCE.finditer(html):
            opened += html.count(_VERSE[0], scanned, m.start()) - html.count(_VERSE[1], scanned, m.start())
            scanned = m.start()
            beside = html[: m.start()].rstrip()[-1:] == _VERSE[0] or html[m.end() :].lstrip()[:1] == _VERSE[1]
            out.append(Reference(k, m.start(), m.end(), Mark.read(m[0]), opened > 0 or beside))
    return out


def pick(notes: list[Note], found: list[Reference]) -> list[int | None]:
    """For each note the index of its reference: see ``footnotes.links``."""
    by_number: dict[str, list[int]] = {}
    for k, r in enumerate(found):
        by_number.setdefault(r.mark.number, []).append(k)
    after, out = 0, []
    for note in notes:
        mark = Mark.read(note.marker)
        rank = lambda k, mark=mark: (found[k].mark.caret != mark.caret, found[k].mark.bracket != mark.bracket, found[k].verse and not found[k].mark.caret, k)
        chosen = min((k for k in by_number.get(mark.number, ()) if k >= after), key=rank, default=None)
        after = after if chosen is None else chosen + 1
        out.append(chosen)
    return out


def aside(note: Note | None, number: int, lines: list[str]) -> Element:
    """The element of a note, or with number 0 of what continues one."""
    out = Element("aside", {"id": f"fn{number}", _TYPE: "footnote"})
    if note is not None:
        SubElement(out, "a", {"href": f"#fnref{number}", "class": "nu"}).text = note.marker
    content = _JOINT.join(lines)
    span = SubElement(out, "span")
    if not set_inner(span, f" {content}" if note is not None and content else content):
        span.text = content
    return out


def _span(note: Element) -> Element | None:
    return next((e for e in note if local(e) == "span"), None)


def append_lines(note: Element, lines: list[str]) -> bool:
    """Puts lines behind what an aside says; False if it has no span or they can't be parsed."""
    span = _span(note)
    return span is not None and set_inner(span, _JOINT.join(x for x in (inner(span).strip(), *lines) if x))


def _parents(root: Element) -> dict[Element, Element]:
    return {child: parent for parent in root.iter() for child in parent}


def _swap(parent: Element, old: Element, new: list[Element]) -> None:
    """Puts ``new`` in the place of ``old``; what follows ``old`` stays."""
    at = list(parent).index(old)
    parent[at : at + 1] = new
    if new:
        new[-1].tail = old.tail
    elif old.tail:
        if at:
            parent[at - 1].tail = (parent[at - 1].tail or "") + old.tail
        else:
            parent.text = (parent.text or "") + old.tail


def _linked(root: Element, paragraphs: list[Element], notes: list[Note], first: int) -> list[int]:
    """Turns the references of ``notes`` in ``paragraphs`` into links, numbered from ``first``; the notes that have one."""
    html = [outer(p) for p in paragraphs]
    found = references(html)
    edits: dict[int, list[tuple[Reference, int]]] = {}
    chosen = pick(notes, found)
    for k, at in enumerate(chosen):
        if at is not None:
            edits.setdefault(found[at].paragraph, []).append((found[at], first + k))
    parents = _parents(root) if edits else {}
    for p, links in edits.items():
        pieces, last = [], 0
        for r, number in sorted(links, key=lambda x: x[0].start):
            pieces += [html[p][last : r.start], f'<a href="#fn{number}" epub:type="noteref" role="doc-noteref" id="fnref{number}" class="fn nu">{html[p][r.start : r.end]}</a>']
            last = r.end
        new = fragment("".join(pieces) + html[p][last:])
        if new is not None and len(new) and paragraphs[p] in parents:
            _swap(parents[paragraphs[p]], paragraphs[p], [new[0]])
    return [k for k, at in enumerate(chosen) if at is not None]


def _is_block(element: Element) -> bool:
    return local(element) == "p" and "hamesh" in (element.get("class") or "").split()


def _box(asides: list[Element]) -> Element:
    box = Element("div", {"class": "hamesh"})
    box.extend(asides)
    return box


def _from_blocks(root: Element, blocks: list[Element]) -> bool:
    """Pages whose notes stand in paragraphs of their own class."""
    continued, notes = read_notes([inner(b) for b in blocks])
    linked = _linked(root, [e for e in root.iter() if local(e) == "p" and not _is_block(e)], notes, 1)
    asides = [aside(notes[k], k + 1, notes[k].lines) for k in linked]
    left = [line for k, note in enumerate(notes) if k not in set(linked) and (line := note.line())]
    if not linked and not continued:
        return False
    if linked and left:
        append_lines(asides[-1], left)
    if continued:
        asides.insert(0, aside(None, 0, continued if linked else continued + left))
    parents = _parents(root)
    for k, block in enumerate(blocks):
        if block in parents:
            _swap(parents[block], block, [] if k else [_box(asides)])
    return True


def _ruled_marker(element: Element) -> Element | None:
    """The span with which a ruled note begins."""
    if local(element) != "p" or (element.text or "").strip() or not len(element) or local(element[0]) != "span":
        return None
    return element[0] if _REFERENCE.fullmatch("".join(element[0].itertext()).strip()) else None


def _ruled_continuation(element: Element | None) -> str:
    if element is None or local(element) != "p" or _ruled_marker(element) is not None:
        return ""
    text = inner(element).strip()
    return text[1:].strip() if text.startswith("=") else ""


def _open_aside(before: list[Element]) -> Element | None:
    """The nearest unfinished footnote among these siblings, unless a note that isn't linked stands nearer."""
    for sibling in reversed(before):
        if _ruled_marker(sibling) is not None:
            return None
        for e in reversed(list(sibling.iter())):
            if local(e) == "aside" and attribute(e, "type") == "footnote" and (span := _span(e)) is not None and inner(span).rstrip().endswith("="):
                return e
    return None


def _from_rules(root: Element) -> bool:
    """Pages whose notes follow rules: each rule ends a section of text and begins its notes."""
    changed, number = False, 1
    for parent in list(root.iter()):
        kids = list(parent)
        rules = [k for k, e in enumerate(kids) if local(e) == "hr"]
        for before, at in zip([-1, *rules], rules, strict=False):
            text = _ruled_continuation(kids[at + 1] if at + 1 < len(kids) else None)
            if text:
                now = list(parent)
                target = _open_aside(now[: now.index(kids[at])])
                if target is not None and append_lines(target, [text]):
                    _swap(parent, kids[at + 1], [])
                    changed = True
            marked = list(takewhile(lambda e: _ruled_marker(e) is not None, kids[at + 1 + bool(text) :]))
            notes = []
            for p in marked:
                span = _ruled_marker(p)
                # The paragraph's text without its marker.
                rest = (span.tail or "") + "".join(outer(e) + (e.tail or "") for e in p[1:])
                notes.append(Note("".join(span.itertext()).strip(), [rest.strip()] if rest.strip() else []))
            section = [e for node in kids[before + 1 : at] for e in node.iter() if local(e) == "p" and (e is not node or _ruled_marker(e) is None)]
            linked = _linked(root, section, notes, number)
            for k in linked[1:]:
                _swap(parent, marked[k], [])
            if linked:
                _swap(parent, marked[linked[0]], [_box([aside(notes[k], number + k, notes[k].lines) for k in linked])])
                changed = True
            number += len(notes)
    return changed


def _standardise(root: Element) -> bool:
    blocks = [e for e in root.iter() if _is_block(e)]
    return _from_blocks(root, blocks) if blocks else _from_rules(root)


def standardised(html: str) -> str:
    """The markup of a page with its notes as asides that the text links to; as it was where there is nothing to link."""
    root = fragment(html)
    return inner(root) if root is not None and _standardise(root) else html


def _footnotes(root: Element) -> list[Element]:
    return [e for e in root.iter() if local(e) == "aside" and re.fullmatch(r"fn\d+", e.get("id") or "") and attribute(e, "type") == "footnote"]


def _without_continuation(root: Element) -> tuple[str | None, bool]:
    """Takes the aside that continues an earlier note out, with elements that it leaves empty: what it says, and whether a note is left."""
    asides = [e for e in _footnotes(root) if _span(e) is not None]
    first = next((e for e in asides if e.get("id") == "fn0"), None)
    text = inner(_span(first)).strip() if first is not None else ""
    if not text.startswith("=") or not text[1:].strip():
        return None, bool(asides)
    parents = _parents(root)
    node = first
    while node in parents:
        parent = parents[node]
        _swap(parent, node, [])
        if parent is root or len(parent) or (parent.text or "").strip():
            break
        node = parent
    return text[1:].strip(), len(asides) > 1


def rewritten(html: str | None) -> tuple[str | None, str | None, str | None, bool]:
    """The standardised markup, that without the aside that continues an earlier note, what this says, and whether a note is left; the page is parsed once."""
    # A page without a block of notes, a rule or a footnote has nothing to rewrite.
    root = fragment(html) if html is not None and re.search("hamesh|<hr|footnote", html) else None
    if root is None:
        return html, None, None, False
    new = inner(root) if _standardise(root) else html
    text, left = _without_continuation(root)
    return new, None if text is None else inner(root), text, left


def with_continuation(html: str, more: str) -> str:
    """The markup with ``more`` behind its last footnote."""
    root = fragment(html)
    asides = [e for e in _footnotes(root) if _span(e) is not None] if root is not None else []
    return inner(root) if asides and append_lines(asides[-1], [more]) else html


def standardised_pages(pages: DataFrame) -> DataFrame:
    """Pages (book, page_no, html) with rewritten ``html``, and ``changed``; continuations go to the last note of the nearest earlier page that has one."""
    key = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select("book", "page_no").schema)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("html").to_pylist()
            done = [rewritten(x) for x in old]
            columns = [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("book"), batch.column("page_no"), batch.column("html"), *columns], names=["book", "page_no", "html", "new", "rest", "continuation", "has_note"])

    rows = pages.select("book", "page_no", "html").mapInArrow(rewrite, f"{key}, html string, new string, rest string, continuation string, has_note boolean")
    moved = footnotes.carried(rows.select("book", "page_no", "html", "new", "rest", "continuation", "has_note"))
    base = moved.select("book", "page_no", "html", F.when(F.col("moved"), F.col("rest")).otherwise(F.col("new")).alias("new"), "more")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, new, more = (batch.column(c).to_pylist() for c in ("html", "new", "more"))
            done = [x if m is None or x is None else with_continuation(x, m) for x, m in zip(new, more, strict=True)]
            changed = [a != b for a, b in zip(old, done, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("book"), batch.column("page_no"), pa.array(done, pa.string()), pa.array(changed, pa.bool_())], names=["book", "page_no", "html", "changed"])

    return base.mapInArrow(join, f"{key}, html string, changed boolean")
