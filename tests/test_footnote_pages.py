"""Footnotes in whole pages: what is linked, what joins what, and that a second run changes nothing."""

from __future__ import annotations

import re

import pytest

from foliant.operators import footnote_pages as N
from foliant.sources import markup


def notes_of(html):
    return dict(re.findall(r'<aside id="fn(\d+)" epub:type="footnote">(?:<a [^>]*>[^<]*</a>)?<span(?: />|>(.*?)</span>)</aside>', html, flags=re.S))


BLOCKS = {
    "linked": ('<div><p>متن (١)</p><hr /><p class="hamesh">(١) هامش</p></div>', {"1": " هامش"}),
    "square": ('<p>a [١] b</p><p class="x hamesh">[١] n</p>', {"1": " n"}),
    "by number": ('<p>x (٨٠) y (١)</p><p class="hamesh">(١) n</p>', {"1": " n"}),
    "plain": ('<p>x (١) y (٢)</p><p class="hamesh">١ - n<br />٢ - m</p>', {"1": " n", "2": " m"}),
    "sub-lines": ('<p>x (^١) y (^٢)</p><p class="hamesh">(^١) n<br />١ - s<br/>٢ - t<br />(^٢) m</p>', {"1": " n<br />١ - s<br />٢ - t", "2": " m"}),
    "left over": ('<p>x (1)</p><p class="hamesh">(1) n<br />(2) m</p>', {"1": "n<br />(2) m"}),
    "left over, plain": ('<p>x (1)</p><p class="hamesh">1 - n<br />2 - m</p>', {"1": "n<br />2 - m"}),
    "continued": ('<p>x (1)</p><p class="hamesh">= more<br />of it<br />(1) n</p>', {"0": "= more<br />of it", "1": " n"}),
    "continued, none linked": ('<p>x</p><p class="hamesh">= more<br />1 - a<br />2 - b</p>', {"0": "= more<br />1 - a<br />2 - b"}),
    "verse": ("<p>﴿x (1)﴾ y (1)</p><p class='hamesh'>(1) n</p>", {"1": " n"}),
    "two blocks": ('<p>a (1) b (1)</p><p class="hamesh">(1) n</p><p>c</p><p class="hamesh">(1) m</p>', {"1": " n", "2": " m"}),
    "empty note": ('<p>a (1)</p><p class="hamesh">(1)</p>', {"1": ""}),
    "markup in a note": ('<p>a <b>(1)</b></p><p class="hamesh">(1) <i>n &amp; m</i></p>', {"1": " <i>n &amp; m</i>"}),
}


@pytest.mark.parametrize("name", BLOCKS)
def test_notes_in_blocks(name):
    html, expected = BLOCKS[name]
    out = N.standardised(html)
    assert notes_of(out) == expected and 'class="hamesh"' in out and 'p class="' not in out.replace('p class="x"', "")
    for k in expected:
        if k != "0":
            assert f'href="#fn{k}" epub:type="noteref" role="doc-noteref" id="fnref{k}" class="fn nu">' in out
    assert N.standardised(out) == out


def test_the_better_reference_is_linked():
    out = N.standardised("<p>﴿x (1)﴾ y (1)</p><p class='hamesh'>(1) n</p>")
    assert "﴿x (1)﴾ y <a " in out
    out = N.standardised("<p>x (1) y [1] z (^1) </p><p class='hamesh'>(^1) n</p>")
    assert "x (1) y [1] z <a " in out
    only = N.standardised("<p>﴿x (1)﴾</p><p class='hamesh'>(1) n</p>")
    assert "﴿x <a " in only and ">(1)</a>﴾" in only


@pytest.mark.parametrize("html", ["", "plain", "<p>no notes (1)</p>", '<p>x (1)</p><p class="hamesh">no number</p>', '<p>x</p><p class="hamesh">(1) n</p>', "<p>broken", '<p>&nbsp;(1)</p><p class="hamesh">(1) n</p>'])
def test_pages_that_stay(html):
    assert N.standardised(html) == html


RULED = '<p>a<span><sup>(1)</sup></span>.</p><hr class="c"/><p><span class="t">(1)</span> n.</p>'


def test_notes_after_rules():
    out = N.standardised(RULED + "<p>title</p><hr/>" + RULED.replace("n.", "m."))
    assert notes_of(out) == {"1": " n.", "2": " m."} and out.count("(1)") == 4 and '<span class="t">' not in out
    assert N.standardised(out) == out


def test_continuations_after_rules():
    begun = RULED.replace("n.", "n =")
    out = N.standardised(begun + '<hr/><p>= more.</p><p><span class="t">(1)</span> not linked.</p>')
    assert notes_of(out) == {"1": "n =<br />more."} and "not linked" in out and "<p>= more.</p>" not in out
    out = N.standardised(begun + "<p>title</p><hr/><p>text</p><p><span></span></p><hr/><p>= more.</p>")
    assert notes_of(out) == {"1": "n =<br />more."}
    kept = N.standardised(RULED + '<p>gap</p><hr/><p><span class="t">(1)</span> loose =</p><hr/><p>= stays.</p>')
    assert notes_of(kept) == {"1": " n."} and "<p>= stays.</p>" in kept


def test_pages_of_a_book(spark):
    note = '<div><p>x (1)</p><hr /><p class="hamesh">(1) first</p></div>'
    pages = [
        ("a", 1, note), ("a", 2, '<div><p>y</p><hr /><p class="hamesh">=more<br />of it</p></div>'), ("b", 1, '<div><p>y</p><p class="hamesh">=alone</p></div>'), ("b", 2, '<div><p>z</p><p class="hamesh">=and on</p></div>'),
        ("c", 1, note), ("c", 2, "<div><p>. . .</p></div>"), ("c", 3, '<div><p>z (1)</p><p class="hamesh">= late<br />(1) own</p></div>'), ("c", 4, '<div><p class="hamesh">= later</p></div>'), ("d", 1, None), ("d", 2, "<p>broken"),
    ]
    out = {(r.book, r.page_no): r for r in N.standardised_pages(spark.createDataFrame(pages, "book STRING, page_no INT, html STRING").repartition(3)).collect()}
    assert len(out) == len(pages)
    assert notes_of(out["a", 1].html) == {"1": "first<br />more<br />of it"} and notes_of(out["a", 2].html) == {} and "<div><p>y</p><hr /></div>" == out["a", 2].html
    assert notes_of(out["b", 1].html) == {"0": "=alone<br />and on"} and notes_of(out["b", 2].html) == {}
    assert notes_of(out["c", 1].html) == {"1": "first<br />late"} and notes_of(out["c", 3].html) == {"1": "own<br />later"} and not out["c", 2].changed
    assert out["d", 1].html is None and out["d", 2].html == "<p>broken" and not out["d", 1].changed
    again = N.standardised_pages(spark.createDataFrame([(b, p, r.html) for (b, p), r in out.items()], "book STRING, page_no INT, html STRING"))
    assert not [r for r in again.collect() if r.changed and r.book != "b"]


def test_markup():
    page = markup.tree(f'<?xml version="1.0"?><html xmlns="{markup.XHTML}" xmlns:epub="{markup.EPUB}" xmlns:z="urn:z"><body epub:type="x" z:a="1">a &lt; b<br/><!--c--><i xml:lang="de">d</i> e</body></html>')
    body = markup.body_of(page)
    assert markup.inner(body) == 'a &lt; b<br /><!--c--><i xml:lang="de">d</i> e'
    assert markup.set_inner(body, '<p epub:type="y">z</p>t') and markup.inner(body) == '<p epub:type="y">z</p>t' and not markup.set_inner(body, "<p>")
    whole = markup.document(page, True)
    assert whole.startswith("<?xml") and markup.inner(markup.body_of(markup.tree(whole))) == '<p epub:type="y">z</p>t'
    assert markup.tree('<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>') is None and markup.tree(b"<a") is None and markup.tree(None) is None
    assert markup.tree("<?xml version='1.0' encoding='utf-8'?>\n<!DOCTYPE html>\n<a/>").tag == "a"
