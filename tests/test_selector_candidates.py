"""A selector that asks for what no element has tests none."""

from __future__ import annotations

from gleanery.functions import html

BODY = '<div class="card"></div><ul class="pagination"><li><a href="?page=2">2</a></li></ul><p>x</p>'


def test_selectors_without_candidates_test_nothing(monkeypatch):
    top, tested, fits = html.parse(BODY), [], html._fits
    monkeypatch.setattr(html, "_fits", lambda node, tests: tested.append(node) or fits(node, tests))
    assert not top.find("nav[class*='pagination'] a[href]") and not top.find("a[rel='next']") and not tested
    assert [n.attrs["href"] for n in top.find("ul[class*='pagination'] a[href]")] == ["?page=2"] and tested
