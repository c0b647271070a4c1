"""Pages of one body are parsed once."""

from __future__ import annotations

import pandas as pd

from gleanery.functions import html
from gleanery.operators import page_links

BODY = '<div class="card"></div><ul class="pagination"><li><a href="?page=2">2</a></li></ul><p>{}</p>'


def test_pages_of_one_body_are_parsed_once(monkeypatch):
    parsed, parse = [], html.parse
    monkeypatch.setattr(html, "parse", lambda page: parsed.append(page) or parse(page))
    bodies = [BODY.format("once"), BODY.format("long" * 10_000), BODY.format("once"), BODY.format("long" * 10_000), None]
    pages = pd.DataFrame({"url": [f"https://a.example/{i}" for i in range(5)], "html": bodies})
    run = page_links._features({"cardSelector": ".card", "pagination": {"maxPages": 3}})
    first, again = (next(iter(run(iter([pages])))) for _ in range(2))
    assert parsed.count(bodies[0]) == 1 and parsed.count(bodies[1]) == 4  # long ones are not kept
    assert first.to_dict("list") | {"cards": None} == again.to_dict("list") | {"cards": None} and list(first["url"]) == list(pages["url"])
    assert list(first["cards"]) == [1, 1, 1, 1, 0] and first["hrefs"][0] == ["?page=2"] * 3 and first["html"][2] == bodies[0]
