"""A small HTML tree and CSS subset for the page functions: what templates use and the standard library can parse.

Selectors: tag, ``*``, ``#id``, ``.class``, ``[attr]``, ``[attr op 'value']`` with = *= ^= $=, ``:contains('...')``,
descendant and ``>`` combinators, comma lists. A blank selector selects nothing. Text is concatenated without spaces.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

# Fixed values of HTML: elements without content, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_STEP = re.compile(r"""([>\s]*)((?:[\w*-]+|\#[\w-]+|\.[\w-]+|\[[^\]]*\]|:contains\((?:'[^']*'|"[^"]*")\))+)""")
_SIMPLE = re.compile(r"""([\w*-]+)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w:@.-]+)\s*(?:([*^$]?=)\s*(?:'([^']*)'|"([^"]*)"|([^\]\s]+))\s*)?\]|:contains\((?:'([^']*)'|"([^"]*)")\)""")


class Node:
    """An element. ``order`` is its place among all elements of its tree, ``end`` that behind its last descendant; ``tree``
    is shared by all elements of a page."""

    __slots__ = ("attrs", "children", "end", "order", "parent", "tag", "tree")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.tree = parent.tree if parent is not None else Tree()
        self.order = len(self.tree.nodes)
        self.end = self.order + 1
        self.tree.add(self)

    def walk(self):
        """Elements below, in document order."""
        return iter(self.tree.nodes[self.order + 1 : self.end])

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(out)

    def attr(self, name: str) -> str:
        return self.attrs.get(name, "").strip()

    def _below(self, chain: tuple) -> list[Node]:
        """Elements below that match a chain: only those with the tag or the attribute that its last step asks for and that
        fewest have are tested, and none where a step asks for one that no element has."""
        having = self.tree.having
        for step in chain:
            if not (found := having(step[2])):
                return []
        return [n for n in found if self.order < n.order < self.end and _matches(n, chain, self)]

    def find(self, selector: str) -> list[Node]:
        chains = compiled(selector)
        if len(chains) == 1:
            return self._below(chains[0])
        return [n for _, n in sorted({n.order: n for chain in chains for n in self._below(chain)}.items())]

    def first(self, selector: str) -> Node | None:
        return next(iter(self.find(selector)), None)

    def first_text(self, selector: str) -> str:
        return n.text() if (n := self.first(selector)) else ""

    def first_attr(self, selector: str, name: str) -> str:
        return n.attr(name) if (n := self.first(selector)) else ""


class Tree:
    """All elements of a page in document order, and those by tag and by attribute."""

    __slots__ = ("by_attr", "by_tag", "nodes")

    def __init__(self):
        self.nodes, self.by_tag, self.by_attr = [], {}, {}

    def add(self, node: Node) -> None:
        self.nodes.append(node)
        self.by_tag.setdefault(node.tag, []).append(node)
        for name in node.attrs:
            self.by_attr.setdefault(name, []).append(node)

    def having(self, asked: tuple) -> list[Node]:
        """The elements that can pass the tests of one step: those of its rarest tag or attribute."""
        found = self.nodes
        for by_tag, name in asked:
            having = (self.by_tag if by_tag else self.by_attr).get(name)
            if having is None:
                return []
            if len(having) < len(found):
                found = having
        return found

    def close(self) -> None:
        """Ends of the elements, which were added before their descendants."""
        for node in reversed(self.nodes[1:]):
            node.parent.end = max(node.parent.end, node.end)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        closes = CLOSES.get(tag, frozenset()) | ({"p"} if tag in ENDS_P else frozenset())
        while self.at.tag in closes:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    builder.root.tree.close()
    return builder.root


@lru_cache(maxsize=4096)
def compiled(selector: str) -> tuple:
    """Chains of (combinator, tests, tags and attributes that they ask for); an alternative that is not understood selects nothing."""
    chains = []
    for alternative in re.split(r",(?![^\[(]*[\])])", selector or ""):
        alternative, chain, at = alternative.strip(), [], 0
        while at < len(alternative) and (m := _STEP.match(alternative, at)):
            tests = _tests(m[2])
            asked = tuple(dict.fromkeys((kind == "tag", name) for kind, name, *_ in tests if kind != "text"))
            chain.append((">" if ">" in m[1] else " ", tests, asked))
            at = m.end()
        if chain and at == len(alternative):
            chains.append(tuple(chain))
    return tuple(chains)


def _tests(step: str) -> tuple[tuple[str, str, str, str], ...]:
    """(kind, name, operator, value) of each simple selector of a step; the kind is tag, class, attr or text, an id is an attribute."""
    out = []
    for tag, ident, cls, attr, op, v1, v2, v3, has1, has2 in (t.groups() for t in _SIMPLE.finditer(step)):
        if tag is not None:
            out += [("tag", tag.lower(), "", "")] if tag != "*" else []
        elif attr is not None:
            out.append(("attr", attr.lower(), op or "", next((v for v in (v1, v2, v3) if v is not None), "")))
        elif ident is not None:
            out.append(("attr", "id", "=", ident))
        elif cls is not None:
            out.append(("class", "class", "", cls))
        else:
            out.append(("text", "", "", has1 if has1 is not None else has2))
    return tuple(out)


def _fits(node: Node, tests: tuple) -> bool:
    for kind, name, op, want in tests:
        if kind == "tag":
            if node.tag != name:
                return False
        elif kind == "text":
            if want not in node.text():
                return False
        else:
            have = node.attrs.get(name)
            if have is None:
                return False
            if kind == "class":
                if want not in have.split():
                    return False
            elif op and not (have == want if op == "=" else bool(want) and (want in have if op == "*=" else have.startswith(want) if op == "^=" else have.endswith(want))):
                return False
    return True


def _matches(node: Node, chain: tuple, top: Node) -> bool:
    if not _fits(node, chain[-1][1]):
        return False
    if len(chain) == 1:
        return True
    up = node.parent
    while up is not None:
        if _matches(up, chain[:-1], top):
            return True
        if chain[-1][0] == ">":
            return False
        up = up.parent
    return False
