"""Small helper: a page as a tree and the few selector forms that the card rules use."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_STEP = re.compile(r"(\*|[a-z][\w-]*)?((?:\.[\w-]+|#[\w-]+|\[[\w-]+(?:[*^]?=\"[^\"]*\")?\])*)")
_TEST = re.compile(r"\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^]?)=\"([^\"]*)\")?\]")


#: Start tags that end an open element, as HTML lets authors leave out end tags: the names that end, and the names that
#: shield an outer list, table or the like.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "option": ({"option"}, {"select"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
_PARAGRAPH = ({"p"}, {"button", "td", "th", "table", "li"})
_BLOCKS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section "
    "table ul".split()
)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def parts(self):
        """Everything below in page order, without recursion: nothing limits how deep a page nests."""
        waiting = self.children[::-1]
        while waiting:
            part = waiting.pop()
            yield part
            if isinstance(part, Node):
                waiting += part.children[::-1]

    def walk(self):
        return (part for part in self.parts() if isinstance(part, Node))

    def text(self) -> str:
        strings = (part.strip() for part in self.parts() if isinstance(part, str))
        return " ".join(s for s in strings if s)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {}, None)
        self.opened = Counter()

    def _close(self, node):
        """Close everything up to and with this open node."""
        while self.open is not node.parent:
            self.opened[self.open.tag] -= 1
            self.open = self.open.parent

    def _end(self, names, shields):
        if not any(self.opened[n] for n in names):
            return
        node = self.open
        while node.parent is not None and node.tag not in shields:
            if node.tag in names:
                return self._close(node)
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._end(*_PARAGRAPH)
        if tag in _ENDS:
            self._end(*_ENDS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node
            self.opened[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.open.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.open))

    def handle_endtag(self, tag):
        if not self.opened[tag]:
            return
        node = self.open
        while node.tag != tag:
            node = node.parent
        self._close(node)

    def handle_data(self, data):
        if self.open.tag not in ("script", "style"):
            self.open.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


@lru_cache(maxsize=4096)
def _tests(step: str) -> tuple[str | None, list[tuple]]:
    """The name a step asks for, if any, and its tests; rules use the same few steps on every page."""
    tag, tests = _STEP.fullmatch(step).groups()
    return (tag if tag != "*" else None), _TEST.findall(tests)


def _fits(node: Node, step: str) -> bool:
    tag, tests = _tests(step)
    if tag and node.tag != tag:
        return False
    for cls, ident, attr, op, value in tests:
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if attr:
            have = node.attrs.get(attr)
            if have is None:
                return False
            if (op == "*" and value not in have) or (op == "^" and not have.startswith(value)):
                return False
            if not op and value and have != value:
                return False
    return True


@lru_cache(maxsize=4096)
def steps(selector: str) -> tuple[str, ...]:
    """Split at blanks outside of brackets."""
    return tuple(re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", selector))


def matches(root: Node, selector: str) -> Iterator[Node]:
    """Nodes below ``root`` that fit the last step and have ancestors for the steps before it, in page order."""
    *above, last = steps(selector)
    for node in root.walk():
        if not _fits(node, last):
            continue
        up, rest = node.parent, list(above)
        while rest and up is not None:
            if up.tag and _fits(up, rest[-1]):
                rest.pop()
            up = up.parent
        if not rest:
            yield node


def select(root: Node, selector: str) -> list[Node]:
    return list(matches(root, selector))


def first_text(root: Node, selectors) -> str:
    for selector in selectors:
        node = next(matches(root, selector), None)
        if node is not None:
            text = re.sub(r"\s+", " ", node.text()).strip()
            if text:
                return text
    return ""
