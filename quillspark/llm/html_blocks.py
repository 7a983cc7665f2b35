"""Leaf blocks of a DOM: one forgiving pass over the tags of a page, without a tree, in time linear in its length.

Quoted values may hold any character; once a tag's quotes never close, this and later tags end at their first `>`. What follows the last `>` of a page holds no tag. A block knows its NEAR nearest ancestors.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z][^>]*>""",
    re.S,
)
#: The same where quotes cannot be relied on.
PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>", re.S)
NEAR = 64
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose content is no markup, and elements whose content is not shown as text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
HIDDEN = {"head", "template", "svg", "math", "noscript", "select", "datalist", "object", "audio", "video", "canvas"}
#: Elements within a line: they neither begin nor end a block.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
    "u", "var", "wbr",
}
#: A start tag of the key ends an open element of these.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    path: tuple  # element features of the ancestors, the nearest last


def element(tag: str, attributes: str) -> tuple[str, ...]:
    """Features of an element: its tag and the words of its class, id and role; those of short tags are kept."""
    return _element(tag, attributes) if len(attributes) < 1000 else _element.__wrapped__(tag, attributes)


@lru_cache(maxsize=65536)
def _element(tag: str, attributes: str) -> tuple[str, ...]:
    found = {f"in:{tag}"}
    for name, *values in ATTRIBUTE.findall(attributes):
        for word in WORDS.findall("".join(values).lower()):
            found.add(f"{'role' if name.lower() == 'role' else 'name'}:{word}")
    return tuple(sorted(found))


def blocks(page: str | None) -> list[Block]:
    """The blocks with text, in page order."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, tuple]] = []
    hidden = 0
    parts: list[str] = []
    linked, in_link = 0, False
    at, end = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends behind it
    tail = page.find("<!--", last)  # but a comment may begin there
    seen = end if tail < 0 else tail
    pattern = TAG
    open_tags: Counter = Counter()

    def flush():
        nonlocal linked, in_link
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(text, linked, tuple(x[1] for x in stack[-NEAR:])))
        linked, in_link = 0, False

    def pop():
        nonlocal hidden
        name = stack.pop()[0]
        open_tags[name] -= 1
        hidden -= name in HIDDEN

    while at < end:
        m = pattern.search(page, at, last) if at < last else None
        stop = m.start() if m else seen
        if stop > at and not hidden:
            piece = page[at:stop]
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start() + 1].isalpha():  # quotes that never close
                pattern, at = PLAIN, m.start()
            elif page.startswith("<!--", m.start()) and not m[0].endswith("-->"):
                break
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not m[1]
            elif tag == "br" and not hidden:
                parts.append(" ")
            continue
        if m[1]:
            flush()
            if open_tags[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        flush()
        if tag in RAW:
            closing = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at, last)
            at = closing.end() if closing else end
            continue
        if stack and stack[-1][0] == "p":
            pop()
        closes = ENDS.get(tag)
        while closes and stack and stack[-1][0] in closes:
            pop()
        if tag in VOID or m[3].endswith("/") and tag not in ("p", "div", "li"):
            continue
        stack.append((tag, element(tag, m[3])))
        open_tags[tag] += 1
        hidden += tag in HIDDEN
    flush()
    return out
