"""Cutting a web page into text blocks with their tag paths."""

from __future__ import annotations

import html
import re
from functools import cache
from typing import NamedTuple

#: Elements whose content is not text of the page.
OPAQUE = {"script", "style", "template", "noscript", "iframe", "object", "svg", "math", "canvas", "audio", "video", "noframes", "xmp"}
#: Those of them that last to the end of the page where no end tag follows.
RAW = {"script", "style", "iframe", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "br", "embed", "input", "picture", "source", "svg", "math"}
#: Start tags that end an open element of a kind, and where the search for it stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)), "body": (("head",), ("html",)),
}

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]{2,}")


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?:[\s/][^>]*)?(?:>|\Z)", re.I)


class Element(NamedTuple):
    tag: str
    names: tuple[str, ...]


class Block(NamedTuple):
    text: str
    path: tuple[Element, ...]
    linked: int


def blocks(page: str | None) -> list[Block]:
    """The blocks of a whole page in order: text between the tags of block elements, with the elements open around
    it, inline ones within the block left out, and its characters inside links.

    Character references are decoded and runs of white space made one
    blank. Tags that HTML lets be left out are supplied, stray end tags are
    passed over, and what is still open at the end is closed. Null: none.
    """
    out: list[Block] = []
    if not page:
        return out
    stack: list[Element] = []
    parts: list[str] = []
    linked = links = at = 0
    path: tuple[Element, ...] = ()

    def flush():
        nonlocal parts, linked
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(text, path, min(linked, len(text))))
            parts, linked = [], 0

    def say(raw: str):
        nonlocal linked, path
        if not raw or not parts and raw.isspace():
            return
        text = html.unescape(raw) if "&" in raw else raw
        if not parts:
            k = len(stack)
            while k and stack[k - 1].tag in INLINE:
                k -= 1
            path = tuple(stack[:k])
        parts.append(text)
        if links:
            linked += len(text.strip())

    def pop_to(k: int):
        nonlocal links
        for e in stack[k:]:
            links -= e.tag == "a"
        del stack[k:]

    endless: set[str] = set()
    while m := _MARKUP.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag == "br":
            say(" ") if not parts else parts.append(" ")
            continue
        block = tag not in INLINE
        if block:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if not block and stack[k].tag not in INLINE:  # an inline end tag closes nothing beyond its block
                    break
            continue
        if block:
            over, until = ENDS.get(tag, ((), ()))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p" or stack[k].tag in over:
                    pop_to(k)
                    if stack and tag in ENDS:
                        continue
                    break
                if stack[k].tag in until or stack[k].tag not in INLINE and tag not in ENDS:
                    break
        if tag in VOID or attributes.endswith("/") and not block:
            continue
        if tag in OPAQUE:
            end = None if tag in endless else _end_of(tag).search(page, at)
            if end:
                at = end.end()
            elif tag in RAW:
                at = len(page)
                break
            else:  # never closed: only the tag itself is passed over
                endless.add(tag)
            continue
        names = tuple(x for g in _NAMES.findall(attributes) for x in _WORDS.findall(" ".join(g).lower())) if attributes else ()
        stack.append(Element(tag, names))
        links += tag == "a"
    say(page[at:])
    flush()
    return out
