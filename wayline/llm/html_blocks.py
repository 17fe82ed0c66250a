"""A page as a sequence of leaf blocks (small helpers that run inside tasks).

A block is the text between two block-level tags, with the path of open elements above it. Elements that a
browser closes by itself (a paragraph before the next, list items, cells) are closed here too. Broken markup
gives whatever blocks it gives: no page fails. Time is in proportion to a page's length, however deep, unclosed or
unquoted its elements are: open elements are counted by name, and a path has the innermost DEEPEST of them.
"""

from __future__ import annotations

import html
import re
from collections import Counter

# a tag ends at the first > that isn't in a quoted value; a quote that is never closed is an ordinary sign
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+(?:>|\Z)|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
# fixed values: HTML's element classes
RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "dfn", "em", "font", "i", "img", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "ins", "del", "acronym"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"ul", "ol", "dl", "table", "select", "body", "div", "article", "section", "main", "td", "th"}


SCANNED = set().union(*CLOSES.values()) | BOUNDS
DEEPEST = 48


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters inside links) of each block that has text, in page order.

    A path entry is an element's name and its class, id and role words. Character references are decoded;
    white space inside a block becomes one space. Raw elements (scripts, styles and so on) have no blocks.
    """
    found: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[str] = []  # names of open elements
    outer: list[str] = []  # entries of those that aren't inline
    scanned: list[str] = []  # names of those that end or bound others
    opened: Counter = Counter()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            found.append((tuple(outer[-DEEPEST:]), text, linked))
        parts, linked = [], 0

    def close(name: str) -> None:
        top = ""
        while top != name:
            top = stack.pop()
            opened[top] -= 1
            if top not in INLINE:
                outer.pop()
            if top in SCANNED:
                scanned.pop()

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        token, at = m[0], m.end()
        if token[0] != "<" or token == "<":
            parts.append(token)
            linked += len(token) if opened["a"] else 0
            continue
        named = NAME.match(token)
        if not named:
            continue
        name = named[1].lower()
        ending = token[1] == "/"
        if name in RAW and not ending:
            if token.endswith("/>") and name in ("svg", "iframe", "object"):
                continue
            after = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = after.end() if after else end
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            parts.append(" ")
        if ending:
            if opened[name]:
                close(name)
            continue
        if name not in INLINE and opened["p"]:
            close("p")
        if name in CLOSES:
            inner = next((n for n in reversed(scanned) if n in CLOSES[name] or n in BOUNDS), "")
            if inner in CLOSES[name]:
                close(inner)
        if name not in VOID and not token.endswith("/>"):
            words = " ".join(a or b or c for a, b, c in MARK.findall(token)).lower()
            stack.append(name)
            opened[name] += 1
            if name not in INLINE:
                outer.append(f"{name} {words}" if words else name)
            if name in SCANNED:
                scanned.append(name)
    flush()
    return found
