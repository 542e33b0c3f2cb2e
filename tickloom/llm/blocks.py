"""Leaf blocks of an HTML page: text between block-level tags, with the tags around it."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TAG = re.compile(
    r"<(?:!--(?:.*?-->|.*)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[!?/][^>]*+>|[!?/a-zA-Z][^>]*+\Z)", re.S
)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_LINK = frozenset(["a"])

#: Elements of the format.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
UNSEEN = frozenset("script style noscript template title textarea select svg iframe button".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: What a start tag ends if it is still open, and the element the search for it stops at.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd", ("dl",)), "dt": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("td", ("tr", "table"))}


@dataclass(slots=True)
class Block:
    """Text with single spaces, distinct tokens of the elements around it (outermost first), characters in links."""

    text: str
    path: tuple[str, ...]
    linked: int


def _token(name: str, attributes: str) -> tuple[str, ...]:
    if not attributes or "=" not in attributes:
        return (name,)
    names = [w.lower() for m in _NAMED.finditer(attributes) for w in re.split(r"[\s_-]+", m[1] or m[2] or m[3] or "") if w]
    return (name, *(f".{w}" for w in dict.fromkeys(names)))


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order. Scripts, styles, comments, titles and controls have none; a tag that the end of the
    page cuts off is dropped; unclosed paragraphs, items and cells end where the next one starts."""
    out: list[Block] = []
    open_tags: list[str] = []
    paths: list[tuple[str, ...]] = [()]
    held: list[str] = []
    linked = links = 0
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, paths[-1], linked))
            held.clear()
        linked = 0

    def close(i: int) -> None:
        nonlocal links
        links -= open_tags[i:].count("a")
        del open_tags[i:], paths[i + 1 :]

    def last(names: tuple[str, ...], stops: frozenset | tuple = ()) -> int:
        for i in range(len(open_tags) - 1, -1, -1):
            if open_tags[i] in names:
                return i
            if open_tags[i] in stops:
                return -1
        return -1

    inner = BREAKS - {"p"}
    while at < size:
        m = _TAG.search(page, at)
        if m is None or m.start() > at:
            piece = page[at : m.start() if m else size]
            if "&" in piece:
                piece = html.unescape(piece)
            held.append(piece)
            if links:
                linked += len(piece)
        if m is None:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BREAKS:
                flush()
            if (i := last((name,))) >= 0:
                if name not in BREAKS and any(t in BREAKS for t in open_tags[i:]):
                    continue  # an inline end tag does not end blocks
                close(i)
            continue
        if name in UNSEEN:
            if not (m[3] or m[6] or "").endswith("/") or name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                if name in RAW:
                    at = end.end() if end else size
                    continue
                # without its own end it ends with the element around it, or hides nothing if that is not closed either
                around = open_tags[-1] if open_tags else None
                shut = re.compile(rf"</{re.escape(around)}\b[^>]*>", re.I).search(page, at, end.start() if end else size) if around else None
                if shut:
                    at = shut.start()
                elif end:
                    at = end.end()
            continue
        if name in BREAKS:
            flush()
            if (i := last(("p",), inner)) >= 0:
                close(i)
            if name in CLOSES:
                what, stops = CLOSES[name]
                if (i := last(tuple({what, name, *(("dt",) if what == "dd" else ("th",) if what == "td" else ())}), stops)) >= 0:
                    close(i)
        if name in VOID:
            continue
        open_tags.append(name)
        links += name == "a"
        above = paths[-1]
        new = tuple(t for t in _token(name, m[3] or m[6] or "") if t not in above)
        paths.append(above + new if new else above)
    flush()
    return out
