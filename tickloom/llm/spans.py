"""Leftmost non-overlapping findings of the personal-data and secret kinds, in linear time on any text.

Every function yields (start, end) in code points, end exclusive. Patterns whose plain form would retry at each place of
a long run are anchored to the start of the run, which finds the same matches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

Span = tuple[int, int]

#: The formats of the kinds.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")


def emails(text: str) -> Iterator[Span]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            end = free = m.end()
            yield start, end
        at = text.find("@", end)


def octets_ok(parts: Iterable[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:] or 0) <= 255 for p in parts)


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def ips(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        if octets_ok(m.groups()):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn_ok(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def assigns(text: str) -> Iterator[Span]:
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            yield m.span()


def accesses(text: str) -> Iterator[Span]:
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 20:
            yield m.span()


def hexes(text: str) -> Iterator[Span]:
    for m in HEX.finditer(text):
        yield m.span()


PERSONAL = {"email": emails, "ip": ips, "card": cards, "phone": phones}
SECRET = {"assign": assigns, "access": accesses, "hex": hexes}


def listed(found: Iterable[tuple[str, int, int]], kinds: list[str]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (x[1], rank[x[0]], x[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
