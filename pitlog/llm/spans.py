"""Spans of code points in a text, and the digest form queries return them in."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

# kind, start, end (exclusive)
Span = tuple[str, int, int]


def line(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def without_overlaps(spans: Iterable[Span]) -> list[Span]:
    """Spans by start; one that overlaps an earlier kept one is merged into it."""
    out: list[Span] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if out and start < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(end, out[-1][2]))
        else:
            out.append((kind, start, end))
    return out


def replaced(text: str, spans: Iterable[Span]) -> str:
    """``text`` with each span replaced by its kind in angle brackets."""
    parts, last = [], 0
    for kind, start, end in without_overlaps(spans):
        parts += [text[last:start], f"<{kind.upper()}>"]
        last = end
    return "".join([*parts, text[last:]])
