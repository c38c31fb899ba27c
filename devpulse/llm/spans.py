"""Ranges of words in a text."""

from __future__ import annotations

import re
from collections.abc import Iterable

Span = tuple[int, int]


def united(spans: Iterable[Span]) -> list[Span]:
    """Ranges in order, those that overlap or touch made one."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: Iterable[Span], word: re.Pattern[str]) -> str:
    """The text without the words [start, end) of each span and what stands between those."""
    at = [m.span() for m in word.finditer(text)]
    out, kept_to = [], 0
    for a, b in spans:
        out.append(text[kept_to : at[a][0]])
        kept_to = at[b - 1][1]
    return "".join(out) + text[kept_to:]
