"""Spans (kind, start, end) in code points, end exclusive, and their text form."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Sequence
from itertools import accumulate

Span = tuple[str, int, int]


def ordered(spans: Iterable[Span], kinds: Sequence[str]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def as_text(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def free_of(new: Iterable[Span], old: Iterable[Span]) -> list[Span]:
    """Those of new that overlap none of old and none kept before them. n log n steps."""
    by_start = sorted((a, b) for _, a, b in old)
    starts, reach = [a for a, _ in by_start], [0, *accumulate((b for _, b in by_start), max)]
    kept: list[Span] = []
    end = 0
    for s in sorted(new, key=lambda s: (s[1], -s[2])):
        if s[1] >= end and reach[bisect_left(starts, s[2])] <= s[1]:
            kept.append(s)
            end = s[2]
    return kept
