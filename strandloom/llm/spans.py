"""Spans of code points in whole texts, and their digests."""

from __future__ import annotations

import hashlib


def joined(spans: list[tuple[str, int, int]], kinds: tuple) -> str:
    """kind:start:end of each span, by start and then by the order of kinds, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def outside(spans: list[tuple[str, int, int]], places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The places, given by start, that meet none of the spans: one pass over both."""
    out, taken, i, reach = [], sorted((s, e) for _, s, e in spans), 0, 0
    for start, end in places:
        # reach: the largest end of the spans that start before this place ends; places by start need no step back.
        while i < len(taken) and taken[i][0] < end:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= start:
            out.append((start, end))
    return out
