"""64-bit hashes of words and of runs of words, in numpy over the bytes of many texts at once.

A run's hash is a polynomial in its words' (or a word's in its bytes') numbers modulo 2**64, from differences of prefix
sums, followed by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

BYTE, RUN, RUN2 = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F | 1
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


FIRST, SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BY_30, BY_27, BY_31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> BY_30)
    x *= FIRST
    x ^= x >> BY_27
    x *= SECOND
    x ^= x >> BY_31
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i up to n, modulo 2**64."""
    found = _POWERS.get(base)
    if found is None or len(found[0]) <= n:
        size = 1 << max(16, n.bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        found = _POWERS[base] = (both[0], both[1])
    return found


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Mixed polynomial hash of values[starts[i]:ends[i]] for each i."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(words: np.ndarray, k: int, base: int = RUN) -> np.ndarray:
    """Hash of each k consecutive words."""
    at = np.arange(max(0, len(words) - k + 1))
    return ranges(words, at, at + k, base)


def word_hashes(texts: Sequence[str | None], lower: bool = False, chunk: int = 1 << 19) -> Iterator[np.ndarray]:
    """For each text the hashes of its words (runs of other bytes than blanks); lower: A-Z count as a-z."""
    for hashes, ends in word_chunks(texts, lower, chunk):
        yield from np.split(hashes, ends[:-1])


def word_chunks(texts: Sequence[str | None], lower: bool = False, chunk: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """word_hashes of several texts in a row, and where each text's words end."""
    lo = 0
    while lo < len(texts):
        raw: list[bytes] = []
        size = 0
        while lo < len(texts) and (size < chunk or not raw):
            raw.append((texts[lo] or "").encode("utf-8", "surrogatepass"))
            size += len(raw[-1]) + 1
            lo += 1
        data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
        data = LOWER[data] if lower else data
        blank = BLANK[data]
        step = np.diff(blank.astype(np.int8), prepend=1)
        starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        hashes = ranges(data.astype(np.uint64) + np.uint64(1), starts, ends[: len(starts)], BYTE)
        bounds = np.cumsum([len(r) + 1 for r in raw])
        yield hashes, np.searchsorted(starts, bounds)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
