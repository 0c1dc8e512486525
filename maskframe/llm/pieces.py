"""Texts as pieces of bytes, cut in numpy over many texts at once, and a table of fixed size from pieces to token ids.

A piece is a run of letters, one digit, or a run of other marks. Words that a byte rule cannot judge (letters beyond
Latin-1, apostrophes, "<|") are one piece each. A piece of up to KEY bytes is an exact key of three 64-bit numbers (its
bytes and its length), so a lookup never confuses two pieces. The table has one place for each hash value: a new piece
takes the place of an older one, so the table's memory is fixed whatever the texts hold, and a piece that lost its place
is encoded again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Bytes of a piece that can be a key; ids of a piece that the table holds.
KEY, WIDTH = 23, 8
SLOTS_LOG2 = 19
BLANK, LETTER, DIGIT, OTHER = 0, 1, 2, 3

KIND = np.full(256, OTHER, dtype=np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = BLANK
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
KIND[128:] = LETTER  # the letters from U+00C0 to U+00FF; other words with such bytes are whole pieces
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
PAD = 32


class Pieces:
    """The pieces of a stretch of UTF-8 bytes: body (ASCII letters in lower case but in whole words), starts, ends, whole."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        """data: bytes of texts in a row, PAD zero bytes behind them; bounds: where texts begin."""
        n = len(data) - PAD
        raw = data[:n]
        kind = KIND[raw]
        blank = kind == BLANK
        cut = np.empty(n, dtype=bool)
        cut[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut |= kind == DIGIT
        cut[bounds[bounds < n]] = True
        self.body = LOWER[data]
        marked = self.unclear(raw)
        inside = None
        if len(marked):
            edge = np.empty(n, dtype=bool)
            edge[:1] = True
            np.not_equal(blank[1:], blank[:-1], out=edge[1:])
            edge[bounds[bounds < n]] = True
            at = np.flatnonzero(edge)
            word = np.unique(np.searchsorted(at, marked, side="right") - 1)
            step = np.zeros(n + 1, dtype=np.int8)
            lo, hi = at[word], np.append(at[1:], n)[word]
            np.add.at(step, lo, 1)
            np.add.at(step, hi, -1)
            inside = np.cumsum(step[:n], dtype=np.int8).astype(bool)
            cut &= ~inside | edge
            self.body[:n][inside] = raw[inside]
        every = np.flatnonzero(cut)
        live = ~blank[every]
        self.starts, self.ends = every[live], np.append(every[1:], n)[live]
        self.whole = inside[self.starts] if inside is not None else np.zeros(len(self.starts), dtype=bool)

    @staticmethod
    def unclear(raw: np.ndarray) -> np.ndarray:
        """Places of bytes whose words stay whole."""
        high = raw >= 0x80
        bad = raw == 0x27
        if high.any():
            lead = raw == 0xC3
            after = np.empty(len(raw), dtype=bool)
            after[:1] = False
            after[1:] = lead[:-1]
            after &= (raw != 0x97) & (raw != 0xB7)  # the marks U+00D7 and U+00F7
            bad |= high & ~lead & ~after
        both = raw[:-1] == 0x3C
        both &= raw[1:] == 0x7C
        bad[:-1] |= both
        return np.flatnonzero(bad)

    def text(self, i: int) -> str:
        return self.body[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "surrogatepass")

    def keys(self) -> np.ndarray:
        """(n, 3): bytes 0-7, 8-15, and 16-22 with the length on top. Only for pieces of up to KEY bytes."""
        size = np.minimum(self.ends - self.starts, KEY)
        eight = np.ndarray((len(self.body) - 7,), "<u8", self.body, strides=(1,))
        out = np.empty((len(size), 3), dtype=np.uint64)
        out[:, 0] = eight[self.starts] & MASKS[np.minimum(size, 8)]
        out[:, 1] = 0
        out[:, 2] = size.astype(np.uint64) << np.uint64(56)
        more = np.flatnonzero(size > 8)
        if len(more):
            s, k = self.starts[more], size[more]
            out[more, 1] = eight[s + 8] & MASKS[np.minimum(k - 8, 8)]
            out[more, 2] |= eight[s + 16] & MASKS[np.clip(k - 16, 0, 7)]
        return out


class IdTable:
    """Piece -> its ids. encode(simple pieces, whole words) gives the ids of each as lists."""

    def __init__(self, encode: Callable[[list[str], list[str]], tuple[list[list[int]], list[list[int]]]], dtype: str = "<u2") -> None:
        self.encode, self.dtype = encode, np.dtype(dtype)
        slots = 1 << SLOTS_LOG2
        self.key = np.zeros((slots, 3), dtype=np.uint64)
        self.ids = np.zeros((slots, WIDTH), dtype=self.dtype)
        self.count = np.zeros(slots, dtype=np.uint8)

    def flat(self, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each piece has."""
        n = len(p.starts)
        if not n:
            return np.empty(0, dtype=self.dtype), np.empty(0, dtype=np.int64)
        key = p.keys()
        slot = self.slots(key)
        long = p.ends - p.starts > KEY
        held = self.key[slot]
        hit = (held == key).all(axis=1) & ~long
        rows, count = self.ids[slot], self.count[slot].astype(np.int64)
        slow: dict[int, list[int]] = {}
        new = np.flatnonzero(~hit & ~long)
        if len(new):
            k = key[new]
            order = np.lexsort((k[:, 0], k[:, 1], k[:, 2]))
            first = np.append(True, (k[order[1:]] != k[order[:-1]]).any(axis=1))
            group = np.empty(len(new), dtype=np.int64)
            group[order] = np.cumsum(first) - 1
            one = new[order[first]]
            found = self.learn(p, one)
            size = np.array([len(x) for x in found], dtype=np.int64)
            fits = size <= WIDTH
            made = np.zeros((len(one), WIDTH), dtype=self.dtype)
            flat = np.array([i for x, ok in zip(found, fits, strict=True) if ok for i in x], dtype=self.dtype)
            made[np.arange(WIDTH) < np.where(fits, size, 0)[:, None]] = flat
            rows[new], count[new] = made[group], size[group]
            place, pick = np.unique(slot[one[fits]], return_index=True)
            pick = np.flatnonzero(fits)[pick]
            self.key[place], self.ids[place], self.count[place] = key[one[pick]], made[pick], size[pick]
            for i in np.flatnonzero(~fits[group]).tolist():
                slow[int(new[i])] = found[int(group[i])]
        far = np.flatnonzero(long)
        if len(far):
            texts = {p.text(i): None for i in far.tolist()}
            known = dict(zip(texts, self.encode([], list(texts))[1], strict=True))
            for i in far.tolist():
                slow[i] = known[p.text(i)]
                count[i] = len(slow[i])
        out = np.empty(int(count.sum()), dtype=self.dtype)
        if slow:
            at = np.cumsum(count) - count
            easy = np.ones(n, dtype=bool)
            easy[list(slow)] = False
            out[np.repeat(easy, count)] = rows[easy][np.arange(WIDTH) < count[easy][:, None]]
            for i, x in slow.items():
                out[at[i] : at[i] + len(x)] = x
        else:
            out[:] = rows[np.arange(WIDTH) < count[:, None]]
        return out, count

    @staticmethod
    def slots(key: np.ndarray) -> np.ndarray:
        h = key[:, 0] * MIX[0] + key[:, 1] * MIX[1] + key[:, 2] * MIX[2]
        h ^= h >> np.uint64(32)
        return ((h * MIX[3]) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)

    def learn(self, p: Pieces, which: np.ndarray) -> list[list[int]]:
        whole = p.whole[which]
        texts = [p.text(i) for i in which.tolist()]
        simple, others = self.encode([t for t, w in zip(texts, whole, strict=True) if not w], [t for t, w in zip(texts, whole, strict=True) if w])
        a, b = iter(simple), iter(others)
        return [next(b) if w else next(a) for w in whole.tolist()]
