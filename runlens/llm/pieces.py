"""Splitting many texts into pre-tokens at once, and a bounded table of the ids of pieces seen before."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import numpy as np

#: Characters whose Unicode classes have long been settled, so that all libraries split them alike.
PLAIN = re.compile("[\x00-\x7e\xa0-ȳΆ-ҁ‐-‧‰-⁞]*")
_LIMIT = 0x2060
WHITE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
#: The contractions that are pieces of their own.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _class(c: str) -> int:
    major = unicodedata.category(c)[0]
    return LETTER if major == "L" else DIGIT if major == "N" else WHITE if re.match(r"\s", c) and c not in "\x1c\x1d\x1e\x1f" else OTHER


_CLASSES = np.array([_class(chr(c)) for c in range(_LIMIT)], np.uint8)
_FOUR = np.array([(1 << 16 * k) - 1 for k in range(5)], np.uint64)  # masks of the first characters of four
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Splitter:
    """Piece starts of plain texts that are laid end to end.

    keep_space: the byte-level pattern (one space joins the next piece, white space makes pieces); otherwise the
    word pattern (white space is dropped, every digit is a piece of its own).
    """

    def __init__(self, keep_space: bool):
        self.keep_space = keep_space

    def split(self, codes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """codes of all texts, start of each text -> (start, end) of every piece."""
        n = len(codes)
        kind = _CLASSES[codes]
        begin = np.zeros(n + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=begin[1:n])
        if not self.keep_space:
            begin[:n] |= kind == DIGIT
        edge = np.zeros(n + 1, bool)
        edge[firsts] = edge[n] = True
        if self.keep_space:
            into = np.flatnonzero((kind[1:] != WHITE) & (kind[:-1] == WHITE)) + 1
            into = into[~edge[into]]
            begin[into - 1] = True
            begin[into] = codes[into - 1] != 32
        begin |= edge
        quote = np.flatnonzero((codes == 39) & begin[:n])
        for c in CONTRACTIONS if len(quote) else ():
            at = quote[quote + len(c) <= n]
            for k in range(1, len(c)):
                at = at[(codes[at + k] == ord(c[k])) & ~edge[at + k]]
            begin[at + 1] = False
            begin[at + len(c)] = True
        start = np.flatnonzero(begin[:n])
        end = np.append(start[1:], n)
        if not self.keep_space:
            word = kind[start] != WHITE
            start, end = start[word], end[word]
        return start, end


class PieceTable:
    """Values of pieces: a direct-mapped table of bounded size over pools that start anew when they are full. A hash says
    where to look; a piece has the values of an entry only if all its characters are the same."""

    def __init__(self, encode: Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]], slots: int = 1 << 20, pool: int = 1 << 22):
        self.encode, self.shift, self.most = encode, np.uint64(64 - slots.bit_length() + 1), pool
        #: One row a slot: the first and second four characters, place of the values and their number, place of the characters after these and the piece's width.
        self.rows = np.zeros((slots, 4), np.uint64)
        self.pool, self.used = np.zeros(pool, np.uint32), 0
        self.chars, self.held = np.zeros(pool, np.uint16), 0

    def _found(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """(slot, first eight characters in two numbers, whether the slot holds the piece, place of its values, their number)."""
        c = np.zeros(len(codes) + 12, np.uint64)
        c[: len(codes)] = codes
        c[:-1] |= c[1:] << np.uint64(16)
        c[:-2] |= c[2:] << np.uint64(32)  # each character and the three after it
        wide = end - start
        k0, k1 = c[start] & _FOUR[np.minimum(wide, 4)], c[start + 4] & _FOUR[np.clip(wide - 4, 0, 4)]
        h = k0 * _MULTIPLIERS[0] + k1 * _MULTIPLIERS[1] + wide.astype(np.uint64) * _MULTIPLIERS[3]
        long = np.flatnonzero(wide > 8)
        h[long] += c[end[long] - 4] * _MULTIPLIERS[2]
        h ^= h >> np.uint64(31)
        slot = ((h * _MULTIPLIERS[1]) >> self.shift).astype(np.int64)
        rows = self.rows[slot]
        hit = (rows[:, 0] == k0) & (rows[:, 1] == k1) & ((rows[:, 3] & np.uint64(0xFFFFFFFF)).astype(np.int64) == wide)
        long = long[hit[long]]
        if len(long):  # the characters after the first eight
            place, rest = (rows[long, 3] >> np.uint64(32)).astype(np.int64), wide[long] - 8
            ends = np.cumsum(rest)
            other = np.flatnonzero(spread(codes, start[long] + 8, rest) != spread(self.chars, place, rest))
            hit[long[np.searchsorted(ends, other, side="right")]] = False
        return slot, k0, k1, hit, (rows[:, 2] >> np.uint64(32)).astype(np.int64), (rows[:, 2] & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def look_up(self, codes: np.ndarray, text: str, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, place in it, count) for every piece of a text; pieces not in the table are encoded, each once."""
        slot, k0, k1, hit, at, n = self._found(codes, start, end)
        if hit.all():
            return self.pool, at, n
        miss = np.flatnonzero(~hit)
        own: dict[str, int] = {}
        back = np.array([own.setdefault(text[a:b], len(own)) for a, b in zip(start[miss].tolist(), end[miss].tolist())])
        first = miss[np.unique(back, return_index=True)[1]]
        ids, counts = self.encode(list(own))
        wide = end[first] - start[first]
        rest = np.maximum(wide - 8, 0)
        if self.used + len(ids) > self.most or self.held + rest.sum() > self.most:  # texts with more new pieces than fit get pools of their own
            self.rows[:] = 0
            keep = np.flatnonzero(hit)
            old, old_at, old_n = self.pool, at[keep], n[keep]
            flat = np.repeat(old_at - np.cumsum(old_n) + old_n, old_n) + np.arange(old_n.sum())
            self.pool = np.zeros(max(self.most, len(flat) + len(ids)), np.uint32)
            self.pool[: len(flat)] = old[flat]
            at[keep] = np.cumsum(old_n) - old_n
            self.used, self.held = len(flat), 0
            self.chars = np.zeros(max(self.most, int(rest.sum())), np.uint16)
        place = self.used + np.cumsum(counts) - counts
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        letters = spread(codes, start[first] + 8, rest)
        self.chars[self.held : self.held + len(letters)] = letters
        text_at = self.held + np.cumsum(rest) - rest
        self.held += len(letters)
        self.rows[slot[first]] = np.stack([k0[first], k1[first], (place << 32 | counts).astype(np.uint64), (text_at << 32 | wide).astype(np.uint64)], axis=1)
        at[miss], n[miss] = place[back], counts[back]
        return self.pool, at, n


def spread(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The values of all pieces, one after the other."""
    n = n.astype(np.int64)
    ends = np.cumsum(n)
    return pool[np.repeat(at - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
