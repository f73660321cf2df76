"""Vectorised word hashing over packed UTF-8 text.

A word is a run of bytes other than ASCII white space. Its hash is a
polynomial in its bytes modulo 2^64, read off one running sum of a whole
block, then mixed with its length. Nothing here loops over words.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of x; a bijection on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random uint64."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(salt * 0x2545F4914F6CDD1D & _MASK))


def _letters(lower: bool) -> np.ndarray:
    out = seeds(256, 11)
    if lower:
        out[0x41:0x5B] = out[0x61:0x7B]
    return out


LOWER, EXACT = _letters(True), _letters(False)


class _Powers:
    """BASE^0.. and its inverses, grown when a single word needs more."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = cls._run(BASE, n), cls._run(pow(BASE, -1, 1 << 64), n)
        return cls.up, cls.down

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


def _blocks(offsets: np.ndarray, raw: np.ndarray) -> list[tuple[int, int, int]]:
    """(first document, from byte, to byte) blocks, cut between documents or else at white space."""
    out, at, doc, last = [], int(offsets[0]), 0, int(offsets[-1])
    while at < last:
        doc = int(np.searchsorted(offsets, at, side="right")) - 1
        to = min(at + BLOCK, last)
        if to < last:
            cut = int(offsets[int(np.searchsorted(offsets, to, side="right")) - 1])
            if cut <= at:  # one document is longer than a block
                end, cut = int(offsets[doc + 1]), to
                while cut < end and not SPACE[raw[cut]]:
                    step = np.flatnonzero(SPACE[raw[cut : min(cut + 4096, end)]])
                    cut = cut + int(step[0]) if len(step) else min(cut + 4096, end)
            to = cut
        out.append((doc, at, to))
        at = to
    return out


def words(offsets: np.ndarray, raw: np.ndarray, lower: bool = True, punctuation: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of n documents, and n + 1 places where each document's words begin.

    lower: A-Z count as a-z. punctuation=False: ASCII punctuation is
    removed before; words of nothing else vanish.
    """
    found, starts = heads(offsets, raw, (0,), lower, punctuation)
    return found[0], starts


def heads(
    offsets: np.ndarray, raw: np.ndarray, sizes: tuple[int, ...], lower: bool = True, punctuation: bool = True, places: list | None = None
) -> tuple[list[np.ndarray], np.ndarray]:
    """As words, for each size with the hashes of the words' first `size` bytes (0: all); a head never equals a shorter word.

    places: a list that gets (begins, ends), the words' places in raw, for each block.
    """
    n = len(offsets) - 1
    found, counts = [[] for _ in sizes], np.zeros(n, np.int64)
    letters = LOWER if lower else EXACT
    if not punctuation and len(raw):
        raw = raw[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        keep = ~PUNCTUATION[raw]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        raw = raw[keep]
    for doc, at, to in _blocks(offsets, raw):
        block = raw[at:to]
        up, down = _Powers.of(max(BLOCK, to - at) + 1)
        full = ~SPACE[block]
        edges = offsets[doc + 1 : int(np.searchsorted(offsets, to, side="left"))] - at
        edges = edges[(edges > 0) & (edges < len(block))]
        before = np.zeros(len(block), bool)
        before[1:] = full[:-1]
        before[edges] = False
        start = np.flatnonzero(full & ~before)
        if not len(start):
            continue
        after = np.zeros(len(block), bool)
        after[:-1] = full[1:]
        after[edges - 1] = False
        end = np.flatnonzero(full & ~after) + 1
        total = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(letters[block] * up[: len(block)], out=total[1:])
        for k, size in enumerate(sizes):
            to = np.minimum(start + size, end) if size else end
            kind = (to - start).astype(np.uint64) + np.uint64(size << 32)
            found[k].append(mix((total[to] - total[start]) * down[start] + kind * np.uint64(0xA0761D6478BD642F)))
        if places is not None:
            places.append((start + at, end + at))
        counts += np.bincount(np.searchsorted(offsets, start + at, side="right") - 1, minlength=n)[:n]
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(counts, out=starts[1:])
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found], starts


def shingles(hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's windows of `width` words, and where they begin.

    A document with fewer words, but some, has its whole sequence as one.
    """
    keys, n = seeds(width, 23), np.diff(starts)
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_starts = np.zeros(len(n) + 1, np.int64)
    np.cumsum(many, out=out_starts[1:])
    out = np.zeros(out_starts[-1], np.uint64)
    if len(hashes) >= width:
        rolled = hashes[: len(hashes) - width + 1] * keys[0]
        for k in range(1, width):
            rolled = rolled + mix(hashes[k : len(hashes) - width + 1 + k] + keys[k])
        full = np.flatnonzero(n >= width)
        if len(full):
            lengths = many[full]
            firsts = np.cumsum(lengths) - lengths
            inside = np.arange(lengths.sum()) - np.repeat(firsts, lengths)
            out[np.repeat(out_starts[full], lengths) + inside] = mix(rolled[np.repeat(starts[full], lengths) + inside])
    for d in np.flatnonzero((n > 0) & (n < width)):
        value = np.uint64(int(n[d]))
        for h in hashes[starts[d] : starts[d + 1]]:
            value = mix(np.array([h], np.uint64) + mix(np.array([value], np.uint64)))[0]
        out[out_starts[d]] = value
    return out, out_starts


def owners(starts: np.ndarray) -> np.ndarray:
    """The document of each item."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


class Lookup:
    """Places of uint64 keys in a sorted array of distinct keys, by their top bits: a few gathers for each question."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, min(24, int(len(keys)).bit_length() + 1))
        self.first = np.searchsorted(keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int64)
        self.most = int(np.diff(self.first).max()) if len(keys) else 0

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        out = np.full(len(asked), -1, np.int64)
        if not self.most:
            return out
        top = (asked >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        open_ = np.flatnonzero(at < end)
        for k in range(self.most):
            place = at[open_] + k
            same = self.keys[place] == asked[open_]
            out[open_[same]] = place[same]
            open_ = open_[~same]
            open_ = open_[at[open_] + k + 1 < end[open_]]
            if not len(open_):
                break
        return out
