"""Vectorised word splitting and a word cache for tokenizers.

Texts are joined into one byte buffer; words (runs without the six ASCII white
space bytes) are found and hashed with numpy: two polynomial hashes modulo 2^64
over the bytes of a word, taken from running sums. ``WordTable`` is an
open-addressing table from the 128-bit key to a code, looked up and filled
many words at a time.
"""

from __future__ import annotations

import re

import numpy as np

P1, P2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1
#: A text with one of these goes to the library whole: other white space, separators, NUL.
OTHER_SPACE = re.compile("[\x00\x1c-\x1f\x85\xa0 ᠎ -     　﻿]").search
#: Below this code point the letter and number classes of every Unicode version in use agree.
SAFE = 0x530
CUT = 1 << 18
#: Bytes that are hashed together; the tables of powers are as long as this.
GROUP = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & MASK, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class Words:
    """Words of some texts: starts, ends (byte positions in ``buffer``), text (number of the text), keys h1 and h2."""

    _cache: dict[str, np.ndarray] = {}

    def __init__(self, parts: list[bytes]):
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        self.begin = np.concatenate(([0], np.cumsum(sizes)))
        self.buffer = b"\n".join(parts) + b"\n"
        b = np.frombuffer(self.buffer, np.uint8)
        space = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.text = np.searchsorted(self.begin, self.starts, "right") - 1
        self.space = space
        n = len(b) + 1
        cache = Words._cache
        if len(cache.get("p1", ())) < n:
            size = 1 << (n - 1).bit_length()
            cache |= {"p1": _powers(P1, size), "p2": _powers(P2, size), "i1": _powers(pow(P1, -1, 1 << 64), size), "i2": _powers(pow(P2, -1, 1 << 64), size)}
        c = b.astype(np.uint64) + np.uint64(1)
        sums = np.zeros(n, np.uint64)
        lengths = (self.ends - self.starts).astype(np.uint64)
        keys = []
        for p, i in (("p1", "i1"), ("p2", "i2")):
            np.cumsum(c * cache[p][: n - 1], out=sums[1:])
            h = (sums[self.ends] - sums[self.starts]) * cache[i][self.starts]
            h ^= lengths * np.uint64(P2)
            h ^= h >> np.uint64(31)
            h *= np.uint64(P1)
            h ^= h >> np.uint64(29)
            keys.append(h)
        self.h1, self.h2 = keys

    def word(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.ends[i]]

    def counts(self, n_texts: int) -> np.ndarray:
        return np.bincount(self.text, minlength=n_texts)[:n_texts]


def segments(text: str, cut: int = CUT) -> list[str]:
    """``text`` in parts of about ``cut`` characters; each part but the first starts with a white space run."""
    if len(text) <= cut:
        return [text]
    out, start = [], 0
    find = re.compile(r"(?<=[^ \t\n\r\x0b\x0c])[ \t\n\r\x0b\x0c]").search
    while len(text) - start > cut and (m := find(text, start + cut)):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def groups(parts: list[bytes], limit: int = GROUP):
    """(number of the first part, parts) in runs of about ``limit`` bytes."""
    start, total = 0, 0
    for i, part in enumerate(parts):
        if i > start and total + len(part) > limit:
            yield start, parts[start:i]
            start, total = i, 0
        total += len(part) + 1
    if len(parts) > start:
        yield start, parts[start:]


class WordTable:
    """From 128-bit word keys to codes 0, 1, 2, ...; at ``limit`` words it starts afresh, so memory is bounded."""

    def __init__(self, limit: int = 1 << 19):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.size, self.n = 1 << 16, 0
        self.k1, self.k2, self.code = (np.zeros(self.size, t) for t in (np.uint64, np.uint64, np.int32))
        self.code[:] = -1

    def lookup(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Codes, -1 where a key is not there."""
        mask = np.int64(self.size - 1)
        at = (h1 & np.uint64(mask)).astype(np.int64)
        out = self.code[at]
        todo = np.flatnonzero((out >= 0) & ((self.k1[at] != h1) | (self.k2[at] != h2)))
        at = at[todo]
        while len(todo):
            at = (at + 1) & mask
            found = self.code[at]
            same = (found < 0) | ((self.k1[at] == h1[todo]) & (self.k2[at] == h2[todo]))
            out[todo[same]] = found[same]
            todo, at = todo[~same], at[~same]
        return out

    def _place(self, h1: np.ndarray, h2: np.ndarray, codes: np.ndarray) -> None:
        mask = np.int64(self.size - 1)
        at = (h1 & np.uint64(mask)).astype(np.int64)
        while len(at):
            free = np.flatnonzero(self.code[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.k1[at[put]], self.k2[at[put]], self.code[at[put]] = h1[put], h2[put], codes[put]
            rest = np.ones(len(at), bool)
            rest[put] = False
            at, h1, h2, codes = (at[rest] + 1) & mask, h1[rest], h2[rest], codes[rest]

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """New codes for distinct keys that are not there."""
        codes = np.arange(self.n, self.n + len(h1), dtype=np.int32)
        self.n += len(h1)
        if self.n * 2 > self.size:
            old = self.code >= 0
            k1, k2, was = self.k1[old], self.k2[old], self.code[old]
            while self.n * 2 > self.size:
                self.size *= 2
            self.k1, self.k2, self.code = (np.zeros(self.size, t) for t in (np.uint64, np.uint64, np.int32))
            self.code[:] = -1
            self._place(k1, k2, was)
        self._place(h1, h2, codes)
        return codes


class Pool:
    """Rows of numbers, one for each code, in one growing array."""

    def __init__(self, kind=np.int32):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.values, self.used = np.zeros(1 << 16, self.kind), 0
        self.offset, self.length, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def add(self, rows: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, rows), np.int32, len(rows))
        total = int(lengths.sum())
        for name, need in (("values", self.used + total), ("offset", self.n + len(rows)), ("length", self.n + len(rows))):
            if need > len(old := getattr(self, name)):
                setattr(self, name, np.concatenate((old, np.zeros(max(len(old), need - len(old)), old.dtype))))
        self.values[self.used : self.used + total] = np.fromiter((x for r in rows for x in r), self.kind, total)
        self.offset[self.n : self.n + len(rows)] = self.used + np.cumsum(lengths) - lengths
        self.length[self.n : self.n + len(rows)] = lengths
        self.used, self.n = self.used + total, self.n + len(rows)

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all rows in a line, lengths)."""
        lengths = self.length[codes]
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.offset[codes] - (ends - lengths), lengths) + np.arange(total)
        return self.values[at], lengths


class Cached:
    """Words to codes through a table; ``make`` gives the pool's rows of unknown words."""

    def __init__(self, kind=np.int32, limit: int = 1 << 19):
        self.table, self.pool = WordTable(limit), Pool(kind)

    def codes(self, h1: np.ndarray, h2: np.ndarray, make) -> np.ndarray:
        """``make(numbers)``: rows for the words with these numbers."""
        out = self.table.lookup(h1, h2)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            _, first, back = np.unique(h1[missing], return_index=True, return_inverse=True)
            new = missing[first]
            if not (same := h2[missing] == h2[new][back]).all():  # two words share the first key
                out[missing[same]] = self.codes(h1[missing[same]], h2[missing[same]], lambda at: make(missing[same][at]))
                rest = missing[~same]
                out[rest] = self.codes(h1[rest], h2[rest], lambda at: make(rest[at]))
                return out
            if self.table.n + len(new) > self.table.limit and self.table.n:
                self.table.clear()
                self.pool.clear()
                return self.codes(h1, h2, make)
            self.pool.add(make(new))
            out[missing] = self.table.insert(h1[new], h2[new])[back]
        return out
