"""Byte-pair encoding behind a word cache, equal to the tokenizers library on whole texts.

The whole-token proof: ``proven`` encodes every string of a vocabulary alone
with the library and keeps those that come back as their own single id. Such a
pre-token needs no merging. It also licenses a plainer merge loop for the rest:
two neighbouring tokens that together spell a proven token t tile t, so the
merges inside t so far are those that the library makes on t alone, and these
end in t; merging any two neighbours whose concatenation is proven, lowest rank
first, is then what the library does. tiktoken's merge loop, given the ranks of
the proven tokens only, is used for that. Whatever the proof does not cover
(special strings, unusual white space, characters on whose class Unicode
versions differ) is encoded by the library itself.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import regex

from .pretok import CUT, OTHER_SPACE, SAFE, Cached, Words, groups, segments

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The pre-token patterns of the two tokenizer files.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for the end-of-word mark in the merge loop; this byte is never part of UTF-8.
END = b"\xff"


def byte_alphabet() -> dict[str, int]:
    """The printable character of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def proven(data: str) -> dict[bytes, int]:
    """Vocabulary strings, as bytes, that the model makes one token of when they stand alone; computed once, on the driver."""
    from tokenizers import Tokenizer

    spec = json.loads(data)
    suffix = spec["model"]["end_of_word_suffix"] or ""
    alphabet = byte_alphabet()
    model = Tokenizer.from_str(data).model
    out = {}
    for token, number in spec["model"]["vocab"].items():
        if suffix and not token.endswith(suffix):
            out[bytes(alphabet[c] for c in token)] = number  # never a whole pre-token; checked below by its merges
            continue
        body = token[: len(token) - len(suffix)]
        if [t.id for t in model.tokenize(body)] == [number]:
            out[bytes(alphabet[c] for c in body) + END * bool(suffix)] = number
    if suffix:
        out = _inner_proven(spec, out, suffix)
    return out


def _inner_proven(spec: dict, found: dict[bytes, int], suffix: str) -> dict[bytes, int]:
    """Word-inner tokens have no text of their own; one is proven if a model without word ends gives it back."""
    from tokenizers import models

    vocab = spec["model"]["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    inner = [m for m in merges if not m[1].endswith(suffix)]
    plain = models.BPE(vocab={k: v for k, v in vocab.items() if not k.endswith(suffix)}, merges=inner)
    alphabet = byte_alphabet()
    out = {k: v for k, v in found.items() if k.endswith(END)}
    for token, number in vocab.items():
        if not token.endswith(suffix) and [t.id for t in plain.tokenize(token)] == [number]:
            out[bytes(alphabet[c] for c in token)] = number
    return out


def merge_ranks(whole: dict[bytes, int], suffixed: bool) -> tuple[dict[bytes, int], np.ndarray]:
    """(ranks for the merge loop, id of each rank). Bytes come first, then bytes at a word's end, then by id."""
    single = [bytes([b]) for b in range(256)]
    ends = [bytes([b]) + END for b in range(256)] if suffixed else []
    rest = sorted((n, t) for t, n in whole.items() if t not in (known := {*single, *ends}) and t not in known)
    order = [*single, *ends, *(t for _, t in rest)]
    return {t: i for i, t in enumerate(order)}, np.array([whole.get(t, -1) for t in order], np.int32)


class Coder:
    """Common part of the two coders: the library, the proven tokens and the merge loop."""

    def __init__(self, data: str, whole: dict[bytes, int], pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data)
        self.special = [t["content"] for t in json.loads(data)["added_tokens"]]
        self.whole = whole
        self.suffixed = any(t.endswith(END) for t in whole)
        ranks, self.ids = merge_ranks(whole, self.suffixed)
        self.merge = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.find = regex.compile(pattern).findall
        self.cached = Cached()

    def by_library(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def unusual(self, text: str) -> bool:
        return OTHER_SPACE(text) is not None or any(s in text for s in self.special)

    def parts(self, text: str) -> list[str] | None:
        """``text`` in segments, or None if it has a word too long for the word table."""
        found = segments(text)
        return None if max(map(len, found)) > 4 * CUT else found


class ByteCounter(Coder):
    """Numbers of tokens under a byte-level vocabulary whose pre-tokens may start with one space."""

    def __init__(self, data: str, whole: dict[bytes, int]):
        super().__init__(data, whole, BYTE_PATTERN)
        self.runs: dict[str, int] = {}

    def piece(self, pre: str) -> int:
        raw = pre.encode()
        return 1 if raw in self.whole else len(self.merge(raw))

    def chunk(self, text: str) -> int:
        if max(text) >= chr(SAFE):
            return len(self.by_library(text))
        raw = text.encode()
        if raw in self.whole and text.lstrip(" ").isalpha():
            return 1
        return sum(map(self.piece, self.find(text)))

    def run(self, text: str) -> int:
        if (n := self.runs.get(text)) is None:
            n = self.piece(text)
            if len(self.runs) < 10_000:
                self.runs[text] = n
        return n

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            own = None if self.unusual(text) else self.parts(text)
            if own is None:
                out[i] = len(self.by_library(text))
            else:
                parts += [s.encode() for s in own]
                owner += [i] * len(own)
        for first, some in groups(parts):
            np.add.at(out, owner[first : first + len(some)], self.count_parts(some))
        return out

    def count_parts(self, parts: list[bytes]) -> np.ndarray:
        w = Words(parts)
        begin, end = w.begin[:-1], w.begin[1:] - 1
        total = np.zeros(len(parts), np.int64)
        last = begin.copy()
        if len(w.starts):
            before = np.maximum(np.concatenate(([0], w.ends[:-1])), begin[w.text])
            gap = w.starts - before
            b = np.frombuffer(w.buffer, np.uint8)
            spaced = (gap > 0) & (b[w.starts - 1] == 32)
            mark = spaced.astype(np.uint64)
            h1, h2 = w.h1 ^ (mark * np.uint64(0x5851F42D4C957F2D)), w.h2 + mark
            make = lambda at: [[self.chunk((" " if spaced[i] else "") + w.word(i).decode())] for i in at.tolist()]
            codes = self.cached.codes(h1, h2, make)
            n = self.cached.pool.values[self.cached.pool.offset[codes]].astype(np.int64)
            n += (gap == 1) & ~spaced
            for i in np.flatnonzero(gap > 1).tolist():
                run = w.buffer[before[i] : w.starts[i]].decode()
                n[i] += self.run(run[:-1]) + (0 if spaced[i] else self.run(run[-1]))
            total += np.bincount(w.text, n, len(parts)).astype(np.int64)
            np.maximum.at(last, w.text, w.ends)
        for i in np.flatnonzero(end > last).tolist():
            total[i] += self.run(w.buffer[last[i] : end[i]].decode())
        return total


class WordCoder(Coder):
    """Ids under a vocabulary with word ends: lower case, white space dropped."""

    def __init__(self, data: str, whole: dict[bytes, int]):
        super().__init__(data, whole, WORD_PATTERN)

    def word(self, text: str) -> list[int]:
        if max(text) >= chr(SAFE):
            return self.by_library(text)
        ids = self.ids
        if text.isalpha():
            return ids[self.merge(text.encode() + END)].tolist()
        out: list[int] = []
        for pre in self.find(text):
            out += ids[self.merge(pre.encode() + END)].tolist()
        return out

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a line, length of each); ``end``: an id appended to each."""
        parts, owner, whole = [], [], {}
        for i, text in enumerate(texts):
            if not text:
                continue
            plain = not self.unusual(text) and "Σ" not in text and unicodedata.is_normalized("NFC", text)
            own = self.parts(text) if plain else None
            if own is None:
                whole[i] = self.by_library(text)
            else:
                parts += [s.lower().encode() for s in own]
                owner += [i] * len(own)
        lengths = np.zeros(len(texts), np.int64)
        flats = [np.zeros(0, np.int32)]
        for first, some in groups(parts):
            w = Words(some)
            codes = self.cached.codes(w.h1, w.h2, lambda at, w=w: [self.word(w.word(i).decode()) for i in at.tolist()])
            flat, n = self.cached.pool.take(codes)
            flats.append(flat)
            lengths += np.bincount(np.array(owner[first : first + len(some)], np.int64)[w.text], n, len(texts)).astype(np.int64)
        flat = np.concatenate(flats)
        if not whole and end is None:
            return flat, lengths
        pieces, at, mark = [], 0, [] if end is None else [end]
        for i, n in enumerate(lengths.tolist()):
            if i in whole:
                pieces.append(np.array(whole[i], np.int32))
                lengths[i] = len(whole[i])
            else:
                pieces.append(flat[at : at + n])
                at += n
            if mark:
                pieces.append(np.array(mark, np.int32))
        return np.concatenate(pieces) if pieces else flat, lengths + len(mark)


_CODERS: dict[tuple[str, int], Coder] = {}


def coder(kind: type[Coder], data: str, whole: dict[bytes, int]) -> Coder:
    """One coder per Python worker, so its cache lives on from task to task."""
    key = (kind.__name__, hash(data))
    if key not in _CODERS:
        _CODERS[key] = kind(data, whole)
    return _CODERS[key]


_PROVEN: dict[str, tuple[str, dict[bytes, int]]] = {}


def vocabulary(path: str) -> tuple[str, dict[bytes, int]]:
    """(text of a tokenizer file, its proven tokens), read on the driver and sent to tasks by value: their size is the vocabulary's."""
    if path not in _PROVEN:
        with open(path, encoding="utf-8") as f:
            data = f.read()
        _PROVEN[path] = (data, proven(data))
    return _PROVEN[path]
