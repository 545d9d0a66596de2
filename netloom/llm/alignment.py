"""Operator 13, alignment of two tokenizers over the same bytes.

Both tokenizers encode a space and the text. Every byte gets a label: no token
ends there, one of A, one of B, or of both. A regular expression scans the
label string for the spans up to each both-label; what a span holds of the
labels says how many tokens of A and of B its group has. The last tokens of a
group end together, which is a link between two token ids.

How often two ids are linked is counted over the whole corpus. Texts go through
in batches of bounded size, and a batch hands on each of its id pairs once, with
its number of links; sums over all batches, and the largest sum of each B id, go
back to the batches that hold the pair. So what moves grows with batches times
their distinct pairs, a pair comes from a batch at most once, however frequent
it is, and no table of pairs is collected or broadcast.

Defined results: a null or empty text, and one that either tokenizer doesn't
give back byte for byte, has no tokens: all counts are 0 and the digest is
empty; texts of any length are read whole; strings of special tokens are plain
text; repeated rows and null ids get a result each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import BYTE_PATTERN, byte_alphabet, merge_ranks, vocabulary
from .common import durable, slices, small_batches, trim
from .pretok import OTHER_SPACE, SAFE

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Bytes of texts that share one list of pairs, about.
BATCH_CHARS = 8 << 20
#: Labels of a byte: nothing ends, a token of A ends, one of B, one of each.
LABELS = b".ab|"
SPAN = re.compile(rb"[^|]*\|")
#: Texts with longer words or runs of white space are left to the library.
LONG = re.compile(r"\S{4096}|\s{1024}")


class Digits:
    """Decimal strings of ids with a separator behind each, put together by table lookup."""

    def __init__(self, size: int):
        text = [str(i).encode() for i in range(size)]
        self.length = np.fromiter(map(len, text), np.int64, size)
        self.table = np.zeros((size, int(self.length.max(initial=1)) + 1), np.uint8)
        for k in range(self.table.shape[1] - 1):
            own = self.length > k
            self.table[own, k] = [t[k] for t in text if len(t) > k]

    def join(self, ids: np.ndarray, separator: np.ndarray) -> bytes:
        rows = self.table[ids]
        n = self.length[ids]
        rows[np.arange(len(ids)), n] = separator
        return rows[np.arange(rows.shape[1]) <= n[:, None]].tobytes()


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the alignment of one text; one of these per worker."""

    def __init__(self, byte_level: str, whole: dict[bytes, int], pieces: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        # a faster loop over the tokens that ``bpe`` has proven to merge as the library does; other texts go to the library
        ranks, self.id_of = merge_ranks(whole, False)
        self.fast = tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        special = {t["content"] for t in json.loads(byte_level)["added_tokens"]}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, number in vocab.items():
            self.a_bytes[number] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        self.digits = Digits(max(len(self.a_bytes), len(self.b_bytes)))

    def plain(self, text: str) -> bool:
        return (text.isascii() or max(text) < chr(SAFE)) and not OTHER_SPACE(text) and not (len(text) > 4096 and LONG.search(text))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """(ids of A, ids of B) of each text, None where one doesn't give the text back."""
        first = [self.id_of[self.fast.encode_to_numpy(" " + t, disallowed_special=())] if self.plain(t) else np.array(self.a.encode(" " + t, add_special_tokens=False).ids, np.int64) for t in texts]
        second = [np.fromiter(ids, np.int64, len(ids)) for ids in self.b.encode(texts, num_threads=1)]
        out = []
        for text, a, b in zip(texts, first, second, strict=True):
            raw = b" " + text.encode()
            # bytes that a byte-level tokenizer takes come back in order, so their number is enough for A
            same = self.a_size[a].sum() == self.b_size[b].sum() == len(raw) and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == raw
            out.append((a, b) if same else None)
        return out

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of A, tokens of B, last A id, last B id) of each group."""
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        mark = np.zeros(int(ends_a[-1]), np.uint8)
        mark[ends_a - 1] = 1
        mark[ends_b - 1] |= 2
        labels = np.frombuffer(LABELS, np.uint8)[mark].tobytes().translate(None, b".")
        spans = SPAN.findall(labels)
        n_a, n_b = np.ones(len(spans), np.int64), np.ones(len(spans), np.int64)
        size = np.fromiter(map(len, spans), np.int64, len(spans))
        for i in np.flatnonzero(size > 1).tolist():
            n_a[i] += spans[i].count(b"a")
        n_b += size - n_a
        return n_a, n_b, a[np.cumsum(n_a) - 1], b[np.cumsum(n_b) - 1]

    def groups_text(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``"""
        both = n_a + n_b
        start = np.cumsum(both) - both
        ids, separator = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        in_a = np.zeros(len(ids), bool)
        group = np.repeat(np.arange(len(both)), both)
        in_a = np.arange(len(ids)) - start[group] < n_a[group]
        ids[in_a], ids[~in_a] = a, b
        separator[start + n_a - 1] = ord("|")
        separator[start + both - 1] = ord(";")
        return self.digits.join(ids, separator)[:-1]


_ALIGNERS: dict[int, Aligner] = {}


def aligner(byte_level: str, whole: dict[bytes, int], pieces: bytes) -> Aligner:
    key = hash((byte_level, pieces))
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(byte_level, whole, pieces)
    return _ALIGNERS[key]


def packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<u4").tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)


DOCS = "batch long, place int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, own binary, times binary, pairs binary, links binary"


def aligned(docs: DataFrame, byte_level: str, whole: dict[bytes, int], pieces: bytes, id_col: str, text_col: str) -> DataFrame:
    """A row per text, with which pairs of its batch it has (``own``, by number, and how many ``times``); the first row of a
    batch also has the batch's ``pairs`` (B id << 32 | A id) and their ``links``."""
    small_batches(docs.sparkSession)
    named = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("doc_id"))
    kind = named.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own, held, size = aligner(byte_level, whole, pieces), [], 0
        nothing = np.zeros(0, np.int64)

        def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids, rows, keys = [], [], []
            for part in parts:
                texts = part.column(0).to_pylist()
                ids += part.column(1).to_pylist()
                found = iter(own.encode([t for t in texts if t]))
                for text in texts:
                    both = next(found) if text else None
                    if both is None:
                        rows.append((0, 0, 0, 0, ""))
                        keys.append(nothing)
                        continue
                    n_a, n_b, a, b = own.align(*both)
                    rows.append((len(both[0]), len(both[1]), len(n_a), len(a), hashlib.sha256(own.groups_text(*both, n_a, n_b)).hexdigest()))
                    keys.append(b << 32 | a)
            flat = np.concatenate(keys) if keys else nothing
            pairs, number, links = np.unique(flat, return_inverse=True, return_counts=True)
            mine, times, at = [], [], 0
            for k in keys:
                which, often = np.unique(number[at : at + len(k)], return_counts=True)
                mine.append(packed(np.diff(which, prepend=0)))
                times.append(packed(often))
                at += len(k)
            batch = int.from_bytes(os.urandom(8), "little", signed=True)
            first = [pairs.astype("<i8").tobytes()] + [None] * (len(rows) - 1)
            counts = [links.astype("<i8").tobytes()] + [None] * (len(rows) - 1)
            columns = [[batch] * len(rows), range(len(rows)), ids, *zip(*rows, strict=True), mine, times, first, counts]
            types = [pa.int64(), pa.int32(), parts[0].schema.field(1).type, *[pa.int64()] * 4, pa.string(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split(" ")[0] for f in DOCS.split(", ")])

        for batch in batches:
            for part in slices(batch, 0):
                if part.num_rows:
                    held.append(part)
                    size += part.nbytes
                if size >= BATCH_CHARS:
                    yield finish(held)
                    held, size = [], 0
        if held:
            yield finish(held)
        trim()

    return named.mapInArrow(run, DOCS.format(kind=kind))


def alignment(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text; ``byte_level`` and ``pieces`` are the
    paths of the tokenizers' files, A and B."""
    data, whole = vocabulary(byte_level)
    with open(pieces, "rb") as f:
        model = f.read()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = durable(aligned(docs, data, whole, model, id_col, text_col), "aligned")

    def unpack(batches):
        for batch in batches:
            for number, pairs, links in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                pair, n = np.frombuffer(pairs, "<i8"), np.frombuffer(links, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), number)), pa.array(np.arange(len(pair), dtype=np.int32)), pa.array(pair), pa.array(n)], names=["batch", "number", "pair", "links"])

    held = durable(rows.where("pairs IS NOT NULL").select("batch", "pairs", "links").mapInArrow(unpack, "batch long, number int, pair long, links long"), "pairs")
    counts = held.groupBy("pair").agg(F.sum("links").alias("count"))
    ranked = counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.shiftright("pair", 32))))
    known = held.select("batch", "number", "pair").join(ranked, "pair").select("batch", "number", "count", "best")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        number = right.column("number").to_numpy()
        count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        count[number], best[number] = right.column("count").to_numpy(), right.column("best").to_numpy().astype(np.int64)
        n_best, total = [], []
        for own, times in zip(left.column("own").to_pylist(), left.column("times").to_pylist(), strict=True):
            which, often = np.cumsum(unpacked(own)), unpacked(times)
            n_best.append(int(best[which] @ often))
            total.append(int(count[which] @ often))
        columns = [left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.chunked_array([pa.array(c, pa.int64())]) for c in (n_best, total)] + [left.column("groups_sha256")]
        return pa.Table.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    texts = rows.drop("place", "pairs", "links")
    return texts.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(finish, schema).withColumnRenamed("doc_id", id_col)
