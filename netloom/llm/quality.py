"""Operator 10, quality: fixed rules, then a hashed n-gram logistic regression.

Rules count words, characters in words, symbols, repeated lines and words in
repeated 8-word windows of the whole text; two of them reject outright. The
rest is decided by a logistic regression on hashed words, word pairs, and byte
n-grams of three and four, fitted on about ``max_rows`` rows of the quality
labels (chosen by a hash of the id), calibrated on a fourth of them that the
fit doesn't see, and compared with a fixed probability.

Defined results: null text has no words and fails; texts of any length are read
whole; documents without a label are scored like others; an id with different
labels is not learned from; with labels of one kind only, or none, what passes
the rules is kept; repeated rows get equal results; an empty table gives an
empty result; columns with other names are carried or ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, sampled, trim
from .linear import byte_grams, calibrate, fit, matrix, probability, squeezed
from .pretok import Words, segments

BITS = 12
MAX_ROWS = 3000
#: Of held-out labelled rows that pass the rules (three folds of four at sf0.1), 0.5 lost none of 2,471 good ones and kept 4 of 233 bad ones; 0.7 lost 2 and kept 3.
KEEP_FROM = 0.5
WINDOW = 8
#: Fixed values of the rules.
SYMBOLS, MIN_WORDS, MAX_REPEAT_PERCENT = "#*$%&|<>", 20, 30
SPACES = " \t\n\x0b\x0c\r"
MIX = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)
OUTPUTS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("p_quality", T.DoubleType())]


def repeat_words(words: list[bytes], keys: np.ndarray) -> int:
    """Words in windows that occur twice or more. Equal hashes only nominate windows; the words themselves are compared."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h += (keys[k : k + n] ^ (keys[k : k + n] >> np.uint64(17))) * MIX[k]
    values, at, times = np.unique(h, return_inverse=True, return_counts=True)
    if len(values) == n:
        return 0
    likely = np.flatnonzero(times[at] > 1).tolist()
    seen = Counter(tuple(words[i : i + WINDOW]) for i in likely)
    covered = np.zeros(len(words) + 1, np.int64)
    for i in likely:
        if seen[tuple(words[i : i + WINDOW])] > 1:
            covered[i] += 1
            covered[i + WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


def measure(text: str | None) -> tuple[tuple[int, ...], np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), hashed counts of word and character n-grams."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    keys = np.concatenate([Words([s.encode()]).h1 for s in segments(text)]) if words else np.zeros(0, np.uint64)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    values = (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words, keys))
    pairs = (keys[:-1] ^ (keys[:-1] >> np.uint64(29))) * MIX[0] + keys[1:] * MIX[1]
    hashed = np.concatenate((keys, pairs)) >> np.uint64(64 - BITS)
    return values, np.concatenate((np.bincount(hashed.astype(np.int64), minlength=1 << BITS), byte_grams(np.frombuffer(raw, np.uint8), BITS, (3, 4))))


class Model:
    """Fitted on the first rows and calibrated on the last fourth, which are views of one matrix."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        cut = len(y) - len(y) // 4
        if len(set(y[cut:].tolist())) < 2 or len(set(y[:cut].tolist())) < 2:
            cut = len(y)
        self.w, self.b = fit(x[:cut], y[:cut], "logistic", penalty=1e-5, steps=400)
        own = slice(cut, None) if cut < len(y) else slice(None)
        self.scale = calibrate(x[own] @ self.w + self.b, y[own])

    def margin(self, counts: np.ndarray) -> float:
        """Of one text, over the n-grams that it has."""
        at = np.flatnonzero(counts)
        x = np.log1p(counts[at], dtype=np.float32)
        return float(x @ self.w[at]) / max(float(np.sqrt(x @ x)), 1e-12) + self.b

    def score(self, margins: list[float]) -> np.ndarray:
        return probability(np.array(margins), *self.scale)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, max_rows: int = MAX_ROWS) -> Model | None:
    named = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    agreed = named.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most")
    chosen = sampled(agreed, max_rows / max(1, agreed.count()), "sample", "id").select("id", "y")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id")  # about max_rows rows

    def kernel():
        def work(columns):
            texts, ids, y = columns
            return [ids, y, [squeezed(measure(t)[1]) for t in texts]], None

        return work

    schema = T.StructType([T.StructField("id", named.schema["id"].dataType), T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())])
    rows = sorted(((zlib.crc32(str(r.id).encode()), r.id, r.y, bytes(r.x)) for r in arrow_map(texts, [F.col("text"), F.col("id"), F.col("y")], schema, kernel).collect()), key=lambda r: r[:2])
    y = np.array([1.0 if r[2] > 0 else -1.0 for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    x = matrix([r[3] for r in rows], 2 << BITS)
    rows.clear()
    model = Model(x, y)
    del x
    trim()
    return model


def judge(docs: DataFrame, model: Model | None, text_col: str = "text", *, carry: list[str], prefix: str = "", keep_from: float = KEEP_FROM) -> DataFrame:
    """The carried columns of every row, then ``OUTPUTS`` with ``prefix`` before their names."""
    schema = T.StructType([T.StructField(prefix + n, t) for n, t in OUTPUTS])

    def kernel():
        def work(columns):
            (texts,) = columns
            out = [[] for _ in OUTPUTS]
            found, margins = [], []
            for text in texts:
                values, counts = measure(text)
                found.append(values)
                if model:
                    margins.append(model.margin(counts))
            p = model.score(margins) if model else np.ones(len(found))
            for values, q in zip(found, p.tolist(), strict=True):
                failed = values[0] < MIN_WORDS or 100 * values[4] > MAX_REPEAT_PERCENT * values[0]
                for column, value in zip(out, (*values, failed, not failed and q >= keep_from, q), strict=True):
                    column.append(value)
            return [pa.array(c) if c else [] for c in out], None

        return work

    return arrow_map(docs, [F.col(f"`{text_col}`")], schema, kernel, carry=carry)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measures, base_failed, kept and p_quality of each row."""
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return judge(named, train(docs, labels, id_col, text_col), carry=["id"]).withColumnRenamed("id", id_col)
