"""Operator 6, language identification in two levels.

First the family of a text is chosen by one-versus-rest linear models, then,
within the family, every two languages are told apart by a linear support
vector machine of their own and the language with the largest summed pairwise
probability wins. Features are hashed byte n-grams of the whole lower-cased
text. ``score`` is the family's calibrated probability times the winner's mean
pairwise probability, from 0 to 1.

The models are fitted on about ``max_rows`` labelled training rows, the same
number for each language as far as there are as many, chosen by a hash of the
id. Languages that ``FAMILIES`` doesn't name are a family each.

Defined results: a null text and one without a letter are ``und`` with score 0;
with no labelled training row every text is ``und``; texts of any length are
read whole; a null id is never learned from and not held out; repeated rows get
equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, sampled, trim
from .linear import byte_grams, calibrate, fit, matrix, probability, squeezed, unit

BITS = 12
MAX_ROWS = 2400
#: Families of language codes.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def features(text: str) -> np.ndarray:
    return byte_grams(np.frombuffer(text.lower().encode(), np.uint8), BITS)


def fold(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(folds))


class Model:
    """Families, their languages, and the weights of all linear models in one matrix."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            families.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
        self.families = list(families.items())
        names, lang_of = np.array([FAMILY_OF.get(v, v) for v in langs]), np.array(langs)
        weights, biases, self.scale = [], [], []

        def add(rows, y):
            w, b = fit(x[rows], y, "hinge")
            self.scale.append(calibrate(x[rows] @ w + b, y))
            weights.append(w)
            biases.append(b)
            return len(weights) - 1

        everything = np.arange(len(langs))
        self.family_model = [add(everything, np.where(names == f, 1.0, -1.0)) if len(families) > 1 else None for f in families]
        self.pair_model = {}
        for _, own in self.families:
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    rows = np.flatnonzero((lang_of == a) | (lang_of == b))
                    self.pair_model[a, b] = add(rows, np.where(lang_of[rows] == a, 1.0, -1.0))
        self.weights = np.array(weights, np.float32).reshape(-1, x.shape[1])
        self.biases = np.array(biases, np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margin = x @ self.weights.T + self.biases if len(self.weights) else np.zeros((len(x), 0))
        p = [probability(margin[:, i], *s) for i, s in enumerate(self.scale)]
        of_family = np.stack([np.ones(len(x)) if m is None else p[m] for m in self.family_model], 1)
        of_family /= of_family.sum(1, keepdims=True)
        family = of_family.argmax(1)
        langs, score = [""] * len(x), np.zeros(len(x))
        for f, (_, own) in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            votes = np.zeros((len(rows), len(own)))
            for i, a in enumerate(own):
                for j in range(i + 1, len(own)):
                    q = p[self.pair_model[a, own[j]]][rows]
                    votes[:, i] += q
                    votes[:, j] += 1 - q
            best = votes.argmax(1)
            for r, b in zip(rows.tolist(), best.tolist(), strict=True):
                langs[r] = own[b]
            score[rows] = of_family[rows, f] * (votes.max(1) / (len(own) - 1) if len(own) > 1 else 1)
        return langs, score


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, folds: int = 4, held: int = 2, max_rows: int = MAX_ROWS) -> Model | None:
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), fold(id_col, folds).alias("fold"))
    known = named.where((F.col("fold") != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(1, max_rows // len(counts))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))])
    chosen = sampled(known, share[F.col("lang")], "sample", "id")

    def kernel():
        def work(columns):
            texts, langs = columns
            return [langs, [squeezed(features(t)) for t in texts]], None

        return work

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("x", T.BinaryType())])
    rows = sorted((r.lang, bytes(r.x)) for r in arrow_map(chosen, [F.col("text"), F.col("lang")], schema, kernel).collect())
    if not rows:
        return None
    langs, x = [lang for lang, _ in rows], matrix([raw for _, raw in rows], 1 << BITS)
    rows.clear()
    model = Model(x, langs)
    del x
    trim()
    return model


def predict(docs: DataFrame, model: Model | None, outputs: tuple[str, str] = ("lang_pred", "score"), text_col: str = "text", *, carry: list[str]) -> DataFrame:
    """The carried columns of every row, its language and score."""
    schema = T.StructType([T.StructField(outputs[0], T.StringType()), T.StructField(outputs[1], T.DoubleType())])

    def kernel():
        def work(columns):
            (texts,) = columns
            langs, score = ["und"] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
            for s in range(0, len(rows), 256):
                part = rows[s : s + 256]
                found, p = model.predict(unit(np.stack([features(texts[i]) for i in part])))
                score[part] = p
                for i, lang in zip(part, found, strict=True):
                    langs[i] = lang
            return [langs, pa.array(score)], None

        return work

    return arrow_map(docs, [F.col(f"`{text_col}`")], schema, kernel, carry=carry)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, folds: int = 4, held: int = 2) -> DataFrame:
    """id, held_out, lang_pred, score of each row, with a model fitted on the rows whose fold isn't ``held``."""
    model = train(docs, id_col, text_col, lang_col, folds=folds, held=held)
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(fold(id_col, folds) == held, F.lit(False)).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    found = predict(named, model, carry=["id", "held_out"])
    return found.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")
