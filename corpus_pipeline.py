"""Corpus pipeline: documents to packed sequences, every stage an operator of netloom.llm.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the
columns of its input; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import exact_dedup, language_id, packing, quality, simhash
from netloom.llm.common import durable, free_name, release, written

#: A document goes if its language is undetermined or its language's score is below this.
LEAST_LANGUAGE_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model knows with some certainty. Null texts, texts without a letter and, where nothing is labelled, all texts go; repeated rows share their fate; an empty table stays empty."""
    model = language_id.train(docs)
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = language_id.predict(docs, model, (lang, score), carry=docs.columns)
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the quality model. Null and very short texts go; without labels of both kinds only the rules decide; repeated rows share their fate; an empty table stays empty."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    prefix = "verdict_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return quality.judge(docs, model, carry=docs.columns, prefix=prefix).where(F.col(f"{prefix}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the largest id, of each group of texts equal but for the case of A-Z; null texts count as one group of empty ones. Rows without an id go before rows that have one; no text is lost."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no kept document with a smaller id is near: five-word shingles, Jaccard 0.8. Texts without words are near each other; rows without an id stay."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 tokens: one row per piece, with its place. Null text is one piece of the end id; an empty table gives no rows."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), max_docs=packing.MAX_DOCS, max_attention=packing.MAX_ATTENTION)


STAGES = [("language_id", language), ("quality_rules", rules), ("exact_dedup", exact), ("simhash_near_dedup", near), ("best_fit_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = written(spark)
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, before, keep="stage-")
    return STAGES[-1][1](spark, docs, sf_dir)
