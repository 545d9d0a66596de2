"""Operator 3, best-fit packing with vectors of capacities.

A document's ids, with an end id, are cut only where they exceed a sequence's
token capacity. Each piece asks for a vector (tokens, documents, attention
cost = length squared) and a sequence offers one. Pieces go in order of
falling length into the open sequence that can take them in every dimension
and that the rule prefers: ``norm`` leaves the smallest weighted residual,
``dot`` has the largest weighted product of demand and residual.

Pieces are dealt by hash into shards of a fixed expected size, which are packed
apart from each other. Sequences that a round leaves with room are opened
again and their pieces packed in a second round of larger shards, and the loss
per shard, less than one sequence, stays a fixed small share at any size.

Defined results: null text counts as empty and is one piece of the end id;
texts of any length are cut into pieces, never dropped; repeated rows are
packed once each; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import arrow_map, durable

SHARD_PIECES = 4096
REPACK_PIECES = 16384
#: Limits of a sequence of 2,048 tokens beside its tokens: pieces, and the sum of their squared lengths.
MAX_DOCS, MAX_ATTENTION = 256, 0.95 * 2048**2
#: Sequences with more free tokens than this are opened again in the second round.
LOOSE_TOKENS = 8


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids as little-endian unsigned 32-bit integers) of every piece."""
    data, whole = bpe.vocabulary(tokenizer)
    fields = [(id_col, docs.schema[id_col].dataType), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    fields += [("ids", T.BinaryType())] * with_ids
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def kernel():
        coder = bpe.coder(bpe.WordCoder, data, whole)

        def work(columns):
            texts, ids = columns
            flat, lengths = coder.encode(texts, end_id)
            flat = flat.astype("<u4")
            out = [[] for _ in fields]
            at = 0
            for key, n in zip(ids, lengths.tolist(), strict=True):
                for piece, start in enumerate(range(0, n, capacity)):
                    own = flat[at + start : at + min(n, start + capacity)].tobytes()
                    for column, value in zip(out, (key, piece, start, len(own) // 4, zlib.crc32(own), own), strict=False):
                        column.append(value)
                at += n
            return out, range(len(out[0]))

        return work

    return arrow_map(docs, [F.col(f"`{text_col}`"), F.col(f"`{id_col}`")], schema, kernel)


def vector_best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length. Capacities: tokens, documents, attention cost; none is ever exceeded
    but the attention cost of a piece alone in its bin."""
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    scale = np.array(capacities, float)
    demand = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], 1) / scale
    demand[:, 2] = np.minimum(demand[:, 2], 1)
    w = np.array(weights, float)
    bins, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room, ids, open_n, made = np.zeros((64, 3)), np.zeros(64, np.int64), 0, 0
    used = np.zeros(n, np.int64)
    least = lengths.min() / scale[0] if n else 0
    for step, i in enumerate(order.tolist()):
        d = demand[i]
        if step % 128 == 127:  # what cannot take even the smallest piece is closed
            keep = np.flatnonzero((room[:open_n, 0] >= least - 1e-12) & (room[:open_n, 1] > 0))
            room[: len(keep)], ids[: len(keep)], open_n = room[keep], ids[keep], len(keep)
        left = room[:open_n] - d
        fits = np.flatnonzero(left.min(1) >= -1e-12) if open_n else ()
        if len(fits):
            left = left[fits]
            score = ((w * left) ** 2).sum(1) if rule == "norm" else -((w * d) * (left + d)).sum(1)
            at = fits[int(score.argmin())]
        else:
            if open_n == len(ids):
                room, ids = np.concatenate((room, np.zeros_like(room))), np.concatenate((ids, np.zeros_like(ids)))
            at, open_n = open_n, open_n + 1
            room[at], ids[at], made = 1.0, made, made + 1
        room[at] -= d
        b = ids[at]
        bins[i], offset[i] = b, used[b]
        used[b] += lengths[i]
    return bins, offset


def pack(pieces: DataFrame, *, capacity: int = 2048, max_docs: int | None = None, max_attention: float | None = None, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), rule: str = "norm") -> DataFrame:
    """``pieces`` (columns of ``token_pieces``) with sequence_id and offset. ``max_docs``: pieces in one sequence;
    ``max_attention``: sum of squared lengths in one sequence, which only a piece alone may exceed. Unset, neither binds."""
    limits = (float(capacity), float(max_docs or capacity), float(max_attention or capacity * capacity))
    names = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("__loose", T.BooleanType())])

    def packed(df: DataFrame, shards: int, number: int) -> DataFrame:
        def run(key, group):
            shard = key[0].as_py()
            group = group.drop_columns("__shard").combine_chunks()
            lengths = group.column("length").to_numpy()
            bins, offset = vector_best_fit(lengths, limits, weights, rule)
            fill = np.bincount(bins, lengths)
            loose = (capacity - fill)[bins] > LOOSE_TOKENS
            for name, values in (("sequence_id", (bins << 24 | shard) * 2 + number), ("offset", offset), ("__loose", loose)):
                group = group.append_column(name, pa.array(values))
            return group

        shard = F.pmod(F.xxhash64(*names), F.lit(shards)).alias("__shard")
        return df.select(*names, shard).groupBy("__shard").applyInArrow(run, schema)

    first = durable(packed(pieces, max(1, round(pieces.count() / SHARD_PIECES)), 0), "packed")
    loose = first.where("__loose").select(*names)
    again = packed(loose, max(1, round(loose.count() / REPACK_PIECES)), 1)
    return first.where("NOT __loose").unionByName(again).drop("__loose")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, **options) -> DataFrame:
    pieces = durable(token_pieces(docs, tokenizer, id_col, text_col, capacity=capacity, end_id=end_id, with_ids=with_ids), "pieces")
    return pack(pieces, capacity=capacity, **options)
