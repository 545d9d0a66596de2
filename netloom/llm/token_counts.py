"""Operator 1, token counts by the whole-token shortcut.

On the driver, every vocabulary string is encoded alone once; those that come
back as one token are proven (``bpe.proven``). In the tasks, texts are split
into words, a pre-token that is proven counts one, and only the rest is merged.
A worker keeps the counts of the words that it has met in a bounded table, so
most words cost one vectorised lookup.

Defined results: null text counts as empty (0 bytes, 0 tokens); special strings
inside a text count as the library counts them; ids are passed through, null
and repeated ones too; other columns are not read; an empty table gives an
empty result. No text is cut; a text of any length is counted in segments that
end at white space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import arrow_map


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 512) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of each row; ``tokenizer``: a byte-level BPE .json file."""
    data, whole = bpe.vocabulary(tokenizer)
    found = docs.schema[id_col]
    schema = T.StructType([T.StructField(id_col, found.dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def kernel():
        counter = bpe.coder(bpe.ByteCounter, data, whole)

        def work(columns):
            texts, ids = columns
            n = counter.counts(texts)
            sizes = np.fromiter((len(t.encode()) if t else 0 for t in texts), np.int64, len(texts))
            return [ids, pa.array(sizes), pa.array(n), pa.array(n > limit)], None

        return work

    return arrow_map(docs, [F.col(f"`{text_col}`"), F.col(f"`{id_col}`")], schema, kernel)
