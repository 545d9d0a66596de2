"""Operator 5, exact dedup: a tree merge of sorted digest runs, DataFrame functions only.

Every row starts as an entry (digest, id, 1) of a numbered leaf run. In round k
``fan_in`` neighbouring runs meet: their entries are exchanged by (run, digest)
and sorted by (run, digest, id), which is Spark's multiway merge of the sorted
runs that the tasks hold, and of equal neighbours in the merged run one stays,
with the surviving identifier and the number of rows. ``log(runs, fan_in)``
rounds give one run. A run is dealt over all tasks by digest, so the root is
spread as widely as the leaves, and a text that fills a third of the table
comes to any task as at most ``fan_in`` entries of each run, at the leaves as
its rows of one leaf, which the number of runs keeps below ``LEAF_ROWS``.

The results go back down the same tree: a digest's entry at one level has at
most ``fan_in`` children at the next, and the rows join at the first level
above the leaves, where a hot digest is divided over all runs.

A digest counts as equal only if SHA-256, a second 64-bit hash and the byte
length all agree at every level.

Defined results: null text counts as empty; empty texts are equal to each
other; rows that share an id share its decision; a null id never survives a
group that has another id; an empty table gives an empty result; columns other
than the id and the text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, durable, free_name

KEY = ["digest", "check", "n_bytes"]
#: Rows of one text that a task may get at the leaves before another level is added.
LEAF_ROWS = 1 << 16


def merged(entries: DataFrame, fan_in: int, survivor: list[Column]) -> DataFrame:
    """One round: ``fan_in`` neighbouring runs of entries (key, run, keep_id, group_size) become one sorted run of distinct digests."""
    dealt = entries.withColumn("run", F.floor(F.col("run") / fan_in)).repartition("run", *KEY).sortWithinPartitions("run", *KEY, *survivor)
    equal = Window.partitionBy("run", *KEY)
    first = F.row_number().over(equal.orderBy(*survivor))
    total = F.sum("group_size").over(equal.orderBy(*survivor).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return dealt.select(*KEY, "run", "keep_id", total.alias("group_size"), first.alias("__place")).where("__place = 1").drop("__place")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "max", fan_in: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. ``keep``: max or min id survives."""
    survivor = [{"max": F.desc_nulls_last, "min": F.asc_nulls_last}[keep]("keep_id")]
    text = F.coalesce(ascii_lower(F.col(f"`{text_col}`")), F.lit(""))
    named = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(F.monotonically_increasing_id()).alias("leaf"))
    prints = durable(
        named.select("id", "leaf", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"), F.xxhash64("text").alias("check"), F.octet_length("text").cast("long").alias("n_bytes")),
        "digests",
    )
    rounds = max(3, 1 + math.ceil(math.log(max(1, prints.count() / LEAF_ROWS), fan_in)))
    leaves = prints.withColumn("run", F.pmod("leaf", F.lit(fan_in**rounds)))  # by place in the table: null and repeated ids are dealt as well as others

    levels = [leaves.select(*KEY, "run", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))]
    for _ in range(rounds):
        levels.append(merged(levels[-1], fan_in, survivor))

    known = levels[-1].where("group_size > 1")
    for level in reversed(levels[1:-1]):
        above = known.withColumnRenamed("run", "above")
        below = level.select(*KEY, "run").withColumn("above", F.floor(F.col("run") / fan_in))
        known = below.join(above, [*KEY, "above"]).drop("above")
    rows = leaves.withColumn("run", F.floor(F.col("run") / fan_in))
    return rows.join(known, [*KEY, "run"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each text of ``docs``, with all its columns. A row is decided by its text and its place, so no text is
    lost where ids are null or repeated: rows of one text that share the surviving id leave one row.

    Rows get a number that a written table makes last; the smallest number of a text's rows with the surviving id stays.
    The join is a merge at every size, so what moves grows with the input and with nothing else."""
    row, gone = free_name(docs, "row"), free_name(docs, "gone")
    own = durable(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    key, least = F.col(f"`{id_col}`"), options.get("keep", "max") == "min"
    rid = F.struct((key.isNull() if least else key.isNotNull()).alias("known"), key.alias("id"), (F.col(row) if least else -F.col(row)).alias("place"))
    found = exact_dedup(own.select(rid.alias("rid"), F.col(f"`{text_col}`").alias("text")), "rid", "text", **options)
    dropped = found.where(~F.col("kept")).select(F.abs(F.col("rid.place")).alias(gone))
    return own.join(dropped.hint("merge"), F.col(row) == F.col(gone), "left_anti").drop(row)


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents
), g AS (SELECT s, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY s)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.s) AS text_sha256
FROM t JOIN g ON t.s = g.s
"""
