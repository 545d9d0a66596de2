"""Grouped Python kernels over many small groups.

Groups are exchanged once by key and sorted within partitions; a task walks its
batches, whose columns become lists once, and hands on whole groups as slices of
these lists, so a group costs a few slices, neither a Python call with its own
Arrow exchange nor a pandas frame. Only one group and one batch are held at a
time. Partitions are dealt (``dealt``): small rows may be much work, and adaptive
execution, which merges partitions by bytes, left whole tables to one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from .lineage import cut, dealt

#: Rows of a group up to which it is worked on within a task; larger ones go by joins over all of their rows.
SMALL = 1000


def map_groups(df: DataFrame, key: str, order: list[str], kernel: Callable[[SimpleNamespace], list[tuple]], schema: str, columns: list[str], nulls: bool = False) -> DataFrame:
    """``kernel`` gets the rows of one key, sorted by ``order``, as one list for each column, and returns result rows. Rows without a
    key are left out, or with ``nulls`` are a group of their own."""
    names = df.columns
    at = names.index(key)
    out = to_arrow_schema(DataType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] | None = None  # rows of one key that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [c.to_pylist() for c in batch.columns]
            values = lists[at]
            edges = [i for i in range(1, len(values)) if values[i] != values[i - 1]]
            rows: list[tuple] = []
            if held and held[at][0] != values[0]:
                rows += kernel(SimpleNamespace(**dict(zip(names, held, strict=True))))
                held = None
            start = 0
            for end in edges:
                group = [c[start:end] for c in lists]
                if held:
                    for own, more in zip(held, group, strict=True):
                        own += more
                    group, held = held, None
                rows += kernel(SimpleNamespace(**dict(zip(names, group, strict=True))))
                start = end
            if held:
                for own, c in zip(held, lists, strict=True):
                    own += c[start:]
            else:
                held = [c[start:] for c in lists]
            yield table(rows)
        if held:
            yield table(kernel(SimpleNamespace(**dict(zip(names, held, strict=True)))))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        lists = list(zip(*rows, strict=True)) or [()] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(lists, out, strict=True)], schema=out)

    rows = df if nulls else df.where(df[key].isNotNull())
    return dealt(rows, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def by_size(df: DataFrame, key: str, small: int = SMALL) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``df``, a table that is cheap to read twice, whose ``key`` has up to ``small`` rows, and the others, None if there are none."""
    large = cut(df.groupBy(F.col(key).alias("large")).count().where(F.col("count") > small).select("large"))
    if large.isEmpty():
        return df, None
    same = df[key].eqNullSafe(large["large"])
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")
