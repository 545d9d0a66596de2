"""Helpers shared by the training-data operators.

* ``durable`` cuts lineage with a Parquet table in the folder that the session
  names in ``spark.checkpoint.dir``, which every executor can read, so a lost
  executor never costs more than the stage that it was running.
* ``arrow_map`` runs a Python kernel over Arrow batches in slices of bounded
  text size and can carry the caller's own columns along, whatever their names.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space of the word pattern [^\x20\x09-\x0D]+; bytes.split() uses the same six.
SLICE_CHARS = 1 << 20
SLICE_ROWS = 4096
_WRITTEN: dict[str, list[str]] = {}


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only in local mode, as in tests, a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + (local := tempfile.mkdtemp(prefix="netloom-"))
        atexit.register(shutil.rmtree, local, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/netloom-{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def durable(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a table written with these options: its plan starts at the files from here on. Spark 4.1 may take a union of equally partitioned
    tables as partitioned though adaptive execution merges each side's partitions differently; that is switched off."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    path = shared_path(spark, label)
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, so that long texts don't pile up beside the JVM's heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int("".join(filter(str.isdigit, spark.conf.get(key)))) > BATCH_BYTES:
            spark.conf.set(key, str(BATCH_BYTES))
    except Exception:  # not a setting of this Spark version: rows bound the batches then
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def trim() -> None:
    """Give a worker's freed memory back to the system between tasks; workers live on and would keep their peak."""
    with contextlib.suppress(OSError, AttributeError):
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)


def written(spark: SparkSession) -> int:
    """How many tables the operators of this session have written so far."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, ()))


def release(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Delete the tables that were written after the first ``since``, but those whose label starts with ``keep``; what else was made of them is void then."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    tables = _WRITTEN.get(spark.sparkContext.applicationId, [])
    kept = [p for p in tables[since:] if keep and p.rsplit("/", 1)[-1].startswith(f"netloom-{keep}")]
    for path in tables[since:]:
        if path not in kept:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
    tables[since:] = kept


def slices(batch: pa.RecordBatch, text_at: int, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts together stay near ``limit`` bytes, of at most ``SLICE_ROWS`` rows; one text is never cut."""
    column = batch.column(text_at)
    sizes = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (total + n > limit or i - start == SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def arrow_map(
    docs: DataFrame,
    inputs: Sequence[Column],
    outputs: T.StructType,
    kernel: Callable[[], Callable[[list[list]], tuple[list, list[int] | None]]],
    *,
    carry: Sequence[str] = (),
    limit: int = SLICE_CHARS,
) -> DataFrame:
    """Apply a Python kernel to slices of rows.

    ``kernel()`` is called once per task and returns a function from the input
    columns (lists; the first is the text) to (output columns, row numbers or
    None for one output row per input row). Carried columns keep their names
    and come first; the inputs travel under positions, so no name can clash.
    """
    small_batches(docs.sparkSession)
    n = len(inputs)
    chosen = docs.select(*[c.alias(f"_{i}") for i, c in enumerate(inputs)], *[F.col(f"`{c}`") for c in carry])
    carried = [chosen.schema[n + i] for i in range(len(carry))]
    schema = T.StructType([*carried, *outputs.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = kernel()
        for batch in batches:
            for part in slices(batch, 0, limit):
                made, rows = work([part.column(i).to_pylist() for i in range(n)])
                kept = [part.column(n + i) for i in range(len(carried))]
                if rows is not None:
                    at = pa.array(rows, pa.int64())
                    kept = [c.take(at) for c in kept]
                columns = [c.cast(f.type) for c, f in zip(kept, arrow, strict=False)]
                columns += [c if isinstance(c, pa.Array) and c.type == f.type else (c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)) for c, f in zip(made, list(arrow)[len(kept) :], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        trim()

    return chosen.mapInArrow(run, schema)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores before it until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def sampled(rows: DataFrame, share: float | Column, purpose: str, *key: str) -> DataFrame:
    """About this share of ``rows``, chosen by a hash of their key; the share may be as small as the table is large."""
    place = F.xxhash64(F.lit(purpose), *key).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return rows.where(place < share)


def spread_join(rows: DataFrame, table: DataFrame, key: Sequence[str], by: Column, runs: int) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row per key) when a key may hold a third of ``rows``.

    ``rows`` is dealt into ``runs`` slices by ``by``. The distinct (key, slice)
    pairs, at most ``runs`` a key, fetch the key's row first; each row then
    joins within its slice, so no task gets more than its slice of a hot key.
    """
    run = "__run"
    dealt = rows.withColumn(run, F.pmod(F.xxhash64(by), F.lit(runs)))
    pairs = dealt.select(*key, run).distinct()
    return dealt.join(pairs.join(table, list(key)), [*key, run], "left").drop(run)
