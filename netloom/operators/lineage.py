"""Cutting the lineage of iterative operators at tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Where the tables of ``cut`` lie.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def steady(spark: SparkSession) -> None:
    """Switch off that Spark 4.1 takes a union of equally partitioned tables as partitioned: adaptive execution may merge the
    partitions of each side differently, and rows of one key then lie apart (seen in ``inside_intervals``). Geometry makes
    methods of more than 8,000 bytes, which Java never compiles and runs many times slower; such stages are split."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one stands in only in local mode, where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="netloom-")
        atexit.register(shutil.rmtree, folder, True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """``df`` dealt by ``key`` into a fixed number of partitions. Adaptive execution merges partitions by their bytes, but in a
    join of cells each small row meets very many others, and merged ones leave all of that to one or two tasks."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *key)


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a table written once to files that all executors can read. A checkpoint would compute it twice, and would
    hand its constraints on to the next plan, which in loops makes them grow beyond measure."""
    steady(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/netloom-cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that a loop has gone beyond; what was made of them and not written is void."""
    spark = tables[0].sparkSession
    for table in tables:
        target = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(table))
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
