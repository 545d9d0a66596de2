"""Every registered network query against DuckDB on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from netloom import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(str, frame[columns].astype(str).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    found = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLES:
        assert rows(found) == rows(duck.execute(registry.ORACLES[name]).df())
    else:
        assert len(found)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_training_operators(tmp_path):
    """The rest imports and registers its queries when the subpackage and the pipeline are away, and when only the subpackage is."""
    root = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    shutil.copytree(root / "netloom", tmp_path / "netloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q) and not any(n.startswith('op1_') or n == 'pipeline' for n in q)"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
