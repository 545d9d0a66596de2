"""The SQL of merged intervals on spans that occur several times, against the query and a plain merge."""

import duckdb
import pytest

from netloom import registry


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    path = tmp_path_factory.mktemp("repeated")
    duckdb.connect().execute(f"""COPY (SELECT CAST(i % 3000 AS BIGINT) AS l_orderkey, CAST((i * 2654435761 % 4294967296) % 12 * 60 AS BIGINT) AS l_partkey, CAST(1 AS BIGINT) AS l_suppkey, CAST(i // 3000 AS INT) AS l_linenumber,
        CAST(10 AS DOUBLE) AS l_quantity, CAST(i AS DOUBLE) AS l_extendedprice, 'R' AS l_returnflag FROM range(120000) r(i)) TO '{path}/lineitem.parquet' (FORMAT parquet)""")
    return str(path)


def merged(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out


@pytest.mark.parametrize("name", ["merge_intervals", "crossing_plateaus", "depth_floors", "domain_intersection"])
def test_equal_intervals(spark, repeated, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{repeated}/lineitem.parquet'")
    columns = ", ".join(registry.QUERIES[name](spark, repeated).columns)
    wanted = sorted(c.execute(f"SELECT {columns} FROM ({registry.ORACLES[name]})").fetchall())
    assert sorted(map(tuple, registry.QUERIES[name](spark, repeated).collect())) == wanted
    if name == "merge_intervals":
        spans = {}
        for route, s, e in c.execute("SELECT l_orderkey, l_partkey % 900, l_partkey % 900 + 10 FROM lineitem").fetchall():
            spans.setdefault(route, []).append((s, e))
        assert wanted == sorted((k, *v) for k, own in spans.items() for v in merged(own))
