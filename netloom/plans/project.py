"""Adapters from the test tables to network roles. The same integer arithmetic runs in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import steady

TABLES = "region nation customer supplier part orders lineitem events".split()
#: SQL of each role over the tables in braces.
ROLES = {
    "chambers": "SELECT CAST(s_suppkey AS BIGINT) AS chamber_id, CAST((s_suppkey * 15485863) % 100000 AS BIGINT) AS x, CAST((s_suppkey * 32452843) % 100000 AS BIGINT) AS y, CAST(s_suppkey % 5 AS INT) AS incident FROM {supplier}",
    "points": "SELECT CAST(c_custkey AS BIGINT) AS point_id, CAST((c_custkey * 7919) % 100000 AS BIGINT) AS x, CAST((c_custkey * 104729) % 100000 AS BIGINT) AS y, CAST(1 + c_custkey % 60 AS DECIMAL(18,3)) AS flow FROM {customer}",
    "tree": "SELECT CAST(p_partkey AS BIGINT) AS node, CASE WHEN p_partkey = 0 THEN NULL ELSE CAST(floor((p_partkey - 1) / 2) AS BIGINT) END AS up, CAST(10 + p_size AS DECIMAL(14,3)) AS length, CAST(p_size % 7 AS DECIMAL(18,3)) AS demand FROM {part}",
    "forest": "SELECT network * 1000 + CAST(floor((n - 1) / 7) AS BIGINT) AS network, (n - 1) % 7 + 1 AS node, length, flow FROM (SELECT CAST(l_orderkey AS BIGINT) AS network, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS n, CAST(1 + l_partkey % 160 AS DECIMAL(14,3)) AS length, CAST(1 + l_quantity % 9 AS DECIMAL(18,3)) AS flow FROM {lineitem}) numbered",
    "areas": "SELECT CAST(s_suppkey AS BIGINT) AS obstacle, CASE s_suppkey % 5 WHEN 0 THEN 'park' WHEN 1 THEN 'oks' WHEN 2 THEN 'road' WHEN 3 THEN 'tram_tracks' ELSE 'water' END AS kind, CAST((s_suppkey * 15485863) % 100000 AS DOUBLE) AS mx, CAST((s_suppkey * 32452843) % 100000 AS DOUBLE) AS my, CAST(2000 + 100 * (s_suppkey % 10) AS DOUBLE) + CAST(0.5 AS DOUBLE) AS half FROM {supplier}",
    "mains": "SELECT CAST(s_suppkey AS BIGINT) AS utility, CAST((s_suppkey * 15485863) % 100000 AS DOUBLE) AS cx, CAST((s_suppkey * 32452843) % 100000 AS DOUBLE) AS cy, CAST((s_suppkey * 15485863) % 100000 + (s_suppkey % 7 - 3) * 2100 + 500 AS DOUBLE) AS dx, CAST((s_suppkey * 32452843) % 100000 + (s_suppkey % 5 - 2) * 2300 + 300 AS DOUBLE) AS dy FROM {supplier}",
    "bends": "SELECT route, seq, CAST(x + CASE WHEN seq >= 2 THEN (route % 41 - 20) * 400 ELSE 0 END - CASE WHEN seq = 3 THEN (route % 37 - 18) * 300 ELSE 0 END AS DOUBLE) AS x, CAST(y + CASE WHEN seq >= 2 THEN (route % 37 - 18) * 400 ELSE 0 END + CASE WHEN seq = 3 THEN (route % 41 - 20) * 300 ELSE 0 END AS DOUBLE) AS y FROM (SELECT CAST(c_custkey AS BIGINT) AS route, CAST((c_custkey * 7919) % 100000 AS BIGINT) AS x, CAST((c_custkey * 104729) % 100000 AS BIGINT) AS y, 1 AS seq FROM {customer} UNION ALL SELECT c_custkey, (c_custkey * 7919) % 100000, (c_custkey * 104729) % 100000, 2 FROM {customer} UNION ALL SELECT c_custkey, (c_custkey * 7919) % 100000, (c_custkey * 104729) % 100000, 3 FROM {customer}) corners",
    "links": "SELECT CAST(p_partkey AS BIGINT) AS node, CASE WHEN p_partkey = 0 THEN NULL WHEN p_partkey % 97 = 0 THEN -1 WHEN p_partkey % 89 = 0 THEN CAST(p_partkey AS BIGINT) ELSE CAST(floor((p_partkey - 1) / 3) AS BIGINT) END AS up, CAST(p_size % 5 AS INT) AS valve FROM {part}",
    "vertices": "SELECT CAST(l_orderkey AS BIGINT) AS route, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS seq, CAST(l_partkey * 37 % 1000 AS BIGINT) AS x, CAST(l_suppkey * 53 % 1000 AS BIGINT) AS y FROM {lineitem}",
    "spans": "SELECT CAST(l_orderkey AS BIGINT) AS route, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS span, CAST(l_partkey % 900 AS BIGINT) AS s, CAST(l_partkey % 900 AS BIGINT) + CAST(l_quantity AS BIGINT) AS e, CASE l_returnflag WHEN 'R' THEN 'road' WHEN 'A' THEN 'gas_pipeline' ELSE 'heat_network' END AS type FROM {lineitem}",
    "variant_edges": "SELECT CAST(l_orderkey AS BIGINT) AS variant, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS edge, CAST(l_quantity AS DECIMAL(18,3)) AS flow, CAST(1 + l_partkey % 400 AS DECIMAL(14,3)) AS length, CASE l_returnflag WHEN 'R' THEN 'road' WHEN 'A' THEN 'gas_pipeline+heat_network' ELSE 'base' END AS crossing, CAST(l_suppkey % 10 AS INT) AS up_node, CAST(l_partkey % 10 AS INT) AS down_node FROM {lineitem}",
    "variants": "SELECT CAST(o_orderkey AS BIGINT) AS variant, CAST(o_custkey % 5 AS BIGINT) AS unconnected, CAST(o_custkey % 40 AS DECIMAL(18,3)) AS unconnected_flow FROM {orders}",
    "jobs": "SELECT CAST(event_id AS BIGINT) AS event_id, ts, CAST(user_id AS BIGINT) AS job_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'poll' END AS kind FROM {events}",
    "features": "SELECT CAST(c_custkey AS BIGINT) AS feature_index, CASE WHEN c_custkey % 50 = 0 THEN 'f0' ELSE concat('f', CAST(c_custkey AS VARCHAR(20))) END AS feature_id, CASE c_custkey % 8 WHEN 0 THEN 'source' WHEN 1 THEN 'heat_network' WHEN 2 THEN 'heat_chamber' WHEN 3 THEN 'oks_future' WHEN 4 THEN 'oks_connection_point' WHEN 5 THEN 'oks_existing' WHEN 6 THEN 'restriction' ELSE 'mystery' END AS object_type, CASE WHEN c_custkey % 11 = 0 THEN 'LineString' WHEN c_custkey % 8 IN (3, 5, 6) THEN 'Polygon' WHEN c_custkey % 8 = 1 THEN 'LineString' ELSE 'Point' END AS geometry_type, CAST(CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN -1 ELSE c_custkey % 40 END AS INT) AS flow, CAST(CASE WHEN c_custkey % 19 = 0 THEN 77 ELSE 50 END AS INT) AS diameter, concat('f', CAST(CASE WHEN c_custkey % 23 = 0 THEN -5 WHEN c_custkey % 8 = 4 THEN c_custkey - 1 ELSE CAST(floor(c_custkey / 8) AS BIGINT) * 8 + 1 END AS VARCHAR(20))) AS reference FROM {customer}",
}


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    steady(spark)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in ROLES[name]}
    return spark.sql(ROLES[name], **used)


def role_sql(*names: str) -> str:
    """The roles as the head of a WITH clause, for the SQL checks."""
    tables = {t: t for t in TABLES}
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({ROLES[n].format(**tables)})" for n in names)
