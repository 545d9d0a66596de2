"""Grouped kernels: groups across batches, null keys, empty results and the way groups are dealt."""

from netloom.operators import groups, routing


def test_groups_across_batches(spark):
    def counted(table):
        return [(table.k[0], len(table.v), table.v[-1])] if len(table.v) > 1 else []

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(k, v) for k in (None, *range(7)) for v in range((k if k is not None else 4) * 2)]
        df = spark.createDataFrame(rows, "k long, v long").repartition(3)
        expected = {(k, 2 * k, 2 * k - 1) for k in range(1, 7)}
        assert set(map(tuple, groups.map_groups(df, "k", ["v"], counted, "k long, n long, last long", ["k", "n", "last"]).collect())) == expected
        assert set(map(tuple, groups.map_groups(df, "k", ["v"], counted, "k long, n long, last long", ["k", "n", "last"], nulls=True).collect())) == expected | {(None, 8, 7)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_small_rows_are_not_left_to_one_task(spark):
    """Adaptive execution merges partitions by bytes; a search is much work for few bytes."""
    pairs = spark.range(200).selectExpr("id AS problem", "1 AS pair", "0 AS ax", "0 AS ay", "100 AS bx", "0 AS by")
    boxes = spark.range(200).selectExpr("id AS problem", "40 AS x1", "-10 AS y1", "60 AS x2", "10 AS y2")
    found = routing.route_pairs(pairs, boxes, 0.0)
    assert found.where("bends > 0").count() == 200
    assert found.selectExpr("spark_partition_id() AS p").distinct().count() > 1


def test_pairs_without_boxes_and_boxes_without_pairs(spark):
    pairs = spark.createDataFrame([(1, 1, 0, 0, 9, 0), (1, 2, 0, 0, 0, 5), (None, 1, 0, 0, 3, 4)], "problem long, pair int, ax long, ay long, bx long, by long")
    boxes = spark.createDataFrame([(2, 0, 0, 1, 1)], "problem long, x1 long, y1 long, x2 long, y2 long")
    found = {(r.problem, r.pair): (r.length, r.bends) for r in routing.route_pairs(pairs, boxes).collect()}
    assert found == {(1, 1): (9.0, 0), (1, 2): (5.0, 0), (None, 1): (5.0, 0)}
