"""Interval joins, and node links over sequences with holes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdigraph.operators import flow as G
from verdigraph.operators.intervals import overlaps

SPAN = "k int, start bigint, end bigint, name int"


def spans(r, n, sizes):
    rows = []
    for i in range(n):
        s = r.randint(-3000, 3000)
        rows.append((r.choice([1, 1, 1, 2, None]), s, s + r.choice(sizes), i % (n - 5)))
    return [*rows, (1, None, 5, -1), (1, 5, None, -2), (1, 7, 7, -3), (1, 9, 2, -4), (1, -(2**40), 2**40, -5), (2, -(2**62), 2**62, -6)]


def meets(a, b):
    return None not in (a[0], a[1], a[2], b[1], b[2]) and a[0] == b[0] and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2]


@pytest.mark.parametrize("seed, left, right", [(1, [1], [1, 2, 40]), (2, [1, 15, 16, 17, 300], [0, 1, 256, 257, 5000]), (3, [1000, 9], [1])])
def test_overlaps_equal_a_plain_comparison(spark, seed, left, right):
    r = random.Random(seed)
    a, b = spans(r, 120, left), spans(r, 150, right)
    got = overlaps(spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN), ["k"])
    assert got.columns == ["k", "left", "right"]
    want = Counter((x[0], x[1:], y[1:]) for x in a for y in b if meets(x, y))
    assert Counter((x["k"], tuple(x["left"]), tuple(x["right"])) for x in got.collect()) == want and len(want) > 50


def test_a_table_overlaps_itself_and_an_empty_one(spark):
    rows = [(1, 0, 10, 0), (1, 5, 6, 1), (1, 10, 11, 2)]
    df = spark.createDataFrame(rows, SPAN)
    got = {(x["left"]["name"], x["right"]["name"]) for x in overlaps(df, df, ["k"]).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (0, 1), (1, 0)}
    assert overlaps(df, df.limit(0), ["k"]).count() == 0 and overlaps(df.limit(0), df, ["k"]).count() == 0


def test_no_pair_of_short_spans_meets_at_a_long_ones_level(spark):
    """One span over all places, many single places that never meet: the join makes one row a place and no more."""
    points = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") * 2).alias("start"), (F.col("id") * 2 + 1).alias("end"))
    wide = spark.createDataFrame([(1, 0, 10_000)], "k int, start bigint, end bigint")
    odd = points.select("k", (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"))
    assert overlaps(points.union(wide), odd.union(wide), ["k"]).count() == 5000 + 5000 + 1


NODE = "idx int, pos int, node int, dep_nodes array<int>"


def test_nodes_are_placed_by_position_with_gaps(spark):
    nodes = spark.createDataFrame([(1, 40, 0, []), (1, 7, 1, [0]), (1, 8, 2, [0]), (2, 7, 0, [])], NODE)
    tokens = spark.createDataFrame([(1, 40, 9, 12), (1, 7, 2, 3), (1, 3, 0, 1), (3, 7, 0, 1)], "idx int, pos int, start int, end int")
    got = sorted(tuple(r) for r in G.place_nodes(nodes, tokens, 4).collect())
    assert got == [(1, 0, 9, 12, [], 13, 17), (1, 1, 2, 3, [0], 13, 17)]


def test_links_over_all_places_equal_those_without_holes(spark):
    r = random.Random(5)
    rows = []
    for idx in range(6):
        for node in range(8):
            s = r.randint(0, 40)
            rows.append((idx, node, s, s + r.randint(0, 6), [r.randint(0, 9) for _ in range(r.randint(0, 3))], 42, 49))
    nodes = spark.createDataFrame(rows, "idx int, node int, start int, end int, dep_nodes array<int>, node_index int, length int")
    places = spark.range(42).crossJoin(spark.range(6).select(F.col("id").cast("int").alias("idx"))).select("idx", F.col("id").alias("col"))
    whole = {tuple(x) for x in G.attention_links(nodes).collect()}
    assert {tuple(x) for x in G.span_links(nodes, places).collect()} == whole
    held = places.where("col % 3 <> 0")
    left = {x for x in whole if all(p >= 42 or p % 3 for p in x[1:])}
    assert {tuple(x) for x in G.span_links(nodes, held.union(held)).collect()} == left and left != whole


def test_links_do_not_plan_their_nodes_again(spark):
    edges = G.reindex_edges(G.prune_edges(G.function_flow(spark.createDataFrame([(1, "{ a = b; c = a; }")], "idx bigint, func string"))))
    nodes = edges.withColumn("node_index", F.col("length")).withColumn("length", F.col("length") + 12)
    links = G.span_links(nodes, nodes.select("idx", F.lit(3).cast("bigint").alias("col")).distinct().limit(1))
    assert "aggregate(" in nodes._jdf.queryExecution().optimizedPlan().toString()
    places_free = G.span_links(nodes, spark.createDataFrame([(1, 3)], "idx bigint, col bigint"))
    assert "aggregate(" not in places_free._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, links.collect())) == sorted(map(tuple, places_free.collect()))


def test_unrolled_spans_are_not_sent_to_all_tasks(spark):
    """A guess by the packed source takes unrolled rows for small, and the driver would hold them all."""
    nodes = spark.range(9).selectExpr("id % 3 AS idx", "id AS pos", "id AS node", "array(id) AS dep_nodes")
    spans = spark.range(9).selectExpr("id % 3 AS idx", "id AS pos", "2 * id AS start", "2 * id + 2 AS end")
    placed = G.place_nodes(nodes, spans, 12)
    met = overlaps(spans.select("idx", "start", "end"), spans.select("idx", "start", "end"), ["idx"])
    for df, joins in ((placed, 2), (met, 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == joins and "Broadcast" not in plan
    assert placed.count() == 9 and met.count() == 9


def test_bounds_keep_their_types(spark):
    left = spark.sql("SELECT 'k' AS k, CAST(1 AS INT) AS start, CAST(4 AS SMALLINT) AS end, 'a' AS x")
    right = spark.sql("SELECT 'k' AS k, 2.5D AS start, CAST(3 AS BIGINT) AS end, CAST(NULL AS STRING) AS y")
    met = overlaps(left, right, ["k"])
    assert dict(met.dtypes)["left"] == "struct<start:int,end:smallint,x:string>" and dict(met.dtypes)["right"] == "struct<start:double,end:bigint,y:string>"
    assert [tuple(r["left"]) + tuple(r["right"]) for r in met.collect()] == [(1, 4, "a", 2.5, 3, None)]
