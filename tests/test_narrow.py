"""What is left out before a shuffle: parts by the labels of their ends, rows by a bitmap of ids; ids hash their key once."""

from pyspark.sql import functions as F

from weftgraph.bind import Bound, definitions, uid_once, uid_parts
from weftgraph.model import stable_id
from weftgraph.operators import scan, traverse
from weftgraph.plans.frontier import parts


def test_labels_are_those_of_the_nodes_and_every_check_has_its_edge(spark, sf_dir):
    g = Bound(spark, sf_dir)
    nodes = g.nodes.select("id", "label").distinct()
    ends = [(g.labelled_edges, "source_id", "source_label"), (g.labelled_edges, "target_id", "target_label"), (g.labelled_claims, "subject_id", "subject_label")]
    for rows, end, label in ends:
        known = rows.select(end, label).distinct().join(nodes, nodes["id"] == rows[end])
        assert known.count() > 0 == known.where(f"{label} <> label").count()
    checks = g.labelled_claims.where("subject_label = 'Check'").select("subject_id")
    edges = g.edges.where("relation_type = 'CHECKS'").selectExpr("source_id as subject_id")
    assert checks.count() > 0 == checks.join(edges, "subject_id", "left_anti").count()


def test_items_and_gates_leave_the_checks_unread(spark, sf_dir):
    states, gates, checks = parts(Bound(spark, sf_dir))
    of = lambda rows: {f.rsplit("/", 1)[-1] for f in rows.inputFiles()}
    assert of(states) == of(gates) == {"orders.parquet"} and of(checks) == set()


def test_rows_of_the_ids_stay_and_most_others_go(spark):
    rows = spark.range(20_000).selectExpr("concat('n', id % 10000) as id", "id as row")
    ids = spark.range(0, 10_000, 500).selectExpr("concat('n', id) as id")
    left = {r.row for r in traverse.maybe_among(rows, "id", ids).collect()}
    assert left >= {i for i in range(20_000) if i % 500 == 0} and len(left) < 100
    assert traverse.among(rows, ids).count() == 40


def test_edges_that_cannot_be_inside_are_not_shuffled(spark):
    edges = spark.createDataFrame([("a", "R", "b"), ("b", "S", "c"), ("a", "R", "b"), ("c", "R", "a"), (None, "R", "a")], "source_id string, relation_type string, target_id string")
    inner = traverse.subgraph_edges(spark.createDataFrame([("a",), ("b",), ("a",)], "id string"), edges)
    assert sorted(map(tuple, inner.collect())) == [("a", "R", "b")] * 2
    assert "_bits" in inner._jdf.queryExecution().optimizedPlan().toString()


def test_an_id_is_one_digest(spark):
    row = spark.range(3).selectExpr(f"{uid_parts(chr(39) + 'Order|' + chr(39) + '||id')} as want", f"{uid_once(chr(39) + 'Order|' + chr(39) + '||id')} as got", "id")
    assert all(r.want == r.got == r.own for r in row.withColumn("own", stable_id("Order", row["id"])).collect())
    assert definitions("spark")["edges"].count("md5(") * 5 == definitions("duckdb")["edges"].count("md5(")


def test_repeats_of_rows_that_cannot_be_among_the_ids_are_not_dealt(spark):
    rows = spark.range(1000).selectExpr("id % 100 as n").distinct().selectExpr("concat('n', n) as id")
    left = traverse.maybe_among(rows, "id", spark.createDataFrame([("n7",), ("n8",)], "id string"))
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [n") < plan.index("LeftSemi") and {r.id for r in left.collect()} == {"n7", "n8"}


def test_edges_that_do_not_touch_the_ids_are_not_shuffled(spark, sf_dir):
    edges = spark.createDataFrame([("a", "R", "b"), ("b", "S", "c"), ("a", "R", "b"), ("c", "R", "a"), ("c", "R", "d"), (None, "R", "a"), ("d", "R", "d")], "source_id string, relation_type string, target_id string")
    ids = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "id string")
    found = scan.edges_touching(edges, ids)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, [("a", "R", "b"), ("b", "S", "c"), ("c", "R", "a"), (None, "R", "a")]))
    assert sorted(map(tuple, scan.edges_touching(edges, ids, both=True).collect())) == [("a", "R", "b")] * 2
    assert found._jdf.queryExecution().optimizedPlan().toString().count("_bits") >= 2
    g = Bound(spark, sf_dir)
    orders = g.table("orders").where("o_orderkey % 50 = 0").select(stable_id("Order", F.col("o_orderkey")).alias("id"))
    labelled = scan.edges_touching(g.labelled_edges, orders, label="Decision").select(*g.edges.columns)
    assert labelled.count() > 0 and sorted(labelled.collect()) == sorted(scan.edges_touching(g.edges, orders).collect())
