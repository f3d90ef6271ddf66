"""What a query leaves unread: pairs of other predicates, a second reading of the edges, a second dealing of the checks."""

import re

from weftgraph.bind import Bound
from weftgraph.model import TEXT_FIELDS
from weftgraph.operators import anchors, audit, facts, frontier, search, traverse
from weftgraph.plans import batches, reconcile
from weftgraph.plans import frontier as work


def test_active_claims_of_a_predicate_leave_pairs_of_others_unread(spark, sf_dir):
    g = Bound(spark, sf_dir)
    active = facts.active_claims(g.claims, g.supersedes)
    of = lambda rows: {f.rsplit("/", 1)[-1] for f in rows.inputFiles()}
    assert "lineitem.parquet" not in of(active.where("predicate = 'priority'"))
    assert "lineitem.parquet" not in of(anchors.lead_structure(active, g.edges))
    plain = facts.active_claims(g.claims, g.supersedes.select("superseder", "superseded"))
    assert sorted(active.select("assertion_id").collect()) == sorted(plain.select("assertion_id").collect())


def test_pairs_name_the_predicate_of_their_claims(spark, sf_dir):
    g = Bound(spark, sf_dir)
    claims = g.claims.select("assertion_id", "predicate").distinct()
    for end in ("superseder", "superseded"):
        named = g.supersedes.join(claims.withColumnRenamed("assertion_id", end).withColumnRenamed("predicate", "own"), end)
        assert named.where("own <> predicate").count() == 0 < named.count()


def test_neighbours_read_the_edges_once(spark):
    edges = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c"), ("c", "S", "c"), ("d", "S", "a"), ("a", "R", "b")], "source_id string, relation_type string, target_id string")
    found = search.neighbours(spark.createDataFrame([("a",), ("c",), ("a",)], "id string"), edges)
    assert sorted(map(tuple, found.collect())) == sorted([("a", "out", "R", "b")] * 2 + [("a", "in", "S", "d"), ("c", "in", "R", "b"), ("c", "out", "S", "c"), ("c", "in", "S", "c")])
    assert found._jdf.queryExecution().analyzed().toString().count("LogicalRDD [source_id") == 1


def test_pins_deal_only_the_nodes_that_they_name(spark, sf_dir):
    g = Bound(spark, sf_dir)
    lead = spark.createDataFrame([("pin", "a", "reads", "n1 - one"), ("pin", "a", "reads", "gone - two")], "kind string, subject_id string, key string, value string")
    nodes = g.nodes.limit(1).selectExpr("'n1' as id", "'Named' as title", *(c for c in g.nodes.columns if c not in ("id", "title")))
    found = anchors.pins(lead, spark.createDataFrame([("a",)], "anchor_id string"), g.nodes.unionByName(nodes))
    assert sorted((r.id, r.title, r.missing) for r in found.collect()) == [("gone", None, True), ("n1", "Named", False)]
    assert "BroadcastHashJoin" in str(found._jdf.queryExecution().executedPlan())


def test_checks_are_dealt_once(spark):
    checks = spark.createDataFrame([("k1", "i1"), ("k1", "i1"), ("k1", "i2"), ("k2", "i1")], "check_id string, item_id string")
    states = spark.createDataFrame([("k1", "done")], "subject_id string, state string")
    out = frontier.dod_summary(checks, states)
    assert sorted(map(tuple, out.collect())) == [("i1", 2, 1, 1), ("i2", 1, 1, 0)]
    plan = re.sub(r"#\d+", "", str(out._jdf.queryExecution().executedPlan()))
    assert "hashpartitioning(check_id, item_id" not in plan and "hashpartitioning(check_id," in plan


def test_only_nodes_that_subjects_may_name_are_dealt(spark):
    nodes = spark.createDataFrame([("aaaaaaaa-0000-0000-0000-000000000001",), ("aaaaaaaa-0000-0000-0000-000000000001",), ("abcdef00-0000-0000-0000-000000000002",), ("abcdef11-0000-0000-0000-000000000003",)], "id string")
    subjects = spark.createDataFrame([("aaaaaaaa-0000-0000-0000-000000000001",), ("ABCDEF0",), ("abcdef",), ("abcdefff",), ("new",), ("new",)], "subject string")
    found = facts.resolve_subjects(subjects, nodes, spark.createDataFrame([], "name string, id string"))
    assert sorted((r.subject, r.outcome) for r in found.collect()) == [("ABCDEF0", "prefix"), ("aaaaaaaa-0000-0000-0000-000000000001", "id"), ("abcdef", "ambiguous"), ("abcdefff", "unresolved"), ("new", "minted")]
    assert "_bits" in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_batch_reads_claims_of_its_predicates_only(spark, sf_dir):
    g = Bound(spark, sf_dir)
    assert {r.predicate for r in batches._requests(g).select("predicate").distinct().collect()} == set(batches.PREDICATES)
    of = lambda rows: {f.rsplit("/", 1)[-1] for f in rows.inputFiles()}
    assert "orders.parquet" not in of(facts.active_claims(g.claims.where(batches.mine()), g.supersedes.where(batches.mine())))


def test_only_edges_that_may_link_a_reference_are_dealt(spark, sf_dir):
    found = spark.createDataFrame([("a", "t1", "b"), ("a", "t2", "c"), ("d", "t1", "b"), ("d", "t3", None), ("e", "t4", "b"), ("e", "t4", "c")], "source_id string, token string, id string")
    edges = spark.createDataFrame([("b", "R", "a"), ("c", "R", "b"), ("a", "R", "d"), ("e", "R", "c"), ("e", "S", "c")], "source_id string, relation_type string, target_id string")
    left = audit.prose_refs_unlinked(found, edges)
    assert sorted(map(tuple, left.collect())) == [("a", "t2", "c", False), ("d", "t1", "b", False)]
    assert "_bits" in left._jdf.queryExecution().optimizedPlan().toString()
    g = Bound(spark, sf_dir)
    plain = audit.prose_refs_unlinked(reconcile.prose(g), g.edges)
    rows = reconcile.prose_refs_unlinked(g)
    assert rows.count() > 0 and sorted(rows.collect()) == sorted(plain.collect())


def test_states_of_some_claims_are_those_of_their_subjects(spark, sf_dir):
    g = Bound(spark, sf_dir)
    checks = frontier.checks_of(g.edges).where("item_id like '1%'")
    some = work.states(g, g.claims.join(checks.selectExpr("check_id as subject_id"), "subject_id", "left_semi"))
    want = frontier.dod_summary(checks, work.states(g))
    assert want.count() > 0 and sorted(frontier.dod_summary(checks, some).collect()) == sorted(want.collect())


def test_a_text_is_read_once_for_all_terms(spark):
    nodes = spark.createDataFrame([("n1", "red fox"), ("n2", "red"), ("n3", None), ("n4", "none")], "id string, name string")
    nodes = nodes.selectExpr("id", "name", *(f"cast(null as string) as {f}" for f in TEXT_FIELDS if f != "name"))
    found = search.find_seeds(nodes, "red fox tail")
    assert [tuple(r) for r in found.collect()] == [("n1", 2, 0), ("n2", 1, 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("concat_ws") == 1


def test_few_ids_are_sent_to_the_rows(spark, monkeypatch):
    rows, ids = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "k string, n long"), spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    few = traverse.narrowed(rows, "k", ids)
    assert sorted(r.n for r in few.collect()) == [1, 3] and "_bits" not in str(few._jdf.queryExecution().optimizedPlan())
    monkeypatch.setattr(traverse, "FEW", 1)
    assert "_bits" in str(traverse.narrowed(rows, "k", ids)._jdf.queryExecution().optimizedPlan().toString())
