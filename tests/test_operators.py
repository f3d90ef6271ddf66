"""Small known cases of the graph operators."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text
from weftgraph.operators import audit, codegraph, facts, frontier, log, scan, search, traverse
from weftgraph.operators.components import connected_components


def test_readiness_chain_and_unknown_gates(spark):
    checks = spark.createDataFrame([], "check_id string, item_id string")
    gates = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "ghost")], "item_id string, gate_id string")
    state = lambda **s: spark.createDataFrame(list(s.items()), "subject_id string, state string")
    got = {r.item_id: r.bucket for r in frontier.classify(state(a="open", b="open", c="open", d="open"), gates, checks).collect()}
    assert got == {"a": "ready", "b": "blocked", "c": "blocked", "d": "blocked"}
    got = {r.item_id: r.bucket for r in frontier.classify(state(a="done", b="open", c="open", d="done"), gates, checks).collect()}
    assert got == {"a": "done", "b": "ready", "c": "blocked", "d": "done"}


def test_checks_satisfy_gates_and_never_partition(spark):
    states = spark.createDataFrame([("arc", "open"), ("k", "done")], "subject_id string, state string")
    checks = spark.createDataFrame([("k", "x")], "check_id string, item_id string")
    gates = spark.createDataFrame([("arc", "k")], "item_id string, gate_id string")
    assert [tuple(r) for r in frontier.classify(states, gates, checks).select("item_id", "bucket").collect()] == [("arc", "ready")]


def test_filing_scores_direct_vote_and_cite(spark):
    items = spark.createDataFrame([("i",)], "item_id string")
    anchors = spark.createDataFrame([("a",), ("b",), ("c",)], "anchor_id string")
    edges = spark.createDataFrame([("i", "REFERENCES", "a"), ("i", "REFERENCES", "n1"), ("n1", "PART_OF", "b"), ("n1", "REFERENCES", "c")], "source_id string, relation_type string, target_id string")
    got = {r.anchor_id: r.score for r in audit.filing_scores(items, anchors, edges).collect()}
    assert got == {"a": 2.0, "b": 1.0, "c": 0.5}


def test_register_drift(spark):
    mk = lambda rows: spark.createDataFrame(rows, "value string, subject_id string")
    hubs = spark.createDataFrame([("v",)], "value string")
    r = audit.register_drift(mk([("v", "m1"), ("v", "m2")]), mk([("v", "m1"), ("v", "old")]), mk([("v", "m1"), ("v", "old"), ("v", "never")]), hubs).first()
    assert (r.members, r.missing_cache, r.stale_cache) == (2, 1, 1)


def test_log_latest_retire_revive_and_fold(spark):
    ops = spark.createDataFrame([(1, "k", "source", "A"), (2, "k", "retire", None), (3, "k", "source", "B"), (4, "j", "source", "A"), (5, "j", "retire", None)], "seq long, key string, op string, content string")
    assert [tuple(r) for r in log.latest_state(ops).collect()] == [("k", "B")]
    links = spark.createDataFrame([(1, "link", "a", "R", "b"), (2, "unlink", "a", "R", "b"), (3, "link", "a", "R", "c")], "seq long, verb string, source_id string, relation_type string, target_id string")
    once = log.replay_edges(links)
    assert [tuple(r) for r in once.collect()] == [("a", "R", "c")]
    again = links.withColumn("seq", F.col("seq") + 3)
    assert [tuple(r) for r in log.replay_edges(links.unionAll(again)).collect()] == [("a", "R", "c")]
    assert [tuple(r) for r in log.replay_edges(links.unionAll(links)).where("target_id = 'c'").collect()] == [("a", "R", "c")]


def test_session_windows_last_registration_wins(spark):
    ops = spark.createDataFrame([(1, "w1", 10.0), (2, "w2", 20.0), (3, "w1", 12.0)], "seq long, key string, started_at double")
    got = {r.key: (r.started_at, r.ended_at) for r in log.session_windows(ops).collect()}
    assert got == {"w1": (12.0, 20.0), "w2": (20.0, None)}
    rows = spark.createDataFrame([(1, 13.0, None), (2, 25.0, None), (3, 5.0, "w2")], "seq long, ts double, session string")
    assert {(r.seq, r.window_key) for r in log.session_ops(rows, log.session_windows(ops), width=4.0).collect()} == {(1, "w1"), (2, "w2"), (3, "w2")}


def test_sessions_of_equal_starts_and_quiet_slots(spark):
    import random

    r = random.Random(1)
    starts = [(k, f"w{k % 17}", float(r.choice([5, 900, 905, 4000, 4000, 9000, 90000]))) for k in range(40)]
    ops = [(k, float(r.choice([0, 4, 5, 899, 900, 3999, 4000, 4001, 50000, 90001, 200000])), r.choice([None, "w1", "w2"])) for k in range(120)]
    last = {key: at for _, key, at in starts}
    ends = {at: min((x for x in last.values() if x > at), default=None) for at in last.values()}
    windows = log.session_windows(spark.createDataFrame(starts, "seq long, key string, started_at double"))
    assert {tuple(x) for x in windows.collect()} == {(k, at, ends[at]) for k, at in last.items()}
    want = sorted([(s, tag) for s, _, tag in ops if tag] + [(s, k) for s, ts, tag in ops for k, at in last.items() if at <= ts and (ends[at] is None or ts < ends[at]) and tag != k])
    rows = spark.createDataFrame(ops, "seq long, ts double, session string")
    for width in (log.SLOT, 10.0):
        assert sorted((x.seq, x.window_key) for x in log.session_ops(rows, windows, width).collect()) == want
    assert log.session_ops(rows.where("false"), windows).count() == log.session_windows(windows.selectExpr("1L as seq", "key", "started_at").where("false")).count() == 0


def test_descendants_of_a_deep_chain_with_a_loop(spark):
    edges = spark.range(40).selectExpr("'n' || id as source_id", "'R' as relation_type", "'n' || (id + 1) as target_id").unionAll(spark.createDataFrame([("n40", "R", "n3"), ("n1", "S", "x")], "a string, b string, c string"))
    got = traverse.descendants(spark.createDataFrame([("n0",), ("n0",), ("lone",)], "id string"), edges, "R").collect()
    assert sorted(r.id for r in got) == sorted([f"n{i}" for i in range(41)] + ["lone"])


def test_versions_of_any_length(spark):
    texts = ["1.2", "1.10", "01.2", "20240101123456", "20240101123456.1", "9" * 60, "v1", None]
    parts = {r.t: r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.semver(F.col("t")).alias("p")).collect()}
    assert parts["v1"] is None and parts[None] is None and parts["1.2"] == parts["01.2"]
    numbers = sorted(texts[:6], key=lambda t: [int(x) for x in t.split(".")])
    for a, b in zip(numbers, numbers[1:]):
        assert [tuple(x) for x in parts[a]] <= [tuple(x) for x in parts[b]]
    claims = lambda rows: spark.createDataFrame(rows, "assertion_id string, slot_id string, predicate string, value string")
    registry = spark.createDataFrame([("version", "semver"), ("task_state", "task")], "predicate string, ordered string")
    old = claims([("o1", "s", "version", "20240101123455"), ("o2", "s", "version", "3"), ("o3", "t", "task_state", "open")])
    new = claims([("n1", "s", "version", "20240101123456"), ("n3", "t", "task_state", "done")])
    assert {tuple(r) for r in facts.auto_supersede(old, new, registry).collect()} == {("n1", "o1"), ("n1", "o2"), ("n3", "o3")}


def test_store_prunes_and_follows_its_sources(spark, tmp_path):
    from weftgraph.sources import store

    source = f"{tmp_path}/t.parquet"
    read = lambda: store.stored(spark, "t", spark.read.parquet(source).selectExpr("id % 3 as k", "cast(id as string) as v"), "k", [source])
    spark.range(9).coalesce(1).write.parquet(source)
    assert read().where("k = 1").count() == 3
    plan = read().where("k = 1").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(k" in plan and "ReadSchema: struct<v:string>" in plan
    spark.range(30).coalesce(1).write.mode("overwrite").parquet(source)
    assert read().count() == 30


def test_components_of_a_long_path(spark):
    links = spark.range(200).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    got = connected_components(links, "x", "y").collect()
    assert len(got) == 201 and {r.component for r in got} == {0}
    assert connected_components(links.where("false"), "x", "y").count() == 0


def test_contradictions_by_registry(spark):
    active = spark.createDataFrame([("1", "s", "x", "p", "Keep"), ("2", "s", "x", "p", "rename"), ("3", "t", "x", "q", "a"), ("4", "t", "x", "q", "b"), ("5", "u", "x", "p", "Keep"), ("6", "u", "x", "p", " keep ")], "assertion_id string, slot_id string, subject_id string, predicate string, value string")
    registry = spark.createDataFrame([("p", True, None, False)], "predicate string, typed boolean, ordered string, multivalued boolean")
    assert [r.slot_id for r in facts.contradictions(active, registry).collect()] == ["s"]
    assert [r.slot_id for r in facts.soft_conflicts(active, registry).collect()] == ["t"]


def test_fuzzy_ratio_is_exact(spark):
    import difflib

    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé_1") for _ in range(r.randint(1, 9)))
    many, asked = sorted({word() for _ in range(150)}), sorted({word() for _ in range(60)})
    ratio = lambda w, n: difflib.SequenceMatcher(None, n, w).ratio()
    want = {w: min((-round(ratio(w, n), 12), n) for n in many if ratio(w, n) >= 0.6)[1] for w in asked if any(ratio(w, n) >= 0.6 for n in many)}
    found = audit.fuzzy_suggest(spark.createDataFrame([(w,) for w in asked], "wanted string"), spark.createDataFrame([(n,) for n in many], "name string")).collect()
    assert {x.wanted: x.name for x in found} == want
    names = ["authoring", "authors", "journal", "journals"]
    got = {r.wanted: (r.name, r.ratio) for r in audit.fuzzy_suggest(spark.createDataFrame([("authorin",), ("zzz",)], "wanted string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {"authorin": ("authoring", round(difflib.SequenceMatcher(None, "authoring", "authorin").ratio(), 6))}


def test_scalar_functions(spark):
    row = spark.createDataFrame([("get_torch_device", "Self-hosting GRAPH arc; the arc!", "see deadbeef and 20260810", "pkg.sub.mod")], "n string, q string, t string, p string")
    r = row.select(text.name_tokens(F.col("n")).alias("a"), text.query_terms(F.col("q")).alias("b"), text.id_tokens(F.col("t")).alias("c"), text.resolve_relative(F.col("p"), F.lit(2), F.lit("x")).alias("d"), text.resolve_relative(F.col("p"), F.lit(4), F.lit("x")).alias("e")).first()
    assert set(r.a) == {"torch", "device"} and list(r.b) == ["self", "hosting", "graph", "arc"] and list(r.c) == ["deadbeef"]
    assert (r.d, r.e) == ("pkg.sub.x", "")


def test_arguments_are_checked():
    with pytest.raises(ValueError):
        scan.parse_where(["no equals sign"])
    with pytest.raises(ValueError):
        search.list_mode(label="A", relation="B")


def test_shared_neighbour_means_no_split(spark):
    m = spark.createDataFrame([("a", "m", "1"), ("b", "m", "1"), ("c", "m", "2"), ("d", "m", "2")], "id string, module_id string, cell_key string").selectExpr("*", "true as is_top", "true as is_public", "false as is_dunder")
    calls = spark.createDataFrame([("a", "z"), ("b", "z"), ("c", "y")], "caller string, callee string")
    assert [r.cell_key for r in codegraph.split_cells(m, calls).collect()] == ["2"]


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
