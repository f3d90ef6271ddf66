"""Components of coupled members against brute force; calls are read for modules of several groups only."""

import collections
import random

from pyspark.sql import functions as F

from weftgraph.bind import Bound
from weftgraph.operators import codegraph as cg
from weftgraph.plans import code

MEMBERS = "id string, name string, module_id string, is_top boolean, is_public boolean, is_dunder boolean"
CALLS = "caller string, callee string, caller_module string, callee_module string"


def test_components_by_names_neighbours_and_calls(spark):
    rows = [("a1", "red_ball", "a"), ("a2", "red_box", "a"), ("a3", "tall_box", "a"), ("a4", "get", "a"), ("a5", "get", "a"), ("a6", "lamp", "a"), ("a7", "lamp", "a"), ("a8", None, "a")]
    rows += [("b1", "one", "b"), ("b2", "two", "b"), ("b3", "three", "b"), ("c1", "up_x", "c"), ("c2", "up_y", "c"), ("n1", "same", None), ("n2", "same", None)]
    members = spark.createDataFrame([(*r, True, True, False) for r in rows], MEMBERS)
    home = {i: m for i, _, m in rows}
    calls = [("a4", "b1"), ("b2", "a4"), ("a7", "b3"), ("a6", "a8"), ("c1", "a1"), ("b1", "b1")]
    call = spark.createDataFrame([(x, y, home[x], home[y]) for x, y in calls], CALLS)
    got = {r.id: r.component for r in cg.coupling_components(members, call).collect()}
    assert got == {"a1": "a1", "a2": "a1", "a3": "a1", "a4": "a4", "a5": "a5", "a6": "a6", "a7": "a6", "a8": "a6", "b1": "b1", "b2": "b1", "b3": "b3", "c1": "c1", "c2": "c1", "n1": "n1", "n2": "n2"}


def test_modules_of_one_group_read_no_calls(spark):
    members = spark.createDataFrame([(f"m{i}", "left_hand", "m", True, True, False) for i in range(5)], MEMBERS)
    fails = F.raise_error(F.lit("calls were read")).cast("string")
    call = spark.range(3).select(*(fails.alias(c.split()[0]) for c in CALLS.split(", ")))
    assert {r.component for r in cg.coupling_components(members, call).collect()} == {"m0"}


def test_pairs_of_a_module_in_many_blocks_come_once_and_unshuffled(spark):
    rng = random.Random(3)
    keys = {(m, f"{m}{i}", f"k{rng.randint(0, 25)}") for m in "ab" for i in range(40) for _ in range(4)}
    keys |= {(None, "n1", "k"), (None, "n2", "k"), ("c", "c1", "one"), ("c", "c2", "other")}
    of = collections.defaultdict(set)
    for m, i, k in keys:
        of[m, i].add(k)
    want = sorted((m, a, b) for m, a in of for n, b in of if m and m == n and a < b and of[m, a] & of[n, b])
    frame = spark.createDataFrame(sorted(keys, key=str), "module_id string, id string, key string")
    for size in (3, 7, 512):
        assert sorted(map(tuple, cg.coupling_pairs(frame, size).collect())) == want
    plan = str(cg.coupling_pairs(frame)._jdf.queryExecution().executedPlan())
    assert "hashpartitioning(a#" not in plan and "(module_id#" not in plan.split("FlatMapGroupsInArrow")[0]


def test_calls_are_dealt_by_natural_keys_and_tell_of_their_ends(spark, sf_dir):
    g = Bound(spark, sf_dir)
    plain, keyed = cg.calls(g.edges, code.members(g)), code.calls(g)
    assert sorted(map(str, keyed.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert {"caller_public", "callee_cell"} <= set(keyed.columns)
    deals = [line for line in str(keyed._jdf.queryExecution().executedPlan()).split("\n") if "hashpartitioning" in line]
    assert deals and not any("md5" in line for line in deals) and dict(code.by_key(g)[1].dtypes)["caller"] == "bigint"


def test_a_member_goes_to_a_block_once_with_all_its_shared_keys(spark):
    keys = spark.createDataFrame([("m", i, f"k{j}") for i in ("a", "b") for j in range(5)] + [("m", "a", "own"), ("m", "c", "alone")], "module_id string, id string, key string")
    packs = cg.packed_keys(keys).collect()
    assert sorted((r.id, len(set(r["keys"]))) for r in packs) == [("a", 5), ("b", 5)] and set(packs[0]["keys"]) == set(packs[1]["keys"])


def test_a_neighbour_of_one_member_both_ways_is_not_shared_and_ends_are_not_joined_again(spark):
    members = spark.createDataFrame([(i, "m", c, True, True, False) for i, c in (("a", "1"), ("b", "1"), ("c", "2"), ("d", "2"))], "id string, module_id string, cell_key string, is_top boolean, is_public boolean, is_dunder boolean")
    members = members.selectExpr("*", "'r' as repo_key")
    edges = spark.createDataFrame([("a", "CALLS", "c"), ("c", "CALLS", "a"), ("b", "CALLS", "d"), ("c", "USES", "d"), ("d", "CALLS", "a")], "source_id string, relation_type string, target_id string")
    call = cg.calls(edges, members)
    found = cg.split_cells(members, call)
    assert found.collect() == cg.split_cells(members, call.select("caller", "callee")).collect()
    assert [(r.cell_key, r.n) for r in found.collect()] == []
    left = cg.split_cells(members, call.where("caller <> 'd' and callee <> 'd'"))
    assert sorted((r.cell_key, r.n) for r in left.collect()) == [("1", 2), ("2", 2)]
    assert str(left._jdf.queryExecution().optimizedPlan()).count("Join Inner") == 2  # those of calls()
