"""Batches of claims against one write after another; clusters by their handles; imports and calls; minting."""

from collections import Counter

import numpy as np

from weftgraph.operators import facts, scan, traverse

REGISTRY = [("version", True, "semver", False), ("policy", True, None, False), ("aka", True, None, True), ("task_state", True, "task", False)]
CLAIMS = "assertion_id string, slot_id string, subject_id string, predicate string, value string, actor string, asserted_at double"


def frames(spark, rows, claims=()):
    requests = spark.createDataFrame(rows, "n long, subject string, predicate string, value string, actor string, asserted_at double, supersede array<string>")
    nodes = spark.createDataFrame([("aaaaaaaa-0000-0000-0000-000000000001",), ("aaaaaaaa-0000-0000-0000-000000000002",), ("bbbbbbbb-0000-0000-0000-000000000003",)], "id string")
    aliases = spark.createDataFrame([("known", "bbbbbbbb-0000-0000-0000-000000000003")], "name string, id string")
    registry = spark.createDataFrame(REGISTRY, "predicate string, typed boolean, ordered string, multivalued boolean")
    return requests, nodes, aliases, spark.createDataFrame(list(claims), CLAIMS), spark.createDataFrame([], "superseder string, superseded string"), registry


def in_turn(rows, resolve):
    """(subject_id, predicate, value, actor) → (born_superseded, superseded in the end, n_conflicts, soft), by writing one after another."""
    slots, out = {}, {}
    rank = lambda p, v: [int(x) for x in v.split(".")] if p == "version" else {"open": [0], "done": [1]}.get(v) if p == "task_state" else None
    typed = {r[0]: r for r in REGISTRY}
    for _, subject, predicate, value, actor, _, supersede in sorted(rows, key=lambda r: r[0]):
        s = resolve(subject)
        if s is None or (s, predicate, value, actor) in out:
            continue
        slot = slots.setdefault((s, predicate), [])
        mine = {"key": (s, predicate, value, actor), "value": value, "gone": False}
        born = False
        for old in [o for o in slot if not o["gone"]]:
            a, b = rank(predicate, value), rank(predicate, old["value"])
            if a and b and a > b:
                old["gone"] = True
            elif a and b and a < b:
                born = True
        mine["gone"] = born
        for token in supersede or []:
            for old in slot:
                old["gone"] |= old["value"].strip().lower() == token.strip().lower()
        slot.append(mine)
        out[mine["key"]] = born
    for (_, predicate), slot in slots.items():
        left = [m for m in slot if not m["gone"]]
        for k, m in enumerate(left):
            others = sum(o["value"].strip().lower() != m["value"].strip().lower() for o in left[:k])
            kind = typed.get(predicate)
            hard = others if kind and not kind[2] and not kind[3] else 0
            out[m["key"]] = (False, False, hard, bool(others and not kind))
        for m in slot:
            if m["gone"]:
                out[m["key"]] = (out[m["key"]] is True, True, 0, False)
    return out


def test_batch_is_what_one_write_after_another_gives(spark):
    rng = np.random.default_rng(6)
    pick = lambda *xs: xs[int(rng.integers(0, len(xs)))]
    ids = {"known": "bbbbbbbb-0000-0000-0000-000000000003", "bbbbbb": "bbbbbbbb-0000-0000-0000-000000000003", "aaaaaaaa-0000-0000-0000-000000000001": "aaaaaaaa-0000-0000-0000-000000000001", "fresh": "fresh", "aaaaaa": None, "abcdef01": None}
    rows = []
    for n in range(150):
        predicate = pick("version", "policy", "aka", "free", "task_state")
        value = {"version": pick("1.0", "1.10", "1.9"), "policy": pick("A", "b", "C "), "aka": pick("x", "y"), "free": pick("p", "q"), "task_state": pick("open", "done")}[predicate]
        rows.append((n, pick(*ids), predicate, value, pick("u", "v"), float(n), pick(None, None, ["a"], ["B", "zzz"]) if predicate in ("policy", "free") else None))
    args = frames(spark, rows)
    new, rejected = facts.write_batch(*args)
    minted = facts.resolve_subjects(args[0], args[1], args[2]).where("outcome = 'minted'").first().id
    want = in_turn(rows, lambda s: minted if s == "fresh" else ids[s])
    got = {(r.subject_id, r.predicate, r.value, r.actor): (r.born_superseded, r.superseder is not None, r.n_conflicts, r.soft_conflict) for r in new.collect()}
    assert got == want
    assert Counter(r.subject for r in rejected.collect()) == Counter(r[1] for r in rows if ids[r[1]] is None)
    for r in new.where("n_conflicts > 0").collect():
        assert r.contradicts in {x.assertion_id for x in new.collect()} and r.contradicts != r.assertion_id
    # The same batch again adds nothing.
    requests, nodes, aliases, _, supersedes, registry = args
    known = new.select(*(c.split()[0] for c in CLAIMS.split(", ")))
    assert facts.write_batch(requests, nodes, aliases, known, supersedes, registry)[0].count() == 0


def test_handles_of_sub_facets_lead_to_as_many_members(spark):
    rng = np.random.default_rng(1)
    rows = [(f"n{k}", float(rng.integers(0, 50)) / 7, f"s{k % 3}") for k in range(60)]
    scored = spark.createDataFrame(rows, "id string, score double, seed_id string")
    nodes = spark.createDataFrame([(f"n{k}", ("A", "B")[k % 2]) for k in range(60)], "id string, label string")
    top = traverse.explore(scored, nodes, [], 10).collect()
    assert [r.total for r in top] == [60] * 13 and {r.part for r in top} == {"member", "seed"}
    best = sorted(rows, key=lambda r: (-r[1], r[0]))[:10]
    assert sorted(r.value for r in top if r.part == "member") == sorted(r[0] for r in best)
    for f in (r for r in top if r.part == "seed"):
        below = traverse.explore(scored, nodes, [("seed", f.value)], 10).collect()
        assert below[0].total == f.n and {r.part for r in below} == {"member", "kind"}
        for k in (r for r in below if r.part == "kind"):
            leaf = traverse.explore(scored, nodes, [("seed", f.value), ("kind", k.value)], 10).collect()
            assert leaf[0].complete and leaf[0].total == k.n == len(leaf)
    assert traverse.explore(scored, nodes, [("kind", "none")], 10).count() == 0


def test_imports_and_calls_from_lists(spark):
    modules = spark.createDataFrame([("1", "a", True, ["b", ".c", "..b", "a", "x"]), ("2", "b", False, ["a.c", ".a"]), ("3", "a.c", False, [".d", "..b", "."]), ("4", "a.d", False, None), ("5", "", False, ["a"])], "id string, import_name string, is_package boolean, imports array<string>")
    found = {(r.source_id, r.target_id) for r in scan.resolve_imports(modules).collect()}
    assert found == {("1", "2"), ("1", "3"), ("2", "3"), ("3", "4"), ("3", "1"), ("5", "1")}
    symbols = spark.createDataFrame([("1", "m.f", ["g", "g", "f", "h"]), ("2", "g", ["h"]), ("3", "x.h", None), ("4", "y.h", ["f"])], "id string, qualname string, calls array<string>")
    assert {(r.source_id, r.target_id) for r in scan.resolve_calls(symbols).collect()} == {("1", "2"), ("4", "1")}


def test_minting_again_adds_nothing(spark):
    rows = spark.createDataFrame([("m1", "s", None, "user", "a", "t"), ("m2", "s", "m1", "user", "b", "t"), ("m2", "s", "m1", "user", "b", "t"), ("m3", "r", None, None, None, None)], "id string, session_id string, prev_id string, role string, text string, transcript string")
    sent = spark.createDataFrame([("m2", ["p1", "p2", "p1"])], "id string, parts array<string>")
    nodes, edges = spark.createDataFrame([("s",)], "id string"), spark.createDataFrame([], "source_id string, relation_type string, target_id string")
    claims = spark.createDataFrame([], "assertion_id string")
    a, b, c = scan.mint_messages(rows, sent, nodes, edges, claims)
    assert sorted(r.id for r in a.collect()) == ["m1", "m2", "m3", "r"] and c.count() == 1
    assert sorted((r.source_id, r.relation_type, r.target_id, r.ord) for r in b.where("relation_type = 'DERIVED_FROM'").collect()) == [("m2", "DERIVED_FROM", "p1", 0), ("m2", "DERIVED_FROM", "p2", 1)]
    again = scan.mint_messages(rows, sent, nodes.unionAll(a.select("id")), b.select(*edges.columns), c.select("assertion_id"))
    assert [x.count() for x in again] == [0, 0, 0]
