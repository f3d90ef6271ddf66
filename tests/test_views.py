"""Small known cases of display rules, lenses and anchor views."""

import pytest

from weftgraph.operators import anchors, display, lens

EDGE = "source_id string, relation_type string, target_id string"


def test_templates_name_what_they_reject():
    kinds = [p.kind for p in display.parse_template("a {name|5} {->R.x|3} {<-R} {#->R}")]
    assert kinds == ["literal", "field", "literal", "edge", "literal", "edge", "literal", "count"]
    with pytest.raises(ValueError, match="#->R.x"):
        display.parse_template("{#->R.x}")
    assert display.rule_errors("{a b}") and display.rule_errors(None) and display.rule_errors("{name}") is None


def test_lens_specs_are_checked_bound_and_filled():
    good = {"params": [{"name": "t", "type": "timestamp", "required": True}], "selection": [{"verb": "grep", "args": {"term": "{t}"}}]}
    assert lens.errors_of(good) == []
    assert len(lens.errors_of({"selection": [{"verb": "draw"}], "expand": {"hops": -1}, "more": 1})) == 3
    for spec, where in ((None, "spec"), ({}, "selection"), ({"selection": []}, "selection"), ({"selection": [{"verb": "list", "args": []}]}, "args"), ({"selection": [{"verb": "list"}], "params": [{"name": "a"}, {"name": "a"}]}, "params"), ({"selection": [{"verb": "list"}], "expand": {"relations": ["R", 1]}}, "relations[1]"), ({"selection": [{"verb": "list"}], "params": [{"type": "string"}]}, "name")):
        assert len(lens.errors_of(spec)) == 1 and where in lens.errors_of(spec)[0]
    assert lens.bind(good, {"t": "1970-01-02"}) == {"t": 86400.0}
    for given in ({}, {"t": 1, "u": 2}, {"t": "soon"}):
        with pytest.raises(ValueError):
            lens.bind(good, given)
    assert lens.substitute({"a": ["{t}", "at {t}"]}, {"t": 1.5}) == {"a": [1.5, "at 1.5"]}


def test_lens_union_keeps_the_first_clause(spark):
    rows = lambda *r: spark.createDataFrame([(x,) for x in r], "ref string")
    spec = {"selection": [{"verb": "list"}, {"verb": "grep"}]}
    found = lens.selections(spec, {}, {"list": lambda a: rows("x", "y"), "grep": lambda a: rows("y", "z", "z")})
    assert {r.ref: r.clause for r in lens.union_refs(found).collect()} == {"x": 0, "y": 0, "z": 1}
    assert sorted(r.selected for r in lens.clause_counts(found).collect()) == [2, 3]


def test_lead_structure_finds_locks_pins_and_statuses(spark):
    claims = [("1", "n", "role", "lock", 1.0), ("2", "a", "role", "program", 1.0), ("3", "a", "role", "arc", 2.0), ("4", "a", "pin.lead", "n - why", 1.0), ("5", "a", "pin.", "n", 1.0), ("6", "a", "program-status", "on", 1.0)]
    active = spark.createDataFrame(claims, "assertion_id string, subject_id string, predicate string, value string, asserted_at double")
    edges = spark.createDataFrame([("n", "ABOUT", "a"), ("m", "ABOUT", "a")], EDGE)
    got = {tuple(r) for r in anchors.lead_structure(active, edges).collect()}
    assert got == {("role", "n", "", "lock"), ("role", "a", "", "program"), ("pin", "a", "lead", "n - why"), ("status", "a", "program", "on"), ("lock", "a", "", "n")}
