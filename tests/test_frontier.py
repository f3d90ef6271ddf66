"""Chains, forks and cycles of gates against a closure by brute force; every pair of a chain is found once."""

from weftgraph.operators import frontier


def reached(pairs):
    out = set(pairs)
    while more := {(a, d) for a, b in out for c, d in pairs if b == c} - out:
        out |= more
    return out


def test_blockers_of_chains_forks_and_cycles(spark):
    pairs = [(f"a{i}", f"a{i + 1}") for i in range(21)] + [("f", "g"), ("f", "h"), ("g", "z"), ("h", "z"), ("x", "y"), ("y", "w"), ("w", "x"), ("l", "l"), ("v", "x")]
    got = [tuple(r) for r in frontier.transitive_blockers(spark.createDataFrame(pairs, "item_id string, gate_id string")).collect()]
    assert len(got) == len(set(got)) and set(got) == reached(pairs)


def test_rounds_hold_numbers_not_ids(spark, tmp_path):
    """What the rounds checkpoint does not grow with the length of the ids."""
    from pathlib import Path

    def written(prefix):
        folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
        size = lambda: sum(f.stat().st_size for f in folder.rglob("part-*"))
        before = size()
        rows = spark.createDataFrame([(f"{prefix}{i}", f"{prefix}{i + 1}") for i in range(60)], "item_id string, gate_id string")
        assert frontier.transitive_blockers(rows).count() == 1830
        return size() - before

    assert written("p" * 200) - written("p") < 200 * 500
