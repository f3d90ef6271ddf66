"""A session's active path and its text: odd turns as in the SQL, nothing read or dealt that has no part in it."""

import os
from pathlib import Path

from weftgraph.bind import TABLES, Bound
from weftgraph.operators import log
from weftgraph.plans import log as plans
from weftgraph.plans.registry import ORACLE_SQL, QUERIES


def test_documents_of_odd_sessions_are_those_of_the_sql(spark, sf_dir, tmp_path):
    import duckdb

    role = lambda turn: "user" if turn % 2 == 0 else "assistant"
    rows = [(1, t, role(t), f"long {t}") for t in range(23)] + [(2, t, role(t), f"twice {t}") for t in (0, 1, 1, 2, 3, 3)]
    rows += [(3, 0, "system", "alone"), (4, 0, None, "no role"), (4, 1, "assistant", None), (4, 2, "user", "last"), (5, 0, "user", None), (5, 1, "assistant", None)]
    rows += [(6, None, "user", "no turn"), (6, 1, "user", "one"), (7, 0, "user", "off"), (7, 2, "user", "off too"), (7, 3, "assistant", "its turn 1 is missing"), (8, 1, "system", "part"), (8, 3, "user", "after")]
    for name in TABLES:
        if name != "conversations":
            os.symlink(Path(sf_dir, f"{name}.parquet"), tmp_path / f"{name}.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet{'/*.parquet' if name == 'conversations' else ''}'")
    for name in ("active_path", "session_document"):
        got = sorted(map(repr, map(tuple, QUERIES[name](spark, str(tmp_path)).collect())))
        assert got == sorted(map(repr, db.sql(ORACLE_SQL[name]).fetchall()))


def test_the_path_of_a_session_reads_messages_only(spark, sf_dir):
    assert {f.rsplit("/", 1)[-1] for f in plans.path(Bound(spark, sf_dir)).inputFiles()} == {"conversations.parquet"}


def test_sessions_that_are_walked_through_are_not_dealt_again(spark, monkeypatch):
    frame, dealt = type(spark.range(0)), []
    write = frame.checkpoint

    def counted(self, *args, **more):
        out = write(self, *args, **more)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(frame, "checkpoint", counted)
    lengths = {"long": 300} | {f"s{i}": 2 for i in range(500)}
    messages = spark.createDataFrame([(s, f"{s}-{i:04}", "transcript", f"{i:04}") for s, n in lengths.items() for i in range(n)], "session string, id string, source string, ts string")
    edges = spark.createDataFrame([(f"{s}-{i:04}", "NEXT", f"{s}-{i + 1:04}") for s, n in lengths.items() for i in range(n - 1)], "source_id string, relation_type string, target_id string")
    assert log.active_path(messages, edges).where("active").count() == 1300
    assert sum(dealt) < 6000


def test_a_path_may_come_to_a_cycle(spark):
    messages = spark.createDataFrame([("s", m, "transcript", m) for m in "abcdefz"] + [("s", "p", "composer", "p"), ("t", "u", "transcript", "u")], "session string, id string, source string, ts string")
    edges = spark.createDataFrame([("a", "NEXT", "z"), ("b", "NEXT", "a"), ("c", "NEXT", "b"), ("a", "NEXT", "c"), ("d", "NEXT", "e"), ("u", "NEXT", "u")], "source_id string, relation_type string, target_id string")
    found = log.active_path(messages, edges).where("active").select("id")
    assert sorted(r.id for r in found.collect()) == ["a", "b", "c", "p", "u", "z"]


def test_a_part_that_was_sent_twice_stands_once(spark):
    entries = spark.createDataFrame([("s", "a", "user", "x", "1", True)], "session string, id string, role string, text string, ts string, active boolean")
    sent = spark.createDataFrame([("a",), ("a",)], "id string")
    assert log.session_document(entries, sent).collect() == [("s", "## user [sent]\nx", 1)]
