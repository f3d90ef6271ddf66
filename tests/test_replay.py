"""Replay against an interpreter that applies one operation after another; stored states; segments of a log."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import corpus, replay
from weftgraph.sources import journal

SCHEMA = "seq long, verb string, ts double, actor string, session string, key string, subject string, predicate string, value string, source_id string, target_id string, relation string, title string, text string, items string"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def uid(*parts):
    m = hashlib.md5("|".join(parts).encode()).hexdigest()
    return "-".join((m[:8], m[8:12], m[12:16], m[16:20], m[20:]))


def random_log(n, seed):
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(0, len(xs)))]
    num = lambda k: int(rng.integers(0, k))
    ids = [uid("Decision", f"d{k}") for k in range(4)] + [uid("Session", f"s{k}") for k in range(3)] + [uid("Note", f"n{k}") for k in range(2)]
    out = []
    for seq in range(n):
        verb = pick("decide", "check", "assert", "alias", "link", "link", "link", "unlink", "session", "retract-session", "new-note", "section", "add-section", "display-rule", "set-lens", "pull-transcript", "mint-messages", "edit-message", "derive-message", "ping")
        a = {"actor": pick("x", "y", None)}
        if verb == "decide":
            a |= {"text": f"d{num(4)}", "title": f"t{seq}", "session": pick(None, "s0", "s1"), "items": pick(None, ids[0], f"{ids[1]},{ids[2]}")}
        elif verb == "check":
            a |= {"source_id": ids[num(4)], "text": f"c{num(2)}"}
        elif verb == "assert":
            a |= {"subject": pick("Old Name", "new name", "other", ids[0], uid("Check", ids[0], "c0")), "predicate": pick("version", "task_state", "note_flag"), "value": pick("1.2.0", "1.10.0", "1.9", "done", "open")}
        elif verb == "alias":
            a |= {"key": pick("Old name", "older"), "subject": pick("new name", ids[3])}
        elif verb in ("link", "unlink"):
            a |= {"source_id": pick(*ids), "target_id": pick(*ids), "relation": "REFERENCES"}
        elif verb in ("session", "retract-session"):
            a |= {"key": f"s{num(3)}", "title": pick(None, f"t{seq}"), "value": pick(None, str(seq))}
        elif verb == "new-note":
            a |= {"key": f"n{num(2)}", "text": pick("one\n\ntwo", "## A\nx\n## A\ny", "plain", "")}
        elif verb == "section":
            a |= {"key": f"n{num(2)}", "subject": pick("a", "a-2", "section", "section-2", "b"), "text": f"edit {seq}"}
        elif verb == "add-section":
            a |= {"key": f"n{num(2)}", "text": pick("## B\nnew", "## A\nagain")}
        elif verb in ("display-rule", "set-lens"):
            a |= {"key": f"k{num(2)}", "title": pick(None, f"t{seq}"), "text": f"x{seq}"}
        elif verb in ("pull-transcript", "mint-messages"):
            m = num(4)
            a |= {"key": f"s{num(2)}", "subject": f"m{m}", "value": f"m{m - 1}" if m else None, "title": "user", "text": f"said {seq}"}
        elif verb == "edit-message":
            a |= {"subject": f"m{num(4)}", "text": f"edit {seq}"}
        elif verb == "derive-message":
            a |= {"subject": "m3", "items": f"{uid('Message', 'm1')},{uid('Message', 'm0')}"}
        out.append((seq, verb, 1000.0 + seq, *(a.get(f) for f in FIELDS[3:])))
    return out


def cut(text):
    lines, raws = text, []
    while lines:
        at = len(lines)
        for k in range(1, len(lines)):
            if (lines[k - 2 : k] == "\n\n" and lines[k] != "\n") or (lines[k - 1] == "\n" and lines[k:].lstrip("#") != lines[k:] and lines[k:].lstrip("#")[:1] == " "):
                at = k
                break
        raws.append(lines[:at])
        lines = lines[at:]
    seen, out = {}, []
    for raw in raws:
        a = raw.split("\n")[0][3:].strip().lower() if raw.startswith("## ") else ""
        a = a or "section"
        seen[a] = seen.get(a, 0) + 1
        out.append((a if seen[a] == 1 else f"{a}-{seen[a]}", raw))
    return out


def interpret(log):
    """Nodes, edges and claims by applying one operation after another."""
    nodes, edges, claims, aliases, gone_first = {}, {}, {}, {}, {}
    full = lambda s: len(s) == 36 and s.count("-") == 4
    slug = lambda s: s.strip().lower().replace(" ", "-")

    def make(id_, label, key, o, ts, text=None, title=None):
        if id_ not in nodes:
            nodes[id_] = {"label": label, "key": key, "text": text, "title": title, "started": None, "o": o, "ts": ts}

    def mint(a, r, b, position=None):
        if (a, r, b) not in edges:
            edges[a, r, b] = position

    def claim(subject, predicate, value, actor, ts):
        claims.setdefault((subject, predicate, value, actor or ""), ts)

    for seq, verb, ts, *args in sorted(log, key=lambda r: (r[1] != "new-note", r[0])):
        a = dict(zip(FIELDS[3:], args, strict=True))
        o = seq - replay.GENESIS if verb == "new-note" else seq
        if verb == "new-note":
            n = uid("Note", a["key"])
            make(n, "Note", a["key"], o, ts)
            for k, (anchor, raw) in enumerate(cut(a["text"])):
                make(uid("Section", a["key"], anchor), "Section", f"{a['key']}#{anchor}", o, ts, raw)
                mint(n, "HAS_SECTION", uid("Section", a["key"], anchor), k)
        elif verb == "add-section":
            anchor = cut(a["text"])[0][0]
            make(uid("Section", a["key"], anchor), "Section", f"{a['key']}#{anchor}", o, ts, a["text"])
            mint(uid("Note", a["key"]), "HAS_SECTION", uid("Section", a["key"], anchor))
        elif verb in ("section", "edit-message"):
            id_ = uid("Section", a["key"], a["subject"]) if verb == "section" else uid("Message", a["subject"])
            if id_ in nodes:
                nodes[id_]["text"] = a["text"]
        elif verb == "decide":
            d = uid("Decision", a["text"])
            make(d, "Decision", a["text"], o, ts, None, a["title"])
            for x in (a["items"] or "").split(","):
                if x:
                    mint(d, "SUPPORTED_BY", x)
            if a["session"] is not None:
                mint(d, "DECIDED_IN", uid("Session", a["session"]))
        elif verb == "check":
            c = uid("Check", a["source_id"], a["text"])
            make(c, "Check", None, o, ts, a["text"])
            mint(c, "CHECKS", a["source_id"])
            claim(c, "task_state", "open", a["actor"], ts)
        elif verb == "alias":
            target = a["subject"] if full(a["subject"]) else uid("Entity", slug(a["subject"]))
            if not full(a["subject"]):
                make(target, "Entity", slug(a["subject"]), o, ts)
            aliases.setdefault(a["key"].lower(), target)
            claim(target, "aka", a["key"], a["actor"], ts)
        elif verb == "assert":
            s = a["subject"]
            if not full(s):
                if s.lower() in aliases:
                    s = aliases[s.lower()]
                else:
                    make(uid("Entity", slug(s)), "Entity", slug(s), o, ts)
                    s = uid("Entity", slug(s))
            claim(s, a["predicate"], a["value"], a["actor"], ts)
        elif verb == "link":
            if a["source_id"] in nodes and a["target_id"] in nodes:
                mint(a["source_id"], a["relation"], a["target_id"])
        elif verb == "unlink":
            edges.pop((a["source_id"], a["relation"], a["target_id"]), None)
        elif verb in ("display-rule", "set-lens"):
            label = {"display-rule": "DisplayRule", "set-lens": "Lens"}[verb]
            id_ = uid(label, a["key"])
            make(id_, label, a["key"], o, ts)
            nodes[id_]["text"] = a["text"]
            nodes[id_]["title"] = a["title"] or nodes[id_]["title"]
        elif verb == "session":
            id_ = uid("Session", a["key"])
            make(id_, "Session", a["key"], o, ts)
            nodes[id_]["title"] = a["title"] or nodes[id_]["title"]
            nodes[id_]["started"] = a["value"] or nodes[id_]["started"]
        elif verb == "retract-session":
            id_ = uid("Session", a["key"])
            nodes.pop(id_, None)
            for e in [e for e in edges if id_ in (e[0], e[2])]:
                del edges[e]
        elif verb in ("pull-transcript", "mint-messages"):
            m, s = uid("Message", a["subject"]), uid("Session", a["key"])
            make(m, "Message", a["key"], o, ts, a["text"], a["title"])
            mint(m, "PART_OF", s)
            mint(*((s, "STARTS_WITH", m) if a["value"] is None else (uid("Message", a["value"]), "NEXT", m)))
        elif verb == "derive-message":
            for k, x in enumerate(a["items"].split(",")):
                mint(uid("Message", a["subject"]), "DERIVED_FROM", x, k)
    return (
        sorted(((i, n["label"], n["key"], n["title"], n["text"], n["started"], n["o"], n["ts"]) for i, n in nodes.items()), key=str),
        sorted(edges),
        sorted((*k, t) for k, t in claims.items()),
    )


def views(state):
    nodes = sorted((tuple(r) for r in replay.nodes(state).collect()), key=str)
    edges = sorted(tuple(r)[:3] for r in replay.edges(state).collect())
    claims = sorted((r.subject_id, r.predicate, r.value, r.actor or "", r.asserted_at) for r in state.claims.collect())
    return nodes, edges, claims


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_is_what_one_operation_after_another_gives(spark, seed):
    log = random_log(500, seed)
    ops = spark.createDataFrame(log, SCHEMA)
    assert views(replay.fold(ops)) == interpret(log)


def test_doubled_log_and_states_that_overlap(spark):
    log = random_log(300, 7)
    ops = spark.createDataFrame(log, SCHEMA)
    want = interpret(log)
    assert views(replay.fold(ops.unionAll(ops))) == want
    early = replay.fold(ops.where("seq < 180"))
    assert views(replay.fold(ops.where("seq >= 120"), early)) == want
    again = [(r[0] + 1000, *r[1:]) for r in log if r[1] not in ("retract-session", "alias")]
    log = [r for r in log if r[1] not in ("retract-session", "alias")]
    twice = views(replay.fold(spark.createDataFrame(log + again, SCHEMA)))
    assert twice == interpret(log + again)
    assert [n[:2] for n in twice[0]] == [n[:2] for n in interpret(log)[0]] and twice[2] == interpret(log)[2]


def test_stored_state_is_continued_and_only_what_is_new_is_read(spark, tmp_path):
    log, folder = random_log(200, 3), str(tmp_path / "state")
    ops = spark.createDataFrame(log, SCHEMA)
    replay.advance(spark, folder, ops, upto=120)
    assert replay.stored_offsets(spark, folder) == [120]
    poisoned = ops.withColumn("verb", F.when(F.col("seq") <= 100, F.raise_error(F.lit("read again"))).otherwise(F.col("verb")))
    assert views(replay.advance(spark, folder, poisoned, overlap=20)) == interpret(log)
    assert replay.stored_offsets(spark, folder) == [120, 199]
    assert views(replay.advance(spark, folder, ops.where("seq > 5000"))) == interpret(log)  # nothing new
    assert views(replay.load(spark, folder, 120)) == interpret(log[:121])
    (tmp_path / "state" / "offset=5").mkdir()  # what a lost job left
    replay.prune(spark, folder, 1)
    assert [p.name for p in (tmp_path / "state").iterdir()] == ["offset=199"]


def test_check_opened_again_is_born_superseded_and_chains_are_linear(spark):
    registry = spark.createDataFrame([("task_state", True, "task", False), ("version", True, "semver", False)], "predicate string, typed boolean, ordered string, multivalued boolean")
    item = uid("Decision", "d")
    check = uid("Check", item, "c")
    log = [(1, "check", 1.0, {"source_id": item, "text": "c"}), (2, "assert", 2.0, {"subject": check, "predicate": "task_state", "value": "done"}), (3, "check", 3.0, {"source_id": item, "text": "c", "actor": "late"})]
    ops = spark.createDataFrame([(a, v, t, *(d.get(f) for f in FIELDS[3:])) for a, v, t, d in log], SCHEMA)
    rows = {(r.value, r.actor): r for r in replay.claims(replay.fold(ops), registry).collect()}
    done = rows["done", None].assertion_id
    assert rows["open", None].superseder == done and rows["open", "late"].superseder == done and rows["done", None].superseder is None
    slot = spark.range(100_000).selectExpr("cast(id as string) assertion_id", "'s' slot_id", "'version' predicate", "concat('1.', id % 1000) value", "cast(id as double) asserted_at")
    chain = replay.superseded(slot, registry)
    assert chain.count() == 100_000 and chain.where("superseder is null").count() == 100
    assert chain.where("assertion_id = '4001'").first().superseder == "2"


def test_empty_log(spark):
    state = replay.fold(spark.createDataFrame([], SCHEMA))
    assert views(state) == ([], [], []) and replay.counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sections_are_lossless_and_references_heal(spark):
    texts = ["", "# A\nx\n## A\ny\n\n\nz\n# B", "\n\nx", "#no heading\n####### neither", "a\n\n\n\nb\n", None, "## \nempty", "# É\ny"]
    notes = spark.createDataFrame([(f"i{k}", f"s{k}", t) for k, t in enumerate(texts)], "id string, slug string, text string")
    found = {}
    for r in corpus.sections(notes).orderBy("note_id", "ord").collect():
        found.setdefault(r.note_id, []).append((r.anchor, r.raw))
    for k, t in enumerate(texts):
        assert "".join(raw for _, raw in found.get(f"i{k}", [])) == (t or "")
    assert [a for a, _ in found["i1"]] == ["a", "a-2", "section", "b"]
    named = spark.createDataFrame([("i0", "s0", "[[s1]] [[s1|x]] [[ s1 ]] [[old]] [[older]] [[gone]] [[s0]]"), ("i1", "s1", None)], "id string, slug string, text string")
    aliases = spark.createDataFrame([("old", "s1"), ("older", "nowhere")], "drifted string, canonical string")
    refs = corpus.references(named, aliases)
    assert sorted((r.slug, r.target_id, r.healed, r.n) for r in refs.collect() if r.target_id) == [("old", "i1", True, 1), ("s0", "i0", False, 1), ("s1", "i1", False, 3)]
    assert refs.where("target_id is null").count() == 2
    assert [tuple(r) for r in corpus.reference_edges(refs).collect()] == [("i0", "REFERENCES", "i1")]


def test_segments_in_append_order_for_any_split(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    lines, at = [], 0
    for name, n in (("log.0001.jsonl", 700), ("log.0002.jsonl", 3), ("log.jsonl", 500)):
        rows = []
        for k in range(n):
            line = "" if k % 50 == 7 else "not json" if k % 50 == 9 else json.dumps({"verb": "assert", "ts": float(at), "actor": "a", "args": {"value": "v" * (k % 37), "actor": "inner"}})
            rows.append(line)
            if line:
                lines.append((at, name, k, None if line == "not json" else "assert"))
            at += 1
        (folder / name).write_text("\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "7777", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = journal.read_journal(spark, str(folder), tail="^log\\.jsonl$")
            assert sorted((r.seq, r.segment, r.line, r.verb) for r in got.collect()) == lines
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    r = journal.with_arguments(got, ("value", "actor")).where("seq = 3").first()
    assert (r.value, r.actor) == ("vvv", "inner")


def test_a_text_of_very_many_sections(spark):
    notes = spark.createDataFrame([("a", "x\n\n" * 20_000), ("b", "## H\n" * 5_000)], "id string, text string")
    found = corpus.sections(notes)
    assert found.where("note_id = 'a'").count() == 20_000 and found.where("anchor = 'section-20000' and ord = 19999").count() == 1
    assert found.where("note_id = 'b' and anchor like 'h%'").count() == 5_000
