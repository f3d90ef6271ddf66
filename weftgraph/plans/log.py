"""Registered queries: journal, time and session operators, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.bind import Bound, uid
from weftgraph.functions import text
from weftgraph.model import stable_id
from weftgraph.operators import log
from weftgraph.plans.base import query
from weftgraph.plans.scans import _MSG, _STATE, _SUMMARY, messages, op_args, source_ops

# The references of each operation of the bound journal.
_TOUCH = f"""
touches AS (SELECT seq, verb, ts, session, actor, unnest(CASE verb WHEN 'link' THEN [subject, object] WHEN 'unlink' THEN [subject, object] WHEN 'assert' THEN [subject]
  WHEN 'decide' THEN [{uid("'Op|'||seq")}, subject, object] ELSE [{uid("'Sess|'||skey")}] END) AS ref FROM journal)"""
_WINDOWS = """
reg AS (SELECT skey AS key, arg_max(ts, seq) AS started_at FROM journal WHERE verb = 'session' GROUP BY skey),
windows AS (SELECT key, started_at, (SELECT min(r2.started_at) FROM reg r2 WHERE r2.started_at > r.started_at) AS ended_at FROM reg r),
sops AS (SELECT j.*, session AS window_key FROM journal j WHERE session IS NOT NULL
  UNION ALL SELECT j.*, w.key FROM journal j JOIN windows w ON j.ts >= w.started_at AND (w.ended_at IS NULL OR j.ts < w.ended_at) WHERE j.session IS NULL OR j.session <> w.key)"""


def touches(g: Bound) -> DataFrame:
    j = g.journal
    args = {"own_id": stable_id("Op", F.col("seq")), "supports": F.array("subject", "object"), "subject": F.col("subject"), "source_id": F.col("subject"), "target_id": F.col("object"), "session_id": stable_id("Sess", F.col("skey"))}
    return log.touch_rows(j, log.touched_by_verb(F.col("verb"), args))


def windows(g: Bound) -> DataFrame:
    return log.session_windows(g.journal.where("verb = 'session'").select("seq", F.col("skey").alias("key"), F.col("ts").alias("started_at")))


@query(_TOUCH + " SELECT seq, verb, ref FROM touches")
def touch_rows(g: Bound) -> DataFrame:
    return touches(g).select("seq", "verb", "ref")


@query(_WINDOWS + " SELECT key, started_at, ended_at FROM windows")
def session_windows(g: Bound) -> DataFrame:
    return windows(g)


@query(_TOUCH + " SELECT ref, count(*) AS touches, min(ts) AS first_ts, max(ts) AS last_ts FROM touches WHERE ts BETWEEN 1704153600 AND 1704672000 GROUP BY ref")
def journal_window(g: Bound) -> DataFrame:
    return log.journal_window(log.in_window(touches(g), 1704153600, 1704672000))


@query(_TOUCH + ", " + _WINDOWS + " SELECT window_key, ref, count(*) AS touches, min(s.ts) AS first_ts, max(s.ts) AS last_ts FROM sops s JOIN touches t USING (seq) GROUP BY window_key, ref")
def journal_session_window(g: Bound) -> DataFrame:
    ops = log.session_ops(g.journal.select("seq", "ts", "session"), windows(g))
    rows = ops.select("seq", "window_key").join(touches(g), "seq")
    return log.journal_window(rows, ("window_key",))


@query(_TOUCH + " SELECT ref, verb, count(*) AS n FROM touches GROUP BY ref, verb")
def journal_window_verbs(g: Bound) -> DataFrame:
    return log.window_verbs(touches(g))


@query(_TOUCH + ", w AS (SELECT ref, count(*) AS touches FROM touches GROUP BY ref) SELECT w.ref, w.touches, t.label, coalesce(t.title, w.ref) AS title, t.id IS NULL AS missing FROM w LEFT JOIN title_of t ON t.id = w.ref")
def journal_window_view(g: Bound) -> DataFrame:
    w = log.journal_window(touches(g)).select(F.col("ref").alias("id"), "touches")
    n = g.nodes.select("id", "label", text.node_title().alias("title"))
    return w.join(n, "id", "left").select(F.col("id").alias("ref"), "touches", "label", F.coalesce("title", "id").alias("title"), F.col("label").isNull().alias("missing"))


@query(_TOUCH + f""", asked AS (SELECT {uid("'Customer|'||c_custkey")} AS r FROM customer WHERE c_custkey % 3 = 0 UNION SELECT substr({uid("'Part|'||p_partkey")},1,10) FROM part WHERE p_partkey % 10 = 1),
m AS (SELECT DISTINCT r AS ref, seq, ts, session, actor FROM touches JOIN asked ON CASE WHEN length(r) = 36 THEN ref = r ELSE starts_with(ref, r) END)
SELECT ref, min(ts) FILTER (WHERE ts > 0) AS first_ts, max(ts) FILTER (WHERE ts > 0) AS last_ts, count(DISTINCT session) AS sessions, count(DISTINCT actor) AS actors, count(*) AS op_count FROM m GROUP BY ref""")
def node_trace(g: Bound) -> DataFrame:
    full = g.table("customer").where("c_custkey % 3 = 0").select(stable_id("Customer", F.col("c_custkey")).alias("ref"))
    short = g.table("part").where("p_partkey % 10 = 1").select(F.substring(stable_id("Part", F.col("p_partkey")), 1, 10).alias("ref"))
    return log.node_trace(touches(g), full.union(short))


def ledger(g: Bound) -> DataFrame:
    args = {k: F.col(k) for k in ("predicate", "statement", "key", "relation")} | {"value": F.col("said")}
    return op_args(g).withColumn("summary", text.op_summary(args))


@query(f"SELECT seq, verb, ts, session, {_SUMMARY} AS summary FROM journal WHERE ts > 1704153600 AND ts <= 1704672000")
def op_ledger(g: Bound) -> DataFrame:
    return log.in_window(ledger(g), 1704153600, 1704672000, exclusive_start=True).select("seq", "verb", "ts", "session", "summary").orderBy("ts", "seq")


@query(f"SELECT seq, verb, ts, {_SUMMARY} AS summary, max(ts) OVER () AS cursor FROM (SELECT * FROM journal ORDER BY ts DESC, seq DESC LIMIT 50)")
def session_feed(g: Bound) -> DataFrame:
    newest = ledger(g).orderBy(F.desc("ts"), F.desc("seq")).limit(50)
    return newest.select("seq", "verb", "ts", "summary").join(F.broadcast(newest.agg(F.max("ts").alias("cursor"))), how="cross")


@query(_STATE + " SELECT key, content FROM latest")
def latest_state(g: Bound) -> DataFrame:
    return log.latest_state(source_ops(g))


@query(_STATE + " SELECT key FROM owned")
def sourced_keys(g: Bound) -> DataFrame:
    return log.sourced_keys(source_ops(g))


@query(_STATE + " SELECT DISTINCT key FROM ops WHERE op = 'cutover'")
def journal_sourced_paths(g: Bound) -> DataFrame:
    return log.genesis_paths(source_ops(g), ("cutover",))


@query(_STATE + " SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN 'unknown' WHEN c_custkey IN (SELECT key FROM ops) THEN 'skipped' ELSE 'imported' END AS outcome FROM customer WHERE c_custkey % 2 = 0")
def genesis_import(g: Bound) -> DataFrame:
    c = g.table("customer").select(F.col("c_custkey").alias("key"))
    return log.genesis_import(c.where("key % 2 = 0"), c.where("key % 4 <> 0"), source_ops(g).select("key").distinct())


def edge_ops(g: Bound) -> DataFrame:
    return g.journal.select("seq", "verb", F.col("subject").alias("source_id"), F.lit("REFERENCES").alias("relation_type"), F.col("object").alias("target_id"))


_FOLD = "folded AS (SELECT subject AS source_id, 'REFERENCES' AS relation_type, object AS target_id FROM journal WHERE verb IN ('link','unlink') {where} GROUP BY subject, object HAVING arg_max(verb, seq) = 'link')"


@query(_FOLD.format(where="") + " SELECT source_id, relation_type, target_id FROM folded")
def replay_fold(g: Bound) -> DataFrame:
    return log.replay_edges(edge_ops(g))


@query("SELECT verb, count(*) AS n FROM journal WHERE seq >= 1000 GROUP BY verb")
def replay_counts(g: Bound) -> DataFrame:
    return log.replay_counts(g.journal, 1000)


@query(_FOLD.format(where="") + " SELECT source_id, relation_type, target_id FROM folded")
def replay_delta(g: Bound) -> DataFrame:
    """The first part's fold is kept as link operations, and only operations past an offset before its end are folded onto it."""
    ops = edge_ops(g)
    half = ops.agg(F.max("seq")).first()[0] // 2
    kept = log.replay_edges(ops.where(F.col("seq") <= half)).select(F.lit(-1).cast("long").alias("seq"), F.lit("link").alias("verb"), "source_id", "relation_type", "target_id")
    return log.replay_edges(kept.unionByName(ops.where(F.col("seq") > half - 50)))


_PATH = """
m AS (SELECT n.id, n.ts, n.source, n.role, n.text, e.target_id AS session FROM nodes n JOIN edges e ON e.source_id = n.id AND e.relation_type = 'PART_OF' WHERE n.label = 'Message'),
tips AS (SELECT session, arg_max(id, (ts, id)) AS id FROM m WHERE source <> 'composer' GROUP BY session),
up AS (SELECT target_id AS node, max(source_id) AS up FROM edges WHERE relation_type = 'NEXT' GROUP BY target_id),
walk AS (SELECT id FROM tips UNION SELECT up FROM walk JOIN up ON up.node = walk.id),
path AS (SELECT m.*, m.source = 'composer' OR m.id IN (SELECT id FROM walk) AS active FROM m)
"""


def path(g: Bound) -> DataFrame:
    part_of = g.labelled_edges.where("relation_type = 'PART_OF' and source_label = 'Message'").select(F.col("source_id").alias("id"), F.col("target_id").alias("session"))
    m = g.nodes.where("label = 'Message'").select("id", "ts", "source", "role", "text").join(part_of, "id")
    return log.active_path(m, g.edges)


@query(_PATH + " SELECT session, id, active FROM path")
def active_path(g: Bound) -> DataFrame:
    return path(g).select("session", "id", "active")


@query(_PATH + " SELECT session, string_agg('## '||role||CASE WHEN ts = '1' THEN ' [sent]' ELSE '' END||chr(10)||text, chr(10)||chr(10) ORDER BY ts, id) AS document, count(*) AS n FROM path WHERE active GROUP BY session")
def session_document(g: Bound) -> DataFrame:
    return log.session_document(path(g), g.nodes.where("label = 'Message' and ts = '1'").select("id"))


@query("SELECT key, started_at FROM (SELECT skey AS key, arg_max(ts, seq) AS started_at FROM journal WHERE verb = 'session' GROUP BY skey) ORDER BY started_at DESC, key LIMIT 3")
def recent_sessions(g: Bound) -> DataFrame:
    return windows(g).select("key", "started_at").orderBy(F.desc("started_at"), "key").limit(3)


@query("SELECT session, count(*) AS n FROM journal WHERE session IS NOT NULL AND verb <> 'session' GROUP BY session")
def session_foreign_ops(g: Bound) -> DataFrame:
    return g.journal.where("session is not null and verb <> 'session'").groupBy("session").agg(F.count("*").alias("n"))


@query(f"{_MSG}, edits AS (SELECT conv_id AS c, max(turn) AS t FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id) SELECT m.id, CASE WHEN m.turn = 0 AND e.c IS NOT NULL THEN 'edit '||e.t ELSE c.text END AS text FROM msgs m JOIN conversations c ON c.conv_id = m.session AND c.turn = m.turn LEFT JOIN edits e ON e.c = m.session")
def message_edit_fold(g: Bound) -> DataFrame:
    m = messages(g)
    edits = m.where("turn % 2 = 0").select(stable_id("Msg", F.col("session"), F.lit(0)).alias("id"), F.col("turn").alias("seq"), F.concat(F.lit("edit "), "turn").alias("text"))
    return log.edit_fold(m.select("id", "text"), edits)


@query(f"{_MSG} SELECT id, session_id, prev_id FROM msgs WHERE turn >= 2")
def mint_messages(g: Bound) -> DataFrame:
    from weftgraph.operators import scan

    m = scan.message_payload(messages(g)).select("id", "session_id", "prev_id", "turn")
    once = scan.delta(m, m.where("turn < 2"))
    return scan.delta(m, m.where("turn < 2").unionAll(once).where("turn < 2")).select("id", "session_id", "prev_id")


@query("SELECT skey AS key, arg_max(ts, seq) AS started_at, arg_max(session, seq) FILTER (WHERE session IS NOT NULL) AS tag FROM journal WHERE verb = 'session' GROUP BY skey")
def session_upsert(g: Bound) -> DataFrame:
    ops = g.journal.where("verb = 'session'").select("seq", F.col("skey").alias("key"), F.col("ts").alias("started_at"), F.col("session").alias("tag"))
    return log.merge_properties(ops, "key", ["started_at", "tag"])


@query("""r AS (SELECT skey AS key, max(seq) FILTER (WHERE verb = 'session') AS reg, max(seq) FILTER (WHERE verb = 'unlink') AS ret FROM journal GROUP BY skey) SELECT key FROM r WHERE reg IS NOT NULL AND (ret IS NULL OR reg > ret)""")
def session_retract(g: Bound) -> DataFrame:
    ops = g.journal.where("verb in ('session', 'unlink')").select("seq", F.col("skey").alias("key"), F.when(F.col("verb") == "session", "source").otherwise("retire").alias("op"), F.lit("").alias("content"))
    return log.latest_state(ops).select("key")
