"""Registered queries: the fact layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.bind import Bound, uid
from weftgraph.model import stable_id
from weftgraph.operators import facts
from weftgraph.plans.base import query


def active(g: Bound) -> DataFrame:
    return facts.active_claims(g.claims, g.supersedes)


@query("SELECT slot_id, count(*) AS n_claims, min(asserted_at) AS first_at, max(asserted_at) AS last_at FROM claims GROUP BY slot_id")
def group_by_slot(g: Bound) -> DataFrame:
    return facts.group_by_slot(g.claims)


@query("SELECT assertion_id, slot_id, value FROM active")
def active_assertions(g: Bound) -> DataFrame:
    return active(g).select("assertion_id", "slot_id", "value")


@query("""SELECT subject_id, predicate, count(*) AS n, string_agg(DISTINCT value, '|' ORDER BY value) AS "values" FROM active WHERE predicate IN ('version','role','return_policy','note_flag') GROUP BY subject_id, predicate""")
def active_values(g: Bound) -> DataFrame:
    return facts.active_values(active(g).where("predicate in ('version','role','return_policy','note_flag')"))


_CONFLICT = "SELECT slot_id, subject_id, predicate, count(*) AS n_active FROM active WHERE predicate {which} GROUP BY slot_id, subject_id, predicate HAVING count(*) >= 2 AND count(DISTINCT lower(trim(value))) >= 2"
_HARD = _CONFLICT.format(which="IN (SELECT predicate FROM registry WHERE typed AND ordered IS NULL AND NOT multivalued)")
_SOFT = _CONFLICT.format(which="NOT IN (SELECT predicate FROM registry WHERE typed)")


@query(_HARD)
def contradictions(g: Bound) -> DataFrame:
    return facts.contradictions(active(g), g.registry)


@query(_SOFT)
def soft_conflicts(g: Bound) -> DataFrame:
    return facts.soft_conflicts(active(g), g.registry)


@query("SELECT predicate, count(DISTINCT slot_id) AS n_slots FROM active WHERE predicate NOT IN (SELECT predicate FROM registry WHERE typed) GROUP BY predicate")
def untyped_predicates(g: Bound) -> DataFrame:
    return facts.untyped_predicates(active(g), g.registry)


_VERSIONS = """
v AS (SELECT slot_id, assertion_id, actor, string_split(value,'.')::INT[] AS r FROM claims WHERE predicate = 'version'),
sup AS (SELECT DISTINCT CASE WHEN n.r > o.r THEN n.assertion_id ELSE o.assertion_id END AS superseder, CASE WHEN n.r > o.r THEN o.assertion_id ELSE n.assertion_id END AS superseded
  FROM v n JOIN v o USING (slot_id) WHERE n.actor = 'b' AND o.actor = 'a' AND n.r <> o.r)"""


def _versions(g: Bound) -> tuple[DataFrame, DataFrame]:
    v = g.claims.where("predicate = 'version'")
    return v.where("actor = 'a'"), v.where("actor = 'b'")


@query(_VERSIONS + " SELECT superseder, superseded FROM sup")
def auto_supersede(g: Bound) -> DataFrame:
    return facts.auto_supersede(*_versions(g), g.registry)


@query("""r AS (SELECT c.assertion_id, c.slot_id, CASE WHEN ascii(substr(c.slot_id,1,1)) % 2 = 0 THEN ' '||lower(o.value) ELSE o.assertion_id END AS token FROM claims c JOIN claims o USING (slot_id) WHERE c.predicate = 'return_policy' AND c.value = 'R' AND o.value = 'N')
SELECT DISTINCT r.assertion_id, r.token, c.assertion_id AS superseded FROM r JOIN claims c ON c.slot_id = r.slot_id AND (c.assertion_id = r.token OR lower(trim(c.value)) = lower(trim(r.token))) WHERE r.assertion_id <> c.assertion_id""")
def explicit_supersede(g: Bound) -> DataFrame:
    p = g.claims.where("predicate = 'return_policy'")
    new, old = p.where("value = 'R'").select("assertion_id", "slot_id"), p.where("value = 'N'").select("slot_id", F.col("assertion_id").alias("old_id"), F.col("value").alias("old"))
    token = F.when(F.ascii(F.substring("slot_id", 1, 1)) % 2 == 0, F.concat(F.lit(" "), F.lower("old"))).otherwise(F.col("old_id"))
    return facts.explicit_supersede(new.join(old, "slot_id").select("assertion_id", "slot_id", token.alias("token")), g.claims)


@query("""SELECT DISTINCT n.assertion_id AS source_id, o.assertion_id AS target_id FROM claims n JOIN active o USING (slot_id) WHERE n.predicate = 'return_policy' AND n.value = 'A' AND lower(n.value) <> lower(o.value) AND n.assertion_id NOT IN (SELECT superseded FROM supersedes)""")
def record_contradicts(g: Bound) -> DataFrame:
    return facts.record_contradicts(g.claims.where("predicate = 'return_policy' and value = 'A'"), active(g), g.supersedes)


@query(_VERSIONS + """ SELECT c.assertion_id, c.slot_id, c.value, c.assertion_id IN (SELECT superseded FROM sup) AS born_superseded FROM claims c WHERE predicate = 'version' AND actor = 'b'""")
def assert_batch(g: Bound) -> DataFrame:
    old, new = _versions(g)
    fresh = new.join(old.select("assertion_id"), "assertion_id", "left_anti")
    born = facts.auto_supersede(old, fresh, g.registry).select(F.col("superseded").alias("assertion_id")).distinct().withColumn("born", F.lit(True))
    return fresh.join(born, "assertion_id", "left").select("assertion_id", "slot_id", "value", F.coalesce("born", F.lit(False)).alias("born_superseded"))


_ALIAS = "aliases AS (SELECT name, min(id) AS id FROM (SELECT id, unnest([lower(trim(key)), lower(trim(name)), lower(trim(replace(name,'#','')))]) AS name FROM nodes WHERE label = 'Entity') WHERE name <> '' GROUP BY name)"


def aliases(g: Bound) -> DataFrame:
    return facts.alias_index(g.nodes.where("label = 'Entity'"))


@query(_ALIAS + " SELECT name, id FROM aliases")
def alias_index(g: Bound) -> DataFrame:
    return aliases(g)


_ASKED = f"""asked AS (SELECT {uid("'Supplier|'||s_suppkey")} AS subject FROM supplier WHERE s_suppkey % 5 = 0 UNION SELECT substr({uid("'Supplier|'||s_suppkey")},1,12) FROM supplier WHERE s_suppkey % 5 = 1
  UNION SELECT s_name FROM supplier WHERE s_suppkey % 5 = 2 UNION SELECT 'abcdef0123'||s_suppkey FROM supplier WHERE s_suppkey % 5 = 3 UNION SELECT 'New Term '||s_suppkey FROM supplier WHERE s_suppkey % 5 = 4)"""
_RESOLVED = _ASKED + ", " + _ALIAS + f""",
pre AS (SELECT subject, count(*) AS n, min(n2.id) AS id FROM asked a JOIN nodes n2 ON regexp_matches(subject, '^[0-9a-fA-F][0-9a-fA-F-]{{5,34}}$') AND starts_with(n2.id, lower(subject)) GROUP BY subject),
resolved AS (SELECT a.subject,
 CASE WHEN n.id IS NOT NULL THEN 'id' WHEN p.n = 1 THEN 'prefix' WHEN p.n > 1 THEN 'ambiguous' WHEN al.id IS NOT NULL THEN 'alias' WHEN regexp_matches(a.subject, '^[0-9a-fA-F][0-9a-fA-F-]{{5,35}}$') AND length(a.subject) <> 36 THEN 'unresolved' ELSE 'minted' END AS outcome,
 coalesce(n.id, CASE WHEN p.n = 1 THEN p.id END, CASE WHEN p.n IS NULL THEN al.id END,
  CASE WHEN p.n IS NULL AND NOT (regexp_matches(a.subject, '^[0-9a-fA-F][0-9a-fA-F-]{{5,35}}$') AND length(a.subject) <> 36) THEN {uid("'Entity|'||trim(regexp_replace(lower(a.subject), '[^a-z0-9]+', '-', 'g'), '-')")} END) AS id
 FROM asked a LEFT JOIN (SELECT DISTINCT id FROM nodes) n ON n.id = a.subject LEFT JOIN pre p ON p.subject = a.subject LEFT JOIN aliases al ON al.name = lower(trim(a.subject)))"""


def asked(g: Bound) -> DataFrame:
    k, i = F.col("s_suppkey"), stable_id("Supplier", F.col("s_suppkey"))
    subject = F.when(k % 5 == 0, i).when(k % 5 == 1, F.substring(i, 1, 12)).when(k % 5 == 2, F.col("s_name")).when(k % 5 == 3, F.concat(F.lit("abcdef0123"), k)).otherwise(F.concat(F.lit("New Term "), k))
    return g.table("supplier").select(subject.alias("subject"))


@query(_RESOLVED + " SELECT subject, outcome, id FROM resolved")
def resolve_subject(g: Bound) -> DataFrame:
    return facts.resolve_subjects(asked(g), g.nodes, aliases(g))


@query("SELECT 'drifted-'||s_suppkey AS drifted, 'supplier-'||s_suppkey AS canonical FROM supplier WHERE s_suppkey % 2 = 0")
def note_alias_map(g: Bound) -> DataFrame:
    """Active aka claims bound from even suppliers; those that a later claim superseded map nothing."""
    s = g.table("supplier")
    claims = s.select(F.concat(F.lit("c"), "s_suppkey").alias("assertion_id"), stable_id("Supplier", F.col("s_suppkey")).alias("subject_id"), F.concat(F.lit("drifted-"), "s_suppkey").alias("value"))
    gone = s.where("s_suppkey % 2 = 1").select(F.lit("x").alias("superseder"), F.concat(F.lit("c"), "s_suppkey").alias("superseded"))
    keys = g.nodes.where("label = 'Entity'").select(F.col("id").alias("subject_id"), F.col("key").alias("canonical"))
    return facts.active_claims(claims, gone).join(keys, "subject_id").select(F.col("value").alias("drifted"), "canonical")


@query("SELECT subject_id, state FROM states")
def task_states(g: Bound) -> DataFrame:
    return facts.task_states(active(g))


@query("SELECT subject_id, last_touch FROM touched")
def last_touch(g: Bound) -> DataFrame:
    return facts.last_touch(g.claims)


_OBSERVED = f"SELECT {uid(chr(39) + 'Supplier|' + chr(39) + '||s_suppkey')} AS subject_id, CASE WHEN s_suppkey % 10 = 9 THEN 'unreadable' ELSE '1.'||s_nationkey||'.'||(s_suppkey % 6) END AS value FROM supplier UNION ALL SELECT 'new-subject', '2.0'"


@query(f"""o AS (SELECT subject_id, CASE WHEN value = 'unreadable' THEN NULL ELSE string_split(value,'.')::INT[] END AS seen FROM ({_OBSERVED})),
k AS (SELECT subject_id, max(string_split(value,'.')::INT[]) AS known FROM active WHERE predicate = 'version' GROUP BY subject_id)
SELECT o.subject_id, CASE WHEN seen IS NULL THEN 'skipped' WHEN known IS NULL THEN 'first_seen' WHEN seen = known THEN 'unchanged' WHEN seen > known THEN 'bumped' ELSE 'skipped' END AS outcome FROM o LEFT JOIN k USING (subject_id)""")
def oracle_refresh(g: Bound) -> DataFrame:
    s = g.table("supplier")
    value = F.when(F.col("s_suppkey") % 10 == 9, "unreadable").otherwise(F.concat(F.lit("1."), "s_nationkey", F.lit("."), F.col("s_suppkey") % 6))
    seen = s.select(stable_id("Supplier", F.col("s_suppkey")).alias("subject_id"), value.alias("value")).unionAll(g.spark.sql("SELECT 'new-subject', '2.0'"))
    return facts.oracle_refresh(seen, active(g))


@query(f"""SELECT {uid("'Op|'||seq")} AS source_id, 'SUPPORTED_BY' AS relation_type, object AS target_id FROM journal WHERE verb = 'decide'
UNION ALL SELECT {uid("'Op|'||seq")}, 'DECIDED_IN', {uid("'Sess|'||session")} FROM journal WHERE verb = 'decide' AND session IS NOT NULL
UNION ALL SELECT {uid("'Op|'||seq")}, 'SUPERSEDES', {uid("'Op|'||prev")} FROM (SELECT seq, lag(seq) OVER (PARTITION BY user_id ORDER BY seq) AS prev FROM journal WHERE verb = 'decide') WHERE prev IS NOT NULL""")
def decide_rows(g: Bound) -> DataFrame:
    from pyspark.sql import Window

    d = g.journal.where("verb = 'decide'").withColumn("prev", F.lag("seq").over(Window.partitionBy("user_id").orderBy("seq")))
    op = stable_id("Op", F.col("seq"))
    ends = F.array(F.struct(F.lit("SUPPORTED_BY").alias("r"), F.col("object").alias("t")), F.when(F.col("session").isNotNull(), F.struct(F.lit("DECIDED_IN").alias("r"), stable_id("Sess", F.col("session")).alias("t"))), F.when(F.col("prev").isNotNull(), F.struct(F.lit("SUPERSEDES").alias("r"), stable_id("Op", F.col("prev")).alias("t"))))
    return d.select(op.alias("source_id"), F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("e")).select("source_id", F.col("e.r").alias("relation_type"), F.col("e.t").alias("target_id"))


@query(_RESOLVED + """, good AS (SELECT subject, id FROM resolved WHERE outcome IN ('id','prefix','alias'))
SELECT a.id AS source_id, 'ABOUT' AS relation_type, b.id AS target_id FROM good a, (SELECT id FROM nodes WHERE label = 'Anchor' AND name = 'NATION_3') b""")
def link_batch(g: Bound) -> DataFrame:
    anchor = stable_id("Nation", F.lit(3))
    requests = asked(g).select(F.col("subject").alias("source"), F.lit("ABOUT").alias("relation"), anchor.alias("target"))
    return facts.link_batch(requests, g.nodes, aliases(g))[0]


@query(_RESOLVED + " SELECT subject AS source, 'ABOUT' AS relation FROM resolved WHERE outcome NOT IN ('id','prefix','alias')")
def link_rejects(g: Bound) -> DataFrame:
    requests = asked(g).select(F.col("subject").alias("source"), F.lit("ABOUT").alias("relation"), stable_id("Nation", F.lit(3)).alias("target"))
    return facts.link_batch(requests, g.nodes, aliases(g))[1].select("source", "relation")


@query("SELECT source_id, relation_type, target_id FROM edges WHERE NOT (relation_type = 'REFERENCES' AND ascii(substr(source_id,1,1)) % 2 = 0)")
def unlink_batch(g: Bound) -> DataFrame:
    gone = g.edges.where("relation_type = 'REFERENCES' and ascii(substr(source_id,1,1)) % 2 = 0")
    absent = g.spark.sql("SELECT 'absent' AS source_id, 'X' AS relation_type, 'absent' AS target_id")
    columns = ["source_id", "relation_type", "target_id"]
    return facts.unlink_batch(g.edges, gone.select(*columns).unionAll(absent)).select(*columns)


@query(f"""SELECT DISTINCT {uid("'Check|'||l_orderkey||'|'||l_linenumber")} AS check_id, {uid("'Order|'||l_orderkey")} AS item_id, 'open' AS state FROM lineitem WHERE l_linestatus = 'O'""")
def check_rows(g: Bound) -> DataFrame:
    return g.table("lineitem").where("l_linestatus = 'O'").select(stable_id("Check", F.col("l_orderkey"), F.col("l_linenumber")).alias("check_id"), stable_id("Order", F.col("l_orderkey")).alias("item_id"), F.lit("open").alias("state")).distinct()


@query("SELECT n.key, arg_max(a.value, (a.asserted_at, a.assertion_id)) AS purpose FROM active a JOIN nodes n ON n.id = a.subject_id WHERE a.predicate = 'version' GROUP BY n.key")
def repo_purpose(g: Bound) -> DataFrame:
    keys = g.nodes.where("label = 'Entity'").select(F.col("id").alias("subject_id"), "key")
    return active(g).where("predicate = 'version'").join(keys, "subject_id").groupBy("key").agg(F.max_by("value", F.struct("asserted_at", "assertion_id")).alias("purpose"))
