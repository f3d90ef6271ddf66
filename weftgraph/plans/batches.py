"""Registered queries: batches of claims, imports and calls from lists, clusters of a search, minted messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.bind import Bound, uid
from weftgraph.operators import facts, scan, traverse
from weftgraph.plans.base import query
from weftgraph.plans.claims import _ALIAS, aliases
from weftgraph.plans.graph import _SCORED, prepared, scored

# A batch that meets itself and what is there: versions of suppliers by id, prefix and name, several of one slot; policies of
# parts, some of which name what they supersede; names that are not known yet; subjects that lead nowhere; repeated requests.
_SUPPLIER, _PART = uid("'Supplier|'||s_suppkey"), uid("'Part|'||p_partkey")
_REQUESTS = [
    f"SELECT s_suppkey * 4 AS n, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN {_SUPPLIER} ELSE substr({_SUPPLIER}, 1, 14) END AS subject, 'version' AS predicate, '1.'||s_nationkey||'.'||(s_suppkey % 9) AS value, CAST(NULL AS STRING) AS token FROM supplier",
    f"SELECT s_suppkey * 4 + 1, {_SUPPLIER}, 'version', '2.0.'||(s_suppkey % 2), NULL FROM supplier WHERE s_suppkey % 2 = 0",
    f"SELECT s_suppkey * 4 + 2, {_SUPPLIER}, 'version', '1.0.5', NULL FROM supplier WHERE s_suppkey % 4 = 0",
    "SELECT s_suppkey * 4 + 3, CASE WHEN s_suppkey % 7 = 0 THEN 'abcdef0123'||s_suppkey ELSE 'Fresh Term '||(s_suppkey % 10) END, 'color', 'shade '||(s_suppkey % 3), NULL FROM supplier",
    f"SELECT 10000000 + p_partkey * 2, {_PART}, 'return_policy', CASE p_partkey % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'R' WHEN 2 THEN 'A ' ELSE 'n' END, NULL FROM part",
    f"SELECT 10000001 + p_partkey * 2, {_PART}, 'return_policy', 'Z', CASE WHEN p_partkey % 2 = 0 THEN ' x' ELSE 'R' END FROM part WHERE p_partkey % 5 = 0",
    f"SELECT 20000000 + s_suppkey, {_SUPPLIER}, 'version', '2.0.'||(s_suppkey % 2), NULL FROM supplier WHERE s_suppkey % 2 = 0",
]
_BATCH = (
    "requests AS (" + " UNION ALL ".join(_REQUESTS) + "), " + _ALIAS + f""",
pre AS (SELECT subject, count(*) AS n, min(n2.id) AS id FROM (SELECT DISTINCT subject FROM requests WHERE regexp_matches(subject, '^[0-9a-fA-F][0-9a-fA-F-]{{5,34}}$')) a JOIN nodes n2 ON substr(n2.id, 1, 6) = lower(substr(subject, 1, 6)) AND starts_with(n2.id, lower(subject)) GROUP BY subject),
resolved AS (SELECT a.subject, n.id IS NULL AND p.n IS NULL AND al.id IS NULL AND shaped IS NOT TRUE AS created_subject,
   coalesce(n.id, CASE WHEN p.n = 1 THEN p.id END, CASE WHEN p.n IS NULL THEN al.id END, CASE WHEN p.n IS NULL AND NOT shaped THEN {uid("'Entity|'||trim(regexp_replace(lower(a.subject), '[^a-z0-9]+', '-', 'g'), '-')")} END) AS subject_id
   FROM (SELECT DISTINCT subject, regexp_matches(subject, '^[0-9a-fA-F][0-9a-fA-F-]{{5,35}}$') AND length(subject) <> 36 AS shaped FROM requests) a
   LEFT JOIN (SELECT DISTINCT id FROM nodes) n ON n.id = a.subject LEFT JOIN pre p ON p.subject = a.subject LEFT JOIN aliases al ON al.name = lower(trim(a.subject))),
asked AS (SELECT r.n, subject_id, predicate, value, token, created_subject, 'batch' AS actor, 2e9 + r.n AS asserted_at, {uid("subject_id||'|'||predicate")} AS slot_id, {uid("subject_id||'|'||predicate||'|'||value||'|batch'")} AS assertion_id FROM requests r JOIN resolved USING (subject) WHERE subject_id IS NOT NULL),
old AS (SELECT {uid("subject_id||'|'||predicate||'|'||value||'|'||actor")} AS assertion_id, {uid("subject_id||'|'||predicate")} AS slot_id, subject_id, predicate, value FROM active),
fresh AS (SELECT assertion_id, any_value(slot_id) AS slot_id, any_value(subject_id) AS subject_id, any_value(predicate) AS predicate, any_value(value) AS value, arg_min(token, n) AS token, arg_min(created_subject, n) AS created_subject, min(n) AS n, arg_min(asserted_at, n) AS asserted_at FROM asked WHERE assertion_id NOT IN (SELECT assertion_id FROM old) GROUP BY assertion_id),
slot_rows AS (SELECT *, lower(trim(value)) AS canon, CASE predicate WHEN 'version' THEN string_split(value, '.')::INT[] END AS r FROM (
   SELECT assertion_id, slot_id, predicate, value, -1 AS n, NULL AS token FROM old WHERE slot_id IN (SELECT slot_id FROM fresh) UNION ALL SELECT assertion_id, slot_id, predicate, value, n, token FROM fresh) q),
told AS (SELECT hit.assertion_id, arg_min(t.assertion_id, t.n) AS told FROM slot_rows t JOIN slot_rows hit ON hit.slot_id = t.slot_id AND hit.n < t.n AND (hit.assertion_id = t.token OR hit.canon = lower(trim(t.token))) GROUP BY hit.assertion_id),
heads AS (SELECT slot_id, r, lead(head) OVER (PARTITION BY slot_id ORDER BY r) AS higher FROM (SELECT slot_id, r, arg_min(assertion_id, (n, assertion_id)) AS head FROM slot_rows WHERE r IS NOT NULL GROUP BY slot_id, r) q),
seen AS (SELECT s.*, coalesce(higher, told) AS superseder FROM slot_rows s LEFT JOIN heads h ON h.slot_id = s.slot_id AND h.r = s.r LEFT JOIN told t ON t.assertion_id = s.assertion_id),
final AS (SELECT a.assertion_id, count(b.assertion_id) AS others, arg_min(b.assertion_id, (b.n, b.assertion_id)) AS witness FROM seen a JOIN seen b ON b.slot_id = a.slot_id AND (b.n, b.assertion_id) < (a.n, a.assertion_id) AND b.canon <> a.canon AND b.superseder IS NULL
   WHERE a.superseder IS NULL AND a.n >= 0 AND a.predicate IN ('return_policy', 'color') GROUP BY a.assertion_id)"""
)


def _requests(g: Bound) -> DataFrame:
    parts = [g.spark.sql(r.replace("FROM supplier", "FROM {supplier}").replace("FROM part", "FROM {part}"), supplier=g.table("supplier"), part=g.table("part")) for r in _REQUESTS]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    return rows.select(F.col("n").cast("long").alias("n"), "subject", "predicate", "value", F.lit("batch").alias("actor"), (2e9 + F.col("n")).alias("asserted_at"), F.when(F.col("token").isNotNull(), F.array("token")).alias("supersede"))


PREDICATES = ("version", "color", "return_policy")  # of the batch


def mine() -> Column:
    return F.col("predicate").isin(*PREDICATES)


def _batch(g: Bound) -> tuple[DataFrame, DataFrame]:
    """A slot is one of a predicate, so of the claims only those of the batch's predicates can meet it."""
    known = {c: F.col(c) for c in g.claims.columns} | {"assertion_id": facts.stable_id(F.col("subject_id"), F.col("predicate"), F.col("value"), F.col("actor")), "slot_id": facts.stable_id(F.col("subject_id"), F.col("predicate"))}
    active = facts.active_claims(g.claims.where(mine()), g.supersedes.where(mine())).select(*(v.alias(c) for c, v in known.items()))
    none = g.supersedes.limit(0)
    return facts.write_batch(_requests(g), g.nodes, aliases(g), active, none, g.registry)


@query(_BATCH + """ SELECT f.assertion_id, f.slot_id, f.subject_id, f.predicate, f.value, 'batch' AS actor, f.asserted_at, f.created_subject,
  coalesce((SELECT max(b.r) FROM slot_rows b WHERE b.slot_id = f.slot_id AND (b.n, b.assertion_id) < (f.n, f.assertion_id)) > s.r, false) AS born_superseded, s.superseder,
  CASE WHEN f.predicate = 'return_policy' THEN coalesce(others, 0) ELSE 0 END AS n_conflicts, CASE WHEN f.predicate = 'return_policy' THEN witness END AS contradicts, f.predicate = 'color' AND others IS NOT NULL AS soft_conflict
  FROM fresh f JOIN seen s USING (assertion_id) LEFT JOIN final USING (assertion_id)""")
def write_batch(g: Bound) -> DataFrame:
    return _batch(g)[0]


@query(_BATCH + " SELECT n, subject, predicate, value, 'unresolved' AS outcome FROM requests JOIN resolved USING (subject) WHERE subject_id IS NULL")
def write_rejected(g: Bound) -> DataFrame:
    requests = _requests(g)
    return facts.rejected_requests(requests, facts.resolve_subjects(requests, g.nodes, aliases(g)))


# Lists of imports and calls: a module's imports come from its parts (absolute, relative, above the package, foreign), a
# symbol's calls are the names of what is ordered next to it.
_CODE = f"""
mods AS (SELECT id, import_name, name LIKE '%LARGE' AS is_package FROM nodes WHERE label = 'CodeModule'),
raw_imports AS (SELECT DISTINCT {uid("'Module|'||p_brand||'/'||p_type")} AS id, CASE p_partkey % 5 WHEN 0 THEN 'brand_'||(p_size % 26)||'.'||lower(p_type) WHEN 1 THEN '.'||(CASE p_size % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'promo' END) WHEN 2 THEN '..brand_'||(p_size % 26)||'.small' WHEN 3 THEN '...' ELSE 'numpy' END AS raw FROM part)"""
_IMPORTS = _CODE + """,
lev AS (SELECT i.id, raw, length(regexp_extract(raw, '^(\\.*)', 1)) AS level, CASE WHEN is_package THEN import_name ELSE regexp_replace(import_name, '\\.?[^.]*$', '') END AS package FROM raw_imports i JOIN mods USING (id)),
target AS (SELECT id, CASE WHEN level = 0 THEN raw WHEN len(string_split(package, '.')) - level + 1 >= 1 THEN array_to_string(list_filter(list_concat(list_slice(string_split(package, '.'), 1, len(string_split(package, '.')) - level + 1), [regexp_replace(raw, '^\\.+', '')]), lambda x: x <> ''), '.') ELSE '' END AS name FROM lev)"""


@query(_IMPORTS + " SELECT DISTINCT t.id AS source_id, 'IMPORTS' AS relation_type, m.id AS target_id FROM target t JOIN (SELECT import_name, min(id) AS id FROM mods WHERE import_name <> '' GROUP BY import_name) m ON m.import_name = t.name WHERE t.id <> m.id")
def resolve_imports(g: Bound) -> DataFrame:
    raw = "CASE p_partkey % 5 WHEN 0 THEN 'brand_'||(p_size % 26)||'.'||lower(p_type) WHEN 1 THEN '.'||(CASE p_size % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'promo' END) WHEN 2 THEN '..brand_'||(p_size % 26)||'.small' WHEN 3 THEN '...' ELSE 'numpy' END"
    lists = g.table("part").groupBy(facts.stable_id("Module", F.concat_ws("/", "p_brand", "p_type")).alias("id")).agg(F.collect_set(F.expr(raw)).alias("imports"))
    modules = g.nodes.where("label = 'CodeModule'").select("id", "import_name", F.col("name").endswith("LARGE").alias("is_package"))
    return scan.resolve_imports(modules.join(lists, "id"))


@query(f"""
syms AS (SELECT id, CASE WHEN p_partkey % 10 = 0 THEN 'own_'||p_partkey ELSE string_split(qualname, '.')[-1] END AS bare FROM nodes JOIN part ON id = {_PART} WHERE label = 'CodeSymbol'),
named AS (SELECT bare AS name, min(id) AS id FROM syms WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT id) = 1),
listed AS (SELECT DISTINCT {uid("'Part|'||a")} AS id, CASE WHEN b % 10 = 0 THEN 'own_'||b ELSE replace(p_name, ' ', '_') END AS name FROM calls_parts JOIN part ON p_partkey = b)
SELECT DISTINCT l.id AS source_id, 'CALLS' AS relation_type, n.id AS target_id FROM listed l JOIN named n USING (name) WHERE l.id <> n.id""")
def resolve_calls(g: Bound) -> DataFrame:
    """Every tenth symbol has a name of its own; most others share theirs, so calls of these stay unresolved."""
    own = F.concat(F.lit("own_"), "p_partkey")
    parts = g.table("part").select(facts.stable_id("Part", F.col("p_partkey")).alias("id"), "p_partkey", F.when(F.col("p_partkey") % 10 == 0, own).otherwise(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("called"))
    calls = g._sql("calls_parts").join(parts.select(F.col("p_partkey").alias("b"), "called"), "b")
    lists = calls.groupBy(facts.stable_id("Part", F.col("a")).alias("id")).agg(F.collect_set("called").alias("calls"))
    symbols = g.nodes.where("label = 'CodeSymbol'").select("id", "qualname").join(parts.select("id", "p_partkey"), "id").join(lists, "id", "left")
    qualname = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("m."), own)).otherwise(F.col("qualname"))
    return scan.resolve_calls(symbols.select("id", qualname.alias("qualname"), "calls"))


_FACET = _SCORED + """, passing AS (SELECT s.id, s.score, s.seed_id, n.label FROM scored s JOIN nodes n USING (id) WHERE {where}), t AS (SELECT count(*) AS total FROM passing)
SELECT part, value, score, p.n AS n, total, total <= {budget} AS complete FROM (
  SELECT * FROM (SELECT 'member' AS part, id AS value, round(score, 3) AS score, NULL AS n FROM passing ORDER BY passing.score DESC, id LIMIT {budget}) UNION ALL
  SELECT '{axis}', {column}, NULL, count(*) FROM passing GROUP BY {column} HAVING (SELECT total FROM t) > {budget}) p, t"""


@query(_FACET.format(where="label = 'Entity'", axis="seed", column="seed_id", budget=5))
def explore_kind(g: Bound) -> DataFrame:
    """The cluster kind = Entity: its best 5 members and its breakdown by seed."""
    return traverse.explore(scored(prepared(g)), g.nodes, [("kind", "Entity")], 5)


@query(_FACET.format(where="true", axis="seed", column="seed_id", budget=5))
def explore_all(g: Bound) -> DataFrame:
    return traverse.explore(scored(prepared(g)), g.nodes, [], 5)


_MINT = f"""
msg AS (SELECT conv_id, turn, {uid("'Msg|'||conv_id||'|'||turn")} AS id, {uid("'Conv|'||conv_id")} AS session_id, lag({uid("'Msg|'||conv_id||'|'||turn")}) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_id, role, text FROM conversations),
gone AS (SELECT DISTINCT id FROM msg WHERE turn >= 2),
part_of AS (SELECT id AS source_id, 'PART_OF' AS relation_type, session_id AS target_id, CAST(NULL AS INT) AS ord FROM msg UNION ALL SELECT coalesce(prev_id, session_id), CASE WHEN prev_id IS NULL THEN 'STARTS_WITH' ELSE 'NEXT' END, id, NULL FROM msg
  UNION ALL SELECT {uid("'Msg|'||conv_id||'|3'")}, 'DERIVED_FROM', {uid("'Msg|'||conv_id||'|'||turn")}, 2 - turn FROM msg WHERE turn IN (1, 2) AND conv_id IN (SELECT conv_id FROM msg WHERE turn = 3))"""


def _minted(g: Bound) -> tuple[DataFrame, ...]:
    """What minting all conversations adds to a graph that has the first two turns of each, with their edges; with the inputs of the mint."""
    from weftgraph.plans.scans import messages

    rows = scan.message_payload(messages(g)).select("id", "session_id", "prev_id", "role", "text", F.when(F.col("session") % 2 == 0, F.concat(F.lit("cc-"), "session")).alias("transcript"), "session", "turn")
    of = lambda turn: facts.stable_id("Msg", F.col("session"), F.lit(turn))
    sent = rows.where("turn = 3").select("id", F.array(of(2), of(1)).alias("parts"))
    early = rows.where("turn < 2")
    known = early.select("id").unionAll(early.select("session_id"))
    edges = scan.message_edges(early)
    claims = g.claims.select("assertion_id").limit(0)
    return rows, sent, known, edges, claims, *scan.mint_messages(rows, sent, known, edges, claims)


@query(_MINT + " SELECT id, 'Message' AS label, role, text FROM msg WHERE turn >= 2 UNION ALL SELECT session_id, 'Session', NULL, NULL FROM msg GROUP BY session_id HAVING min(turn) >= 2")
def mint_nodes(g: Bound) -> DataFrame:
    return _minted(g)[5]


@query(_MINT + " SELECT source_id, relation_type, target_id, min(ord) AS ord FROM part_of p WHERE relation_type = 'DERIVED_FROM' OR source_id IN (SELECT id FROM gone) OR target_id IN (SELECT id FROM gone) GROUP BY ALL")
def mint_edges(g: Bound) -> DataFrame:
    return _minted(g)[6]


@query(_MINT + f""" SELECT DISTINCT {uid("session_id||'|cc_session_uuid|cc-'||conv_id")} AS assertion_id, session_id AS subject_id, 'cc_session_uuid' AS predicate, 'cc-'||conv_id AS value FROM msg WHERE conv_id % 2 = 0""")
def mint_facts(g: Bound) -> DataFrame:
    return _minted(g)[7]


@query(_MINT + """ SELECT (SELECT count(*) FROM msg WHERE turn >= 2) + (SELECT count(*) FROM (SELECT session_id FROM msg GROUP BY session_id HAVING min(turn) >= 2)) AS nodes,
  (SELECT count(*) FROM (SELECT DISTINCT source_id, relation_type, target_id FROM part_of WHERE relation_type = 'DERIVED_FROM' OR source_id IN (SELECT id FROM gone) OR target_id IN (SELECT id FROM gone))) AS edges,
  (SELECT count(DISTINCT conv_id) FROM msg WHERE conv_id % 2 = 0) AS facts, 0 AS again""")
def mint_again(g: Bound) -> DataFrame:
    """How much a mint adds, and how much the same messages add to the graph that it gave: nothing."""
    rows, sent, known, edges, claims, *added = _minted(g)
    again = scan.mint_messages(rows, sent, known.unionAll(added[0].select("id")), edges.unionAll(added[1].select(*edges.columns)), claims.unionAll(added[2].select("assertion_id")))
    counts = [x.agg(F.count("*").alias(n)) for x, n in zip(added, ("nodes", "edges", "facts"), strict=True)]
    more = again[0].select("id").unionAll(again[1].select("source_id")).unionAll(again[2].select("assertion_id"))
    return counts[0].join(counts[1]).join(counts[2]).join(more.agg(F.count("*").alias("again")))  # one row each
