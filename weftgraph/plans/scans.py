"""Registered queries: scans, sources and sinks, and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.bind import Bound, uid
from weftgraph.functions import text
from weftgraph.model import NAME_STOPWORDS, STOPWORDS, TEXT_FIELDS, TITLE_FIELDS, stable_id
from weftgraph.operators import log, scan
from weftgraph.plans.base import query

_HAY = "lower(concat_ws(' ', " + ", ".join(f"nullif({f},'')" for f in TEXT_FIELDS) + "))"


@query("SELECT id, label, name, slug, statement FROM nodes")
def scan_rows(g: Bound) -> DataFrame:
    return scan.scan_rows(g.nodes, ["label", "name", "slug", "statement"])


@query("SELECT id, label, name FROM nodes WHERE label = 'CodeModule' ORDER BY id LIMIT 100")
def load_label(g: Bound) -> DataFrame:
    return scan.load_label(g.nodes, "CodeModule", 100).select("id", "label", "name")


@query("SELECT id, slug, note_type FROM nodes WHERE label = 'Note' AND note_type = 'en' AND path = 'src7' ORDER BY id LIMIT 20 OFFSET 2")
def load_label_where(g: Bound) -> DataFrame:
    return scan.load_label_where(g.nodes, "Note", ["note_type=en", "path = src7"], 20, 2).select("id", "slug", "note_type")


@query("SELECT id, name FROM nodes WHERE label = 'CodeSymbol' AND cell_key = '3' AND symbol_kind = 'function'")
def parse_where(g: Bound) -> DataFrame:
    return g.nodes.where(scan.parse_where(["label=CodeSymbol", "cell_key=3", "symbol_kind=function"])).select("id", "name")


@query("SELECT count(*) AS n FROM nodes WHERE label = 'Decision' AND status = 'F'")
def count_label(g: Bound) -> DataFrame:
    return scan.count_label(g.nodes, "Decision", ["status=F"])


_IDS = f"SELECT DISTINCT {uid(chr(39) + 'Order|' + chr(39) + '||o_orderkey')} AS id FROM orders WHERE o_orderkey % 50 = 0"


def _some_ids(g: Bound) -> DataFrame:
    return g.table("orders").where("o_orderkey % 50 = 0").select(stable_id("Order", F.col("o_orderkey")).alias("id"))


@query(f"SELECT id, label, statement FROM nodes WHERE id IN ({_IDS})")
def load_nodes(g: Bound) -> DataFrame:
    return scan.load_nodes(g.nodes, _some_ids(g)).select("id", "label", "statement")


@query("SELECT source_id, target_id FROM edges WHERE relation_type = 'GATED_BY'")
def edge_pairs(g: Bound) -> DataFrame:
    return scan.edge_pairs(g.edges, "GATED_BY")


@query(f"s AS ({_IDS}) SELECT source_id, relation_type, target_id FROM edges WHERE source_id IN (SELECT id FROM s) OR target_id IN (SELECT id FROM s)")
def edges_touching(g: Bound) -> DataFrame:
    return scan.edges_touching(g.labelled_edges, _some_ids(g), label="Decision").select("source_id", "relation_type", "target_id")


@query("SELECT 'label' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'relation', relation_type, count(*) FROM edges GROUP BY relation_type")
def schema(g: Bound) -> DataFrame:
    return scan.schema(g.nodes, g.edges)


@query("SELECT seq, verb, ts, session, actor FROM journal")
def journal_scan(g: Bound) -> DataFrame:
    return scan.journal_scan(g.journal).select("seq", "verb", "ts", "session", "actor")


@query("SELECT source_id, relation_type, target_id FROM edges")
def export_edges(g: Bound) -> DataFrame:
    return scan.export_edges(g.edges)


_CLAUSE_SQL = """
flatted AS (SELECT id, label, f, CASE WHEN f IS NULL THEN NULL ELSE trim(regexp_replace(f, '\\s+', ' ', 'g')) END AS s FROM (SELECT id, label, nullif(trim({field}), '') AS f FROM nodes)),
cuts AS (SELECT id, s, unnest(range(15, 111)) AS i FROM flatted WHERE length(s) > 110),
best AS (SELECT id, max(i) AS i FROM cuts WHERE (substr(substr(s,1,111), i+1, 2) IN (': ', '. ', '; ') OR substr(substr(s,1,111), i+1, 3) = ' — ')
  AND length(replace(substr(s,1,i),'(','')) = length(replace(substr(s,1,i),')','')) GROUP BY id),
clause AS (SELECT f.id, f.label, CASE WHEN s IS NULL THEN NULL WHEN length(s) <= 110 THEN s WHEN b.i IS NOT NULL THEN rtrim(regexp_replace(substr(s,1,b.i), '[.:;— ]+$', '')) ELSE rtrim(substr(s,1,109))||'…' END AS clause FROM flatted f LEFT JOIN best b ON f.id = b.id)
"""


@query(_CLAUSE_SQL.format(field="text") + "SELECT id, clause FROM clause WHERE label = 'Note'")
def first_clause(g: Bound) -> DataFrame:
    return g.nodes.where("label = 'Note'").select("id", text.first_clause(text.filled(F.col("text"))).alias("clause"))


@query(_CLAUSE_SQL.format(field="coalesce(nullif(trim(statement),''), nullif(trim(value),''), nullif(trim(text),''), source)") + """
SELECT n.id, n.label, coalesce(nullif(trim(title),''), nullif(trim(name),''), nullif(trim(slug),''), nullif(trim(key),''), nullif(trim(subject_label),''), clause, n.id) AS title FROM nodes n JOIN clause c ON n.id = c.id""")
def export_nodes(g: Bound) -> DataFrame:
    return scan.export_nodes(g.nodes)


@query(_CLAUSE_SQL.format(field="statement") + """
SELECT n.id, n.label, coalesce(nullif(trim(title),''), nullif(trim(name),''), nullif(trim(slug),''), nullif(trim(key),''), clause, n.id) AS title FROM nodes n JOIN clause c ON n.id = c.id""")
def node_title(g: Bound) -> DataFrame:
    return g.nodes.select("id", "label", text.node_title(TITLE_FIELDS).alias("title"))


@query("""
parts AS (SELECT id, label, name, 0 AS part FROM nodes WHERE label IN ('Anchor','Topic') UNION ALL SELECT id, 'Copy', name, 1 FROM nodes WHERE label IN ('Anchor','Entity'))
SELECT id, arg_min(label, part) AS label, arg_min(name, part) AS name FROM parts GROUP BY id""")
def assemble_graph(g: Bound) -> DataFrame:
    n = g.nodes.select("id", "label", "name")
    return scan.assemble_graph([n.where("label in ('Anchor','Topic')"), n.where("label in ('Anchor','Entity')").withColumn("label", F.lit("Copy"))])


@query(f"""
specs AS (SELECT DISTINCT lower(p_brand) AS package, 'brand#'||((p_partkey + 1) % 26)||CASE p_partkey % 3 WHEN 0 THEN '>=1.'||p_size WHEN 1 THEN '[extra]~=2.0' ELSE '' END AS spec FROM part
  UNION SELECT lower(p_brand), 'numpy>=1.0' FROM part),
deps AS (SELECT DISTINCT package, regexp_extract(spec, '^([A-Za-z0-9._#-]+)', 1) AS dep FROM specs)
SELECT {uid("'Entity|'||package")} AS source_id, 'DEPENDS_ON' AS relation_type, {uid("'Entity|'||CASE WHEN dep = 'brand#0' THEN 'brand#25' ELSE dep END")} AS target_id FROM deps
WHERE dep LIKE 'brand#%' AND package <> CASE WHEN dep = 'brand#0' THEN 'brand#25' ELSE dep END GROUP BY ALL""")
def dependency_edges(g: Bound) -> DataFrame:
    p = g.table("part")
    spec = F.concat(F.lit("Brand#"), (F.col("p_partkey") + 1) % 26, F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(">=1."), "p_size")).when(F.col("p_partkey") % 3 == 1, "[extra]~=2.0").otherwise(""))
    specs = p.select(F.col("p_brand").alias("package"), spec.alias("dep_spec")).unionAll(p.select("p_brand", F.lit("numpy>=1.0")))
    aliases = g.spark.sql("SELECT 'brand#0' AS name, 'brand#25' AS canonical")
    return scan.dependency_edges(specs, "brand#", aliases)


@query(f"""SELECT {uid("'Doc|'||doc_id")} AS note_id, i AS ord, 's'||i AS anchor, raw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)""")
def corpus_sections(g: Bound) -> DataFrame:
    return scan.corpus_sections(g.nodes.where("label = 'Note'"))


@query("""SELECT page_id, slug, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"/?#]+)"', 1)) AS slug FROM pages) GROUP BY ALL""")
def corpus_references(g: Bound) -> DataFrame:
    return scan.corpus_references(g.table("pages"))


# Source states: users are keys; view → source, error → retire, signup → cutover; the content is the event's value.
_STATE = """
ops AS (SELECT seq, user_id AS key, CASE event_type WHEN 'view' THEN 'source' WHEN 'error' THEN 'retire' WHEN 'signup' THEN 'cutover' END AS op, CAST(value AS VARCHAR) AS content FROM journal WHERE event_type IN ('view','error','signup')),
last_state AS (SELECT key, arg_max(op, seq) AS op, arg_max(content, seq) AS content FROM ops WHERE op IN ('source','retire') GROUP BY key),
latest AS (SELECT key, content FROM last_state WHERE op = 'source'),
owned AS (SELECT key FROM (SELECT key, arg_max(op, seq) AS op FROM ops WHERE op IN ('cutover','retire') GROUP BY key) WHERE op = 'cutover')
"""


def source_ops(g: Bound) -> DataFrame:
    op = F.when(F.col("event_type") == "view", "source").when(F.col("event_type") == "error", "retire").when(F.col("event_type") == "signup", "cutover")
    return g.journal.select("seq", F.col("user_id").alias("key"), op.alias("op"), F.col("value").cast("string").alias("content")).where("op is not null")


@query(_STATE + """, scanned AS (SELECT c_custkey AS key, c_name AS scan FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(s.key, l.key) AS key, CASE WHEN o.key IS NOT NULL AND l.content IS NOT NULL THEN l.content ELSE scan END AS content,
 CASE WHEN o.key IS NOT NULL AND l.content IS NOT NULL THEN 'log' ELSE 'file' END AS origin
FROM scanned s FULL JOIN latest l ON s.key = l.key LEFT JOIN owned o ON o.key = coalesce(s.key, l.key) WHERE scan IS NOT NULL OR (o.key IS NOT NULL AND l.content IS NOT NULL)""")
def source_override_merge(g: Bound) -> DataFrame:
    ops = source_ops(g)
    scanned = g.table("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("content"))
    return scan.source_override_merge(scanned, log.latest_state(ops), log.sourced_keys(ops))


@query("""
targets AS (SELECT id, name FROM nodes WHERE label = 'CodeSymbol' AND cell_key = '1' AND module_id IN (SELECT id FROM nodes WHERE label = 'CodeModule' AND module_path = 'LARGE')),
u AS (SELECT name, min(id) AS t FROM targets GROUP BY name HAVING count(DISTINCT id) = 1)
SELECT DISTINCT n.id AS source_id, 'CALLS' AS relation_type, t AS target_id FROM nodes n JOIN u USING (name) WHERE label = 'CodeSymbol' AND n.id <> t""")
def resolve_code_edges(g: Bound) -> DataFrame:
    symbols = g.nodes.where("label = 'CodeSymbol'")
    large = g.nodes.where("label = 'CodeModule' and module_path = 'LARGE'").select(F.col("id").alias("module_id"))
    targets = symbols.where("cell_key = '1'").join(large, "module_id", "left_semi").select("id", "name")
    return scan.resolve_names(symbols.select("id", "name"), targets, "CALLS")


@query("""
m AS (SELECT id AS module_id, module_path FROM nodes WHERE label = 'CodeModule'),
s AS (SELECT n.id, n.name, m.module_path LIKE 'PROMO%' AS test, n.cell_key FROM nodes n JOIN m USING (module_id) WHERE label = 'CodeSymbol'),
u AS (SELECT name, min(id) AS t FROM s WHERE NOT test AND cell_key IN ('1','2') GROUP BY name HAVING count(DISTINCT id) = 1)
SELECT DISTINCT s.id AS source_id, 'TESTS' AS relation_type, t AS target_id FROM s JOIN u USING (name) WHERE test AND s.id <> t""")
def resolve_test_edges(g: Bound) -> DataFrame:
    modules = g.nodes.where("label = 'CodeModule'").select(F.col("id").alias("module_id"), F.col("module_path").startswith("PROMO").alias("test"))
    symbols = g.nodes.where("label = 'CodeSymbol'").select("id", "name", "module_id", "cell_key").join(modules, "module_id")
    return scan.resolve_names(symbols.where("test"), symbols.where("not test and cell_key in ('1','2')"), "TESTS")


def messages(g: Bound) -> DataFrame:
    c = g.table("conversations")
    return c.select(F.col("conv_id").alias("session"), stable_id("Conv", F.col("conv_id")).alias("session_id"), "turn", stable_id("Msg", F.col("conv_id"), F.col("turn")).alias("id"), "role", "text")


_MSG = f"""msgs AS (SELECT conv_id AS session, {uid("'Conv|'||conv_id")} AS session_id, turn, {uid("'Msg|'||conv_id||'|'||turn")} AS id, lag({uid("'Msg|'||conv_id||'|'||turn")}) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_id FROM conversations)"""


@query(f"{_MSG} SELECT session, turn, id, prev_id FROM msgs")
def message_payload(g: Bound) -> DataFrame:
    return scan.message_payload(messages(g)).select("session", "turn", "id", "prev_id")


@query("SELECT id, label, key, role, ts, source FROM nodes WHERE label IN ('Session', 'Message')")
def message_nodes(g: Bound) -> DataFrame:
    return g.nodes.where("label in ('Session', 'Message')").select("id", "label", "key", "role", "ts", "source")


@query(f"{_MSG} SELECT id AS source_id, 'PART_OF' AS relation_type, session_id AS target_id FROM msgs UNION ALL SELECT coalesce(prev_id, session_id), CASE WHEN prev_id IS NULL THEN 'STARTS_WITH' ELSE 'NEXT' END, id FROM msgs")
def message_edges(g: Bound) -> DataFrame:
    return scan.message_edges(scan.message_payload(messages(g)))


@query(f"{_MSG} SELECT id, turn FROM msgs WHERE turn > 1")
def message_delta(g: Bound) -> DataFrame:
    m = messages(g)
    return scan.delta(m.select("id", "turn"), m.where("turn <= 1"))


@query(f"""{_MSG}, sent AS (SELECT session, max(turn) AS turn FROM msgs GROUP BY session),
p AS (SELECT s.session, m.id AS target_id, row_number() OVER (PARTITION BY s.session ORDER BY m.turn) - 1 AS ord, s.turn FROM sent s JOIN msgs m ON m.session = s.session AND m.turn < s.turn)
SELECT m.id AS source_id, 'DERIVED_FROM' AS relation_type, p.target_id, p.ord FROM p JOIN msgs m ON m.session = p.session AND m.turn = p.turn""")
def derived_edges(g: Bound) -> DataFrame:
    m = messages(g)
    ordered = m.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("turn", "id"))).alias("all"))
    sent = ordered.select(F.element_at("all", -1)["id"].alias("id"), F.transform(F.slice("all", F.lit(1), F.size("all") - 1), lambda x: x["id"]).alias("parts"))
    return scan.derived_edges(sent)


@query(f"""results AS (SELECT source_id AS request, string_agg(target_id, ' ' ORDER BY target_id) || ' ' || source_id || ' ' || source_id AS body FROM edges WHERE relation_type = 'REFERENCES' GROUP BY source_id)
SELECT request, len(f) AS n, list_aggregate(f[1:3], 'string_agg', ',') AS ids FROM (SELECT request, list_sort(list_distinct(regexp_extract_all(body, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}'))) AS f FROM results)""")
def reads_ledger_ids(g: Bound) -> DataFrame:
    refs = g.edges.where("relation_type = 'REFERENCES'").groupBy("source_id").agg(F.array_join(F.sort_array(F.collect_list("target_id")), " ").alias("t"))
    results = refs.select(F.col("source_id").alias("request"), F.concat_ws(" ", "t", "source_id", "source_id").alias("body"))
    found = scan.reads_ledger(results, keep=500)
    return found.select("request", F.col("n").cast("long").alias("n"), F.array_join(F.slice(F.sort_array("ids"), 1, 3), ",").alias("ids"))


@query(_STATE + "SELECT o.seq, o.key, o.content FROM ops o WHERE op = 'source' AND NOT EXISTS (SELECT 1 FROM latest l WHERE l.key = o.key AND l.content = o.content)")
def append_dedup(g: Bound) -> DataFrame:
    ops = source_ops(g)
    return scan.append_dedup(ops.where("op = 'source'").select("seq", "key", "content"), log.latest_state(ops))


@query("SELECT user_id AS key, arg_max(CAST(value AS VARCHAR), seq) AS content FROM journal WHERE event_type = 'signup' GROUP BY user_id")
def register_latest(g: Bound) -> DataFrame:
    events = g.journal.where("event_type = 'signup'").select(F.col("user_id").alias("key"), F.col("value").cast("string").alias("content"), "seq")
    return scan.register_latest(events, "key", "content", "seq")


@query(_STATE + "SELECT key, 'retire' AS op, 'k'||(key + 1) AS successor FROM latest WHERE key % 3 = 0")
def append_retire(g: Bound) -> DataFrame:
    asked = g.table("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.concat(F.lit("k"), F.col("c_custkey") + 1).alias("successor"))
    return asked.join(log.latest_state(source_ops(g)), "key", "left_semi").select("key", F.lit("retire").alias("op"), "successor")


@query("SELECT verb, session, n FROM (SELECT verb, session, count(*) AS n FROM journal WHERE verb IN ('link','unlink') GROUP BY ALL)")
def append_reads(g: Bound) -> DataFrame:
    reads = g.journal.where("verb in ('link','unlink')").select("verb", "session", "subject")
    return reads.where("verb = 'link'").unionAll(reads.where("verb = 'unlink'")).groupBy("verb", "session").agg(F.count("*").alias("n"))


@query(_STATE + ", a AS (SELECT c_custkey AS key, 'cust-'||c_custkey AS durable FROM customer WHERE c_custkey % 2 = 1) SELECT coalesce(durable, CAST(l.key AS VARCHAR)) AS key, content, o.key IS NOT NULL AS flipped FROM latest l LEFT JOIN a USING (key) LEFT JOIN owned o USING (key)")
def normalised_state(g: Bound) -> DataFrame:
    ops = source_ops(g)
    a = g.table("customer").where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("key"), F.concat(F.lit("cust-"), "c_custkey").alias("durable"))
    rows = log.latest_state(ops).join(a, "key", "left").join(log.sourced_keys(ops).withColumn("flipped", F.lit(True)), "key", "left")
    return rows.select(F.coalesce("durable", F.col("key").cast("string")).alias("key"), "content", F.coalesce("flipped", F.lit(False)).alias("flipped"))


@query("SELECT assertion_id, slot_id, subject_id, predicate, value, asserted_at FROM claims")
def claims_scan(g: Bound) -> DataFrame:
    return g.claims.select("assertion_id", "slot_id", "subject_id", "predicate", "value", "asserted_at")


# Scalar functions.
_SNIPPET = "CASE WHEN length(b) > 160 THEN substr(b,1,159)||'…' ELSE nullif(b,'') END"


@query(_CLAUSE_SQL.format(field="statement") + f"""
SELECT n.id, coalesce(nullif(trim(title),''), nullif(trim(name),''), nullif(trim(slug),''), nullif(trim(key),''), clause, n.id) AS title,
 coalesce(nullif(description,''), {_SNIPPET}) AS description, note_type, entity_kind, status
FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS b FROM nodes) n JOIN clause c ON n.id = c.id""")
def node_summary(g: Bound) -> DataFrame:
    parts = text.node_summary()
    return g.nodes.select("id", *(parts[k].alias(k) for k in ("title", "description", "note_type", "entity_kind", "status")))


@query(f"SELECT id, {_HAY} AS haystack FROM nodes WHERE label IN ('Decision', 'Anchor', 'CodeSymbol')")
def haystack(g: Bound) -> DataFrame:
    return g.nodes.where("label in ('Decision', 'Anchor', 'CodeSymbol')").select("id", text.haystack().alias("haystack"))


_STOP = "['" + "','".join(STOPWORDS) + "']"


@query(f"SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x))), ' ') AS terms FROM conversations")
def query_terms(g: Bound) -> DataFrame:
    return g.table("conversations").select("conv_id", "turn", F.array_join(F.sort_array(text.query_terms(F.col("text"))), " ").alias("terms"))


_NAME_STOP = "['" + "','".join(NAME_STOPWORDS) + "']"


@query(f"SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(name, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x))), lambda x: NOT list_contains({_NAME_STOP}, x))), ' ') AS tokens FROM (SELECT p_partkey, replace(p_name,' ','_')||'GetValue'||p_size||'_of' AS name FROM part)")
def name_tokens(g: Bound) -> DataFrame:
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("GetValue"), "p_size", F.lit("_of"))
    return g.table("part").select("p_partkey", F.array_join(F.sort_array(text.name_tokens(name)), " ").alias("tokens"))


@query(r"SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(statement, '\b[0-9a-f]{8}\b'), lambda x: NOT regexp_matches(x, '^[0-9]{8}$')))), ' ') AS tokens FROM nodes WHERE label = 'Decision'")
def id_tokens(g: Bound) -> DataFrame:
    return g.nodes.where("label = 'Decision'").select("id", F.array_join(F.sort_array(text.id_tokens(F.col("statement"))), " ").alias("tokens"))


@query("SELECT DISTINCT p_name, coalesce(nullif(trim(regexp_replace(lower(p_name||' / '||p_brand), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unnamed') AS slug FROM part")
def term_slug(g: Bound) -> DataFrame:
    return g.table("part").select("p_name", text.term_slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug")).distinct()


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'durable-'||c_custkey ELSE c_name END AS key FROM customer")
def conceptual_key(g: Bound) -> DataFrame:
    c = g.table("customer")
    aliases = c.where("c_custkey % 5 = 0").select("c_name", F.concat(F.lit("durable-"), "c_custkey").alias("durable"))
    return c.join(aliases, "c_name", "left").select("c_custkey", F.coalesce("durable", "c_name").alias("key"))


@query(r"SELECT subject_id, regexp_extract(trim(value), '^(\S+)', 1) AS target, trim(regexp_replace(regexp_replace(trim(value), '^\S+\s*', ''), '^[—\- ]+', '')) AS pin_gloss FROM claims WHERE predicate LIKE 'pin.%'")
def pin_target(g: Bound) -> DataFrame:
    parts = text.pin_target(F.col("value"))
    return g.claims.where("predicate like 'pin.%'").select("subject_id", parts["target"].alias("target"), parts["pin_gloss"].alias("pin_gloss"))


@query("SELECT doc_id, text AS body, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS lead FROM documents")
def strip_frontmatter(g: Bound) -> DataFrame:
    d = g.table("documents").withColumn("full", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\nname: x\n---\n"), "text")).otherwise(F.col("text")))
    return d.select("doc_id", text.strip_frontmatter(F.col("full")).alias("body"), text.lead_line(F.col("full")).alias("lead"))


_SUMMARY = "CASE verb WHEN 'assert' THEN 'value = '||CAST(round(value) AS BIGINT) WHEN 'decide' THEN 'buys '||substr(object,1,8) WHEN 'session' THEN 'key='||skey ELSE 'relation=REFERENCES' END"


def op_args(g: Bound) -> DataFrame:
    """journal with its arguments by name."""
    v = F.col("verb")
    return g.journal.select("*", F.when(v == "assert", "value").alias("predicate"), F.when(v == "decide", F.concat(F.lit("buys "), F.substring("object", 1, 8))).alias("statement"), F.when(v == "session", F.col("skey")).alias("key"), F.when(v.isin("link", "unlink"), "REFERENCES").alias("relation"), F.round("value").cast("long").cast("string").alias("said"))


@query(f"SELECT seq, {_SUMMARY} AS summary FROM journal")
def op_summary(g: Bound) -> DataFrame:
    args = {k: F.col(k) for k in ("predicate", "statement", "key", "relation")} | {"value": F.col("said")}
    return op_args(g).select("seq", text.op_summary(args).alias("summary"))


@query("SELECT o_orderkey, round(1.0 + 0.5 / (1.0 + greatest((1.1e9 - epoch(o_orderdate)) / 86400.0, 0) / 30.0), 6) AS factor FROM orders")
def recency_factor(g: Bound) -> DataFrame:
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6
    return g.table("orders").select("o_orderkey", F.round(text.recency_factor(at, F.lit(1.1e9)), 6).alias("factor"))


@query("""v AS (SELECT subject_id, actor, value, string_split(value, '.')::INT[] AS parts FROM claims WHERE predicate = 'version')
SELECT a.subject_id, CASE WHEN b.parts > a.parts THEN 'newer' WHEN b.parts < a.parts THEN 'older' ELSE 'equal' END AS second FROM v a JOIN v b ON a.subject_id = b.subject_id AND a.actor = 'a' AND b.actor = 'b'""")
def semver_compare(g: Bound) -> DataFrame:
    v = g.claims.where("predicate = 'version'").select("subject_id", "actor", text.semver(F.col("value")).alias("parts"))
    a, b = v.where("actor = 'a'").select("subject_id", F.col("parts").alias("x")), v.where("actor = 'b'").select("subject_id", F.col("parts").alias("y"))
    return a.join(b, "subject_id").select("subject_id", F.when(F.col("y") > F.col("x"), "newer").when(F.col("y") < F.col("x"), "older").otherwise("equal").alias("second"))


@query("SELECT n.id, n.label, t.title, path FROM nodes n JOIN (SELECT id, title FROM title_of) t ON n.id = t.id WHERE n.label IN ('Note', 'Anchor', 'Entity')")
def locate_row(g: Bound) -> DataFrame:
    return g.nodes.where("label in ('Note', 'Anchor', 'Entity')").select("id", "label", text.node_title().alias("title"), "path")


@query(r"SELECT doc_id, CASE WHEN length(s) <= 90 THEN s ELSE rtrim(substr(s,1,89))||'…' END AS capped FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)")
def cap_text(g: Bound) -> DataFrame:
    return g.table("documents").select("doc_id", text.cap_text(F.col("text"), 90).alias("capped"))


@query("SELECT id, position('.' IN qualname) = 0 AS is_top, NOT starts_with(string_split(qualname, '.')[-1], '_') AS is_public, regexp_matches(string_split(qualname, '.')[-1], '^__.*__$') AS is_dunder FROM nodes WHERE label = 'CodeSymbol'")
def member_flags(g: Bound) -> DataFrame:
    flags = text.member_flags(F.col("qualname"))
    return g.nodes.where("label = 'CodeSymbol'").select("id", *(c.alias(k) for k, c in flags.items()))


@query("SELECT e.source_id, coalesce(t.title, e.source_id) AS source_title, e.target_id FROM edges e LEFT JOIN title_of t ON t.id = e.source_id WHERE relation_type = 'REFERENCES' AND (t.label IS NULL OR t.label <> 'Decision')")
def label_ids(g: Bound) -> DataFrame:
    refs = g.edges.where("relation_type = 'REFERENCES'").select("source_id", "target_id")
    decisions = g.nodes.where("label = 'Decision'").select(F.col("id").alias("source_id"))
    return text.label_ids(refs.join(decisions, "source_id", "left_anti"), "source_id", g.nodes, "source_title")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'named-'||doc_id ELSE 'file-'||doc_id END AS slug FROM documents")
def note_slug(g: Bound) -> DataFrame:
    d = g.table("documents")
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\nname: named-"), "doc_id", F.lit("\n---\n"), F.regexp_replace("text", "name:", "")))
    return d.select("doc_id", text.note_slug(F.concat(F.lit("notes/file-"), "doc_id", F.lit(".md")), body).alias("slug"))


@query(f"SELECT o_orderkey, {uid(chr(39) + 'Order|' + chr(39) + '||o_orderkey')} AS id FROM orders")
def stable_ids(g: Bound) -> DataFrame:
    return g.table("orders").select("o_orderkey", stable_id("Order", F.col("o_orderkey")).alias("id"))


@query("""SELECT p_partkey, CASE WHEN lv < 1 OR lv > 3 THEN '' ELSE array_to_string(list_concat(['pkg','sub',lower(p_type)][1:4-lv], CASE WHEN p_partkey % 2 = 0 THEN [split_part(p_name,' ',1)] ELSE [] END), '.') END AS target
FROM (SELECT *, p_size % 5 AS lv FROM part)""")
def resolve_relative(g: Bound) -> DataFrame:
    package = F.concat(F.lit("pkg.sub."), F.lower("p_type"))
    module = F.when(F.col("p_partkey") % 2 == 0, F.split_part("p_name", F.lit(" "), F.lit(1)))
    return g.table("part").select("p_partkey", text.resolve_relative(package, F.col("p_size") % 5, module).alias("target"))
