"""Registered queries: display rules, lenses and anchor views."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.bind import Bound, uid
from weftgraph.functions import text
from weftgraph.model import stable_id
from weftgraph.operators import anchors, display, frontier, lens, log, search, traverse
from weftgraph.plans.base import query
from weftgraph.plans.claims import active
from weftgraph.plans.frontier import _FILED, buckets, states
from weftgraph.plans.frontier import anchors as work_anchors
from weftgraph.plans.graph import _SCORED, TASK, prepared
from weftgraph.plans.log import _TOUCH, touches

RULES = {"Anchor": "{name|12} in {->PART_OF.name} with {#<-PART_OF} filed", "Entity": "{name}: {#<-ABOUT} orders {->REFERENCES}"}
_CAP = "CASE WHEN length(n.name) <= 12 THEN n.name ELSE rtrim(substr(n.name, 1, 11))||'…' END"


@query(f"""po AS (SELECT source_id AS id, min(target_id) AS t FROM edges WHERE relation_type = 'PART_OF' GROUP BY 1), pi AS (SELECT target_id AS id, count(*) AS c FROM edges WHERE relation_type = 'PART_OF' GROUP BY 1),
ab AS (SELECT target_id AS id, count(*) AS c FROM edges WHERE relation_type = 'ABOUT' GROUP BY 1), re AS (SELECT source_id AS id, min(target_id) AS t FROM edges WHERE relation_type = 'REFERENCES' GROUP BY 1)
SELECT n.id, n.label, CASE n.label WHEN 'Anchor' THEN {_CAP}||' in '||coalesce(r.name,'')||' with '||coalesce(pi.c,0)||' filed' ELSE trim(n.name||': '||coalesce(ab.c,0)||' orders '||coalesce(t.title,'')) END AS display_title
FROM nodes n LEFT JOIN po ON po.id = n.id LEFT JOIN nodes r ON r.id = po.t LEFT JOIN pi ON pi.id = n.id LEFT JOIN ab ON ab.id = n.id LEFT JOIN re ON re.id = n.id LEFT JOIN title_of t ON t.id = re.t WHERE n.label IN ('Anchor','Entity')""")
def display_annotate(g: Bound) -> DataFrame:
    return display.annotate(g.nodes, g.edges, RULES)


def rule_ops(g: Bound) -> DataFrame:
    """Rules as the journal's decisions write them: every third has a token of no kind."""
    template = F.when(F.col("seq") % 3 == 0, "{#->ABOUT.name}").otherwise(F.concat(F.lit("{name|"), (F.col("seq") % 50 + 1).cast("string"), F.lit("}")))
    return g.journal.where("verb = 'decide'").select("seq", F.concat(F.lit("Label"), F.col("user_id") % 20).alias("label"), template.alias("template"))


@query("SELECT 'Label'||(user_id % 20) AS label, '{name|'||(max(seq) % 50 + 1)||'}' AS template FROM journal WHERE verb = 'decide' AND seq % 3 <> 0 GROUP BY 1")
def display_rule_validate(g: Bound) -> DataFrame:
    return display.latest_rules(rule_ops(g))


# Lenses.
def _nation(k: int) -> str:
    m = hashlib.md5(f"Nation|{k}".encode()).hexdigest()
    return "-".join((m[:8], m[8:12], m[12:16], m[16:20], m[20:]))


FRONT = [*map(_nation, range(25)), "00000000-0000-0000-0000-000000000000"]
SPEC = {
    "params": [{"name": "since", "type": "timestamp", "required": True}, {"name": "kind", "default": "Anchor"}],
    "selection": [
        {"verb": "list", "args": {"label": "{kind}"}},
        {"verb": "readiness", "args": {"states": ["ready"]}},
        {"verb": "journal-window", "args": {"start": "{since}"}},
        {"verb": "grep", "args": {"term": "supplier#00000000"}},
    ],
    "expand": {"hops": 1, "relations": ["PART_OF"]},
}
GIVEN = {"since": "2024-01-03"}


def verbs(g: Bound) -> dict:
    ids = lambda rows: rows.select(F.col("id").alias("ref"))
    return {
        "list": lambda a: ids(search.list_label(g.nodes, a["label"], a.get("contains"), a.get("limit", 500))),
        "grep": lambda a: ids(search.grep(g.nodes, a["term"]).orderBy("label", "title", "id").limit(a.get("limit", 25))),
        "relevant": lambda a: ids(traverse.relevant(traverse.score_task(search.find_seeds(g.nodes, a["task"]).checkpoint(), g.edges), g.nodes, a.get("k", 12))),
        "readiness": lambda a: buckets(g).where(F.col("bucket").isin(*a.get("states", ["ready", "blocked"]))).select(F.col("item_id").alias("ref")),
        "journal-window": lambda a: log.journal_window(log.in_window(touches(g), *(None if a.get(k) is None else lens.timestamp(a[k]) for k in ("start", "end")))).select("ref"),
        "subgraph": lambda a: g.spark.createDataFrame([(r,) for r in a["refs"]], "ref string"),
    }


def selected(g: Bound) -> DataFrame:
    return lens.selections(SPEC, GIVEN, verbs(prepared(g)))


_LENS = _TOUCH + """,
picked AS (SELECT 0 AS clause, 'list' AS verb, id AS ref FROM nodes WHERE label = 'Anchor' UNION ALL SELECT 1, 'readiness', item_id FROM ready WHERE bucket = 'ready'
  UNION ALL SELECT 2, 'journal-window', ref FROM (SELECT DISTINCT ref FROM touches WHERE ts >= 1704240000)
  UNION ALL SELECT 3, 'grep', id FROM (SELECT n.id FROM nodes n JOIN title_of t USING (id) WHERE contains(lower(concat_ws(chr(31), n.title, n.name, n.slug, n.key, n.description, n.statement, n.value, n.text, n.source, n.body)), 'supplier#00000000') ORDER BY n.label, t.title, n.id LIMIT 25)),
lens_refs AS (SELECT ref, min(clause) AS clause FROM picked GROUP BY ref)"""


@query(_LENS + " SELECT ref, clause, t.label, t.title, t.id IS NULL AS missing FROM lens_refs LEFT JOIN title_of t ON t.id = ref")
def lens_apply(g: Bound) -> DataFrame:
    n = g.nodes.select(F.col("id").alias("ref"), "label", text.node_title().alias("title"))
    return lens.union_refs(selected(g)).join(n, "ref", "left").select("ref", "clause", "label", "title", F.col("label").isNull().alias("missing"))


@query(_LENS + """, known AS (SELECT ref AS id FROM lens_refs JOIN nodes ON id = ref),
grown AS (SELECT id FROM known UNION SELECT n.id FROM edges e JOIN known k ON e.source_id = k.id JOIN nodes n ON n.id = e.target_id WHERE e.relation_type = 'PART_OF' UNION SELECT n.id FROM edges e JOIN known k ON e.target_id = k.id JOIN nodes n ON n.id = e.source_id WHERE e.relation_type = 'PART_OF')
SELECT source_id, relation_type, target_id FROM edges WHERE source_id IN (SELECT id FROM grown) AND target_id IN (SELECT id FROM grown)""")
def lens_edges(g: Bound) -> DataFrame:
    refs = lens.union_refs(selected(g)).select(F.col("ref").alias("id")).checkpoint()  # read for the nodes twice
    nodes = g.nodes.select("id", "label")
    seeds = traverse.among(nodes, refs).checkpoint()
    reached = traverse.subgraph_members(seeds, g.edges, SPEC["expand"]["hops"], SPEC["expand"]["relations"]).where("expanded")
    members = seeds.unionAll(traverse.among(nodes, reached.select("id"))).checkpoint()
    labels = [r.label for r in members.select("label").distinct().collect()]  # as many as there are kinds of nodes
    edges = g.labelled_edges.where(F.col("source_label").isin(labels) & F.col("target_label").isin(labels))
    return traverse.subgraph_edges(members, edges)


#: What a search finds, and a fixed sub-graph: the nations of the bound graph by id, and one that is gone.
SEARCH = {"params": [{"name": "task", "required": True}, {"name": "most", "default": 12}], "selection": [{"verb": "relevant", "args": {"task": "{task}", "k": "{most}"}}, {"verb": "subgraph", "args": {"refs": FRONT}}]}


@query(_SCORED + f""", picked AS (SELECT 0 AS clause, 'relevant' AS verb, id AS ref FROM (SELECT id FROM scored ORDER BY round(score, 3) DESC, id LIMIT 12) UNION ALL SELECT 1, 'subgraph', unnest({FRONT!r}))
SELECT ref, min(clause) AS clause, min(label) AS label FROM picked LEFT JOIN nodes ON id = ref GROUP BY ref""")
def lens_search(g: Bound) -> DataFrame:
    """A lens of the clauses that search and that name a sub-graph."""
    found = lens.selections(SEARCH, {"task": TASK}, verbs(prepared(g)))
    n = g.nodes.select(F.col("id").alias("ref"), "label")
    return lens.union_refs(found).join(n, "ref", "left").select("ref", "clause", "label")


@query(_LENS + " SELECT clause, verb, count(*) AS selected FROM picked GROUP BY clause, verb")
def lens_clause_counts(g: Bound) -> DataFrame:
    return lens.clause_counts(selected(g))


def lens_ops(g: Bound) -> DataFrame:
    """Lenses as the journal's assertions write them: every fourth selects by a verb of no kind."""
    verb = F.when(F.col("seq") % 4 == 0, "draw").otherwise("list")
    spec = F.concat(F.lit('{"selection":[{"verb":"'), verb, F.lit('","args":{"label":"L'), F.col("seq").cast("string"), F.lit('"}}]}'))
    return g.journal.where("verb = 'assert'").select("seq", F.concat(F.lit("lens-"), F.col("user_id") % 40).alias("slug"), F.concat(F.lit("Lens "), F.col("seq")).alias("title"), spec.alias("spec"))


@query("""SELECT 'lens-'||(user_id % 40) AS slug, 'Lens '||max(seq) AS title, '{"selection":[{"verb":"list","args":{"label":"L'||max(seq)||'"}}]}' AS spec FROM journal WHERE verb = 'assert' AND seq % 4 <> 0 GROUP BY 1""")
def lens_shelf(g: Bound) -> DataFrame:
    return lens.shelf(lens_ops(g))


@query("SELECT seq, CASE WHEN seq % 4 = 0 THEN 'spec.selection[0].verb: unknown value' ELSE '' END AS errors FROM journal WHERE verb = 'assert'")
def lens_validate(g: Bound) -> DataFrame:
    check = F.udf(lambda s: "; ".join(lens.errors_of(lens.read_spec(s))), "string", useArrow=True)
    return lens_ops(g).select("seq", check("spec").alias("errors"))


def _bound_label(label: str, stray: bool) -> str:
    spec = {"params": [{"name": "kind", "required": True}], "selection": [{"verb": "list", "args": {"label": "{kind}", "contains": "of {kind}"}}]}
    try:
        args = lens.substitute(spec["selection"][0]["args"], lens.bind(spec, {"kind": label} | ({"other": 1} if stray else {})))
    except ValueError as e:
        return str(e)
    return json.dumps(args)


@query("""SELECT seq, CASE WHEN seq % 5 = 0 THEN 'undeclared parameters: other' ELSE '{"label": "L'||user_id||'", "contains": "of L'||user_id||'"}' END AS args FROM journal WHERE verb = 'assert'""")
def lens_bind(g: Bound) -> DataFrame:
    bound = F.udf(_bound_label, "string", useArrow=True)
    return g.journal.where("verb = 'assert'").select("seq", bound(F.concat(F.lit("L"), "user_id"), F.col("seq") % 5 == 0).alias("args"))


# Anchor views.  Every front door also pins a register of each role, and one that is gone.
_LEAD = f"""firsts AS (SELECT subject_id, predicate, arg_min(value, (asserted_at, assertion_id)) AS value FROM active GROUP BY subject_id, predicate),
base_lead AS (SELECT predicate AS kind, subject_id, '' AS key, value FROM firsts WHERE predicate IN ('role','priority')
  UNION ALL SELECT 'status', subject_id, substr(predicate, 1, length(predicate) - 7), value FROM firsts WHERE ends_with(predicate, '-status') AND length(predicate) > 7
  UNION ALL SELECT 'pin', subject_id, substr(predicate, 5), value FROM active WHERE starts_with(predicate, 'pin.') AND length(predicate) > 4),
door AS (SELECT subject_id AS anchor_id, value AS role FROM base_lead WHERE kind = 'role' AND value IN ('portfolio','program')),
hub_values AS (SELECT DISTINCT value FROM base_lead WHERE kind = 'role'),
hubs AS (SELECT {uid("'Hub|'||value")} AS id, value||'-register' AS slug, value FROM hub_values),
lead_rows AS (SELECT * FROM base_lead UNION ALL SELECT 'pin', anchor_id, 'register', id||' - register' FROM door, (SELECT id FROM hubs UNION ALL SELECT {uid("'Hub|gone'")}) h),
all_titles AS (SELECT id, title FROM title_of UNION ALL SELECT id, slug FROM hubs),
pinned AS (SELECT anchor_id, key AS role, regexp_extract(value, '^(\\S+)', 1) AS id, trim(regexp_replace(regexp_replace(value, '^\\S+\\s*', ''), '^[—\\- ]+', '')) AS gloss FROM lead_rows JOIN door ON subject_id = anchor_id WHERE kind = 'pin')"""


def lead(g: Bound) -> DataFrame:
    return anchors.lead_structure(active(g), g.edges)


def with_hubs(g: Bound) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lead rows, front-door anchors and nodes, with the registers."""
    base = lead(prepared(g)).checkpoint()  # read about ten times below
    door = anchors.doors(base)
    values = base.where("kind = 'role'").select("value").distinct()
    hubs = values.select(stable_id("Hub", F.col("value")).alias("id"), F.concat("value", F.lit("-register")).alias("slug"), F.lit("Note").alias("label"))
    to = hubs.select("id").unionAll(g.spark.range(1).select(stable_id("Hub", "gone").alias("id")))
    pins = door.join(F.broadcast(to), how="cross").select(F.lit("pin").alias("kind"), F.col("anchor_id").alias("subject_id"), F.lit("register").alias("key"), F.concat("id", F.lit(" - register")).alias("value"))
    return base.unionByName(pins), door, g.nodes.unionByName(hubs, allowMissingColumns=True)


@query(_LEAD + " SELECT kind, subject_id, key, value FROM base_lead")
def lead_structure(g: Bound) -> DataFrame:
    return lead(g)


@query(_LEAD + " SELECT anchor_id, role, p.id, gloss, title, title IS NULL AS missing FROM pinned p LEFT JOIN all_titles t ON t.id = p.id")
def anchor_pins(g: Bound) -> DataFrame:
    rows, door, nodes = with_hubs(g)
    return anchors.pins(rows, door, nodes)


@query(_LEAD + """ SELECT anchor_id, p.id AS hub_id, h.id IS NULL AS missing, m.subject_id AS member_id, t.title AS member_title, s.value AS status FROM pinned p LEFT JOIN hubs h ON h.id = p.id
LEFT JOIN base_lead m ON m.kind = 'role' AND m.value = h.value LEFT JOIN base_lead s ON s.kind = 'status' AND s.key = h.value AND s.subject_id = m.subject_id LEFT JOIN title_of t ON t.id = m.subject_id WHERE role = 'register'""")
def anchor_registers(g: Bound) -> DataFrame:
    rows, door, nodes = with_hubs(g)
    return anchors.registers(rows, anchors.pins(rows, door, nodes), nodes)


@query(_LEAD + " SELECT anchor_id, role, p.id FROM pinned p WHERE id NOT IN (SELECT id FROM all_titles)")
def anchor_missing_refs(g: Bound) -> DataFrame:
    rows, door, nodes = with_hubs(g)
    return anchors.pins(rows, door, nodes).where("missing").select("anchor_id", "role", "id")


@query(_FILED + ", " + _LEAD + """, open_items AS (SELECT f.anchor_id, item_id, bucket, coalesce(d.open = 0, false) AS closable, starts_with(n.statement, 'FINDING') AS finding FROM filed f JOIN ready USING (item_id) LEFT JOIN dod d USING (item_id) JOIN nodes n ON n.id = item_id WHERE bucket <> 'done'),
vital AS (SELECT anchor_id, count(*) FILTER (WHERE bucket = 'ready') AS ready, count(*) FILTER (WHERE bucket = 'blocked') AS blocked, count(*) FILTER (WHERE closable) AS closable, count(*) FILTER (WHERE finding) AS findings FROM open_items GROUP BY anchor_id),
reach AS (SELECT anchor_id, anchor_id AS ref FROM door UNION SELECT anchor_id, id FROM pinned UNION SELECT anchor_id, item_id FROM open_items),
last AS (SELECT r.anchor_id, max(asserted_at) AS last_touch FROM reach r JOIN claims ON subject_id = ref GROUP BY 1)
SELECT d.anchor_id, d.role, t.title, coalesce(ready, 0) AS ready, coalesce(blocked, 0) AS blocked, coalesce(closable, 0) AS closable, coalesce(findings, 0) AS findings, (SELECT count(*) FROM pinned p WHERE p.anchor_id = d.anchor_id) AS pins, last_touch
FROM door d LEFT JOIN vital USING (anchor_id) LEFT JOIN last USING (anchor_id) JOIN title_of t ON t.id = d.anchor_id""")
def portfolio(g: Bound) -> DataFrame:
    rows, door, nodes = with_hubs(g)
    b = buckets(g).checkpoint()
    filed = frontier.program_of(b, g.edges, work_anchors(g)).select("item_id", "anchor_id").join(b.where("bucket <> 'done'").select("item_id", "bucket"), "item_id").checkpoint()
    open_ids = filed.select(F.col("item_id").alias("id"))
    # Of checks, nodes and claims only what may be at a filed open item, or at what an anchor refers to, is dealt; items are Decisions, as every check has its edge.
    checks = traverse.maybe_among(frontier.checks_of(g.edges), "item_id", open_ids).checkpoint()
    done = states(g, traverse.maybe_among(g.claims, "subject_id", checks.select(F.col("check_id").alias("id"))))
    closable = frontier.closable(filed, frontier.dod_summary(checks, done)).select("item_id", F.lit(True).alias("closable"))
    said = traverse.maybe_among(g.nodes.where("label = 'Decision'"), "id", open_ids).select(F.col("id").alias("item_id"), F.col("statement").startswith("FINDING").alias("finding"))
    items = filed.join(closable, "item_id", "left").join(said, "item_id", "left").select("item_id", "anchor_id", "bucket", F.coalesce("closable", F.lit(False)).alias("closable"), F.coalesce("finding", F.lit(False)).alias("finding"))
    pinned = anchors.pins(rows, door, nodes).checkpoint()
    locks = rows.where("kind = 'lock'").select(F.col("value").alias("id"))
    refs = open_ids.unionAll(door.select("anchor_id")).unionAll(pinned.select("id")).unionAll(locks)
    touch = traverse.maybe_among(g.claims, "subject_id", refs).groupBy(F.col("subject_id").alias("ref")).agg(F.max("asserted_at").alias("last_ts"))
    return anchors.portfolio(door, pinned, rows, items, touch, text.met(nodes, door, "anchor_id"))


@query(_LEAD + " SELECT source_id, relation_type, target_id FROM edges WHERE source_id IN (SELECT anchor_id FROM door) AND target_id IN (SELECT anchor_id FROM door)")
def portfolio_links(g: Bound) -> DataFrame:
    return traverse.subgraph_edges(anchors.doors(lead(g)).select(F.col("anchor_id").alias("id")), g.edges)


@query("SELECT string_agg(label||'×'||n, ' · ' ORDER BY n DESC, label) AS line FROM (SELECT label, count(*) AS n FROM nodes GROUP BY label)")
def coverage_line(g: Bound) -> DataFrame:
    return anchors.coverage_line(search.overview_kinds(g.nodes))
