"""Registered queries: search and traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.bind import Bound, uid
from weftgraph.model import EDGE_WEIGHTS, LOCATE_FIELDS, TEXT_FIELDS, stable_id
from weftgraph.operators import scan, search, traverse
from weftgraph.plans.claims import active
from weftgraph.plans.base import query

TASK = "What about the nation supplier priority orders of reanble and thonor"
_TERMS = ("nation", "supplier", "priority", "orders", "reanble", "thonor", "about")
_HAY = "lower(concat_ws(' ', " + ", ".join(f"nullif({f},'')" for f in TEXT_FIELDS) + "))"
_HITS = " + ".join(f"CAST(contains(h, '{t}') AS INT)" for t in _TERMS)
_SEEDS = f"""scored_nodes AS (SELECT id, {_HITS} AS hits FROM (SELECT id, {_HAY} AS h FROM nodes)),
seeds AS (SELECT id, hits, row_number() OVER (ORDER BY hits DESC, id) - 1 AS rank FROM (SELECT * FROM scored_nodes WHERE hits > 0 ORDER BY hits DESC, id LIMIT 6))"""
_W = "CASE r " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EDGE_WEIGHTS.items()) + " ELSE 1.0 END"
_BOTH = "both_ways AS (SELECT source_id AS a, target_id AS b, relation_type AS r FROM edges UNION ALL SELECT target_id, source_id, relation_type FROM edges)"
_BALL = _SEEDS + ", " + _BOTH + f""",
h0 AS (SELECT id AS seed_id, id, 0 AS hop, '' AS relation FROM seeds),
h1 AS (SELECT seed_id, b AS id, 1 AS hop, arg_min(r, (-({_W}), r)) AS relation FROM h0 JOIN both_ways ON a = id WHERE (seed_id, b) NOT IN (SELECT (seed_id, id) FROM h0) GROUP BY seed_id, b),
h2 AS (SELECT seed_id, b AS id, 2 AS hop, arg_min(r, (-({_W}), r)) AS relation FROM h1 JOIN both_ways ON a = id WHERE (seed_id, b) NOT IN (SELECT (seed_id, id) FROM h0 UNION ALL SELECT (seed_id, id) FROM h1) GROUP BY seed_id, b),
ball AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)"""
_SCORED = _BALL + f""",
old AS (SELECT DISTINCT seed_id, target_id AS id FROM edges JOIN ball ON ball.id = source_id WHERE relation_type = 'SUPERSEDES'),
rated AS (SELECT b.id, b.seed_id, b.hop, b.relation, s.rank, ((SELECT count(*) FROM seeds) - s.rank) * pow(0.5, b.hop) * CASE WHEN b.hop = 0 THEN 3.0 ELSE {_W.replace('CASE r', 'CASE b.relation')} END * CASE WHEN o.id IS NOT NULL THEN 0.3 ELSE 1.0 END AS score
  FROM ball b JOIN seeds s ON s.id = b.seed_id LEFT JOIN old o ON o.seed_id = b.seed_id AND o.id = b.id),
scored AS (SELECT id, score, seed_id, hop, relation FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, rank) AS rn FROM rated) WHERE rn = 1)"""


def seeds(g: Bound) -> DataFrame:
    return search.find_seeds(g.nodes, TASK)


def scored(g: Bound) -> DataFrame:
    return traverse.score_task(seeds(g).checkpoint(), g.edges)


def prepared(g: Bound) -> Bound:
    from weftgraph.operators.components import ensure_checkpoint_dir

    ensure_checkpoint_dir(g.spark)
    return g


@query("SELECT label, count(*) AS n FROM nodes GROUP BY label")
def overview_kinds(g: Bound) -> DataFrame:
    return search.overview_kinds(g.nodes)


@query("d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id) SELECT n.id, label, degree FROM d JOIN nodes n USING (id) WHERE label IN ('Anchor','Entity') ORDER BY degree DESC, n.id LIMIT 20")
def overview_hubs(g: Bound) -> DataFrame:
    return search.overview_hubs(g.nodes, g.edges, ["Anchor", "Entity"], 20)


@query(_SEEDS + " SELECT id, hits, rank FROM seeds")
def find_seeds(g: Bound) -> DataFrame:
    return seeds(g)


_REFS = f"""refs AS (SELECT {uid("'Order|'||o_orderkey")} AS ref FROM orders WHERE o_orderkey % 100 = 1 UNION SELECT substr({uid("'Order|'||o_orderkey")},1,10) FROM orders WHERE o_orderkey % 100 = 2 UNION SELECT 'zz'||o_orderkey FROM orders WHERE o_orderkey % 100 = 3 UNION SELECT substr({uid("'Order|'||o_orderkey")},1,6) FROM orders WHERE o_orderkey % 100 = 4),
hits AS (SELECT ref, count(*) AS n, min(nodes.id) AS id FROM refs JOIN nodes ON CASE WHEN length(ref) = 36 THEN nodes.id = ref ELSE regexp_matches(ref, '^[0-9a-fA-F][0-9a-fA-F-]{{5,34}}$') AND starts_with(nodes.id, ref) END GROUP BY ref)"""


def refs(g: Bound) -> DataFrame:
    k, i = F.col("o_orderkey"), stable_id("Order", F.col("o_orderkey"))
    ref = F.when(k % 100 == 1, i).when(k % 100 == 2, F.substring(i, 1, 10)).when(k % 100 == 3, F.concat(F.lit("zz"), k)).otherwise(F.substring(i, 1, 6))
    return g.table("orders").where("o_orderkey % 100 between 1 and 4").select(ref.alias("ref"))


@query(_REFS + " SELECT r.ref, CASE WHEN n IS NULL THEN 'missing' WHEN length(r.ref) = 36 THEN 'exact' WHEN n = 1 THEN 'prefix' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN id END AS id FROM refs r LEFT JOIN hits USING (ref)")
def resolve_ref(g: Bound) -> DataFrame:
    return search.resolve_refs(refs(g), g.nodes)


@query(_REFS + " SELECT r.ref, CASE WHEN n IS NULL THEN 'missing' ELSE 'ambiguous' END AS outcome FROM refs r LEFT JOIN hits USING (ref) WHERE n IS NULL OR n > 1")
def subgraph_missing(g: Bound) -> DataFrame:
    return search.resolve_refs(refs(g), g.nodes).where("outcome in ('missing', 'ambiguous')").select("ref", "outcome")


_SHOWN = f"shown AS (SELECT {uid(chr(39) + 'Nation|' + chr(39) + '||n_nationkey')} AS id FROM nation WHERE n_nationkey < 5)"


def shown(g: Bound) -> DataFrame:
    return g.table("nation").where("n_nationkey < 5").select(stable_id("Nation", F.col("n_nationkey")).alias("id"))


@query(_SHOWN + " SELECT source_id AS id, 'out' AS direction, relation_type, target_id AS other FROM edges WHERE source_id IN (SELECT id FROM shown) UNION ALL SELECT target_id, 'in', relation_type, source_id FROM edges WHERE target_id IN (SELECT id FROM shown)")
def show_node(g: Bound) -> DataFrame:
    return search.neighbours(shown(g), g.edges)


@query(_BALL + " SELECT seed_id, id, hop, relation FROM ball")
def k_hop(g: Bound) -> DataFrame:
    return traverse.k_hop(seeds(prepared(g)).checkpoint(), g.edges, 2)


_MEMBERS = _SHOWN + ", " + _BOTH + """,
m1 AS (SELECT DISTINCT b AS id FROM both_ways WHERE a IN (SELECT id FROM shown) AND r IN ('PART_OF','REFERENCES') AND b NOT IN (SELECT id FROM shown)),
m2 AS (SELECT DISTINCT b AS id FROM both_ways WHERE a IN (SELECT id FROM m1) AND r IN ('PART_OF','REFERENCES') AND b NOT IN (SELECT id FROM shown) AND b NOT IN (SELECT id FROM m1)),
members AS (SELECT id, false AS expanded FROM shown UNION ALL SELECT id, true FROM (SELECT id, 1 AS hop FROM m1 UNION ALL SELECT id, 2 FROM m2 ORDER BY 2, 1 LIMIT 500))"""


def members(g: Bound) -> DataFrame:
    return traverse.subgraph_members(shown(g), g.edges, 2, ["PART_OF", "REFERENCES"], cap=500)


@query(_MEMBERS + " SELECT m.id, t.label, t.title, m.expanded FROM members m JOIN (SELECT id, label, coalesce(nullif(trim(name),''), nullif(trim(slug),''), nullif(trim(key),''), CASE WHEN length(statement) <= 110 THEN statement END, id) AS title FROM nodes) t USING (id)")
def subgraph_nodes(g: Bound) -> DataFrame:
    return traverse.subgraph_nodes(members(g), g.nodes)


@query(_MEMBERS + " SELECT source_id, relation_type, target_id FROM edges WHERE source_id IN (SELECT id FROM members) AND target_id IN (SELECT id FROM members)")
def subgraph_edges(g: Bound) -> DataFrame:
    return traverse.subgraph_edges(members(g), g.edges)


@query(_SCORED + " SELECT id, round(score, 6) AS score, seed_id, hop, relation FROM scored")
def score_task(g: Bound) -> DataFrame:
    return scored(prepared(g)).withColumn("score", F.round("score", 6))


@query(_SCORED + " SELECT s.id, n.label, round(score, 3) AS score, seed_id FROM scored s LEFT JOIN nodes n ON n.id = s.id ORDER BY round(score, 3) DESC, s.id LIMIT 12")
def relevant_results(g: Bound) -> DataFrame:
    return traverse.relevant(scored(prepared(g)), g.nodes).select("id", "label", "score", "seed_id")


@query(_SCORED + " SELECT 'kind' AS axis, label AS value, count(*) AS n FROM scored JOIN nodes USING (id) GROUP BY label UNION ALL SELECT 'seed', seed_id, count(*) FROM scored GROUP BY seed_id")
def relevant_facets(g: Bound) -> DataFrame:
    return traverse.facets(scored(prepared(g)).checkpoint(), g.nodes)


@query(_SCORED + " SELECT s.id, round(score, 3) AS score, count(*) OVER () AS total FROM scored s JOIN nodes n USING (id) WHERE label = 'Entity' ORDER BY score DESC, s.id LIMIT 15")
def explore(g: Bound) -> DataFrame:
    """Members of the facet kind = Entity up to the budget of 15, with their true number."""
    rows = scored(prepared(g)).join(g.nodes.where("label = 'Entity'").select("id"), "id", "left_semi").checkpoint()
    top = rows.orderBy(F.desc("score"), "id").limit(15).select("id", F.round("score", 3).alias("score"))
    return top.join(F.broadcast(rows.agg(F.count("*").alias("total"))), how="cross")


SUBJECT = "Supplier#000000007 its references"
_SUBJECT_HITS = " + ".join(f"CAST(contains(h, '{t}') AS INT)" for t in ("supplier", "000000007", "references"))


@query(f"best AS (SELECT id FROM (SELECT id, {_SUBJECT_HITS} AS hits FROM (SELECT id, {_HAY} AS h FROM nodes)) WHERE hits > 0 ORDER BY hits DESC, id LIMIT 1) SELECT source_id AS id, 'out' AS direction, relation_type, target_id AS other FROM edges WHERE source_id IN (SELECT id FROM best) UNION ALL SELECT target_id, 'in', relation_type, source_id FROM edges WHERE target_id IN (SELECT id FROM best)")
def state_view(g: Bound) -> DataFrame:
    """A subject that is neither an id nor a prefix goes to its best seed, which is shown."""
    best = search.find_seeds(g.nodes, SUBJECT, 1)
    return search.neighbours(best, g.edges)


_LOCATED = "located AS (SELECT id, label, coalesce(nullif(trim(name),''), nullif(trim(slug),''), nullif(trim(key),''), id) AS title, path FROM nodes WHERE " + " OR ".join(f"contains(lower({f}), 'nation_1')" for f in LOCATE_FIELDS) + ")"


@query(_LOCATED + " SELECT *, count(*) OVER () AS total FROM located ORDER BY label, title, id LIMIT 25")
def locate(g: Bound) -> DataFrame:
    return search.locate(g.nodes, "NATION_1")


def _grep_sql(term: str) -> str:
    field = "CASE " + " ".join(f"WHEN contains(lower({f}), '{term}') THEN '{f}'" for f in TEXT_FIELDS) + " END"
    value = "CASE " + " ".join(f"WHEN contains(lower({f}), '{term}') THEN {f}" for f in TEXT_FIELDS) + " END"
    return f"""hits AS (SELECT id, label, {field} AS field, {value} AS v FROM nodes), spot AS (SELECT *, strpos(lower(v), '{term}') AS p, {len(term)} AS n FROM hits WHERE field IS NOT NULL),
cut AS (SELECT *, greatest(p - 60, 1) AS b, least(p + n + 60, length(v) + 1) AS e FROM spot)
SELECT id, label, field, CASE WHEN b > 1 THEN '…' ELSE '' END||trim(regexp_replace(substr(v, b, e - b), '\\s+', ' ', 'g'))||CASE WHEN e <= length(v) THEN '…' ELSE '' END AS snippet FROM cut"""


@query(_grep_sql("reanble"))
def grep(g: Bound) -> DataFrame:
    return search.grep(g.nodes, "reanble")


@query("r AS (SELECT id, name AS title FROM nodes WHERE label = 'CodeModule' AND contains(lower(name), 'small')) SELECT id, title, count(*) OVER () AS total FROM r ORDER BY id LIMIT 10 OFFSET 5")
def list_label(g: Bound) -> DataFrame:
    return search.list_label(g.nodes, "CodeModule", "small", 10, 5)


@query("SELECT subject_id, coalesce(n.name, subject_id) AS subject, a.value FROM active a LEFT JOIN nodes n ON n.id = subject_id WHERE predicate = 'role' AND a.value = 'arc' ORDER BY 2, 3, 1 LIMIT 5")
def list_predicate(g: Bound) -> DataFrame:
    return search.list_predicate(active(g), g.nodes, "role", "arc", 5)


@query("SELECT source_id, coalesce(a.name, source_id) AS source, target_id, coalesce(b.name, target_id) AS target FROM edges LEFT JOIN nodes a ON a.id = source_id LEFT JOIN nodes b ON b.id = target_id WHERE relation_type = 'IMPORTS' ORDER BY 2, 4, 1, 3 LIMIT 50")
def list_relation(g: Bound) -> DataFrame:
    return search.list_relation(g.edges, g.nodes, "IMPORTS", 50)


@query("SELECT source_id, target_id, 'relation' AS mode FROM edges WHERE relation_type = 'IMPORTS'")
def list_dispatch(g: Bound) -> DataFrame:
    """The listing chosen by its one option: here every relation of one kind."""
    mode = search.list_mode(relation="IMPORTS")
    return scan.edge_pairs(g.edges, "IMPORTS").withColumn("mode", F.lit(mode))


_ROOT = f"{uid(chr(39) + 'Part|' + chr(39) + '||p_partkey')}"


@query(f"d AS (SELECT {_ROOT} AS id FROM part WHERE p_partkey % 100 = 0 UNION SELECT target_id FROM d JOIN edges ON source_id = d.id WHERE relation_type = 'CALLS') SELECT id FROM d")
def descendants(g: Bound) -> DataFrame:
    roots = g.table("part").where("p_partkey % 100 = 0").select(stable_id("Part", F.col("p_partkey")).alias("id"))
    return traverse.descendants(roots, g.edges, "CALLS")


_GONE = "gone AS (SELECT n.id FROM nodes n JOIN nodes m ON m.id = n.module_id WHERE m.module_path = 'SMALL' UNION SELECT id FROM nodes WHERE label = 'CodeModule' AND module_path = 'SMALL')"


@query(_GONE + " SELECT source_id, relation_type, target_id FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)")
def subtree_delete(g: Bound) -> DataFrame:
    small = g.nodes.where("label = 'CodeModule' and module_path = 'SMALL'").select("id")
    held = g.nodes.where("label = 'CodeSymbol'").join(small.withColumnRenamed("id", "module_id"), "module_id", "left_semi").select("id")
    return traverse.delete_subtree(small.unionAll(held), g.nodes, g.edges)[1].select("source_id", "relation_type", "target_id")


@query(f"SELECT {uid(chr(39) + 'Doc|' + chr(39) + '||doc_id')} AS note_id, text, len(string_split(text, chr(10))) AS n FROM documents")
def reconstruct_text(g: Bound) -> DataFrame:
    return traverse.reconstruct_text(scan.corpus_sections(g.nodes.where("label = 'Note'")), "\n")
