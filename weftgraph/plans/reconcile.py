"""Registered queries: reconcilers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.bind import Bound, uid
from weftgraph.model import stable_id
from weftgraph.operators import audit, scan
from weftgraph.operators import frontier as fr
from weftgraph.operators.components import ensure_checkpoint_dir
from weftgraph.plans.base import query
from weftgraph.plans.claims import active
from weftgraph.plans.frontier import anchors, parts

# Registers: hubs for three roles; each caches two thirds of its members and some subjects that once had its role.
_N = uid("'Nation|'||n_nationkey")
_REG = f"""
mem AS (SELECT value, subject_id FROM active WHERE predicate = 'role'),
hist AS (SELECT value, subject_id FROM claims WHERE predicate = 'role' UNION SELECT CASE (n_nationkey + 1) % 4 WHEN 0 THEN 'program' WHEN 1 THEN 'arc' WHEN 2 THEN 'north-star' ELSE 'reviewer' END, {_N} FROM nation WHERE n_nationkey % 5 = 0),
cached AS (SELECT m.value, m.subject_id FROM mem m JOIN nation ON {_N} = m.subject_id WHERE n_nationkey % 3 <> 0 UNION SELECT value, subject_id FROM hist WHERE subject_id IN (SELECT {_N} FROM nation WHERE n_nationkey % 5 = 0) AND (value, subject_id) NOT IN (SELECT (value, subject_id) FROM mem)),
hubs AS (SELECT unnest(['program','arc','reviewer']) AS value),
found AS (SELECT value, subject_id, 'missing' AS finding FROM mem WHERE value IN (SELECT value FROM hubs) AND (value, subject_id) NOT IN (SELECT (value, subject_id) FROM cached)
  UNION SELECT value, subject_id, 'stale' FROM cached WHERE value IN (SELECT value FROM hubs) AND (value, subject_id) NOT IN (SELECT (value, subject_id) FROM mem) AND (value, subject_id) IN (SELECT (value, subject_id) FROM hist))"""


def registers(g: Bound) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    key, me = F.col("n_nationkey"), stable_id("Nation", F.col("n_nationkey")).alias("subject_id")
    n = g.table("nation")
    members = active(g).where("predicate = 'role'").select("value", "subject_id")
    k = (key + 1) % 4
    once = n.where("n_nationkey % 5 = 0").select(F.when(k == 0, "program").when(k == 1, "arc").when(k == 2, "north-star").otherwise("reviewer").alias("value"), me)
    historic = g.claims.where("predicate = 'role'").select("value", "subject_id").union(once).distinct()
    kept = members.join(n.where("n_nationkey % 3 <> 0").select(me), "subject_id", "left_semi").select("value", "subject_id")
    left = historic.join(n.where("n_nationkey % 5 = 0").select(me), "subject_id", "left_semi").select("value", "subject_id").join(members, ["value", "subject_id"], "left_anti")
    hubs = g.spark.sql("SELECT explode(array('program','arc','reviewer')) AS value")
    ensure_checkpoint_dir(g.spark)
    return members.checkpoint(), historic.checkpoint(), kept.union(left).checkpoint(), hubs


@query(_REG + " SELECT h.value, (SELECT count(*) FROM mem m WHERE m.value = h.value) AS members, (SELECT count(*) FROM cached c WHERE c.value = h.value) AS cached, (SELECT count(*) FROM found f WHERE f.value = h.value AND finding = 'missing') AS missing_cache, (SELECT count(*) FROM found f WHERE f.value = h.value AND finding = 'stale') AS stale_cache FROM hubs h")
def register_drift(g: Bound) -> DataFrame:
    return audit.register_drift(*registers(g))


@query(_REG + " SELECT value, subject_id FROM found WHERE finding = 'missing'")
def register_missing(g: Bound) -> DataFrame:
    return audit.register_rows(*registers(g)).where("finding = 'missing'").select("value", "subject_id")


@query(_REG + " SELECT value, subject_id FROM found WHERE finding = 'stale'")
def register_stale(g: Bound) -> DataFrame:
    return audit.register_rows(*registers(g)).where("finding = 'stale'").select("value", "subject_id")


@query(_REG + " SELECT value, count(*) AS members FROM mem WHERE value NOT IN (SELECT value FROM hubs) GROUP BY value")
def hubless_roles(g: Bound) -> DataFrame:
    members, _, _, hubs = registers(g)
    return audit.hubless(members, hubs)


@query("SELECT anchor_id FROM anchor_ids")
def anchor_subjects(g: Bound) -> DataFrame:
    return anchors(g)


_FILING = """
filed AS (SELECT DISTINCT source_id AS item_id, target_id AS anchor_id FROM edges WHERE relation_type = 'PART_OF' AND target_id IN (SELECT anchor_id FROM anchor_ids) AND source_id IN (SELECT item_id FROM items WHERE state <> 'done')),
near AS (SELECT DISTINCT a, b FROM (SELECT source_id AS a, target_id AS b FROM edges WHERE relation_type IN ('REFERENCES','SHAPES') UNION ALL SELECT target_id, source_id FROM edges WHERE relation_type IN ('REFERENCES','SHAPES')) WHERE a <> b),
own AS (SELECT a AS item_id, b FROM near WHERE a IN (SELECT item_id FROM items WHERE state <> 'done')),
votes AS (SELECT DISTINCT source_id AS b, target_id AS anchor_id FROM edges WHERE relation_type = 'PART_OF' AND target_id IN (SELECT anchor_id FROM anchor_ids) AND source_id NOT IN (SELECT anchor_id FROM anchor_ids) AND source_id IN (SELECT a FROM near)),
cites AS (SELECT a AS b, b AS anchor_id FROM near WHERE b IN (SELECT anchor_id FROM anchor_ids) AND a NOT IN (SELECT anchor_id FROM anchor_ids) AND (a, b) NOT IN (SELECT (b, anchor_id) FROM votes)),
points AS (SELECT item_id, b AS anchor_id, 2.0::DOUBLE AS p FROM own WHERE b IN (SELECT anchor_id FROM anchor_ids) UNION ALL SELECT item_id, anchor_id, 1.0 FROM own JOIN votes USING (b) UNION ALL SELECT item_id, anchor_id, 0.5 FROM own JOIN cites USING (b)),
score AS (SELECT item_id, anchor_id, sum(p) AS score FROM points GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, anchor_id) AS rank FROM score),
props AS (SELECT item_id, anchor_id, score, rank FROM placed WHERE item_id NOT IN (SELECT item_id FROM filed) AND rank <= 3),
refile AS (SELECT p.item_id, p.anchor_id, p.score FROM placed p WHERE rank = 1 AND p.item_id IN (SELECT item_id FROM filed) AND (p.item_id, p.anchor_id) NOT IN (SELECT (item_id, anchor_id) FROM filed)
  AND p.score > (SELECT max(coalesce(s.score, 0)) FROM filed f LEFT JOIN score s ON s.item_id = f.item_id AND s.anchor_id = f.anchor_id WHERE f.item_id = p.item_id))"""


def filing(g: Bound) -> tuple[DataFrame, DataFrame, DataFrame]:
    states, _, checks = parts(g)
    items = fr.work_items(states, checks).where("state <> 'done'").select("item_id")
    a = anchors(g)
    filed = g.edges.where("relation_type = 'PART_OF'").select(F.col("source_id").alias("item_id"), F.col("target_id").alias("anchor_id")).join(a, "anchor_id", "left_semi").join(items, "item_id", "left_semi").select("item_id", "anchor_id").distinct()
    ensure_checkpoint_dir(g.spark)
    return audit.filing_scores(items, a, g.edges).checkpoint(), filed.checkpoint(), items


@query(_FILING + " SELECT item_id, anchor_id, score FROM score")
def filing_scores(g: Bound) -> DataFrame:
    return filing(g)[0]


@query(_FILING + " SELECT item_id, anchor_id, score, rank FROM props")
def filing_proposals(g: Bound) -> DataFrame:
    scores, filed, _ = filing(g)
    return audit.filing_proposals(scores, filed)


@query(_FILING + " SELECT item_id, anchor_id, score FROM refile")
def filing_refile(g: Bound) -> DataFrame:
    scores, filed, _ = filing(g)
    return audit.filing_refile(scores, filed)


@query(_FILING + " SELECT (SELECT count(*) FROM items WHERE state <> 'done') AS open, (SELECT count(*) FROM anchor_ids) AS anchors, (SELECT count(DISTINCT item_id) FROM filed) AS filed, (SELECT count(DISTINCT item_id) FROM props) AS with_proposal, (SELECT count(*) FROM refile) AS refile")
def filing_counts(g: Bound) -> DataFrame:
    scores, filed, items = filing(g)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(items, "open")
    for df, name in ((anchors(g), "anchors"), (filed.select("item_id").distinct(), "filed"), (audit.filing_proposals(scores, filed, 1), "with_proposal"), (audit.filing_refile(scores, filed), "refile")):
        out = out.join(F.broadcast(one(df, name)), how="cross")
    return out


_STATEMENT = "erinst resh of thonor"
_IDF = """
toks AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{3,}'))) AS t FROM documents),
"""


@query(_IDF.strip() + f""" q AS (SELECT unnest(list_distinct(regexp_extract_all(lower('{_STATEMENT}'), '[a-z0-9_]{{3,}}'))) AS t),
df AS (SELECT coalesce(a.t, q.t) AS t, coalesce(n, 0) + CASE WHEN q.t IS NULL THEN 0 ELSE 1 END AS df, q.t IS NOT NULL AS asked FROM (SELECT t, count(*) AS n FROM toks GROUP BY t) a FULL JOIN q ON a.t = q.t),
w AS (SELECT t, asked, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / df) + 1.0 AS w FROM df),
d AS (SELECT doc_id, sum(CASE WHEN asked THEN w * w ELSE 0 END) AS dot, sqrt(sum(w * w)) AS norm FROM toks JOIN w USING (t) GROUP BY doc_id),
s AS (SELECT doc_id AS id, dot / (norm * (SELECT sqrt(sum(w * w)) FROM w WHERE asked)) AS score FROM d)
SELECT id, round(score, 4) AS score FROM s WHERE score >= 0.1 ORDER BY round(score, 4) DESC, id LIMIT 5""")
def near_duplicates(g: Bound) -> DataFrame:
    return audit.near_duplicates(_STATEMENT, g.table("documents"), "doc_id", "text")


@query("""sets AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{3,}'))) AS ts FROM documents),
cls AS (SELECT ts, min(doc_id) AS id, count(*) AS copies FROM sets WHERE len(ts) > 0 GROUP BY ts),
r AS (SELECT id, copies, unnest(ts) AS t FROM cls),
df AS (SELECT t, sum(copies) AS df FROM r GROUP BY t),
w AS (SELECT r.id, r.t, ln((SELECT count(*) FROM documents)::DOUBLE / df) + 1.0 AS w FROM r JOIN df USING (t)),
norm AS (SELECT id, sqrt(sum(w * w)) AS n FROM w GROUP BY id),
dots AS (SELECT a.id AS class_a, b.id AS class_b, sum(a.w * a.w) AS dot FROM w a JOIN w b ON a.t = b.t AND a.id < b.id GROUP BY ALL)
SELECT class_a, class_b, round(dot / (x.n * y.n), 4) AS score FROM dots JOIN norm x ON x.id = class_a JOIN norm y ON y.id = class_b WHERE dot / (x.n * y.n) >= 0.8""")
def near_duplicate_pairs(g: Bound) -> DataFrame:
    return audit.near_duplicate_pairs(g.table("documents"), "doc_id", "text")


@query("""sets AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{3,}'))) AS ts FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY ts) AS class_id FROM sets WHERE len(ts) > 0""")
def near_duplicate_classes(g: Bound) -> DataFrame:
    return audit.near_duplicate_classes(g.table("documents"), "doc_id", "text")


_PROSE = r"""
texts AS (SELECT id AS source_id, statement AS text FROM nodes WHERE label = 'Decision' UNION ALL SELECT id, coalesce(description,'')||' '||text FROM nodes WHERE label = 'Note'),
toks AS (SELECT DISTINCT source_id, unnest(list_filter(regexp_extract_all(text, '\b[0-9a-f]{8}\b'), lambda x: NOT regexp_matches(x, '^[0-9]{8}$'))) AS token FROM texts),
hits AS (SELECT t.source_id, t.token, n.id FROM toks t LEFT JOIN nodes n ON substr(n.id, 1, 8) = t.token WHERE NOT starts_with(t.source_id, t.token)),
links AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges)
"""


def prose(g: Bound) -> DataFrame:
    decisions = g.nodes.where("label = 'Decision'").select(F.col("id").alias("source_id"), F.col("statement").alias("text"))
    notes = g.nodes.where("label = 'Note'").select("id", F.concat_ws(" ", F.coalesce("description", F.lit("")), "text"))
    return audit.prose_references(decisions.unionAll(notes), g.nodes)


@query(_PROSE + " SELECT source_id, token, min(id) AS id, count(*) > 1 AS ambiguous FROM hits h WHERE id IS NOT NULL GROUP BY source_id, token HAVING NOT bool_or((source_id, id) IN (SELECT (a, b) FROM links))")
def prose_refs_unlinked(g: Bound) -> DataFrame:
    """An edge with a text's node has the label of such nodes at one end; others are left unread."""
    texts = "'Decision', 'Note'"
    return audit.prose_refs_unlinked(prose(g), g.labelled_edges.where(f"source_label in ({texts}) or target_label in ({texts})"))


@query(_PROSE + " SELECT source_id, token FROM hits WHERE id IS NULL")
def prose_refs_unresolvable(g: Bound) -> DataFrame:
    return prose(g).where("id is null").select("source_id", "token")


@query("SELECT id, label FROM nodes WHERE label IN ('Decision','Note') AND id NOT IN (SELECT source_id FROM edges UNION SELECT target_id FROM edges)")
def degree_zero(g: Bound) -> DataFrame:
    return audit.degree_zero(g.nodes, g.edges, ["Decision", "Note"])


# Logged links; customers 100 and up and every fifth part are taken as gone from the graph.
_ORPHANS = f"""
alive AS (SELECT id FROM nodes WHERE id NOT IN (SELECT {uid("'Part|'||p_partkey")} FROM part WHERE p_partkey % 5 = 0) AND id NOT IN (SELECT {uid("'Customer|'||c_custkey")} FROM customer WHERE c_custkey >= 100)),
lk AS (SELECT DISTINCT subject, object FROM journal WHERE verb = 'link' AND (subject, object) NOT IN (SELECT (subject, object) FROM journal WHERE verb = 'unlink')),
orphans AS (SELECT subject AS source_id, 'REFERENCES' AS relation_type, object AS target_id, subject NOT IN (SELECT id FROM alive) AS source_missing, object NOT IN (SELECT id FROM alive) AS target_missing FROM lk),
bad AS (SELECT * FROM orphans WHERE source_missing OR target_missing)"""


def orphans(g: Bound) -> DataFrame:
    from weftgraph.plans.log import edge_ops

    parts_gone = g.table("part").where("p_partkey % 5 = 0").select(stable_id("Part", F.col("p_partkey")).alias("id"))
    gone = parts_gone.unionAll(g.table("customer").where("c_custkey >= 100").select(stable_id("Customer", F.col("c_custkey"))))
    return audit.orphaned_links(edge_ops(g), g.nodes.select("id").join(gone, "id", "left_anti"))


@query(_ORPHANS + " SELECT source_id, relation_type, target_id, source_missing, target_missing FROM bad")
def orphaned_links(g: Bound) -> DataFrame:
    return orphans(g)


@query(_ORPHANS + f""", p AS (SELECT {uid("'Part|'||p_partkey")} AS m, {uid("'Part|'||(p_partkey + 1)")} AS n FROM part WHERE p_partkey % 5 = 0)
SELECT source_id, relation_type, target_id FROM bad WHERE NOT (NOT source_missing AND target_missing AND (source_id, (SELECT n FROM p WHERE m = target_id)) IN (SELECT (subject, object) FROM lk))""")
def orphan_healed(g: Bound) -> DataFrame:
    """Renamed parts moved to the next key; the graph's live links are those of the log."""
    from weftgraph.plans.log import edge_ops

    k = F.col("p_partkey")
    proposals = g.table("part").where("p_partkey % 5 = 0").select(stable_id("Part", k).alias("missing_id"), stable_id("Part", k + 1).alias("new_id"))
    ops = edge_ops(g)
    triple = ["source_id", "relation_type", "target_id"]
    live = ops.where("verb = 'link'").select(*triple).distinct().join(ops.where("verb = 'unlink'").select(*triple), triple, "left_anti")
    return audit.orphan_healed(orphans(g), proposals, live)


def slugs(g: Bound) -> tuple[DataFrame, DataFrame]:
    """References of pages, and the slugs on five or more pages, which count as declared."""
    refs = scan.corpus_references(g.table("pages"))
    return refs, refs.groupBy("slug").agg(F.count("*").alias("pages")).where("pages >= 5").select("slug")


_SLUGS = """refs AS (SELECT page_id, slug, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"/?#]+)"', 1)) AS slug FROM pages) GROUP BY ALL),
declared AS (SELECT slug FROM refs GROUP BY slug HAVING count(*) >= 5)"""


@query(_SLUGS + " SELECT slug, count(*) AS pages FROM refs WHERE slug NOT IN (SELECT slug FROM declared) GROUP BY slug")
def dangling_refs(g: Bound) -> DataFrame:
    refs, declared = slugs(g)
    return audit.dangling(refs, declared).groupBy("slug").agg(F.count("*").alias("pages"))


@query(_SLUGS + " SELECT page_id, slug FROM refs WHERE slug NOT IN (SELECT slug FROM declared)")
def dangling_sources(g: Bound) -> DataFrame:
    return audit.dangling(*slugs(g)).select("page_id", "slug")


@query()
def fuzzy_suggest(g: Bound) -> DataFrame:
    """For each dangling slug the declared slug most like it."""
    refs, declared = slugs(g)
    return audit.fuzzy_suggest(audit.dangling(refs, declared).select(F.col("slug").alias("wanted")), declared.select(F.col("slug").alias("name")))


_LETTERS = "àâäáãçéèêëîïíôöóùûüúñßÀÁÄÇÉÈÊÍÑÓÖÜÚÔ"  # the checking engine counts edits in bytes: these become one byte each
_ONE_BYTE = lambda c: f"translate({c}, '{_LETTERS}', '{(''.join(map(chr, range(1, 32))) + '<>[]{}')[: len(_LETTERS)]}')"


@query(_SLUGS + f""", w AS (SELECT DISTINCT slug AS wanted FROM refs WHERE slug NOT IN (SELECT slug FROM declared)),
near AS (SELECT wanted, slug AS name, levenshtein({_ONE_BYTE('wanted')}, {_ONE_BYTE('slug')}) AS distance FROM w, declared)
SELECT wanted, name, distance FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY distance, name) AS place FROM near WHERE distance <= 2) WHERE place = 1""")
def fuzzy_suggest_edits(g: Bound) -> DataFrame:
    """The native twin: nearest declared slug within two edits; lengths that differ by more than two never meet."""
    from weftgraph.operators.facts import top_rows

    refs, declared = slugs(g)
    d = audit.dangling(refs, declared).select(F.col("slug").alias("wanted")).distinct().withColumn("l", F.explode(F.sequence(F.length("wanted") - 2, F.length("wanted") + 2)))
    near = d.join(declared.select(F.col("slug").alias("name"), F.length("slug").alias("l")), "l").withColumn("distance", F.levenshtein("wanted", "name")).where("distance <= 2")
    return top_rows(near, ["wanted"], [F.asc("distance"), F.asc("name")], 1).select("wanted", "name", "distance")


@query()
def orphan_proposals(g: Bound) -> DataFrame:
    """For parts that are gone the living part whose description names them, else the one whose name is most like theirs; names have the key appended, as labels of the links."""
    p = g.table("part").select("p_partkey", stable_id("Part", F.col("p_partkey")).alias("id"), F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), "p_partkey").alias("name"))
    bad = orphans(g).where("target_missing").select(F.col("target_id").alias("id")).distinct()
    wanted = bad.join(p.select("id", F.col("name").alias("wanted")), "id").select("wanted")
    living = p.where("p_partkey % 5 <> 0")
    bodies = living.join(g.nodes.where("label = 'CodeSymbol'").select("id", F.col("description").alias("body")), "id").select("name", "body")
    return audit.orphan_proposals(wanted, living.select("name"), bodies, 0.6)


@query(_SLUGS + """ SELECT 'dangling' AS kind, count(DISTINCT slug) AS n FROM refs WHERE slug NOT IN (SELECT slug FROM declared)
UNION ALL SELECT 'soft_conflict', count(*) FROM (SELECT slot_id FROM active WHERE predicate NOT IN (SELECT predicate FROM registry WHERE typed) GROUP BY slot_id HAVING count(*) >= 2 AND count(DISTINCT lower(trim(value))) >= 2)
UNION ALL SELECT 'untyped', count(DISTINCT predicate) FROM active WHERE predicate NOT IN (SELECT predicate FROM registry WHERE typed)""")
def worklist_counts(g: Bound) -> DataFrame:
    from weftgraph.operators import facts

    one = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    a = active(g)
    return one(audit.dangling(*slugs(g)).select("slug").distinct(), "dangling").unionAll(one(facts.soft_conflicts(a, g.registry), "soft_conflict")).unionAll(one(facts.untyped_predicates(a, g.registry), "untyped"))


# A second version of the corpus: even documents gain a section, every third loses its first, every fifth has its second rewritten.
_SECTIONS = f"""
old AS (SELECT doc_id, {uid("'Doc|'||doc_id")} AS note_id, i, 's'||i AS anchor, raw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
new AS (SELECT note_id, anchor, CASE WHEN doc_id % 5 = 0 AND i = 1 THEN raw||' (edited)' ELSE raw END AS raw FROM old WHERE NOT (doc_id % 3 = 0 AND i = 0) UNION ALL SELECT {uid("'Doc|'||doc_id")}, 'appendix', 'added' FROM documents WHERE doc_id % 2 = 0),
diff AS (SELECT note_id, anchor, CASE WHEN o.raw IS NULL THEN 'added' WHEN n.raw IS NULL THEN 'removed' ELSE 'changed' END AS change, o.raw AS old_raw, n.raw AS new_raw FROM (SELECT note_id, anchor, raw FROM old) o FULL JOIN new n USING (note_id, anchor) WHERE o.raw IS DISTINCT FROM n.raw)"""


def divergence(g: Bound) -> DataFrame:
    docs = g.table("documents").select(F.col("doc_id"), stable_id("Doc", F.col("doc_id")).alias("id"), "text")
    old = scan.corpus_sections(docs).join(docs.select(F.col("id").alias("note_id"), "doc_id"), "note_id")
    raw = F.when((F.col("doc_id") % 5 == 0) & (F.col("ord") == 1), F.concat("raw", F.lit(" (edited)"))).otherwise(F.col("raw"))
    new = old.where("not (doc_id % 3 = 0 and ord = 0)").select("note_id", "anchor", raw.alias("raw"))
    new = new.unionAll(docs.where("doc_id % 2 = 0").select("id", F.lit("appendix"), F.lit("added")))
    return audit.section_divergence(old, new)


@query(_SECTIONS + " SELECT note_id, anchor, change FROM diff")
def section_divergence(g: Bound) -> DataFrame:
    return divergence(g).select("note_id", "anchor", "change")


@query(_SECTIONS + " SELECT 'section' AS verb, note_id, anchor, new_raw AS raw, old_raw AS replaces FROM diff WHERE change = 'changed'")
def reconcile_absorb(g: Bound) -> DataFrame:
    return divergence(g).where("change = 'changed'").select(F.lit("section").alias("verb"), "note_id", "anchor", F.col("new_raw").alias("raw"), F.col("old_raw").alias("replaces"))


@query("""SELECT doc_id AS key, CASE WHEN doc_id % 7 = 0 THEN 'only_live' WHEN doc_id % 4 = 0 THEN 'drifted' ELSE 'equal' END AS verdict FROM documents UNION ALL SELECT -1, 'only_artifact'""")
def source_check(g: Bound) -> DataFrame:
    live = g.table("documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content"))
    artifact = live.where("key % 7 <> 0").select("key", F.when(F.col("key") % 4 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content")).alias("content"))
    return audit.source_check(live, artifact.unionAll(g.spark.sql("SELECT -1L, 'only here'")))


@query(f"""m AS (SELECT {uid("'Supplier|'||s_suppkey")} AS o, {uid("'Supplier|'||(s_suppkey + 1000)")} AS n FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT {uid("'Supplier|'||s_suppkey")}, {uid("'Supplier|'||(s_suppkey + 2000)")} FROM supplier WHERE s_suppkey % 10 = 0),
s AS (SELECT o, count(DISTINCT n) AS k, min(n) AS n FROM m GROUP BY o),
j AS (SELECT e.*, a.n AS sn, a.k AS sk, b.n AS tn, b.k AS tk FROM edges e LEFT JOIN s a ON a.o = source_id LEFT JOIN s b ON b.o = target_id WHERE a.o IS NOT NULL OR b.o IS NOT NULL)
SELECT DISTINCT CASE WHEN coalesce(sk,1) > 1 OR coalesce(tk,1) > 1 THEN source_id ELSE coalesce(sn, source_id) END AS source_id, relation_type, CASE WHEN coalesce(sk,1) > 1 OR coalesce(tk,1) > 1 THEN target_id ELSE coalesce(tn, target_id) END AS target_id, CASE WHEN coalesce(sk,1) > 1 OR coalesce(tk,1) > 1 THEN 'blocked' ELSE 'moved' END AS outcome FROM j""")
def edge_remap(g: Bound) -> DataFrame:
    k = F.col("s_suppkey")
    s = g.table("supplier")
    one = s.where("s_suppkey % 2 = 0").select(stable_id("Supplier", k).alias("old_id"), stable_id("Supplier", k + 1000).alias("new_id"))
    two = s.where("s_suppkey % 10 = 0").select(stable_id("Supplier", k), stable_id("Supplier", k + 2000))
    return audit.edge_remap(g.edges, one.unionAll(two))
