"""Registered queries: replay of the whole log, and its continuation from a stored state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.bind import OP_FIELDS, Bound, uid
from weftgraph.model import stable_id
from weftgraph.operators import corpus, replay
from weftgraph.plans.base import query
from weftgraph.sources import journal
from weftgraph.sources.store import shared_folder

_SECTIONS = """
raws AS (SELECT doc_id, slug, r.raw, r.ord FROM (SELECT doc_id, slug, unnest(list_transform(list_filter(string_split(regexp_replace(regexp_replace(md, '(\\n\\n+)([^\\n])', '\\1'||chr(1)||'\\2', 'g'), '\\n(#{1,6} )', chr(10)||chr(1)||'\\1', 'g'), chr(1)), lambda x: x <> ''), lambda x, i: {'raw': x, 'ord': i - 1})) AS r FROM corpus) q),
named AS (SELECT *, CASE WHEN a = '' THEN 'section' ELSE a END AS name FROM (SELECT *, trim(regexp_replace(lower(regexp_extract(raw, '^#{1,6} ([^\\n]*)', 1)), '[^a-z0-9]+', '-', 'g'), '-') AS a FROM raws) q),
secs AS (SELECT doc_id, slug, ord, raw, CASE WHEN n = 1 THEN name ELSE name||'-'||n END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY ord) AS n FROM named) q)"""


def _notes(g: Bound) -> DataFrame:
    return g.corpus.select(stable_id("Note", F.col("slug")).alias("id"), "slug", "topic", F.col("md").alias("text"))


_NOTE = uid("'Note|'||slug")


@query(_SECTIONS + f" SELECT {_NOTE} AS note_id, ord, anchor, raw FROM secs")
def markdown_sections(g: Bound) -> DataFrame:
    """Sections of the documents read as markdown."""
    return corpus.sections(_notes(g))


_REFS = f"""
named_slugs AS (SELECT {_NOTE} AS source_id, trim(unnest(regexp_extract_all(md, '\\[\\[([^\\]|#\\n]+)[^\\]\\n]*\\]\\]', 1))) AS slug FROM corpus),
renamed AS (SELECT 'former-'||doc_id AS drifted, slug AS canonical FROM corpus WHERE doc_id % 4 <> 1),
refs AS (SELECT source_id, n.slug, coalesce(d.slug, m.slug) AS hit, d.slug IS NULL AND m.slug IS NOT NULL AS healed, count(*) AS n FROM named_slugs n LEFT JOIN (SELECT DISTINCT slug FROM corpus) d ON d.slug = n.slug
  LEFT JOIN renamed r ON r.drifted = n.slug LEFT JOIN (SELECT DISTINCT slug FROM corpus) m ON m.slug = r.canonical GROUP BY ALL)"""
_HIT = uid("'Note|'||hit")


def _references(g: Bound) -> DataFrame:
    renamed = g.corpus.where("doc_id % 4 <> 1").select(F.concat(F.lit("former-"), "doc_id").alias("drifted"), F.col("slug").alias("canonical"))
    return corpus.references(_notes(g), renamed)


@query(_REFS + f" SELECT source_id, slug, CASE WHEN hit IS NOT NULL THEN {_HIT} END AS target_id, healed, n FROM refs")
def note_references(g: Bound) -> DataFrame:
    """References between the documents, healed where a slug has drifted (three of four former slugs are known)."""
    return _references(g)


@query(_REFS + f""" SELECT source_id, 'REFERENCES' AS relation_type, {_HIT} AS target_id FROM refs WHERE hit IS NOT NULL AND source_id <> {_HIT}
UNION SELECT {_NOTE}, 'TAGGED', {uid("'Topic|'||lower(trim(topic))")} FROM corpus WHERE trim(topic) <> ''""")
def note_edges(g: Bound) -> DataFrame:
    return corpus.reference_edges(_references(g)).unionByName(corpus.topics(_notes(g))[1])


@query(f"""SELECT DISTINCT {uid("'Topic|'||lower(trim(topic))")} AS id, 'Topic' AS label, lower(trim(topic)) AS name FROM corpus WHERE trim(topic) <> ''""")
def topic_nodes(g: Bound) -> DataFrame:
    return corpus.topics(_notes(g))[0]


# The fold.  o: the place in replay.
_ID = "regexp_matches({0}, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$')"
_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
_TERM = "CASE WHEN " + _ID + " THEN {0} ELSE " + uid("'Entity|'||" + _SLUG) + " END"
_DECISION, _CHECK, _SESSION, _SECTION, _MESSAGE = uid("'Decision|'||text"), uid("'Check|'||source_id||'|'||text"), uid("'Session|'||key"), uid("'Section|'||key||'|'||{0}"), uid("'Message|'||{0}")
_ADDED = "'added'"  # the anchor of every added section of the bound log
_ORDERED = _SECTIONS + f""",
ops AS (SELECT *, CASE WHEN verb = 'new-note' THEN seq - 1125899906842624 ELSE seq END AS o FROM oplog),
alias_of AS (SELECT lower(trim(key)) AS name, arg_min({_TERM.format("subject")}, o) AS canonical, min(o) AS since FROM ops WHERE verb = 'alias' GROUP BY 1),
said AS (
  SELECT o, ts, CASE WHEN since < o THEN canonical ELSE {_TERM.format("subject")} END AS subject_id, CASE WHEN since < o OR {_ID.format("subject")} THEN NULL ELSE {_SLUG.format("subject")} END AS term, predicate, value, actor
    FROM (SELECT ops.*, CASE WHEN NOT {_ID.format("subject")} THEN since END AS since, canonical FROM ops LEFT JOIN alias_of ON name = lower(trim(subject)) WHERE verb = 'assert') q
  UNION ALL SELECT o, ts, {_TERM.format("subject")}, CASE WHEN NOT {_ID.format("subject")} THEN {_SLUG.format("subject")} END, 'aka', key, actor FROM ops WHERE verb = 'alias'
  UNION ALL SELECT o, ts, {_CHECK}, NULL, 'task_state', 'open', actor FROM ops WHERE verb = 'check'),
retracted AS (SELECT {_SESSION} AS id, max(o) AS gone FROM ops WHERE verb = 'retract-session' GROUP BY 1),
sess AS (SELECT {_SESSION} AS id, ops.* FROM ops WHERE verb = 'session'),
made AS (
  SELECT {uid("'Note|'||key")} AS id, 'Note' AS label, key, o, ts, NULL AS text, NULL AS title FROM ops WHERE verb = 'new-note'
  UNION ALL SELECT {uid("'Section|'||s.slug||'|'||anchor")}, 'Section', s.slug||'#'||anchor, o, ts, raw, NULL FROM ops JOIN secs s ON s.slug = key WHERE verb = 'new-note'
  UNION ALL SELECT {_SECTION.format(_ADDED)}, 'Section', key||'#added', o, ts, text, NULL FROM ops WHERE verb = 'add-section'
  UNION ALL SELECT {_DECISION}, 'Decision', text, o, ts, NULL, title FROM ops WHERE verb = 'decide'
  UNION ALL SELECT {_CHECK}, 'Check', NULL, o, ts, text, NULL FROM ops WHERE verb = 'check'
  UNION ALL SELECT {_MESSAGE.format("subject")}, 'Message', key, o, ts, text, title FROM ops WHERE verb IN ('pull-transcript', 'mint-messages')
  UNION ALL SELECT subject_id, 'Entity', term, o, ts, NULL, NULL FROM said WHERE term IS NOT NULL),
edits AS (
  SELECT {_SECTION.format("subject")} AS id, o, text FROM ops WHERE verb = 'section'
  UNION ALL SELECT {_MESSAGE.format("subject")}, o, text FROM ops WHERE verb = 'edit-message'),
once AS (SELECT id, min(label) AS label, arg_min(key, o) AS key, min(o) AS born, arg_min(ts, o) AS ts, arg_min(text, o) AS text, arg_min(title, o) AS title FROM made GROUP BY id),
ends AS (
  SELECT id, born, NULL AS gone FROM once
  UNION ALL SELECT {uid("'DisplayRule|'||key")}, min(o), NULL FROM ops WHERE verb = 'display-rule' GROUP BY 1 UNION ALL SELECT {uid("'Lens|'||key")}, min(o), NULL FROM ops WHERE verb = 'set-lens' GROUP BY 1
  UNION ALL SELECT coalesce(s.id, r.id), min(s.o) FILTER (WHERE r.gone IS NULL OR s.o > r.gone), max(r.gone) FROM sess s FULL JOIN retracted r ON r.id = s.id GROUP BY 1)"""
_UPSERT = "SELECT {id} AS id, '{label}' AS label, key, arg_max(title, o) AS title, arg_max(text, o) AS text, NULL AS started, min(o) AS created_seq, arg_min(ts, o) AS created_ts FROM ops WHERE verb = '{verb}' GROUP BY key"
_REPLAY_NODES = f""" SELECT n.id, label, key, title, coalesce(last_text, n.text) AS text, NULL AS started, born AS created_seq, ts AS created_ts FROM once n
  LEFT JOIN (SELECT e.id, arg_max(e.text, e.o) AS last_text FROM edits e JOIN once m ON m.id = e.id AND e.o >= m.born GROUP BY e.id) e ON e.id = n.id
UNION ALL {_UPSERT.format(id=uid("'DisplayRule|'||key"), label="DisplayRule", verb="display-rule")}
UNION ALL {_UPSERT.format(id=uid("'Lens|'||key"), label="Lens", verb="set-lens")}
UNION ALL SELECT s.id, 'Session', arg_min(key, o), arg_max(title, o), NULL, arg_max(value, o), min(o), arg_min(ts, o) FROM sess s LEFT JOIN retracted r ON r.id = s.id WHERE r.gone IS NULL OR s.o > r.gone GROUP BY s.id"""


@query(_ORDERED + _REPLAY_NODES)
def replay_nodes(g: Bound) -> DataFrame:
    return replay.nodes(replay.fold(g.oplog))


_EDGES = _ORDERED + f""",
minted AS (
  SELECT {_DECISION} AS source_id, 'SUPPORTED_BY' AS relation_type, unnest(string_split(items, ',')) AS target_id, o, NULL AS position FROM ops WHERE verb = 'decide' AND items IS NOT NULL
  UNION ALL SELECT {_DECISION}, 'DECIDED_IN', {uid("'Session|'||session")}, o, NULL FROM ops WHERE verb = 'decide' AND session IS NOT NULL
  UNION ALL SELECT {_CHECK}, 'CHECKS', source_id, o, NULL FROM ops WHERE verb = 'check'
  UNION ALL SELECT {uid("'Note|'||key")}, 'HAS_SECTION', {uid("'Section|'||s.slug||'|'||anchor")}, o, ord FROM ops JOIN secs s ON s.slug = key WHERE verb = 'new-note'
  UNION ALL SELECT {uid("'Note|'||key")}, 'HAS_SECTION', {_SECTION.format(_ADDED)}, o, NULL FROM ops WHERE verb = 'add-section'
  UNION ALL SELECT {_MESSAGE.format("subject")}, 'PART_OF', {_SESSION}, o, NULL FROM ops WHERE verb = 'pull-transcript'
  UNION ALL SELECT CASE WHEN value IS NULL THEN {_SESSION} ELSE {_MESSAGE.format("value")} END, CASE WHEN value IS NULL THEN 'STARTS_WITH' ELSE 'NEXT' END, {_MESSAGE.format("subject")}, o, NULL FROM ops WHERE verb = 'pull-transcript'
  UNION ALL SELECT {_MESSAGE.format("subject")}, 'DERIVED_FROM', part, o, i FROM (SELECT subject, o, unnest(string_split(items, ',')) AS part, unnest(range(len(string_split(items, ',')))) AS i FROM ops WHERE verb = 'derive-message') q),
unlinked AS (SELECT source_id, relation AS relation_type, target_id, max(o) AS u FROM ops WHERE verb = 'unlink' GROUP BY ALL),
valid AS (
  SELECT m.source_id, m.relation_type, m.target_id, m.o, m.position FROM minted m
  UNION ALL SELECT l.source_id, l.relation, l.target_id, l.o, NULL FROM ops l JOIN ends a ON a.id = l.source_id AND l.o > a.born JOIN ends b ON b.id = l.target_id AND l.o > b.born WHERE l.verb = 'link'),
kept AS (SELECT v.source_id, v.relation_type, v.target_id, arg_min(v.position, v.o) AS position FROM valid v LEFT JOIN unlinked n USING (source_id, relation_type, target_id)
  LEFT JOIN retracted a ON a.id = v.source_id LEFT JOIN retracted b ON b.id = v.target_id GROUP BY ALL
  HAVING max(v.o) > coalesce(max(n.u), -1e18) AND max(v.o) > coalesce(max(a.gone), -1e18) AND max(v.o) > coalesce(max(b.gone), -1e18))
 SELECT source_id, relation_type, target_id, CAST(position AS INT) AS position FROM kept"""


@query(_EDGES)
def replay_edges(g: Bound) -> DataFrame:
    return replay.edges(replay.fold(g.oplog))


_CLAIMS = _ORDERED + f""",
firsts AS (SELECT {uid("subject_id||'|'||predicate||'|'||value||'|'||coalesce(actor, '')")} AS assertion_id, {uid("subject_id||'|'||predicate")} AS slot_id, subject_id, predicate, value, actor, arg_min(ts, o) AS asserted_at, min(o) AS first FROM said GROUP BY ALL),
ranked AS (SELECT *, CASE predicate WHEN 'version' THEN string_split(value, '.')::INT[] WHEN 'task_state' THEN CASE value WHEN 'done' THEN [1] WHEN 'open' THEN [0] END END AS r FROM firsts),
heads AS (SELECT slot_id, r, lead(head) OVER (PARTITION BY slot_id ORDER BY r) AS superseder FROM (SELECT slot_id, r, arg_min(assertion_id, (first, assertion_id)) AS head FROM ranked WHERE r IS NOT NULL GROUP BY slot_id, r) q)
 SELECT assertion_id, slot_id, subject_id, predicate, value, actor, asserted_at, superseder FROM ranked LEFT JOIN heads USING (slot_id, r)"""


@query(_CLAIMS.replace("GROUP BY ALL),\nranked", "GROUP BY subject_id, predicate, value, actor),\nranked"))
def replay_claims(g: Bound) -> DataFrame:
    return replay.claims(replay.fold(g.oplog), g.registry)


@query("SELECT CASE WHEN verb = 'ping' THEN 'skipped' ELSE verb END AS verb, count(*) AS n FROM oplog GROUP BY 1")
def replay_verbs(g: Bound) -> DataFrame:
    return replay.counts(g.oplog)


@query(_EDGES)
def replay_continued(g: Bound) -> DataFrame:
    """Edges of a state that was stored after the orders' part of the log and then continued with what lies past its offset."""
    folder = f"{shared_folder(g.spark)}/replay-{uuid.uuid4()}"
    replay.advance(g.spark, folder, g.oplog, upto=1_000_000_000)
    return replay.edges(replay.advance(g.spark, folder, g.oplog, overlap=1000))


@query("SELECT seq, verb, ts, session, actor, key, subject, predicate, value, source_id, target_id, relation, title, items FROM (SELECT row_number() OVER (ORDER BY seq, verb) - 1 AS seq, verb, ts, session, actor, key, subject, predicate, value, source_id, target_id, relation, title, items FROM oplog) q")
def journal_segments(g: Bound) -> DataFrame:
    """The log written as segments of JSON lines and read back in parallel, in append order."""
    folder = f"{shared_folder(g.spark)}/journal-{uuid.uuid4()}"
    args = [f for f in OP_FIELDS if f not in ("actor", "session", "text")]
    ops = g.oplog.select("seq", "verb", "ts", "session", "actor", F.struct(*args).alias("args"))
    journal.write_journal(ops.withColumn("at", F.struct("seq", "verb")), folder, "at")
    return journal.with_arguments(journal.read_journal(g.spark, folder), tuple(args)).select("seq", "verb", "ts", "session", "actor", *args)


_VERSION_CHAIN = """
v AS (SELECT assertion_id, slot_id, asserted_at, string_split(value, '.')::INT[] AS r FROM claims WHERE predicate = 'version'),
heads AS (SELECT slot_id, r, lead(head) OVER (PARTITION BY slot_id ORDER BY r) AS superseder FROM (SELECT slot_id, r, arg_min(assertion_id, (asserted_at, assertion_id)) AS head FROM v GROUP BY slot_id, r) q)"""


@query(_VERSION_CHAIN + " SELECT assertion_id, superseder FROM v LEFT JOIN heads USING (slot_id, r)")
def supersede_chain(g: Bound) -> DataFrame:
    """Every version claim and the one that supersedes it: one link a claim, however many a slot has."""
    return replay.superseded(g.claims.where("predicate = 'version'"), g.registry).select("assertion_id", "superseder")
