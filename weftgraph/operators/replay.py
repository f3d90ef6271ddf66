"""Replay of a log of all verbs into nodes, edges and claims, and its continuation from a stored state.

A log is first reduced to a state: for each node when it was made, edited and retracted, for each edge when it was last
linked, minted and unlinked, for each claim when it was first made.  Every column of a state is a first or last value in
the order of the log, so states of two parts of a log merge by the same aggregation, in any order and with any overlap,
and a state can be stored with its offset and continued.  The views of the graph are derived from a state.

Order: genesis (new-note) comes before everything else, whenever it was logged, then the log's own order.
Insert-once (the first operation of an id counts): new-note, decide, alias, assert, check, pull-transcript, mint-messages,
derive-message, add-section.  Last wins: section and edit-message (on what exists at that point), display-rule, set-lens,
session (each property's last value that is not null).  unlink and retract-session undo what came before them.  A link needs
both ends to exist at that point.  Other verbs change nothing.

ops: seq, verb, ts and the columns of ARGS; a column that a verb does not use is not read.
    new-note(key: slug, text)   section(key, subject: anchor, text)   add-section(key, text)   decide(text, title, actor, session, items: supports)
    alias(key: drifted name, subject: canonical)   assert(subject, predicate, value, actor)   check(source_id: item, text, actor)
    link/unlink(source_id, relation, target_id)   display-rule(key, title, text)   set-lens(key, title, text)   session(key, title, value: start)
    retract-session(key)   pull-transcript/mint-messages(key: session, subject: message, value: message before, title: role, text)
    edit-message(subject, text)   derive-message(subject: sent, items: parts)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import term_slug
from weftgraph.model import stable_id
from weftgraph.operators.corpus import first_anchor, sectioned
from weftgraph.operators.facts import rank

GENESIS = 1 << 50
NEVER = -(1 << 60)
FULL_ID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
MESSAGE_VERBS = ("pull-transcript", "mint-messages")
UPSERTS = {"display-rule": "DisplayRule", "set-lens": "Lens"}
INSERTS = ("new-note", "decide", "alias", "assert", "check", "derive-message", "add-section", *MESSAGE_VERBS)
VERBS = (*INSERTS, *UPSERTS, "section", "edit-message", "session", "retract-session", "link", "unlink")
ARGS = ("actor", "session", "key", "subject", "predicate", "value", "source_id", "target_id", "relation", "title", "text", "items")

_NODE = {"id": "string", "label": "string", "key": "string", "born": "bigint", "born_ts": "double", "text": "string", "edited": "bigint", "edit": "string", "title": "string", "title_at": "bigint"}
_SESSION = {"id": "string", "key": "string", "born": "bigint", "born_ts": "double", "gone": "bigint", "title": "string", "title_at": "bigint", "started": "string", "started_at": "bigint"}
_EDGE = {"source_id": "string", "relation_type": "string", "target_id": "string", "linked": "bigint", "minted": "bigint", "unlinked": "bigint", "first": "bigint", "position": "int"}
_CLAIM = {"assertion_id": "string", "slot_id": "string", "subject_id": "string", "predicate": "string", "value": "string", "actor": "string", "first": "bigint", "asserted_at": "double"}
_ALIAS = {"name": "string", "canonical": "string", "first": "bigint"}
PARTS = {"nodes": _NODE, "sessions": _SESSION, "edges": _EDGE, "claims": _CLAIM, "aliases": _ALIAS}


@dataclass
class State:
    nodes: DataFrame
    sessions: DataFrame
    edges: DataFrame
    claims: DataFrame
    aliases: DataFrame


def _row(kind: dict[str, str], **values: str) -> str:
    """A row of a state as SQL text; columns without a value are null."""
    return "named_struct(" + ", ".join(f"'{n}', cast({values.get(n, 'null')} as {t})" for n, t in kind.items()) + ")"


def _uid(*parts: str) -> str:
    """stable_id() as SQL text."""
    return f"regexp_replace(md5(concat_ws('|', {', '.join(parts)})), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5')"


def _exploded(ops: DataFrame, by_verb: dict[tuple[str, ...], str]) -> DataFrame:
    """The rows that operations give, one pass over the log: by_verb has the SQL text of an array of rows for verbs."""
    cases = " ".join(f"when verb in ({', '.join(map(repr, verbs))}) then {rows}" for verbs, rows in by_verb.items())
    return ops.where(F.col("verb").isin(*(v for verbs in by_verb for v in verbs))).select(F.expr(f"inline(case {cases} end)"))


def ordered(ops: DataFrame) -> DataFrame:
    """ops with o, the place in the order of replay, and all argument columns."""
    missing = {c: F.lit(None).cast("string") for c in ARGS if c not in ops.columns}
    return ops.withColumns(missing | {"o": F.when(F.col("verb") == "new-note", F.col("seq") - GENESIS).otherwise(F.col("seq"))}).where("seq is not null")


def _id_of(name: Column) -> Column:
    """A full id stands for itself, any other name for its term."""
    return F.when(name.rlike(FULL_ID), name).otherwise(stable_id("Entity", term_slug(name)))


_ADDED = first_anchor("text")


def _note_sections(ops: DataFrame) -> DataFrame:
    """(o, ts, key, ord, anchor, raw) of the sections of new notes."""
    return sectioned(ops.where("verb = 'new-note'").select("o", "ts", "key", "text"), "o", "text")


def _node_rows(ops: DataFrame, said: DataFrame) -> DataFrame:
    new = lambda id_, label, **more: _row(_NODE, id=id_, label=f"'{label}'", born="o", born_ts="ts", **more)
    last = {"title": "title", "title_at": "if(title is not null, o, null)"}
    once = {"title": "title", "title_at": "if(title is not null, -o, null)"}  # the first title stays
    section = lambda anchor: _uid("'Section'", "key", anchor)
    message = _uid("'Message'", "subject")
    by_verb = {
        ("new-note",): f"array({new(_uid(repr('Note'), 'key'), 'Note', key='key')})",
        ("decide",): f"array({new(_uid(repr('Decision'), 'text'), 'Decision', key='text', **once)})",
        ("check",): f"array({new(_uid(repr('Check'), 'source_id', 'text'), 'Check', text='text')})",
        ("section",): f"array({_row(_NODE, id=section('subject'), edited='o', edit='text')})",
        ("add-section",): f"array({new(section(_ADDED), 'Section', key=f'key || {chr(39)}#{chr(39)} || {_ADDED}', text='text')})",
        MESSAGE_VERBS: f"array({new(message, 'Message', key='key', text='text', **once)})",
        ("edit-message",): f"array({_row(_NODE, id=message, edited='o', edit='text')})",
    }
    for verb, label in UPSERTS.items():
        by_verb[(verb,)] = f"array({new(_uid(repr(label), 'key'), label, key='key', edited='o', edit='text', **last)})"
    sections = _note_sections(ops).selectExpr(f"inline(array({new(section('anchor'), 'Section', key='key || ' + repr('#') + ' || anchor', text='raw')}))")
    terms = said.where("term is not null").selectExpr(f"inline(array({_row(_NODE, id='subject_id', label=repr('Entity'), key='term', born='o', born_ts='ts')}))")
    return _exploded(ops, by_verb).unionByName(sections).unionByName(terms)


def _session_rows(ops: DataFrame) -> DataFrame:
    id_ = _uid("'Session'", "key")
    registered = _row(_SESSION, id=id_, key="key", born="o", born_ts="ts", title="title", title_at="if(title is not null, o, null)", started="value", started_at="if(value is not null, o, null)")
    return _exploded(ops, {("session",): f"array({registered})", ("retract-session",): f"array({_row(_SESSION, id=id_, gone='o')})"})


def _edge_rows(ops: DataFrame) -> DataFrame:
    mint = lambda a, rel, b, **more: _row(_EDGE, source_id=a, relation_type=rel, target_id=b, minted="o", first="o", **more)
    given = {"source_id": "source_id", "relation_type": "relation", "target_id": "target_id"}
    note, decision, check, session, message, before = _uid("'Note'", "key"), _uid("'Decision'", "text"), _uid("'Check'", "source_id", "text"), _uid("'Session'", "key"), _uid("'Message'", "subject"), _uid("'Message'", "value")
    section = lambda anchor: _uid("'Section'", "key", anchor)
    listed = "filter(split(coalesce(items, ''), ','), x -> x <> '')"
    decided = f"filter(array({mint(decision, repr('DECIDED_IN'), _uid(repr('Session'), 'session'))}), x -> session is not null)"
    sections = _note_sections(ops).selectExpr(f"inline(array({mint(note, repr('HAS_SECTION'), section('anchor'), position='ord')}))")
    return _exploded(
        ops,
        {
            ("link",): f"array({_row(_EDGE, **given, linked='o', first='o')})",
            ("unlink",): f"array({_row(_EDGE, **given, unlinked='o')})",
            ("decide",): f"concat(transform({listed}, x -> {mint(decision, repr('SUPPORTED_BY'), 'x')}), {decided})",
            ("check",): f"array({mint(check, repr('CHECKS'), 'source_id')})",
            ("add-section",): f"array({mint(note, repr('HAS_SECTION'), section(_ADDED))})",
            MESSAGE_VERBS: f"array({mint(message, repr('PART_OF'), session)}, {mint(f'if(value is null, {session}, {before})', 'if(value is null, ' + repr('STARTS_WITH') + ', ' + repr('NEXT') + ')', message)})",
            ("derive-message",): f"transform({listed}, (x, i) -> {mint(message, repr('DERIVED_FROM'), 'x', position='i')})",
        },
    ).unionByName(sections)


def _alias_rows(ops: DataFrame) -> DataFrame:
    return ops.where("verb = 'alias'").select(F.lower(F.trim("key")).alias("name"), _id_of(F.col("subject")).alias("canonical"), F.col("o").alias("first"))


def _first_aliases(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(F.min_by("canonical", F.struct("first", "canonical")).alias("canonical"), F.min("first").alias("first"))


def _said(ops: DataFrame, aliases: DataFrame) -> DataFrame:
    """(o, ts, subject_id, term, predicate, value, actor): what asserts, aliases and checks claim.

    The subject of an assert is a full id, or a name: that of an alias if one was logged before, else a term of its own.
    """
    c = F.col
    asserts = ops.where("verb = 'assert'").withColumn("name", F.lower(F.trim("subject")))
    known = aliases.select("name", "canonical", c("first").alias("since"))
    healed = c("since").isNotNull() & (c("since") < c("o")) & ~c("subject").rlike(FULL_ID)
    own = ~healed & ~c("subject").rlike(FULL_ID)
    asserts = asserts.join(known, "name", "left").select("o", "ts", F.when(healed, c("canonical")).otherwise(_id_of(c("subject"))).alias("subject_id"), F.when(own, term_slug(c("subject"))).alias("term"), "predicate", "value", "actor")
    alias = ops.where("verb = 'alias'").select("o", "ts", _id_of(c("subject")).alias("subject_id"), F.when(~c("subject").rlike(FULL_ID), term_slug(c("subject"))).alias("term"), F.lit("aka").alias("predicate"), c("key").alias("value"), "actor")
    check = ops.where("verb = 'check'").select("o", "ts", stable_id("Check", c("source_id"), c("text")).alias("subject_id"), F.lit(None).cast("string").alias("term"), F.lit("task_state").alias("predicate"), F.lit("open").alias("value"), "actor")
    return asserts.unionByName(alias).unionByName(check).where("subject_id is not null and predicate is not null and value is not null")


def _first(column: str, order: str) -> Column:
    """The value of a column at its first place; rows without a place do not count."""
    return F.min_by(column, order).alias(column)


def _last(column: str, order: str) -> Column:
    return F.max_by(column, order).alias(column)


def _reduced(rows: State) -> State:
    """Rows of operations and of states, reduced to one state."""
    nodes = rows.nodes.groupBy("id").agg(_first("label", "born"), _first("key", "born"), _first("born_ts", "born"), _first("text", "born"), F.min("born").alias("born"), _last("edit", "edited"), F.max("edited").alias("edited"), _last("title", "title_at"), F.max("title_at").alias("title_at"))
    # A session is what came after its last retraction.
    retracted = rows.sessions.groupBy("id").agg(F.max("gone").alias("gone")).where("gone is not null")
    sessions = rows.sessions.drop("gone").join(retracted, "id", "left")
    alive = lambda at: F.when(F.col(at) > F.coalesce("gone", F.lit(NEVER)), F.col(at))
    sessions = sessions.withColumns({c: alive(c) for c in ("born", "title_at", "started_at")}).groupBy("id").agg(
        F.max("key").alias("key"), _first("born_ts", "born"), F.min("born").alias("born"), F.max("gone").alias("gone"), _last("title", "title_at"), F.max("title_at").alias("title_at"), _last("started", "started_at"), F.max("started_at").alias("started_at")
    )
    edges = rows.edges.groupBy("source_id", "relation_type", "target_id").agg(F.max("linked").alias("linked"), F.max("minted").alias("minted"), F.max("unlinked").alias("unlinked"), _first("position", "first"), F.min("first").alias("first"))
    claims = rows.claims.groupBy("assertion_id", "slot_id", "subject_id", "predicate", "value", "actor").agg(_first("asserted_at", "first"), F.min("first").alias("first"))
    found = {"nodes": nodes, "sessions": sessions, "edges": edges, "claims": claims, "aliases": _first_aliases(rows.aliases)}
    return State(**{k: v.select(*PARTS[k]) for k, v in found.items()})


def fold(ops: DataFrame, before: State | None = None) -> State:
    """The state after a log; with a state, that after its log and this one, which may overlap."""
    ops = ordered(ops)
    aliases = _alias_rows(ops)
    said = _said(ops, _first_aliases(aliases if before is None else aliases.unionByName(before.aliases)))
    actor = F.coalesce("actor", F.lit(""))
    claims = said.select(
        stable_id(F.col("subject_id"), F.col("predicate"), F.col("value"), actor).alias("assertion_id"),
        stable_id(F.col("subject_id"), F.col("predicate")).alias("slot_id"),
        *("subject_id", "predicate", "value", "actor"),
        F.col("o").alias("first"),
        F.col("ts").alias("asserted_at"),
    )
    rows = State(_node_rows(ops, said), _session_rows(ops), _edge_rows(ops), claims, aliases)
    if before is not None:
        rows = State(**{k: getattr(rows, k).unionByName(getattr(before, k)) for k in PARTS})
    return _reduced(rows)


# Views.


def nodes(state: State) -> DataFrame:
    """(id, label, key, title, text, started, created_seq, created_ts) of the nodes that there are; created_seq is the place in replay."""
    columns = ("id", "label", "key", "title", "text", "started", "born", "born_ts")
    text = F.when(F.col("edited") >= F.col("born"), F.col("edit")).otherwise(F.col("text"))
    nodes = state.nodes.where("born is not null").withColumns({"text": text, "started": F.lit(None).cast("string")})
    sessions = state.sessions.where("born is not null").withColumns({"label": F.lit("Session"), "text": F.lit(None).cast("string")})
    return nodes.select(*columns).unionByName(sessions.select(*columns)).withColumnsRenamed({"born": "created_seq", "born_ts": "created_ts"})


def edges(state: State) -> DataFrame:
    """(source_id, relation_type, target_id, position): edges minted or validly linked after they were last unlinked.

    A link counts if both ends were there before it; nothing from before an end's retraction does.
    """
    ends = state.nodes.select("id", "born", F.lit(None).cast("bigint").alias("gone")).unionByName(state.sessions.select("id", "born", "gone"))
    rows = state.edges.join(ends.toDF("source_id", "s_born", "s_gone"), "source_id", "left").join(ends.toDF("target_id", "t_born", "t_gone"), "target_id", "left")
    linked = F.when((F.col("linked") > F.col("s_born")) & (F.col("linked") > F.col("t_born")), F.col("linked"))
    at, never = F.greatest(linked, "minted"), F.lit(NEVER)
    there = (at > F.coalesce("unlinked", never)) & (at > F.coalesce("s_gone", never)) & (at > F.coalesce("t_gone", never))
    return rows.where(there).select("source_id", "relation_type", "target_id", "position")


def claims(state: State, registry: DataFrame) -> DataFrame:
    """(assertion_id, slot_id, subject_id, predicate, value, actor, asserted_at, superseder): every claim, and the one that supersedes it.

    Of an ordered predicate a claim is superseded by the first claim of the next higher rank in its slot, in whatever order
    they were made: a check that is opened again after it was done is born superseded.
    """
    return superseded(state.claims, registry, "first").select("assertion_id", "slot_id", "subject_id", "predicate", "value", "actor", "asserted_at", "superseder")


def superseded(rows: DataFrame, registry: DataFrame, order: str = "asserted_at") -> DataFrame:
    """rows (assertion_id, slot_id, predicate, value) with superseder: a chain from rank to rank, one link a claim at most.

    The ranks of a slot are told apart first; only they, and not the claims, are put in order.
    """
    ranks = F.broadcast(registry.where("ordered is not null").select("predicate", "ordered"))
    ranked = rows.join(ranks, "predicate", "left").withColumn("rank", rank(F.col("ordered"), F.col("value"))).drop("ordered")
    heads = ranked.where("rank is not null").groupBy("slot_id", "rank").agg(F.min_by("assertion_id", F.struct(order, "assertion_id")).alias("head"))
    heads = heads.select("slot_id", "rank", F.lead("head").over(Window.partitionBy("slot_id").orderBy("rank")).alias("superseder"))
    return ranked.join(heads, ["slot_id", "rank"], "left").drop("rank")


def counts(ops: DataFrame) -> DataFrame:
    """(verb, n): operations by verb; those that change nothing count as 'skipped'."""
    return ops.groupBy(F.when(F.col("verb").isin(*VERBS), F.col("verb")).otherwise("skipped").alias("verb")).agg(F.count("*").alias("n"))


# A state in a folder.


def stored_offsets(spark: SparkSession, folder: str) -> list[int]:
    """The offsets of the states in a folder, smallest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    done = [f.getPath() for f in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "complete/_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def load(spark: SparkSession, folder: str, offset: int) -> State:
    of = lambda k, kind: spark.read.schema(", ".join(f"{n} {t}" for n, t in kind.items())).parquet(f"{folder}/offset={offset}/{k}")
    return State(**{k: of(k, kind) for k, kind in PARTS.items()})


def advance(spark: SparkSession, folder: str, ops: DataFrame, upto: int | None = None, overlap: int = 0) -> State:
    """Continue the newest state in a folder with the operations past its offset, and store what comes out under its own.

    Only operations with seq > offset - overlap are read; a filter on seq reaches the log's files.  The new state is complete
    when its last part is written, so a job that is lost before leaves the one before in force.
    """
    known = stored_offsets(spark, folder)
    if known:
        ops = ops.where(F.col("seq") > known[-1] - overlap)
    if upto is not None:
        ops = ops.where(F.col("seq") <= upto)
    end = ops.agg(F.max("seq")).first()[0]
    if known and (end is None or end <= known[-1]):
        return load(spark, folder, known[-1])
    end = -GENESIS if end is None else end
    state = fold(ops, load(spark, folder, known[-1]) if known else None)
    for k in PARTS:
        getattr(state, k).write.mode("overwrite").parquet(f"{folder}/offset={end}/{k}")
    spark.range(1).write.mode("overwrite").parquet(f"{folder}/offset={end}/complete")
    return load(spark, folder, end)


def prune(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Delete all but the newest complete states in a folder, and unfinished ones older than these."""
    jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs, kept = at.getFileSystem(spark._jsc.hadoopConfiguration()), stored_offsets(spark, folder)[-max(keep, 1) :]
    for f in fs.listStatus(at) if kept else ():
        if int(f.getPath().getName().split("=")[1]) < kept[0]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f.getPath().toString()), True)
