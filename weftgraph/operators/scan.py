"""Scans, sources and sinks of the graph tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import filled, first_clause, resolve_relative
from weftgraph.model import EXPORT_TITLE_FIELDS, stable_id
from weftgraph.operators.components import ensure_checkpoint_dir
from weftgraph.operators.traverse import maybe_among


def scan_rows(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """Every node as a flat row of its id and the named fields; only these columns are read."""
    return nodes.select("id", *fields)


def load_label(nodes: DataFrame, label: str, limit: int | None = None) -> DataFrame:
    """Nodes of one label; with a limit, those with the smallest ids."""
    rows = nodes.where(F.col("label") == label)
    return rows if limit is None else rows.orderBy("id").limit(limit)


def parse_where(clauses: list[str]) -> Column:
    """'property=value' clauses as one predicate; a dotted property reads into a JSON column.  Other clauses raise ValueError."""
    terms = []
    for clause in clauses:
        m = re.fullmatch(r"\s*([A-Za-z_][\w.]*)\s*=(.*)", clause, re.S)
        if not m:
            raise ValueError(f"not of the form PROPERTY=VALUE: {clause!r}")
        name, value = m[1], m[2].strip()
        head, _, rest = name.partition(".")
        column = F.get_json_object(F.col(head), f"$.{rest}") if rest else F.col(head).cast("string")
        terms.append(column == value)
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def load_label_where(nodes: DataFrame, label: str, where: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of the nodes of a label that meet all clauses, in the order of ids."""
    return nodes.where((F.col("label") == label) & parse_where(where)).orderBy("id").offset(offset).limit(limit)


def count_label(nodes: DataFrame, label: str, where: list[str] | None = None) -> DataFrame:
    """The true total, whatever page is shown."""
    return nodes.where((F.col("label") == label) & parse_where(where or [])).agg(F.count("*").alias("n"))


def load_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes among a set of ids (column id); absent ids are left out."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def edge_pairs(edges: DataFrame, relation: str) -> DataFrame:
    return edges.where(F.col("relation_type") == relation).select("source_id", "target_id")


def edges_touching(edges: DataFrame, ids: DataFrame, both: bool = False, label: str | None = None) -> DataFrame:
    """Edges with an end (or both ends) in a set of ids; only what may have such an end is shuffled.

    label is that of all nodes of the ids: edges with source_label and target_label are then read where an end has it.
    """
    ensure_checkpoint_dir(ids.sparkSession)
    ids = ids.select("id").distinct().checkpoint()  # read for both ends

    def at(rows: DataFrame, end: str) -> DataFrame:
        rows = rows if label is None else rows.where(F.col(f"{end}_label") == label)
        return maybe_among(rows, f"{end}_id", ids).join(ids.withColumnRenamed("id", f"{end}_id"), f"{end}_id").select(*edges.columns)

    if both:
        return at(at(edges, "source"), "target")
    return at(edges, "source").union(at(edges, "target")).distinct()


def schema(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): labels and relation types with their counts."""
    labels = nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).select(F.lit("label").alias("kind"), "name", "n")
    return labels.unionAll(edges.groupBy(F.col("relation_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("relation").alias("kind"), "name", "n"))


def journal_scan(journal: DataFrame) -> DataFrame:
    """Operations in append order: seq is given once, when lines are taken in."""
    return journal.orderBy("seq")


def export_nodes(nodes: DataFrame) -> DataFrame:
    """(id, label, title) of the whole graph by the cheap title cascade."""
    long_fields = ("statement", "value", "text", "source")
    return nodes.select("id", "label", F.coalesce(*(first_clause(filled(F.col(f))) if f in long_fields else filled(F.col(f)) for f in EXPORT_TITLE_FIELDS), F.col("id")).alias("title"))


def export_edges(edges: DataFrame) -> DataFrame:
    return edges.select("source_id", "relation_type", "target_id")


def assemble_graph(parts: list[DataFrame]) -> DataFrame:
    """The union of element sets; the first part that has an id gives its row."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    columns = [c for c in rows.columns if c != "_part"]
    best = rows.groupBy("id").agg(F.min_by(F.struct(*columns), F.col("_part")).alias("row"))
    return best.select("row.*")


def dependency_edges(specs: DataFrame, prefix: str, aliases: DataFrame | None = None) -> DataFrame:
    """(source_id, relation_type, target_id) from (package, dep_spec): versions and extras go, the prefix stays, no self edges.

    aliases (name, canonical) map drifted package names.
    """
    name = F.regexp_replace(F.lower(F.regexp_extract(F.trim("dep_spec"), r"^([A-Za-z0-9._#-]+)", 1)), "_", "-")
    rows = specs.select(F.lower("package").alias("package"), name.alias("dep")).where(F.col("dep").startswith(prefix))
    if aliases is not None:
        rows = rows.join(aliases.select(F.col("name").alias("dep"), "canonical"), "dep", "left").withColumn("dep", F.coalesce("canonical", "dep"))
    return rows.where("package <> dep").select(stable_id("Entity", F.col("package")).alias("source_id"), F.lit("DEPENDS_ON").alias("relation_type"), stable_id("Entity", F.col("dep")).alias("target_id")).distinct()


def corpus_sections(notes: DataFrame) -> DataFrame:
    """(note_id, ord, anchor, raw): lines of a text as its ordered sections; joined by line breaks they give the text back."""
    parts = notes.select(F.col("id").alias("note_id"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "raw"))
    return parts.select("note_id", "ord", F.concat(F.lit("s"), F.col("ord").cast("string")).alias("anchor"), "raw")


def corpus_references(pages: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """(id, slug, n): links of the form [[slug]] or href="/slug" in texts, with how often each occurs."""
    links = F.regexp_extract_all(F.col(text_col), F.lit(r'href="/([^"/?#]+)"|\[\[([^\]|]+)\]\]'), F.lit(0))
    slug = F.regexp_extract(F.col("link"), r'(?:href="/|\[\[)([^"\]]+)', 1)
    return pages.select(F.col(id_col), F.explode(links).alias("link")).select(id_col, slug.alias("slug")).groupBy(id_col, "slug").agg(F.count("*").alias("n"))


def source_override_merge(scanned: DataFrame, journaled: DataFrame, live: DataFrame) -> DataFrame:
    """(key, content, origin): a live logged state overrides the scanned file, a retired key drops, logged keys without a file still come in.

    scanned (key, content); journaled (key, content) the latest logged states; live (key) the keys that the log owns.
    """
    owned = live.select("key", F.lit(True).alias("owned"))
    rows = scanned.select("key", F.col("content").alias("scan")).join(journaled.select("key", F.col("content").alias("log")), "key", "full_outer").join(owned, "key", "left")
    rows = rows.where(F.col("scan").isNotNull() | F.col("owned"))
    from_log = F.coalesce("owned", F.lit(False)) & F.col("log").isNotNull()
    return rows.select("key", F.when(from_log, F.col("log")).otherwise(F.col("scan")).alias("content"), F.when(from_log, "log").otherwise("file").alias("origin")).where(F.col("content").isNotNull())


def resolve_names(callers: DataFrame, targets: DataFrame, relation: str) -> DataFrame:
    """(source_id, relation_type, target_id): (id, name) callers joined to (id, name) targets whose name is unambiguous; no self edges."""
    unique = targets.groupBy("name").agg(F.min("id").alias("target_id"), F.countDistinct("id").alias("n")).where("n = 1").select("name", "target_id")
    return callers.select(F.col("id").alias("source_id"), "name").join(unique, "name").where("source_id <> target_id").select("source_id", F.lit(relation).alias("relation_type"), "target_id").distinct()


def resolve_imports(modules: DataFrame) -> DataFrame:
    """IMPORTS edges of modules (id, import_name, is_package, imports: array): each import is looked up by its absolute name.

    A relative import ('.x', '..x') is resolved against the package of its module: the module itself if it is a package, else
    its parent.  A name of several modules is that of the smallest id; imports of a module itself give no edge.
    """
    named = modules.where("import_name <> ''").groupBy(F.col("import_name").alias("name")).agg(F.min("id").alias("target_id"))
    rows = modules.select(F.col("id").alias("source_id"), "import_name", "is_package", F.explode(F.array_distinct("imports")).alias("raw"))
    level = F.length(F.regexp_extract("raw", r"^(\.*)", 1))
    package = F.when(F.col("is_package"), F.col("import_name")).otherwise(F.regexp_replace("import_name", r"\.?[^.]*$", ""))
    name = F.when(level == 0, F.col("raw")).otherwise(resolve_relative(package, level, F.regexp_replace("raw", r"^\.+", "")))
    found = rows.select("source_id", name.alias("name")).distinct().join(named, "name").where("source_id <> target_id")
    return found.select("source_id", F.lit("IMPORTS").alias("relation_type"), "target_id").distinct()


def resolve_calls(symbols: DataFrame) -> DataFrame:
    """CALLS edges of symbols (id, qualname, calls: array): a called name leads to the symbol with this bare name, if there is only one.

    Calls are distinct names before the join, so a name that very many symbols call joins with one row.
    """
    bare = F.element_at(F.split("qualname", r"\."), -1)
    targets = symbols.select("id", bare.alias("name")).where("name <> ''")
    return resolve_names(symbols.select("id", F.explode(F.array_distinct("calls")).alias("name")), targets, "CALLS")


def message_payload(messages: DataFrame) -> DataFrame:
    """messages (session, turn, id, ...) plus prev_id: the message before in the session."""
    return messages.withColumn("prev_id", F.lag("id").over(Window.partitionBy("session").orderBy("turn")))


def message_edges(messages: DataFrame) -> DataFrame:
    """PART_OF for every message; NEXT from its predecessor, else STARTS_WITH from the session.  messages: (session_id, id, prev_id)."""
    part_of = messages.select(F.col("id").alias("source_id"), F.lit("PART_OF").alias("relation_type"), F.col("session_id").alias("target_id"))
    chain = messages.select(F.coalesce("prev_id", "session_id").alias("source_id"), F.when(F.col("prev_id").isNull(), "STARTS_WITH").otherwise("NEXT").alias("relation_type"), F.col("id").alias("target_id"))
    return part_of.unionAll(chain)


def delta(rows: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not there yet."""
    return rows.join(existing.select(key).distinct(), key, "left_anti").select(*rows.columns)


def derived_edges(sent: DataFrame) -> DataFrame:
    """(source_id, relation_type, target_id, ord): a sent message is derived from each of its parts, in order."""
    return sent.select(F.col("id").alias("source_id"), F.posexplode("parts").alias("ord", "target_id")).select("source_id", F.lit("DERIVED_FROM").alias("relation_type"), "target_id", "ord")


def mint_messages(messages: DataFrame, sent: DataFrame, nodes: DataFrame, edges: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, claims) that pulled messages add to a graph: only what it does not have, so minting again adds nothing.

    messages: (id, session_id, prev_id, role, text, transcript): nodes, their chain, and a fact that pairs a session with its
    transcript.  sent: (id, parts): DERIVED_FROM edges in order.  Of repeated messages the one of the smallest text counts.
    """
    once = messages.groupBy("id").agg(F.min(F.struct("session_id", "prev_id", "role", "text", "transcript")).alias("m")).select("id", "m.*")
    made = once.select("id", F.lit("Message").alias("label"), "role", "text").unionByName(once.select(F.col("session_id").alias("id"), F.lit("Session").alias("label")).distinct(), allowMissingColumns=True)
    triple = ["source_id", "relation_type", "target_id"]
    chain = message_edges(once).withColumn("ord", F.lit(None).cast("int")).unionByName(derived_edges(sent))
    chain = chain.groupBy(*triple).agg(F.min("ord").alias("ord"))
    facts = once.where("transcript is not null").select(F.col("session_id").alias("subject_id"), F.lit("cc_session_uuid").alias("predicate"), F.col("transcript").alias("value")).distinct()
    facts = facts.select(stable_id(F.col("subject_id"), F.col("predicate"), F.col("value")).alias("assertion_id"), "subject_id", "predicate", "value")
    return delta(made, nodes), chain.join(edges.select(*triple), triple, "left_anti"), delta(facts, claims, "assertion_id")


def reads_ledger(results: DataFrame, text_col: str = "body", keep: int = 500) -> DataFrame:
    """results plus ids (full ids in order, distinct, at most `keep`) and n (all of them)."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"), F.lit(0)))
    return results.withColumn("_found", found).withColumn("ids", F.slice("_found", 1, keep)).withColumn("n", F.size("_found")).drop("_found")


def append_dedup(ops: DataFrame, latest: DataFrame, key: str = "key", content: str = "content") -> DataFrame:
    """Operations that change their key's latest state; equal to it, they are dropped."""
    same = latest.select(F.col(key), F.col(content))
    return ops.join(same, [key, content], "left_anti").select(*ops.columns)


def register_latest(events: DataFrame, key: str, content: str, order: str) -> DataFrame:
    """(key, content): the last registration of each key."""
    return events.groupBy(key).agg(F.max_by(content, order).alias(content))
