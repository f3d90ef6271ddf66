"""Search: seeds by terms, literal search, id prefixes, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import any_of, filled, haystack, node_title, terms_of
from weftgraph.model import LOCATE_FIELDS, TEXT_FIELDS


def overview_kinds(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): undirected degree."""
    return edges.select(F.col("source_id").alias("id")).unionAll(edges.select("target_id")).groupBy("id").agg(F.count("*").alias("degree"))


def overview_hubs(nodes: DataFrame, edges: DataFrame, labels: list[str], top: int) -> DataFrame:
    """(id, label, degree): the nodes of these labels with the most edges; titles are for the winners only."""
    wanted = nodes.where(F.col("label").isin(*labels)).select("id", "label")
    return degrees(edges).join(wanted, "id").orderBy(F.desc("degree"), "id").limit(top)


def find_seeds(nodes: DataFrame, task: str, k: int = 6) -> DataFrame:
    """(id, hits, rank): nodes that contain the most distinct terms of a task; rank from 0."""
    terms = terms_of(task)
    text = haystack()
    hits = sum((F.contains(F.col("_hay"), F.lit(t)).cast("int") for t in terms), F.lit(0))
    # A node without a hit goes after the cut: a filter on the number before it would read the text anew for every term.
    best = nodes.select("id", text.alias("_hay")).select("id", hits.alias("hits")).orderBy(F.desc("hits"), "id").limit(k).where("hits > 0")
    return best.agg(F.sort_array(F.collect_list(F.struct((-F.col("hits")).alias("neg"), "id", "hits"))).alias("all")).select(F.posexplode("all").alias("rank", "row")).select("row.id", "row.hits", "rank")


def resolve_refs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref, outcome, id): full ids are looked up exactly; other hex refs of 6 or more characters as prefixes; 'ambiguous' and 'missing' stay visible."""
    ids = nodes.select("id")
    r = refs.select("ref").distinct()
    exact = r.join(ids, r["ref"] == ids["id"], "left_semi").select("ref", F.lit("exact").alias("outcome"), F.col("ref").alias("id"))
    shaped = r.where(F.col("ref").rlike("^[0-9a-fA-F][0-9a-fA-F-]{5,34}$"))
    p = shaped.withColumn("six", F.substring(F.lower("ref"), 1, 6)).join(ids.withColumn("six", F.substring("id", 1, 6)), "six").where(F.col("id").startswith(F.lower("ref")))
    prefix = p.groupBy("ref").agg(F.count("*").alias("n"), F.min("id").alias("id")).select("ref", F.when(F.col("n") == 1, "prefix").otherwise("ambiguous").alias("outcome"), F.when(F.col("n") == 1, F.col("id")).alias("id"))
    known = exact.unionByName(prefix.join(exact.select("ref"), "ref", "left_anti"))
    missing = r.join(known.select("ref"), "ref", "left_anti").select("ref", F.lit("missing").alias("outcome"), F.lit(None).cast("string").alias("id"))
    return known.unionByName(missing)


def neighbours(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, direction, relation_type, other) of every edge at these nodes; the edges are read once, each from both of its ends."""
    end = lambda at, direction, other: F.struct(F.col(at).alias("id"), F.lit(direction).alias("direction"), F.col(other).alias("other"))
    ends = edges.select("relation_type", F.explode(F.array(end("source_id", "out", "target_id"), end("target_id", "in", "source_id"))).alias("e"))
    return ends.select("e.id", "e.direction", "relation_type", "e.other").join(ids.select("id"), "id", "left_semi")


def locate(nodes: DataFrame, term: str, limit: int = 25) -> DataFrame:
    """(id, label, title, path, total): case-insensitive substring of an identity field; the list is capped, the total is true."""
    t = term.lower()
    found = nodes.where(any_of([F.coalesce(F.contains(F.lower(f), F.lit(t)), F.lit(False)) for f in LOCATE_FIELDS])).select("id", "label", node_title().alias("title"), "path")
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("label", "title", "id").limit(limit).join(F.broadcast(total), how="cross")


def _snippet(text: Column, at: Column, size: int, context: int) -> Column:
    begin = F.greatest(at - context, F.lit(1))
    end = F.least(at + size + context, F.length(text) + 1)
    part = F.trim(F.regexp_replace(F.substring(text, begin, end - begin), r"\s+", " "))
    return F.concat(F.when(begin > 1, "…").otherwise(""), part, F.when(end <= F.length(text), "…").otherwise(""))


def grep(nodes: DataFrame, term: str, context: int = 60) -> DataFrame:
    """(id, label, field, snippet): literal case-insensitive search; the first text field that matches, with its surroundings."""
    t = term.lower()
    hits = []
    for f in TEXT_FIELDS:
        at = F.instr(F.lower(f), t)
        hits.append(F.when(at > 0, F.struct(F.lit(f).alias("field"), F.col(f).alias("text"), at.alias("at"))))
    found = nodes.select("id", "label", F.coalesce(*hits).alias("hit")).where("hit is not null")
    return found.select("id", "label", "hit.field", _snippet(F.col("hit.text"), F.col("hit.at"), len(t), context).alias("snippet"))


def list_label(nodes: DataFrame, label: str, contains: str | None, limit: int, offset: int = 0) -> DataFrame:
    """(id, title, total): a page of a label's nodes by title, with the true total."""
    rows = nodes.where(F.col("label") == label).select("id", node_title().alias("title"))
    if contains:
        rows = rows.where(F.contains(F.lower("title"), F.lit(contains.lower())))
    return rows.orderBy("id").offset(offset).limit(limit).join(F.broadcast(rows.agg(F.count("*").alias("total"))), how="cross")


def list_predicate(active: DataFrame, nodes: DataFrame, predicate: str, value: str | None, limit: int, offset: int = 0) -> DataFrame:
    """(subject_id, subject, value): active claims of a predicate, by subject and value."""
    rows = active.where(F.col("predicate") == predicate)
    if value is not None:
        rows = rows.where(F.col("value") == value)
    titles = nodes.select(F.col("id").alias("subject_id"), node_title().alias("subject"))
    rows = rows.select("subject_id", "value").join(titles, "subject_id", "left").withColumn("subject", F.coalesce("subject", "subject_id"))
    return rows.orderBy("subject", "value", "subject_id").offset(offset).limit(limit)


def list_relation(edges: DataFrame, nodes: DataFrame, relation: str, limit: int, offset: int = 0) -> DataFrame:
    """(source_id, source, target_id, target): labelled edges of a relation, sorted and paged."""
    rows = edges.where(F.col("relation_type") == relation).select("source_id", "target_id")
    for end in ("source", "target"):
        rows = rows.join(nodes.select(F.col("id").alias(f"{end}_id"), node_title().alias(end)), f"{end}_id", "left").withColumn(end, F.coalesce(end, f"{end}_id"))
    return rows.orderBy("source", "target", "source_id", "target_id").offset(offset).limit(limit).select("source_id", "source", "target_id", "target")


def list_mode(label: str | None = None, predicate: str | None = None, relation: str | None = None, value: str | None = None) -> str:
    """The listing that is asked for; exactly one of the three, and a value only with a predicate."""
    modes = [m for m, x in (("label", label), ("predicate", predicate), ("relation", relation)) if x]
    if len(modes) != 1:
        raise ValueError("give exactly one of label, predicate and relation")
    if value is not None and modes != ["predicate"]:
        raise ValueError("a value goes with a predicate")
    return modes[0]


def nonblank(field: str) -> Column:
    return filled(F.col(field)).isNotNull()
