"""Markdown corpora: sections with anchors, references between notes, topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.model import stable_id

#: Before a heading at the start of a line, and behind a run of empty lines.
BOUNDARY = "(?<=\\n)(?=#{1,6} )|(?<=\\n\\n)(?=[^\\n])"
UNTITLED = "section"
#: [[slug]], [[slug|text]] and [[slug#anchor]].
REFERENCE = "\\[\\[([^\\]|#\\n]+)[^\\]\\n]*\\]\\]"


def _pieces(text: str) -> str:
    """SQL text: the parts of a text, cut before headings and behind empty lines; together they are the text."""
    return f"filter(split(coalesce({text}, ''), r'{BOUNDARY}'), x -> x <> '')"


def _name(raw: str) -> str:
    """SQL text: what a part is called by its heading."""
    return f"coalesce(nullif(trim('-' from regexp_replace(lower(regexp_extract({raw}, r'^#{{1,6}} ([^\\n]*)', 1)), '[^a-z0-9]+', '-')), ''), '{UNTITLED}')"


def first_anchor(text: str) -> str:
    """SQL text: the anchor of the first section of a text, null if it has none."""
    return f"if({text} <> '', {_name(f'get({_pieces(text)}, 0)')}, null)"


def sectioned(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    """rows, one for each section of their text, with ord, anchor and raw in place of the text.

    The anchor is that of the heading, or 'section' without one; the second of an anchor in a text gets -2, and so on.  A null
    or empty text has no sections.  key tells texts apart; rows that are repeated give repeated sections.  Anchors are
    numbered by a window over the sections, so a text of very many takes no longer than their sorting.
    """
    kept = [c for c in rows.columns if c != text_col]
    parts = rows.select(*kept, F.posexplode(F.expr(_pieces(f"`{text_col}`"))).alias("ord", "raw")).withColumn("anchor", F.expr(_name("raw")))
    nth = F.dense_rank().over(Window.partitionBy(key, "anchor").orderBy("ord"))
    return parts.withColumn("_nth", nth).withColumn("anchor", F.when(F.col("_nth") == 1, F.col("anchor")).otherwise(F.concat_ws("-", "anchor", "_nth"))).drop("_nth")


def sections(notes: DataFrame, text_col: str = "text") -> DataFrame:
    """(note_id, ord, anchor, raw) of notes (id, text); the raws of a note in order are its text."""
    return sectioned(notes.select(F.col("id").alias("note_id"), F.col(f"`{text_col}`").alias("text")), "note_id", "text").select("note_id", "ord", "anchor", "raw")


def references(notes: DataFrame, aliases: DataFrame, text_col: str = "text") -> DataFrame:
    """(source_id, slug, target_id, healed, n): the slugs that each note (id, slug, text) names, and the notes that they lead to.

    A slug of no note is looked up among aliases (drifted, canonical) and heals to the note of the canonical slug; one that
    leads nowhere keeps a null target.  Slugs are counted per note first, so a slug that very many texts name is a row for
    each note, and joins by slug.  A slug of several notes is that of the smallest id.
    """
    found = notes.select(F.col("id").alias("source_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(REFERENCE), F.lit(1))).alias("slug"))
    found = found.groupBy("source_id", F.trim("slug").alias("slug")).agg(F.count("*").alias("n"))
    by_slug = notes.groupBy("slug").agg(F.min("id").alias("id"))
    healed = aliases.groupBy(F.col("drifted").alias("slug")).agg(F.min("canonical").alias("canonical"))
    rows = found.join(by_slug.withColumnRenamed("id", "direct"), "slug", "left").join(healed, "slug", "left")
    rows = rows.join(by_slug.select(F.col("slug").alias("canonical"), F.col("id").alias("mended")), "canonical", "left")
    return rows.select("source_id", "slug", F.coalesce("direct", "mended").alias("target_id"), (F.col("direct").isNull() & F.col("mended").isNotNull()).alias("healed"), "n")


def reference_edges(refs: DataFrame) -> DataFrame:
    """(source_id, relation_type, target_id) of references that lead to another note."""
    return refs.where("target_id is not null and source_id <> target_id").select("source_id", F.lit("REFERENCES").alias("relation_type"), "target_id").distinct()


def topics(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topic nodes (id, label, name) of notes (id, topic), and TAGGED edges onto them; a blank topic tags nothing."""
    tagged = notes.where("trim(topic) <> ''").select("id", F.lower(F.trim("topic")).alias("name"))
    topic_id = stable_id("Topic", F.col("name"))
    return tagged.select("name").distinct().select(topic_id.alias("id"), F.lit("Topic").alias("label"), "name"), tagged.select(F.col("id").alias("source_id"), F.lit("TAGGED").alias("relation_type"), topic_id.alias("target_id")).distinct()
