"""Line dedup: lines that spread over many sites are boilerplate and leave every text.

A line's key is two hashes of its trimmed text.  The sites of a key are gathered in HyperLogLog sketches, which merge
by aggregation: each task sends one small sketch per key, however often and wherever the line occurs.  Where the
estimate lies within the sketch's error of the threshold, the distinct sites are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrow import picked, use_checkpoints

SITES = 10
SKETCH_BITS = 9
MARGIN = 0.25  # over five standard errors of a sketch of 2^9 registers
SMALL = 1_000_000  # lines that may be broadcast
SPACES = " \t\x0b\x0c\r"


def _row_key(id_col: str, text_col: str):
    """Rows that share an id are told apart by their text; equal texts lose equal lines anyway."""
    return F.struct(F.col(f"`{id_col}`").alias("i"), F.xxhash64(F.col(f"`{text_col}`")).alias("t"))


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(row, site, at, h1, h2): every line with a word, with its place in the text and the hashes of its trimmed text."""
    lines = docs.select(_row_key(id_col, text_col).alias("row"), F.col(f"`{site_col}`").alias("site"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n", -1)).alias("at", "line"))
    trimmed = lines.select("row", "site", "at", F.btrim("line", F.lit(SPACES)).alias("line")).where("line <> ''")
    return trimmed.select("row", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def _among(keys: DataFrame, lines: DataFrame) -> DataFrame:
    """keys of these lines.  Up to SMALL lines (16 bytes each) are broadcast, so that a frequent line's rows stay where they are read."""
    return keys.join(F.broadcast(lines) if lines.count() <= SMALL else lines, ["h1", "h2"], "left_semi")


def spread_lines(keys: DataFrame, sites: int = SITES) -> DataFrame:
    """(h1, h2): keys on at least this many distinct sites."""
    keys = keys.where("site is not null")
    estimated = keys.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch")).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("n_sites"))
    estimated = estimated.where(F.col("n_sites") >= sites * (1 - MARGIN)).checkpoint()
    clear = estimated.where(F.col("n_sites") >= sites * (1 + MARGIN)).select("h1", "h2")
    near = estimated.where(F.col("n_sites") < sites * (1 + MARGIN)).select("h1", "h2").checkpoint()
    # So near the threshold a line's sites are few: they are gathered in the tasks that read them, and one row a task and line is sent on.
    exact = _among(keys.select("h1", "h2", "site"), near).groupBy("h1", "h2").agg(F.size(F.collect_set("site")).alias("n_sites"))
    return clear.unionByName(exact.where(F.col("n_sites") >= sites).select("h1", "h2")).checkpoint()


def mark_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """(doc, gone): every row of docs as one struct, so that no column can clash, and the places of its boilerplate lines, null if it has none."""
    use_checkpoints(docs.sparkSession)
    keys = line_keys(docs, id_col, text_col, site_col)
    gone = _among(keys.select("row", "at", "h1", "h2"), spread_lines(keys, sites)).groupBy("row").agg(F.collect_set("at").alias("gone"))
    rows = docs.select(_row_key(id_col, text_col).alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    return rows.join(gone.hint("shuffle_hash"), "row", "left").select("doc", "gone")


def _kept_text(text):
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("gone", i))
    return F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """docs with the same columns and rows, without the lines that occur on at least `sites` distinct sites.

    Lines are compared without white space around them; lines without a word stay.  Rows with a null site count for
    no site but lose boilerplate lines; null texts stay null; a text of boilerplate lines only becomes ''; rows with
    a null id and repeated rows stay and are treated alike; columns may have any names; an empty table stays empty.
    """
    marked, doc = mark_lines(docs, id_col, text_col, site_col, sites), F.col("doc")
    return marked.select(*((_kept_text(doc.getField(c)) if c == text_col else doc.getField(c)).alias(c) for c in docs.columns))


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """(id, n_lines, n_removed, kept_sha256) for every row of docs; a null text has no lines and counts as empty."""
    marked = mark_lines(picked(docs, id_col, text_col, site_col), id_col, text_col, site_col, sites)
    text = F.col("doc").getField(text_col)
    return marked.select(
        F.col("doc").getField(id_col).alias(id_col),
        F.greatest(F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(_kept_text(text), F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), trimmed AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM lines),
gone AS (SELECT k FROM trimmed WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {SITES}),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM gone)) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM gone)), '') AS body
  FROM trimmed GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
