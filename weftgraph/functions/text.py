"""Scalar text functions, all built of native column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.model import NAME_STOPWORDS, NAME_TOKEN, STOPWORDS, TEXT_FIELDS, TITLE_FIELDS
from weftgraph.operators.components import ensure_checkpoint_dir


def flat(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def filled(text: Column) -> Column:
    """Trimmed text, null if blank."""
    return F.nullif(F.trim(text), F.lit(""))


def cap_text(text: Column, limit: int) -> Column:
    """Flat text of at most limit characters; a cut ends in an ellipsis."""
    s = flat(text)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("…")))


def first_clause(text: Column, limit: int = 110) -> Column:
    """Flat text up to its last clause boundary within the limit whose head has balanced parentheses, else a hard cut.

    A boundary is ': ', '. ', ' — ' or '; ' that starts at character 15 or later within the first limit + 1 characters.
    """
    return F.get(F.transform(F.array(flat(text)), lambda s: _clause(s, limit)), F.lit(0))  # flat text is bound once


def _clause(s: Column, limit: int) -> Column:
    head = F.substring(s, 1, limit + 1)

    def cut(i: Column) -> Column:
        part = F.substring(head, F.lit(1), i)
        opened = F.length(F.replace(part, F.lit("("), F.lit("")))
        closed = F.length(F.replace(part, F.lit(")"), F.lit("")))
        two, three = F.substring(head, i + 1, F.lit(2)), F.substring(head, i + 1, F.lit(3))
        return (two.isin(": ", ". ", "; ") | (three == " — ")) & (opened == closed)

    at = F.array_max(F.filter(F.sequence(F.lit(15), F.lit(limit)), cut))
    clause = F.rtrim(F.regexp_replace(F.substring(head, F.lit(1), at), "[.:;— ]+$", ""))
    hard = F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(s) <= limit, s).when(at.isNotNull(), clause).otherwise(hard)


def node_title(fields: tuple[str, ...] = TITLE_FIELDS, clause_fields: tuple[str, ...] = ("statement", "value"), last: str = "id") -> Column:
    """The first field that is not blank; long fields give their first clause; the id if all are blank."""
    return F.coalesce(*(first_clause(filled(F.col(f))) if f in clause_fields else filled(F.col(f)) for f in fields), F.col(last))


def node_summary() -> dict[str, Column]:
    """Title, description or else a snippet of the text of up to 160 characters, gloss and kind columns."""
    body = flat(F.col("text"))
    snippet = F.when(F.length(body) > 160, F.concat(F.substring(body, 1, 159), F.lit("…"))).otherwise(F.nullif(body, F.lit("")))
    described = F.coalesce(F.nullif(F.col("description"), F.lit("")), snippet)
    return {"title": node_title(), "description": described, "gloss": filled(F.col("gloss")), **{f: F.nullif(F.col(f), F.lit("")).alias(f) for f in ("note_type", "entity_kind", "status", "root_kind")}}


def haystack() -> Column:
    """All text fields in lower case, joined by spaces."""
    return F.lower(F.concat_ws(" ", *(F.nullif(F.col(f), F.lit("")) for f in TEXT_FIELDS)))


def query_terms(text: Column, pattern: str = "[A-Za-z0-9]+", longer_than: int = 2) -> Column:
    """Distinct lower-case words of a question without stopwords, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(pattern.replace("A-Z", "")), F.lit(0))
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > longer_than)), F.array(*map(F.lit, STOPWORDS)))


def terms_of(text: str) -> list[str]:
    """query_terms() of a literal."""
    found = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(w for w in found if len(w) > 2 and w not in STOPWORDS))


def name_tokens(name: Column) -> Column:
    """Lower-case parts of snake_case and camelCase names without generic words."""
    parts = F.regexp_extract_all(name, F.lit(NAME_TOKEN), F.lit(0))
    lower = F.transform(parts, F.lower)
    return F.array_except(F.array_distinct(lower), F.array(*map(F.lit, NAME_STOPWORDS)))


def id_tokens(text: Column) -> Column:
    """Id-shaped tokens in order: 8 hex digits (not all decimal) or full ids."""
    found = F.regexp_extract_all(text, F.lit(r"\b[0-9a-f]{8}(?:-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})?\b"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike("^[0-9]{8}$")))


def term_slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "unnamed").otherwise(F.coalesce(s, F.lit("unnamed")))


def pin_target(value: Column) -> dict[str, Column]:
    """'id gloss' as its first word and the rest without leading dashes."""
    v = F.trim(value)
    return {"target": F.regexp_extract(v, r"^(\S+)", 1), "pin_gloss": F.trim(F.regexp_replace(F.regexp_replace(v, r"^\S+\s*", ""), "^[—\\- ]+", ""))}


def strip_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")


def lead_line(text: Column) -> Column:
    """The first line of the body that is not blank, trimmed; null if there is none."""
    lines = F.filter(F.transform(F.split(strip_frontmatter(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.get(lines, F.lit(0))


def note_slug(path: Column, text: Column) -> Column:
    """The name that a line of the text gives, else the file's stem."""
    named = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^name:\s*(\S+)\s*$", 1), F.lit(""))
    return F.coalesce(named, F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(?<=.)\.[^.]*$", ""))


def op_summary(args: dict[str, Column], limit: int = 90) -> Column:
    """'predicate = value' if there is a predicate; else the first speaking argument; else 'name=value' of the first filled one; else ''."""
    given = {k: filled(v) for k, v in args.items()}
    none = F.lit(None).cast("string")
    predicate, value = given.get("predicate", none), given.get("value", none)
    assertion = F.when(value.isNull(), predicate).otherwise(F.concat(predicate, F.lit(" = "), value))
    speaking = [cap_text(given[k], limit) for k in ("statement", "title", "gloss", "name") if k in given]
    rest = [F.concat(F.lit(f"{k}="), cap_text(given[k], limit)) for k in ("slug", "key", "relation", "symbol", "module_path", "path", "text", "body") if k in given]
    return F.coalesce(cap_text(assertion, limit), *speaking, *rest, F.lit(""))


def recency_factor(updated_at: Column, as_of: Column) -> Column:
    """1 + 0.5 / (1 + age in days / 30), 1 without a time."""
    age = F.greatest((as_of - updated_at) / 86400.0, F.lit(0.0))
    return F.when(updated_at.isNull(), F.lit(1.0)).otherwise(1.0 + 0.5 / (1.0 + age / 30.0))


def semver(text: Column) -> Column:
    """Version numbers as an array that compares in order; null if the text is no version.

    A part is (number of digits, digits) without leading zeros, so parts of any length compare as numbers.
    """
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.transform(F.split(text, r"\."), lambda x: version_part(F.regexp_replace(x, "^0+(?=.)", ""))))


def version_part(digits: Column) -> Column:
    return F.struct(F.length(digits).alias("n"), digits.alias("digits"))


def member_flags(qualname: Column) -> dict[str, Column]:
    last = F.substring_index(qualname, ".", -1)
    return {"is_top": ~qualname.contains("."), "is_public": ~last.startswith("_"), "is_dunder": last.rlike("^__.*__$")}


def resolve_relative(package: Column, level: Column, module: Column) -> Column:
    """The absolute name of a relative import: the caller's package less level - 1 parts, then the module; '' if it cannot be resolved."""
    parts = F.split(package, r"\.")
    keep = F.size(parts) - level + 1
    base = F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0)))
    name = F.array_join(F.when(F.coalesce(module, F.lit("")) == "", base).otherwise(F.concat(base, F.array(module))), ".")
    return F.when((F.coalesce(package, F.lit("")) == "") | (level < 1) | (keep < 1), "").otherwise(name)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


SMALL = 100_000  # ids that may be broadcast


def met(nodes: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """The nodes that id_col of rows names; ids that are few are sent to the nodes, so that not all nodes are dealt."""
    ensure_checkpoint_dir(nodes.sparkSession)
    ids = rows.select(F.col(id_col).alias("id")).distinct().checkpoint()
    return nodes.join(F.broadcast(ids) if ids.count() <= SMALL else ids, "id", "left_semi")


def with_titles(rows: DataFrame, id_col: str, nodes: DataFrame, out: str, missing: str = "_missing") -> DataFrame:
    """rows with the title of the node that id_col names, null if there is none.  Titles are made after the join, of the nodes that are met; missing names a column that says whether there is none."""
    fields = nodes.select(F.col("id").alias(id_col), F.struct(*TITLE_FIELDS).alias("_node"))
    title = node_title(tuple(f"_node.{f}" for f in TITLE_FIELDS), ("_node.statement", "_node.value"), id_col)
    return rows.join(fields, id_col, "left").withColumn(missing, F.col("_node").isNull()).withColumn(out, F.when(F.col("_node").isNotNull(), title)).drop("_node")


def label_ids(rows: DataFrame, id_col: str, nodes: DataFrame, out: str) -> DataFrame:
    """rows with the title of the node that id_col names, the id itself if there is none."""
    return with_titles(rows, id_col, nodes, out).withColumn(out, F.coalesce(out, id_col)).drop("_missing")
