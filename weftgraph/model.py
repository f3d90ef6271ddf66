"""The data model: columns of the tables, fixed vocabularies and constants.

nodes is a flat table with one column per hot property, so that filters and column pruning reach the files; edges
is unique on (source_id, relation_type, target_id); claims is append-only with SUPERSEDES pairs beside it; journal is
the append-only operation log, ordered by seq.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE_FIELDS = ("title", "name", "slug", "key", "description", "statement", "value", "text", "source", "body", "display_title", "subject_label", "path", "repo_key", "module_path", "import_name", "qualname", "module_id", "symbol_kind", "cell_key", "note_type", "entity_kind", "status", "root_kind", "gloss", "role", "ts")

# Fixed values.
TEXT_FIELDS = ("title", "name", "slug", "key", "description", "statement", "value", "text", "source", "body")
TITLE_FIELDS = ("display_title", "title", "name", "slug", "key", "subject_label", "statement", "value")
EXPORT_TITLE_FIELDS = ("title", "name", "slug", "key", "subject_label", "statement", "value", "text", "source")
LOCATE_FIELDS = ("name", "title", "slug", "key", "module_path", "import_name", "path")
EDGE_WEIGHTS = {"SUPERSEDES": 3.0, "CONTRADICTS": 3.0, "SUPPORTED_BY": 3.0, "DERIVED_FROM": 2.0, "DEPENDS_ON": 2.0, "ABOUT": 2.0, "PRODUCED": 2.0, "DECIDED_IN": 1.5, "PRODUCED_IN": 1.5, "EVIDENCED_BY": 1.5, "LANDS_AT": 1.5}
HOP_DECAY = 0.5
SUPERSEDED_FACTOR = 0.3
STOPWORDS = (
    "the", "and", "for", "with", "this", "that", "from", "into", "are", "was", "were", "has", "have", "had", "not", "but", "all", "any",
    "its", "our", "their", "what", "which", "when", "how", "why", "who", "via", "per", "out",
)
NAME_STOPWORDS = ("get", "set", "to", "from", "of", "run", "make", "build", "create", "the", "a", "an", "and", "or", "for", "with", "new", "init")
NAME_TOKEN = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
ANCHOR_ROLES = ("program", "arc", "north-star")
FRONT_DOOR_ROLES = ("portfolio", "program")


def stable_id(*parts: str | Column) -> Column:
    """A 36-character id derived from a natural key joined by '|'."""
    digest = F.md5(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))
    for at in (9, 14, 19, 24):  # one digest, however often the id is evaluated in a key or a filter
        digest = F.overlay(digest, F.lit("-"), at, 0)
    return digest


def edge_weight(relation: Column) -> Column:
    out = F.lit(1.0)
    for name, w in EDGE_WEIGHTS.items():
        out = F.when(relation == name, w).otherwise(out)
    return out
