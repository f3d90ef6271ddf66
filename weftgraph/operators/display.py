"""Display rules: one template per label, rendered as native columns over at most one hop of edges."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text

_FIELD = re.compile(r"(?P<prop>\w+)(?:\|(?P<cap>\d+))?")
_EDGE = re.compile(r"(?P<way>->|<-)(?P<relation>\w+)(?:\.(?P<prop>\w+))?(?:\|(?P<cap>\d+))?")
_COUNT = re.compile(r"#(?P<way>->|<-)(?P<relation>\w+)")


class Part(NamedTuple):
    kind: str  # literal, field, edge or count
    text: str = ""
    way: str = ""
    relation: str = ""
    cap: int | None = None


def parse_template(template: str) -> list[Part]:
    """{prop|N}, {->REL.prop|N}, {<-REL}, {#->REL} and literal text; any other token is an error that names it."""
    out = []
    for at, piece in enumerate(re.split(r"\{([^{}]*)\}", template)):
        if at % 2 == 0:
            if piece:
                out.append(Part("literal", piece))
        elif m := _FIELD.fullmatch(piece.strip()):
            out.append(Part("field", m["prop"], cap=m["cap"] and int(m["cap"])))
        elif m := _EDGE.fullmatch(piece.strip()):
            out.append(Part("edge", m["prop"] or "", m["way"], m["relation"], m["cap"] and int(m["cap"])))
        elif m := _COUNT.fullmatch(piece.strip()):
            out.append(Part("count", "", m["way"], m["relation"]))
        else:
            raise ValueError(f"no such display token: {{{piece}}}")
    return out


def rule_errors(template: str) -> str | None:
    """What is wrong with a template; None if it may be written."""
    try:
        return None if parse_template(template or "") else "empty template"
    except ValueError as e:
        return str(e)


def latest_rules(ops: DataFrame) -> DataFrame:
    """(label, template): the last rule of each label among those that parse; ops (seq, label, template).  Null templates never land."""
    good = F.udf(lambda t: rule_errors(t) is None, "boolean", useArrow=True)
    parsed = ops.select("template").distinct().where(good("template"))  # each template is parsed once, however often it is written
    return ops.join(parsed, "template", "left_semi").groupBy("label").agg(F.max_by("template", "seq").alias("template"))


def annotate(nodes: DataFrame, edges: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(id, label, display_title) of the nodes that have a rule, or a stored display title, which wins.

    An edge token shows the neighbour of the smallest id, by its own title or the named property; a missing value is
    empty; a title that comes out blank is null.  Each (direction, relation) costs one aggregation and one join.
    """
    parsed = {label: parse_template(t) for label, t in rules.items()}
    rows = nodes.where(F.col("label").isin(*parsed) | text.filled(F.col("display_title")).isNotNull())
    hops = sorted({(p.way, p.relation) for parts in parsed.values() for p in parts if p.relation})
    for k, (way, relation) in enumerate(hops):
        here, there = ("source_id", "target_id") if way == "->" else ("target_id", "source_id")
        near = edges.where(F.col("relation_type") == relation).groupBy(F.col(here).alias("id")).agg(F.count("*").alias(f"_n{k}"), F.min(there).alias(f"_first{k}"))
        props = sorted({p.text for parts in parsed.values() for p in parts if p.kind == "edge" and (p.way, p.relation) == (way, relation) and p.text})
        kept = nodes.select(F.col("id").alias(f"_first{k}"), *(F.struct(F.col(p).cast("string").alias(p)).alias(f"_p_{p}") for p in props))
        near = text.with_titles(near.join(kept, f"_first{k}", "left"), f"_first{k}", nodes, "_title")
        shown = F.struct("_title", *(F.col(f"_p_{p}.{p}").alias(p) for p in props)).alias(f"_near{k}")
        rows = rows.join(near.select("id", f"_n{k}", shown), "id", "left")

    def shown_part(p: Part) -> Column:
        if p.kind == "literal":
            return F.lit(p.text)
        if p.kind == "field":
            value = F.col(p.text).cast("string")
        elif p.kind == "count":
            value = F.coalesce(F.col(f"_n{hops.index((p.way, p.relation))}"), F.lit(0)).cast("string")
        else:
            value = F.col(f"_near{hops.index((p.way, p.relation))}.{p.text or '_title'}")
        return F.coalesce(text.cap_text(value, p.cap) if p.cap else value, F.lit(""))

    title = F.lit(None).cast("string")
    for label, parts in parsed.items():
        title = F.when(F.col("label") == label, F.nullif(text.flat(F.concat(*map(shown_part, parts))), F.lit(""))).otherwise(title)
    return rows.select("id", "label", F.coalesce(text.filled(F.col("display_title")), title).alias("display_title"))
