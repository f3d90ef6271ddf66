"""Anchor views: the lead structure that claims assert, and the portfolio derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text
from weftgraph.model import FRONT_DOOR_ROLES


def lead_structure(active: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, subject_id, key, value): roles, priorities, pins, statuses and locks.

    The earliest active value counts for a role, a priority and each <key>-status; all active values of pin.<key>
    are pins; a lock is the smallest node with the role 'lock' that is ABOUT the subject.
    """
    p = F.col("predicate")
    single = active.where((p == "role") | (p == "priority") | p.endswith("-status")).where(p != "-status")  # in terms that are decided for a part of one predicate
    first = single.groupBy("subject_id", "predicate").agg(F.min_by("value", F.struct("asserted_at", "assertion_id")).alias("value"))
    status = p.endswith("-status")
    firsts = first.select(F.when(status, "status").otherwise(p).alias("kind"), "subject_id", F.when(status, p.substr(F.lit(1), F.length(p) - 7)).otherwise("").alias("key"), "value")
    pins = active.where(p.startswith("pin.") & (F.length(p) > 4)).select(F.lit("pin").alias("kind"), "subject_id", p.substr(F.lit(5), F.length(p)).alias("key"), "value")
    locked = firsts.where("kind = 'role' and value = 'lock'").select(F.col("subject_id").alias("source_id"))
    about = edges.where("relation_type = 'ABOUT'").join(locked, "source_id", "left_semi")
    locks = about.groupBy(F.col("target_id").alias("subject_id")).agg(F.min("source_id").alias("value")).select(F.lit("lock").alias("kind"), "subject_id", F.lit("").alias("key"), "value")
    return firsts.unionByName(pins).unionByName(locks)


def doors(lead: DataFrame, roles: tuple[str, ...] = FRONT_DOOR_ROLES) -> DataFrame:
    """(anchor_id, role) of the anchors at the front door."""
    return lead.where((F.col("kind") == "role") & F.col("value").isin(*roles)).select(F.col("subject_id").alias("anchor_id"), F.col("value").alias("role"))


def pins(lead: DataFrame, anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """(anchor_id, role, id, gloss, title, missing): pins of the anchors; a target that does not resolve stays, as missing."""
    parts = text.pin_target(F.col("value"))
    rows = lead.where("kind = 'pin'").join(anchors.select(F.col("anchor_id").alias("subject_id")), "subject_id", "left_semi")
    rows = rows.select(F.col("subject_id").alias("anchor_id"), F.col("key").alias("role"), parts["target"].alias("id"), parts["pin_gloss"].alias("gloss"))
    return text.with_titles(rows, "id", text.met(nodes, rows, "id"), "title", "missing").select("anchor_id", "role", "id", "gloss", "title", "missing")


def registers(lead: DataFrame, pinned: DataFrame, nodes: DataFrame) -> DataFrame:
    """(anchor_id, hub_id, missing, member_id, member_title, status) of register pins.

    The hub's slug is <value>-register; its members have the role <value>; status is their <value>-status.  A hub
    without members, or that does not resolve, gives one row without a member.
    """
    hubs = pinned.where("role = 'register'").select("anchor_id", F.col("id").alias("hub_id"), "missing")
    slugs = text.met(nodes, hubs, "hub_id").where("slug is not null").select(F.col("id").alias("hub_id"), F.regexp_replace("slug", "-register$", "").alias("value"))
    roles = lead.where("kind = 'role'").select("value", F.col("subject_id").alias("member_id"))
    status = lead.where("kind = 'status'").select(F.col("key").alias("value"), F.col("subject_id").alias("member_id"), F.col("value").alias("status"))
    rows = hubs.join(slugs, "hub_id", "left").join(roles, "value", "left").join(status, ["value", "member_id"], "left")
    return text.label_ids(rows, "member_id", text.met(nodes, roles, "member_id"), "member_title").select("anchor_id", "hub_id", "missing", "member_id", "member_title", "status")


def portfolio(anchors: DataFrame, pinned: DataFrame, lead: DataFrame, filed: DataFrame, touch: DataFrame, nodes: DataFrame) -> DataFrame:
    """(anchor_id, role, title, ready, blocked, closable, findings, pins, last_touch) of each anchor.

    filed (item_id, anchor_id, bucket, closable, finding) are its open items; touch (ref, last_ts).  last_touch is the
    newest time of the anchor, its lock, its pins and its open items, null without any.  References meet touch by a
    join of both tables and are reduced before the anchors see them, so no anchor's items come together.
    """
    vital = filed.groupBy("anchor_id").agg(F.count_if(F.col("bucket") == "ready").alias("ready"), F.count_if(F.col("bucket") == "blocked").alias("blocked"), F.count_if("closable").alias("closable"), F.count_if("finding").alias("findings"))
    n_pins = pinned.groupBy("anchor_id").agg(F.count("*").alias("pins"))
    locks = lead.where("kind = 'lock'").select(F.col("subject_id").alias("anchor_id"), F.col("value").alias("ref"))
    refs = anchors.select("anchor_id", F.col("anchor_id").alias("ref")).unionByName(locks).unionByName(pinned.select("anchor_id", F.col("id").alias("ref"))).unionByName(filed.select("anchor_id", F.col("item_id").alias("ref")))
    last = refs.join(touch, "ref").groupBy("anchor_id").agg(F.max("last_ts").alias("last_touch"))
    rows = anchors.join(vital, "anchor_id", "left").join(n_pins, "anchor_id", "left").join(last, "anchor_id", "left").withColumn("id", F.col("anchor_id"))
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return text.label_ids(rows, "id", nodes, "title").select("anchor_id", "role", "title", *map(count, ("ready", "blocked", "closable", "findings", "pins")), "last_touch")


def coverage_line(kinds: DataFrame) -> DataFrame:
    """(line): 'kind×count · …' of (label, n), most frequent first; there are as many parts as labels."""
    parts = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "label")))
    return kinds.agg(F.array_join(F.transform(parts, lambda p: F.concat(p["label"], F.lit("×"), (-p["n"]).cast("string"))), " · ").alias("line"))
