"""The fact layer: claims in slots, supersession, conflicts, subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import semver, term_slug, version_part
from weftgraph.model import stable_id
from weftgraph.operators.components import ensure_checkpoint_dir
from weftgraph.operators.traverse import maybe_among


def canonical(value: Column) -> Column:
    """The form in which values are compared; the one place to change it."""
    return F.lower(F.trim(value))


def rank(ordered: Column, value: Column) -> Column:
    """Comparable rank of a value of an ordered predicate: versions by their numbers, open before done."""
    task = F.when(value == "done", F.array(version_part(F.lit("1")))).when(value == "open", F.array(version_part(F.lit("0"))))
    return F.when(ordered == "semver", semver(value)).when(ordered == "task", task)


def group_by_slot(claims: DataFrame) -> DataFrame:
    """(slot_id, n_claims, first_at, last_at); claims without a slot are dropped."""
    return claims.where("slot_id is not null").groupBy("slot_id").agg(F.count("*").alias("n_claims"), F.min("asserted_at").alias("first_at"), F.max("asserted_at").alias("last_at"))


def active_claims(claims: DataFrame, supersedes: DataFrame) -> DataFrame:
    """Claims that nothing supersedes, wherever the superseding claim is.

    A column predicate of the pairs is that of the superseded claim; a filter on it then leaves the pairs of other predicates unread.
    """
    gone = supersedes.withColumnRenamed("superseded", "assertion_id")
    keys = [c for c in ("assertion_id", "predicate") if c in gone.columns]
    return claims.join(gone.select(*keys), keys, "left_anti").select(*claims.columns)


def active_values(active: DataFrame) -> DataFrame:
    """(subject_id, predicate, n, values): distinct active values of every subject, sorted."""
    return active.groupBy("subject_id", "predicate").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("value")), "|").alias("values"))


def _disagreeing(active: DataFrame) -> DataFrame:
    return active.groupBy("slot_id", "subject_id", "predicate").agg(F.count("*").alias("n_active"), F.countDistinct(canonical(F.col("value"))).alias("n_values")).where("n_active >= 2 and n_values >= 2")


def contradictions(active: DataFrame, registry: DataFrame) -> DataFrame:
    """(slot_id, subject_id, predicate, n_active): slots of a typed, unordered, single-valued predicate whose active values disagree."""
    hard = registry.where("typed and ordered is null and not multivalued").select("predicate")
    return _disagreeing(active).join(F.broadcast(hard), "predicate", "left_semi").select("slot_id", "subject_id", "predicate", "n_active")


def soft_conflicts(active: DataFrame, registry: DataFrame) -> DataFrame:
    """As contradictions(), for predicates that no type is known of."""
    return _disagreeing(active).join(F.broadcast(registry.where("typed").select("predicate")), "predicate", "left_anti").select("slot_id", "subject_id", "predicate", "n_active")


def untyped_predicates(active: DataFrame, registry: DataFrame) -> DataFrame:
    rows = active.join(F.broadcast(registry.where("typed").select("predicate")), "predicate", "left_anti")
    return rows.select("predicate", "slot_id").distinct().groupBy("predicate").agg(F.count("*").alias("n_slots"))


def auto_supersede(old: DataFrame, new: DataFrame, registry: DataFrame) -> DataFrame:
    """(superseder, superseded) between new claims and the active ones of their slots, for ordered predicates.

    The higher rank supersedes; a new claim below an old one is born superseded; equal ranks give no pair.
    """
    order = F.broadcast(registry.where("ordered is not null").select("predicate", "ordered"))
    o = old.join(order, "predicate").select("slot_id", F.col("assertion_id").alias("old_id"), rank(F.col("ordered"), F.col("value")).alias("old_rank"))
    n = new.join(order, "predicate").select("slot_id", F.col("assertion_id").alias("new_id"), rank(F.col("ordered"), F.col("value")).alias("new_rank"))
    both = n.join(o, "slot_id").where("new_id <> old_id and new_rank <> old_rank")
    wins = F.col("new_rank") > F.col("old_rank")
    return both.select(F.when(wins, F.col("new_id")).otherwise(F.col("old_id")).alias("superseder"), F.when(wins, F.col("old_id")).otherwise(F.col("new_id")).alias("superseded")).distinct()


def explicit_supersede(requests: DataFrame, claims: DataFrame) -> DataFrame:
    """(assertion_id, token, superseded): a token names a claim of the slot by id, or else by its value; requests (assertion_id, slot_id, token)."""
    by_id = requests.join(claims.select(F.col("assertion_id").alias("token"), "slot_id", F.col("assertion_id").alias("hit")), ["token", "slot_id"], "left")
    values = claims.select("slot_id", canonical(F.col("value")).alias("c"), F.col("assertion_id").alias("by_value"))
    rest = by_id.where("hit is null").drop("hit").withColumn("c", canonical(F.col("token"))).join(values, ["slot_id", "c"]).select("assertion_id", "token", F.col("by_value").alias("superseded"))
    return by_id.where("hit is not null").select("assertion_id", "token", F.col("hit").alias("superseded")).unionByName(rest).where("assertion_id <> superseded").distinct()


def record_contradicts(new: DataFrame, active: DataFrame, born_superseded: DataFrame) -> DataFrame:
    """(source_id, target_id): a new claim contradicts the active claims of its slot with another value, unless it is born superseded."""
    alive = new.join(born_superseded.select(F.col("superseded").alias("assertion_id")), "assertion_id", "left_anti")
    a = active.select("slot_id", F.col("assertion_id").alias("target_id"), canonical(F.col("value")).alias("old"))
    return alive.select("slot_id", F.col("assertion_id").alias("source_id"), canonical(F.col("value")).alias("said")).join(a, "slot_id").where("said <> old and source_id <> target_id").select("source_id", "target_id").distinct()


def alias_index(entities: DataFrame) -> DataFrame:
    """(name, id): keys, names and aliases, lower-cased; an ambiguous name goes to the smallest id."""
    names = F.array_distinct(F.filter(F.transform(F.array("key", "name", F.replace("name", F.lit("#"), F.lit(""))), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "")))
    return entities.select("id", F.explode(names).alias("name")).groupBy("name").agg(F.min("id").alias("id"))


def resolve_subjects(subjects: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(subject, outcome, id): exact id, else a unique prefix of 6 or more hex characters, else an alias, else an error or a minted term.

    A prefix is looked up by its first six characters, which is an equi-join whatever its length.
    """
    ensure_checkpoint_dir(subjects.sparkSession)
    s = subjects.select("subject").distinct().checkpoint()  # read for the nodes that it may name, exactly or by a prefix
    ids = nodes.select("id")
    known = maybe_among(ids, "id", s.select(F.col("subject").alias("id"))).distinct()
    exact = s.join(known, s["subject"] == known["id"]).select("subject", F.lit("id").alias("outcome"), F.col("subject").alias("id")).checkpoint()
    rest = s.join(exact.select("subject"), "subject", "left_anti").checkpoint()
    shaped = F.col("subject").rlike("^[0-9a-fA-F][0-9a-fA-F-]{5,35}$")
    asked = rest.where(shaped).withColumn("six", F.substring(F.lower("subject"), 1, 6))
    begun = maybe_among(ids.withColumn("six", F.substring("id", 1, 6)), "six", asked.select(F.col("six").alias("id")))
    p = asked.join(begun, "six").where(F.col("id").startswith(F.lower("subject")))
    prefix = p.groupBy("subject").agg(F.count("*").alias("n"), F.min("id").alias("id")).select("subject", F.when(F.col("n") == 1, "prefix").otherwise("ambiguous").alias("outcome"), F.when(F.col("n") == 1, F.col("id")).alias("id"))
    left = rest.join(prefix.select("subject"), "subject", "left_anti").withColumn("name", F.lower(F.trim("subject"))).join(aliases, "name", "left")
    full = F.length("subject") == 36
    outcome = F.when(F.col("id").isNotNull(), "alias").when(shaped & ~full, "unresolved").otherwise("minted")
    last = left.select("subject", outcome.alias("outcome"), F.when(F.col("id").isNotNull(), F.col("id")).when(outcome == "minted", stable_id("Entity", term_slug(F.col("subject")))).alias("id"))
    return exact.unionByName(prefix).unionByName(last)


def task_states(active: DataFrame) -> DataFrame:
    """(subject_id, state): the earliest active task_state of each subject."""
    return active.where("predicate = 'task_state'").groupBy("subject_id").agg(F.min_by("value", F.struct("asserted_at", "assertion_id")).alias("state"))


def last_touch(claims: DataFrame) -> DataFrame:
    """(subject_id, last_touch): newest time of any task_state claim, superseded ones included."""
    return claims.where("predicate = 'task_state'").groupBy("subject_id").agg(F.max("asserted_at").alias("last_touch"))


def oracle_refresh(observed: DataFrame, active: DataFrame) -> DataFrame:
    """(subject_id, outcome): observed versions against active ones: first_seen, unchanged, bumped, or skipped if older or unreadable."""
    best = active.where("predicate = 'version'").groupBy("subject_id").agg(F.max(semver(F.col("value"))).alias("known"))
    seen = observed.select("subject_id", semver(F.col("value")).alias("seen")).join(best, "subject_id", "left")
    outcome = F.when(F.col("seen").isNull(), "skipped").when(F.col("known").isNull(), "first_seen").when(F.col("seen") == F.col("known"), "unchanged").when(F.col("seen") > F.col("known"), "bumped").otherwise("skipped")
    return seen.select("subject_id", outcome.alias("outcome"))


def link_batch(requests: DataFrame, nodes: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges to add, rejected requests) of (source, relation, target) requests; both ends must resolve to a node, prefixes are fine."""
    ends = requests.select(F.col("source").alias("subject")).unionAll(requests.select("target"))
    found = resolve_subjects(ends, nodes, aliases).where("outcome in ('id', 'prefix', 'alias')")
    rows = requests.join(found.select(F.col("subject").alias("source"), F.col("id").alias("source_id")), "source", "left").join(found.select(F.col("subject").alias("target"), F.col("id").alias("target_id")), "target", "left")
    good = rows.where("source_id is not null and target_id is not null").select("source_id", F.col("relation").alias("relation_type"), "target_id").distinct()
    return good, rows.where("source_id is null or target_id is null").select("source", "relation", "target")


def unlink_batch(edges: DataFrame, triples: DataFrame) -> DataFrame:
    """edges without these triples; a triple that is not there does no harm."""
    return edges.join(triples.select("source_id", "relation_type", "target_id").distinct(), ["source_id", "relation_type", "target_id"], "left_anti").select(*edges.columns)


def latest_by(rows: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """The row of each key that comes last in an order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in columns))


def top_rows(rows: DataFrame, partition: list[str], order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """The first n rows of each partition, with their rank from 1."""
    return rows.withColumn(rank_col, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col(rank_col) <= n)


def rejected_requests(requests: DataFrame, found: DataFrame) -> DataFrame:
    """(n, subject, predicate, value, outcome) of requests whose subject is not among what resolve_subjects() found an id for."""
    return requests.join(found.where("id is null").select("subject", "outcome"), "subject").select("n", "subject", "predicate", "value", "outcome")


def write_batch(requests: DataFrame, nodes: DataFrame, aliases: DataFrame, claims: DataFrame, supersedes: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims that are new, rejected requests) of a batch of asserted values, in one pass over the slots that it meets.

    requests: (n: the order of the batch, subject, predicate, value, actor, asserted_at, supersede: array of ids or values).
    A subject that is ambiguous, or shaped like an id that leads nowhere, is rejected; a new name becomes a term.  A claim
    that there is already, or that the batch repeats, adds nothing, so the same batch again gives no rows.

    New claims: (assertion_id, slot_id, subject_id, predicate, value, actor, asserted_at, created_subject, born_superseded, superseder,
    n_conflicts, contradicts, soft_conflict).  Claims of a slot are compared with the active ones before the batch and with
    those that come earlier in the batch: born_superseded if one of them has a higher rank; superseder is a claim that
    supersedes this one in the end, by rank or because a later request names it.  Conflicts are those of the slot after
    the batch, counted against the claims before: n_conflicts with another value, and contradicts the first of them, where the
    predicate is typed, unordered and single-valued; soft_conflict instead where no type is known of it.  No pairs of claims
    are made: each comparison is a running value over the slot in order.
    """
    ensure_checkpoint_dir(requests.sparkSession)
    found = resolve_subjects(requests, nodes, aliases).checkpoint()
    good = found.where("id is not null").select("subject", F.col("id").alias("subject_id"), (F.col("outcome") == "minted").alias("created_subject"))
    rejected = rejected_requests(requests, found)
    c = F.col
    new = requests.join(good, "subject").select(
        "n", "subject_id", "predicate", "value", "actor", "asserted_at", "supersede", "created_subject",
        stable_id(c("subject_id"), c("predicate"), c("value"), c("actor")).alias("assertion_id"),
        stable_id(c("subject_id"), c("predicate")).alias("slot_id"),
    )
    new = new.groupBy("assertion_id").agg(F.min_by(F.struct(*(x for x in new.columns if x != "assertion_id")), "n").alias("r")).select("assertion_id", "r.*")
    new = new.checkpoint()
    there = maybe_among(claims.select("assertion_id"), "assertion_id", new.select(F.col("assertion_id").alias("id")))
    new = new.join(there, "assertion_id", "left_anti").checkpoint()
    slots = new.select(F.col("slot_id").alias("id")).distinct()
    old = active_claims(maybe_among(claims, "slot_id", slots).join(slots.withColumnRenamed("id", "slot_id"), "slot_id").select(*claims.columns), supersedes)
    none = F.lit(None)
    old = old.select("assertion_id", F.lit(-1).cast("long").alias("n"), "subject_id", "predicate", "value", "actor", "asserted_at", none.cast("array<string>").alias("supersede"), none.cast("boolean").alias("created_subject"), "slot_id")
    rows = new.select(*old.columns).unionByName(old).join(F.broadcast(registry), "predicate", "left")
    rows = rows.withColumns({"rank": rank(c("ordered"), c("value")), "canon": canonical(c("value"))}).checkpoint()
    # What requests name themselves: an id of the slot, else a value of it, of a claim that was there before.
    named = rows.where("supersede is not null").select("slot_id", F.col("n").alias("by_n"), F.col("assertion_id").alias("by"), F.explode("supersede").alias("token"))
    ids = named.join(rows.select("slot_id", F.col("assertion_id").alias("token"), F.col("assertion_id").alias("hit"), "n"), ["slot_id", "token"], "left")
    values = ids.where("hit is null").drop("hit", "n").withColumn("canon", canonical(c("token"))).join(rows.select("slot_id", "canon", F.col("assertion_id").alias("hit"), "n"), ["slot_id", "canon"])
    told = ids.where("hit is not null").select("hit", "by", "by_n", "n").unionByName(values.select("hit", "by", "by_n", "n")).where("n < by_n").groupBy(F.col("hit").alias("assertion_id")).agg(F.min_by("by", F.struct("by_n", "by")).alias("told"))
    rows = rows.join(told, "assertion_id", "left")
    # By rank: the highest before, and the first claim of the next higher rank.
    order = [c("n"), c("assertion_id")]
    before = Window.partitionBy("slot_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.where("rank is not null").groupBy("slot_id", "rank").agg(F.min_by("assertion_id", F.struct("n", "assertion_id")).alias("head"))
    heads = heads.select("slot_id", "rank", F.lead("head").over(Window.partitionBy("slot_id").orderBy("rank")).alias("higher"))
    rows = rows.withColumn("highest", F.max("rank").over(before)).join(heads, ["slot_id", "rank"], "left")
    rows = rows.withColumn("superseder", F.coalesce("higher", "told")).withColumn("born_superseded", F.coalesce(c("highest") > c("rank"), F.lit(False)))
    # Conflicts among the claims that are left.
    left = rows.where("superseder is null and (ordered is null) and not coalesce(multivalued, false)")
    same = Window.partitionBy("slot_id", "canon").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = left.withColumns({"others": F.count("*").over(before) - F.count("*").over(same), "head": F.first("assertion_id").over(before), "head_canon": F.first("canon").over(before)})
    left = left.withColumn("second", F.first(F.when(c("canon") != c("head_canon"), c("assertion_id")), ignorenulls=True).over(before))
    typed = F.coalesce("typed", F.lit(False))
    conflicts = left.where("others > 0").select(
        "assertion_id",
        F.when(typed, c("others")).otherwise(0).alias("n_conflicts"),
        F.when(typed, F.when(c("head_canon") != c("canon"), c("head")).otherwise(c("second"))).alias("contradicts"),
        (~typed).alias("soft_conflict"),
    )
    out = rows.where("n >= 0").join(conflicts, "assertion_id", "left").select(
        "assertion_id", "slot_id", "subject_id", "predicate", "value", "actor", "asserted_at", "created_subject", "born_superseded", "superseder",
        F.coalesce("n_conflicts", F.lit(0)).cast("long").alias("n_conflicts"), "contradicts", F.coalesce("soft_conflict", F.lit(False)).alias("soft_conflict"),
    )
    return out, rejected
