"""The frontier of gated work items: ready, blocked, done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.components import ensure_checkpoint_dir
from weftgraph.operators.facts import top_rows


def gate_edges(edges: DataFrame) -> DataFrame:
    """(item_id, gate_id): both kinds of gates, each once."""
    return edges.where(F.col("relation_type").isin("GATED_BY", "BLOCKED_BY")).select(F.col("source_id").alias("item_id"), F.col("target_id").alias("gate_id")).distinct()


def checks_of(edges: DataFrame) -> DataFrame:
    """(check_id, item_id); repeats stay."""
    return edges.where("relation_type = 'CHECKS'").select(F.col("source_id").alias("check_id"), F.col("target_id").alias("item_id"))


def work_items(states: DataFrame, checks: DataFrame) -> DataFrame:
    """(item_id, state): subjects with a state that are not checks."""
    return states.select(F.col("subject_id").alias("item_id"), "state").join(checks.select(F.col("check_id").alias("item_id")), "item_id", "left_anti")


def unmet_gates(states: DataFrame, gates: DataFrame, checks: DataFrame) -> DataFrame:
    """(item_id, gate_id) of open items: a gate is met by a done item or check; a gate without a state is unmet."""
    open_items = work_items(states, checks).where("state <> 'done'").select("item_id")
    done = states.where("state = 'done'").select(F.col("subject_id").alias("gate_id"))
    return gates.join(open_items, "item_id", "left_semi").join(done, "gate_id", "left_anti").select("item_id", "gate_id")


def classify(states: DataFrame, gates: DataFrame, checks: DataFrame) -> DataFrame:
    """(item_id, bucket, n_gates, n_unmet): done whatever the gates; ready if no gate is unmet; blocked otherwise.

    Gates are joined once: each row knows whether its gate is done, and one aggregation by item counts both.
    """
    items = work_items(states, checks)
    done = states.where("state = 'done'").select(F.col("subject_id").alias("gate_id"), F.lit(1).alias("met"))
    counted = gates.join(done, "gate_id", "left").groupBy("item_id").agg(F.count("*").alias("n_gates"), F.count_if(F.col("met").isNull()).alias("n_unmet"))
    rows = items.join(counted, "item_id", "left").withColumn("n_gates", F.coalesce("n_gates", F.lit(0)))
    unmet = F.when(F.col("state") == "done", F.lit(0)).otherwise(F.coalesce("n_unmet", F.lit(0)))
    return rows.select("item_id", F.when(F.col("state") == "done", "done").when(unmet > 0, "blocked").otherwise("ready").alias("bucket"), F.col("n_gates").cast("long").alias("n_gates"), unmet.cast("long").alias("n_unmet"))


def dod_summary(checks: DataFrame, states: DataFrame) -> DataFrame:
    """(item_id, total, done, open): checks of each item; a check without a state is open."""
    checks = checks.repartition("check_id").distinct()  # dealt once, for the repeats and for the join
    s = states.select(F.col("subject_id").alias("check_id"), (F.col("state") == "done").alias("ok"))
    return checks.join(s, "check_id", "left").groupBy("item_id").agg(F.count("*").alias("total"), F.count_if(F.coalesce("ok", F.lit(False))).alias("done"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("open"))


def closable(buckets: DataFrame, dod: DataFrame) -> DataFrame:
    """Open items all of whose checks are done."""
    return buckets.where("bucket <> 'done'").join(dod.where("open = 0 and total > 0"), "item_id").select("item_id", "bucket", "total")


def dod_drift(buckets: DataFrame, dod: DataFrame) -> DataFrame:
    """Done items with open checks."""
    return buckets.where("bucket = 'done'").join(dod.where("open > 0"), "item_id").select("item_id", "open", "total")


def filed_under(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(item_id, anchor_id): the smallest anchor that anything is PART_OF, work item or not; enough where items are joined to it."""
    filed = edges.where("relation_type = 'PART_OF'").select(F.col("source_id").alias("item_id"), F.col("target_id").alias("anchor_id")).join(anchors, "anchor_id", "left_semi")
    return filed.groupBy("item_id").agg(F.min("anchor_id").alias("anchor_id"))


def program_of(buckets: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(item_id, anchor_id): the item's anchor by PART_OF, the smallest if it has several."""
    return filed_under(edges, anchors).join(buckets.select("item_id"), "item_id", "left_semi")


def counts(buckets: DataFrame, filed: DataFrame) -> DataFrame:
    """(bucket, n, unfiled): true totals before any paging."""
    rows = buckets.join(filed, "item_id", "left")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if((F.col("bucket") != "done") & F.col("anchor_id").isNull()).alias("unfiled"))


def page(buckets: DataFrame, touch: DataFrame, bucket: str = "ready", limit: int = 15, offset: int = 0) -> DataFrame:
    """A page of one bucket: ready items by last touch, newest first; other buckets by id."""
    rows = buckets.where(F.col("bucket") == bucket).join(touch.select(F.col("subject_id").alias("item_id"), "last_touch"), "item_id", "left")
    order = [F.desc_nulls_last("last_touch"), F.asc("item_id")] if bucket == "ready" else [F.asc("item_id")]
    return rows.orderBy(*order).offset(offset).limit(limit).select("item_id", "bucket", "last_touch")


def frontier_by_program(buckets: DataFrame, filed: DataFrame, touch: DataFrame, awaiting: DataFrame, top: int = 5) -> DataFrame:
    """(program, rank, item_id, awaiting): the newest ready items of each anchor, unfiled ones as '(unfiled)'."""
    rows = buckets.where("bucket = 'ready'").join(filed, "item_id", "left").join(touch.select(F.col("subject_id").alias("item_id"), "last_touch"), "item_id", "left")
    rows = rows.withColumn("program", F.coalesce("anchor_id", F.lit("(unfiled)")))
    best = top_rows(rows, ["program"], [F.desc_nulls_last("last_touch"), F.asc("item_id")], top)
    return best.join(awaiting.select(F.col("subject_id").alias("item_id"), F.lit(True).alias("awaiting")).distinct(), "item_id", "left").select("program", "rank", "item_id", F.coalesce("awaiting", F.lit(False)).alias("awaiting"))


def gate_dag(buckets: DataFrame, gates: DataFrame) -> DataFrame:
    """(kind, a, b): the nodes of open items by bucket, 'prereq' nodes of gates that are no open item, and the gate edges."""
    shown = buckets.where("bucket <> 'done'")
    edges = gates.join(shown.select("item_id"), "item_id", "left_semi")
    nodes = shown.select(F.col("item_id").alias("id"), F.col("bucket").alias("kind"), F.lit(0).alias("rank")).unionAll(edges.select("gate_id", F.lit("prereq"), F.lit(1)))
    best = nodes.groupBy("id").agg(F.min_by("kind", "rank").alias("kind"))
    return best.select("kind", F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).unionAll(edges.select(F.lit("gate"), "item_id", "gate_id"))


def transitive_blockers(unmet: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(item_id, blocker_id): every open item that an item waits for, directly or through others.

    A round knows all pairs by fewer than 2^k steps and those by exactly 2^k; going on from the second by the first finds
    every pair of a chain once, not once for each item between.  The rounds are the logarithm of the longest chain, and
    most_rounds is out of reach; they run on numbers of the items, which stand for the ids until the end.  The closure
    itself has a row for every pair: a chain of n items gives n * n / 2 of them.
    """
    ensure_checkpoint_dir(unmet.sparkSession)
    unmet = unmet.select("item_id", "gate_id").checkpoint()
    number = unmet.select(F.col("item_id").alias("id")).unionAll(unmet.select("gate_id")).distinct().select("id", F.monotonically_increasing_id().alias("n")).checkpoint()  # the numbers hold from here on
    item, gate = (number.select(F.col("id").alias(f"{k}_id"), F.col("n").alias(k)) for k in ("item", "gate"))
    exact = unmet.join(item, "item_id").join(gate, unmet["gate_id"].eqNullSafe(gate["gate_id"])).select("item", "gate").distinct().checkpoint()
    closure, n = exact, exact.count()
    for _ in range(most_rounds):
        far = exact.select(F.col("gate").alias("mid"), "item").join(exact.select(F.col("item").alias("mid"), "gate"), "mid").select("item", "gate").distinct().checkpoint()
        if far.isEmpty():
            break
        on = far.select("item", F.col("gate").alias("mid")).join(closure.select(F.col("item").alias("mid"), "gate"), "mid").select("item", "gate")
        closure, exact = closure.unionAll(far).unionAll(on).distinct().checkpoint(), far
        now = closure.count()
        if now == n:
            break
        n = now
    blocker = gate.select("gate", F.col("gate_id").alias("blocker_id"))
    return closure.join(item, "item").join(blocker, "gate").select("item_id", "blocker_id")
