"""Registered queries: streaming forms of the log and the fact layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.bind import Bound
from weftgraph.functions.text import semver
from weftgraph.model import stable_id
from weftgraph.plans.base import query
from weftgraph.plans.log import _TOUCH, ledger, touches
from weftgraph.plans.scans import _STATE, _SUMMARY, source_ops
from weftgraph.streaming import log, runs


class Streamed(Bound):
    """The graph with tables that are read as streams."""

    def table(self, name: str) -> DataFrame:
        schema = super().table(name).schema  # a pattern, as the stream's source takes a plain path for a folder
        return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{name}.parque[t]")

    def part(self, name: str) -> DataFrame:
        return self._sql(name)


def streamed(g: Bound) -> Streamed:
    return Streamed(g.spark, g.sf_dir)


@query(_TOUCH + " SELECT CAST(floor(ts / 86400) * 86400 AS BIGINT) AS slot, ref, count(*) AS touches FROM touches GROUP BY 1, 2")
def stream_touch_counts(g: Bound) -> DataFrame:
    counts = log.touch_counts(touches(streamed(g)))
    return runs.latest(runs.settle(counts, "update", runs.place(counts)), ["slot", "ref"])


@query("SELECT DISTINCT verb, subject, object, ts FROM journal")
def stream_dedup(g: Bound) -> DataFrame:
    """Every seventh operation is delivered twice."""
    ops = streamed(g).journal
    once = log.dedup(ops.unionByName(ops.where("seq % 7 = 0")), ["verb", "subject", "object", "ts"])
    return runs.settle(once, "append", runs.place(once)).drop("batch")


@query(_STATE + " SELECT key, content FROM latest")
def stream_latest_state(g: Bound) -> DataFrame:
    last = log.last_state(source_ops(streamed(g)))
    return runs.latest(runs.settle(last, "update", runs.place(last)), ["key"]).where("op = 'source'").select("key", "content")


@query("""v AS (SELECT assertion_id, slot_id, value, string_split(value,'.')::INT[] AS r FROM claims WHERE predicate = 'version')
SELECT assertion_id, slot_id, value FROM v JOIN (SELECT slot_id, max(r) AS best FROM v GROUP BY slot_id) USING (slot_id) WHERE r = best""")
def stream_active_claims(g: Bound) -> DataFrame:
    """Version claims as suppliers arrive."""
    part = lambda m: F.concat(F.lit("1."), F.col("s_nationkey"), F.lit("."), F.col("s_suppkey") % m)
    supplier = stable_id("Supplier", F.col("s_suppkey"))
    said = streamed(g).table("supplier").select(stable_id(F.concat(supplier, F.lit("version"))).alias("slot_id"), F.explode(F.array(part(7), part(5))).alias("value"))
    best = log.best_versions(said)
    kept = runs.latest(runs.settle(best, "update", runs.place(best)), ["slot_id"])
    claims = g.claims.where("predicate = 'version'").select("assertion_id", "slot_id", "value")
    return claims.join(kept, "slot_id").where(semver(F.col("value")) == F.col("best")).select("assertion_id", "slot_id", "value")


@query(f"SELECT seq, verb, ts, {_SUMMARY} AS summary FROM journal")
def stream_feed(g: Bound) -> DataFrame:
    """Read up to the cursor, then once more: nothing comes twice."""
    feed = ledger(streamed(g)).select("seq", "verb", "ts", "summary")
    folder = runs.place(feed)
    runs.settle(feed, "append", folder)
    return runs.settle(feed, "append", folder).drop("batch")
