"""Traversal: balls of k hops, sub-graphs, scored relevance, subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import node_title
from weftgraph.model import HOP_DECAY, SUPERSEDED_FACTOR, edge_weight
from weftgraph.operators.components import ensure_checkpoint_dir


PLACES = 1 << 26  # bits of maybe_among(), in words of 64: at most a million of them, whatever the number of ids


def maybe_among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """rows without most of those whose column is not among ids (id), unshuffled; an exact join follows.

    Every id sets the bit of its hash in a bitmap of a fixed size, which is broadcast.  No row of an id is lost, and with many
    ids more rows of others stay.  As a semi join with a broadcast it is moved below unions, projections and the dealing of
    repeats, to the tables that rows come from.  The exact join is to be an inner join with distinct ids: a semi join would be
    moved below this one.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(PLACES))
    word, bit = (lambda c: F.shiftright(place(c), 6)), (lambda c: (place(c) % 64).cast("int"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit("id"))
    words = ids.groupBy(word("id").alias("_word")).agg(F.bit_or(one).alias("_bits"))
    return rows.join(F.broadcast(words), (word(column) == F.col("_word")) & (F.getbit("_bits", bit(column)) == 1), "left_semi")


FEW = 100_000  # ids that may be broadcast themselves


def narrowed(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """maybe_among() of ids that are stored; ids that are few are sent to the rows themselves, which hashes a row once."""
    if ids.count() > FEW:
        return maybe_among(rows, column, ids)
    return rows.join(F.broadcast(ids.select(F.col("id").alias("_id")).distinct()), F.col(column) == F.col("_id"), "left_semi")


def among(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes whose id is among distinct ids (id); only what may be among them is shuffled."""
    return maybe_among(nodes, "id", ids).join(ids.select("id"), "id").select(*nodes.columns)


def undirected(edges: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """(a, b, relation_type) both ways."""
    e = edges if relations is None else edges.where(F.col("relation_type").isin(*relations))
    return e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "relation_type").unionAll(e.select("target_id", "source_id", "relation_type"))


def k_hop(seeds: DataFrame, edges: DataFrame, hops: int, relations: list[str] | None = None) -> DataFrame:
    """(seed_id, id, hop, relation): nodes within some hops of each seed, by the highest edge weight that discovers them.

    The number of hops is a small constant; a frontier that a hub makes large is cut from its lineage at every hop.
    """
    ensure_checkpoint_dir(seeds.sparkSession)
    both = undirected(edges, relations)
    known = seeds.select(F.col("id").alias("seed_id"), "id", F.lit(0).alias("hop"), F.lit("").alias("relation")).distinct().checkpoint()
    frontier = known
    for h in range(1, hops + 1):
        reached = frontier.select("seed_id", F.col("id").alias("a")).join(narrowed(both, "a", frontier), "a").select("seed_id", F.col("b").alias("id"), "relation_type")
        best = reached.groupBy("seed_id", "id").agg(F.min_by("relation_type", F.struct(-edge_weight(F.col("relation_type")), F.col("relation_type"))).alias("relation"))
        frontier = best.join(known.select("seed_id", "id"), ["seed_id", "id"], "left_anti").select("seed_id", "id", F.lit(h).alias("hop"), "relation").checkpoint()
        known = known.unionByName(frontier)
    return known


def reach(seeds: DataFrame, edges: DataFrame, hops: int, relations: list[str] | None = None) -> DataFrame:
    """(id, hop): nodes within some hops of any seed and the fewest hops to them.  One frontier for all seeds."""
    ensure_checkpoint_dir(seeds.sparkSession)
    both = undirected(edges, relations).select("a", "b")
    known = seeds.select("id", F.lit(0).alias("hop")).distinct().checkpoint()  # read at every hop and in the result
    frontier = known
    for h in range(1, hops + 1):
        near = frontier.select(F.col("id").alias("a")).join(narrowed(both, "a", frontier), "a").select(F.col("b").alias("id")).distinct()
        frontier = near.join(known.select("id"), "id", "left_anti").select("id", F.lit(h).alias("hop")).checkpoint()
        known = known.unionAll(frontier)
    return known


def subgraph_members(seeds: DataFrame, edges: DataFrame, hops: int, relations: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """(id, expanded): the seeds and what they reach; a cap limits expanded nodes only, nearer ones first, then by id."""
    rows = reach(seeds, edges, hops, relations).select("id", (F.col("hop") > 0).alias("expanded"), "hop")
    if cap is None:
        return rows.select("id", "expanded")
    allowed = rows.where("expanded").orderBy("hop", "id").limit(cap).select("id", "expanded")
    return rows.where("not expanded").select("id", "expanded").unionByName(allowed)


def subgraph_nodes(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, label, title, expanded): members that have a node."""
    return members.join(nodes.select("id", "label", node_title().alias("title")), "id").select("id", "label", "title", "expanded")


def subgraph_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of every relation with both ends among the members."""
    ensure_checkpoint_dir(members.sparkSession)
    m = members.select("id").distinct().checkpoint()  # read for both ends
    inner = maybe_among(maybe_among(edges, "source_id", m), "target_id", m)
    for end in ("source_id", "target_id"):
        inner = inner.join(m.withColumnRenamed("id", end), end)
    return inner.select("source_id", "relation_type", "target_id")


def score_task(seeds: DataFrame, edges: DataFrame, recency: DataFrame | None = None, depth: int = 2) -> DataFrame:
    """(id, score, seed_id, hop, relation): each reached node's best score over the seeds.

    seeds (id, rank from 0).  Seed weight = number of seeds - rank; a seed itself counts 3 at hop 0; others count
    0.5^hop by the weight of the edge that discovers them, by recency, by 0.3 if superseded within the ball.  Equal
    scores keep the earlier seed.
    """
    n = seeds.count()
    ball = k_hop(seeds, edges, depth)
    superseded = edges.where("relation_type = 'SUPERSEDES'").select(F.col("source_id").alias("by"), F.col("target_id").alias("id"))
    within = narrowed(superseded, "by", ball).join(ball.select("seed_id", F.col("id").alias("by")), "by").select("seed_id", "id").distinct().withColumn("old", F.lit(True))
    rows = ball.join(within, ["seed_id", "id"], "left").join(F.broadcast(seeds.select(F.col("id").alias("seed_id"), "rank")), "seed_id")
    if recency is not None:
        rows = rows.join(recency.select("id", "factor"), "id", "left")
    factor = F.coalesce("factor", F.lit(1.0)) if recency is not None else F.lit(1.0)
    weight = F.when(F.col("hop") == 0, 3.0).otherwise(edge_weight(F.col("relation")))
    score = (n - F.col("rank")) * F.pow(F.lit(HOP_DECAY), F.col("hop")) * weight * factor * F.when(F.col("old"), SUPERSEDED_FACTOR).otherwise(1.0)
    best = rows.withColumn("score", score).groupBy("id").agg(F.min_by(F.struct("score", "seed_id", "hop", "relation"), F.struct(-F.col("score"), F.col("rank"))).alias("w"))
    return best.select("id", "w.score", "w.seed_id", "w.hop", "w.relation")


def relevant(scored: DataFrame, nodes: DataFrame, k: int = 12) -> DataFrame:
    """(id, label, title, score, seed_id): the best k, titled after the cut."""
    ensure_checkpoint_dir(scored.sparkSession)
    top = scored.select("id", F.round("score", 3).alias("score"), "seed_id").orderBy(F.desc("score"), "id").limit(k).checkpoint()
    named = narrowed(nodes, "id", top).select("id", "label", node_title().alias("title"))  # only the k nodes are dealt and titled
    return top.join(named, "id", "left").select("id", "label", F.coalesce("title", "id").alias("title"), "score", "seed_id")


def facets(scored: DataFrame, nodes: DataFrame) -> DataFrame:
    """(axis, value, n): counts of everything reached, by kind and by winning seed."""
    kinds = scored.join(nodes.select("id", "label"), "id").groupBy(F.col("label").alias("value")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("axis"), "value", "n")
    return kinds.unionAll(scored.groupBy(F.col("seed_id").alias("value")).agg(F.count("*").alias("n")).select(F.lit("seed"), "value", "n"))


def descendants(roots: DataFrame, edges: DataFrame, relation: str) -> DataFrame:
    """(id): the roots and everything below them along one relation, however deep; a round of joins for each level."""
    ensure_checkpoint_dir(roots.sparkSession)
    down = edges.where(F.col("relation_type") == relation).select("source_id", "target_id").checkpoint()  # read at every level
    known = roots.select("id").distinct().checkpoint()
    frontier, levels = known, 0
    while not frontier.isEmpty():
        frontier = frontier.join(down, frontier["id"] == down["source_id"]).select(F.col("target_id").alias("id")).distinct().join(known, "id", "left_anti").checkpoint()
        known, levels = known.unionAll(frontier), levels + 1
        if levels % 16 == 0:
            known = known.checkpoint()  # a plan of a few unions, whatever the depth
    return known


def delete_subtree(gone: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without a set of ids and all edges at them."""
    g = gone.select("id").distinct()
    left = edges.join(g.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(g.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes.join(g, "id", "left_anti"), left.select(*edges.columns)


def reconstruct_text(sections: DataFrame, separator: str = "") -> DataFrame:
    """(note_id, text, n): raws of a note joined in their order."""
    return sections.groupBy("note_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "raw"))), lambda x: x["raw"]), separator).alias("text"), F.count("*").alias("n"))


def running_rank(rows: DataFrame, partition: list[str], order: list) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


AXES = {"seed": "seed_id", "kind": "label"}  # in the order in which a cluster is broken down


def explore(scored: DataFrame, nodes: DataFrame, filters: list[tuple[str, str]], budget: int = 15) -> DataFrame:
    """(part, value, score, n, total, complete): the best `budget` members of what passes all filters (axis, value), best first;
    if there are more, also how they break down on the first axis that no filter uses.

    part is 'member' (value: the node) or the axis of a sub-facet (value: what to filter it by next, n: its members; its handle is
    the filters and this pair).  What passes is written once, then the members are taken from it by a distributed top-k, and
    the sub-facets and the total by one aggregation.
    """
    unknown = {a for a, _ in filters} - set(AXES)
    if unknown:
        raise ValueError(f"no such axis: {', '.join(sorted(unknown))}")
    ensure_checkpoint_dir(scored.sparkSession)
    rows = scored.join(nodes.select("id", "label"), "id")
    for axis, value in filters:
        rows = rows.where(F.col(AXES[axis]) == value)
    rows = rows.select("id", "score", *AXES.values()).checkpoint()
    axis = next((a for a in AXES if a not in {f for f, _ in filters}), None)
    by = rows.groupBy((F.col(AXES[axis]) if axis else F.lit(None).cast("string")).alias("value")).agg(F.count("*").alias("n"))
    total = F.broadcast(by.agg(F.sum("n").alias("total")).withColumn("complete", F.col("total") <= budget))  # one row
    best = rows.orderBy(F.desc("score"), "id").limit(budget)
    members = best.select(F.lit("member").alias("part"), F.col("id").alias("value"), F.round("score", 3).alias("score"), F.lit(None).cast("long").alias("n")).join(total)
    if axis is None:
        return members
    facets = by.select(F.lit(axis).alias("part"), "value", F.lit(None).cast("double").alias("score"), "n").join(total).where("not complete")
    return members.unionByName(facets)
