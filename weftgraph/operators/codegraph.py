"""Audits of a graph of containers (modules in repositories) and members that call each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import member_flags, name_tokens
from weftgraph.operators.components import connected_components, ensure_checkpoint_dir


def members_of(nodes: DataFrame) -> DataFrame:
    """(id, name, qualname, module_id, repo_key, module_path, cell_key, symbol_kind, description, is_top, is_public, is_dunder)."""
    modules = nodes.where("label = 'CodeModule'").select(F.col("id").alias("module_id"), "repo_key", "module_path")
    symbols = nodes.where("label = 'CodeSymbol'").select("id", "name", "qualname", "module_id", "cell_key", "symbol_kind", "description")
    flags = member_flags(F.col("qualname"))
    return symbols.join(modules, "module_id", "left").withColumns(flags)


def public_top(members: DataFrame) -> DataFrame:
    return members.where("is_top and is_public and not is_dunder")


def without_incoming(members: DataFrame, edges: DataFrame, relation: str) -> DataFrame:
    """Members that no edge of a relation points to."""
    targets = edges.where(F.col("relation_type") == relation).select(F.col("target_id").alias("id"))
    return members.join(targets, "id", "left_anti")


def no_docstring(members: DataFrame) -> DataFrame:
    return public_top(members).where(F.coalesce(F.trim("description"), F.lit("")) == "")


def non_granular(members: DataFrame) -> DataFrame:
    """(module_id, cell_key, n): cells with more than one public member."""
    return public_top(members).groupBy("module_id", "cell_key").agg(F.count("*").alias("n")).where("n > 1")


ENDS = ("caller", "callee")


def _public() -> Column:
    return F.col("is_top") & F.col("is_public") & ~F.col("is_dunder")


def calls(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(caller, callee) of calls between known members, and of both ends _module, _repo, _cell and _public: whether it is public_top()."""
    e = edges.where(F.col("relation_type").isin("CALLS", "USES")).select(F.col("source_id").alias("caller"), F.col("target_id").alias("callee")).distinct()
    return _with_ends(e, members, "inner")


def _with_ends(call: DataFrame, members: DataFrame, how: str) -> DataFrame:
    for end in ENDS:
        e = members.select(F.col("id").alias(end), F.col("module_id").alias(f"{end}_module"), F.col("repo_key").alias(f"{end}_repo"), F.col("cell_key").alias(f"{end}_cell"), _public().alias(f"{end}_public"))
        call = call.join(e, end, how)
    return call


def relocation(members: DataFrame, call: DataFrame) -> DataFrame:
    """(id, caller_repo, n, home): top-level members all of whose callers are in other repositories, with callers by repository."""
    top = members.where("is_top and not is_dunder and coalesce(repo_key, '') <> ''").select(F.col("id").alias("callee"), F.col("repo_key").alias("home"))
    rows = call.join(top, "callee")
    away = rows.groupBy("callee").agg(F.bool_and(F.col("caller_repo") != F.col("home")).alias("away")).where("away").select("callee")
    return rows.join(away, "callee", "left_semi").groupBy(F.col("callee").alias("id"), "home", "caller_repo").agg(F.count("*").alias("n"))


def relocation_cycle(moves: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """moves plus cycle: whether the home repository imports the caller's."""
    modules = nodes.where("label = 'CodeModule'").select("id", "repo_key")
    lifted = edges.where("relation_type = 'IMPORTS'").join(modules.select(F.col("id").alias("source_id"), F.col("repo_key").alias("home")), "source_id").join(modules.select(F.col("id").alias("target_id"), F.col("repo_key").alias("caller_repo")), "target_id").select("home", "caller_repo", F.lit(True).alias("cycle")).distinct()
    return moves.join(lifted, ["home", "caller_repo"], "left").withColumn("cycle", F.coalesce("cycle", F.lit(False)))


def repo_imports(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, used_by): repositories that import another one."""
    modules = nodes.where("label = 'CodeModule'").select("id", "repo_key")
    rows = edges.where("relation_type = 'IMPORTS'").join(modules.select(F.col("id").alias("source_id"), F.col("repo_key").alias("used_by")), "source_id").join(modules.select(F.col("id").alias("target_id"), F.col("repo_key").alias("repo")), "target_id")
    return rows.where("repo <> used_by").select("repo", "used_by").distinct()


def dead_members(members: DataFrame, edges: DataFrame) -> DataFrame:
    rows = public_top(members).where("symbol_kind in ('function', 'class')").where(~F.col("name").rlike("^(test_|main$)") & ~F.coalesce(F.col("module_path"), F.lit("")).endswith("__init__.py"))
    called = edges.where(F.col("relation_type").isin("CALLS", "USES")).select(F.col("target_id").alias("id"))
    return rows.join(called, "id", "left_anti")


def consolidation(members: DataFrame) -> DataFrame:
    """(name, repos, n): public names defined in two or more repositories."""
    return public_top(members).groupBy("name").agg(F.countDistinct("repo_key").alias("repos"), F.count("*").alias("n")).where("repos >= 2")


def both_ways(call: DataFrame) -> DataFrame:
    """(id, other): callers and callees of a member, without itself."""
    pairs = call.select(F.col("caller").alias("id"), F.col("callee").alias("other")).where("id <> other")
    return pairs.unionAll(pairs.select("other", "id")).distinct()


def near_public(members: DataFrame, call: DataFrame) -> DataFrame:
    """(id, other, module_id, cell_key, other_module, other_public): callers and callees of a public top-level member, without itself; repeats stay.

    calls() tell all of it; only calls that do not are joined with the members here.
    """
    if "caller_public" not in call.columns:
        call = _with_ends(call.select(*ENDS), members.withColumn("repo_key", F.lit(None).cast("string")), "left")
    side = lambda x, y: F.struct(F.col(x).alias("id"), F.col(y).alias("other"), F.col(f"{x}_module").alias("module_id"), F.col(f"{x}_cell").alias("cell_key"), F.col(f"{x}_public").alias("public"), F.col(f"{y}_module").alias("other_module"), F.col(f"{y}_public").alias("other_public"))
    rows = call.where("caller <> callee").select(F.explode(F.array(side(*ENDS), side(*ENDS[::-1]))).alias("e"))  # the calls are read once
    return rows.select("e.*").where("public").drop("public")


def split_cells(members: DataFrame, call: DataFrame) -> DataFrame:
    """(module_id, cell_key, n): cells with two or more public members whose neighbourhoods are pairwise disjoint.

    They are disjoint exactly if no neighbour is shared, which one grouping by (cell, neighbour) shows: it is if its smallest
    and its greatest member there differ.
    """
    cells = public_top(members).groupBy("module_id", "cell_key").agg(F.count("*").alias("n")).where("n >= 2")
    met = near_public(members, call).groupBy("module_id", "cell_key", "other").agg(F.min("id").alias("least"), F.max("id").alias("greatest"))
    return cells.join(met.where("least <> greatest").select("module_id", "cell_key"), ["module_id", "cell_key"], "left_anti")


def coupling_keys(members: DataFrame, call: DataFrame) -> DataFrame:
    """(module_id, id, key): what couples members of a module: a shared neighbour, a shared name token, a direct call.

    Two members are coupled if they share a key; keys stand for pairs, so no pair of members is ever built.
    """
    p = public_top(members).select("module_id", "id", "name")
    near = near_public(members, call)  # calls both ways may repeat a row; the keys are made distinct below
    shared = near.select("module_id", "id", F.concat(F.lit("n:"), "other").alias("key"))
    tokens = p.select("module_id", "id", F.explode(name_tokens(F.col("name"))).alias("t")).select("module_id", "id", F.concat(F.lit("t:"), "t").alias("key"))
    direct = near.where("module_id = other_module and other_public")
    direct = direct.select("module_id", "id", F.concat(F.lit("d:"), F.least("id", "other"), F.lit("|"), F.greatest("id", "other")).alias("key"))
    return shared.unionAll(tokens).unionAll(direct).repartition("module_id", "key").distinct()  # dealt as the keys meet


BLOCK = 8192  # members of a module that meet as many others at once
PAIRS = 1 << 18  # pairs that a task holds before it gives them out


def _batches(module: str, names: pa.Array, found: list) -> pa.RecordBatch:
    a, b = (np.concatenate(side) for side in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(module, pa.string()), len(a)), names.take(pa.array(a)), names.take(pa.array(b))], ["module_id", "a", "b"])


def _block_pairs(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(module_id, a, b) of members that share a key: two blocks of one module, or one block with itself.

    Each member marks those that its keys name, so what is held is the keys of two blocks, one row of marks and some pairs.
    """
    module, lo, hi = (x.as_py() for x in group)
    table = pa.Table.from_batches(list(batches)).select(["id", "block", "keys"]).combine_chunks().sort_by("id")
    names, block = table.column("id").combine_chunks(), table.column("block").to_numpy()
    lists = table.column("keys").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    who = np.repeat(np.arange(len(size)), size)
    _, key = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    if lo == hi:
        asks, order = np.arange(len(size)), np.argsort(key, kind="stable")
    else:
        asks, order = np.flatnonzero(block == lo), np.argsort(key, kind="stable")
        order = order[block[who[order]] == hi]
    members, at = who[order], np.searchsorted(key[order], np.arange(key.max(initial=-1) + 2))
    ends = np.cumsum(size)
    found, held, mark = [], 0, np.zeros(len(size), bool)
    for i in asks.tolist():
        mark[:] = False
        for k in key[ends[i] - size[i] : ends[i]].tolist():
            mark[members[at[k] : at[k + 1]]] = True
        j = np.flatnonzero(mark[i + 1 :]) + (i + 1) if lo == hi else np.flatnonzero(mark)
        if len(j):
            found.append((np.minimum(i, j), np.maximum(i, j)))
            held += len(j)
        if held >= PAIRS:
            yield _batches(module, names, found)
            found, held = [], 0
    if found:
        yield _batches(module, names, found)


def packed_keys(keys: DataFrame) -> DataFrame:
    """(module_id, id, keys) of keys (module_id, id, key): the numbers of the keys that a member shares with another one of its module."""
    by_key = Window.partitionBy("module_id", "key")
    counted = keys.where("module_id is not null").withColumn("at", F.monotonically_increasing_id()).withColumns({"n": F.count("*").over(by_key), "number": F.min("at").over(by_key)})
    ensure_checkpoint_dir(keys.sparkSession)
    shared = counted.where("n > 1").select("module_id", "id", "number").checkpoint()  # the numbers hold from here on
    return shared.groupBy("module_id", "id").agg(F.collect_list("number").alias("keys"))


def met_pairs(packs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(module_id, a, b), a < b: members (module_id, id, keys) that share a key, each pair once.

    A module's members are dealt to blocks of about `size`, and every two blocks meet in one place, where a pair is found once
    however many keys it shares: a member is shuffled once for each block of its module, with its keys, but pairs never are.
    """
    ensure_checkpoint_dir(packs.sparkSession)
    packs = packs.checkpoint()  # read for the sizes too
    blocks = packs.groupBy("module_id").agg(F.ceil(F.count("*") / size).alias("blocks"))
    rows = packs.join(blocks, "module_id").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    met = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    met = met.select("module_id", "id", "keys", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return met.groupBy("module_id", "lo", "hi").applyInArrow(_block_pairs, "module_id string, a string, b string")


def coupling_pairs(keys: DataFrame, size: int = BLOCK) -> DataFrame:
    """(module_id, a, b), a < b: members that share a key (module_id, id, key), each pair once."""
    return met_pairs(packed_keys(keys), size)


def _linked(rows: DataFrame, at: list[str]) -> DataFrame:
    """(id, first): ids that share the columns `at`, linked through the smallest."""
    first = rows.groupBy(*at).agg(F.min("id").alias("first"))
    return rows.join(first, at).where("id <> first").select("id", "first").distinct()


def coupling_components(members: DataFrame, call: DataFrame) -> DataFrame:
    """(module_id, id, component): coupled members of a module; component is the smallest member id.

    Members of one name go as one, and names that share tokens form groups first; only the calls at modules of two or more
    groups can couple any further, so only those are read.
    """
    ensure_checkpoint_dir(members.sparkSession)
    p = public_top(members).select("module_id", "id", "name")
    spoken = p.where(F.size(name_tokens(F.col("name"))) > 0).groupBy("module_id", "name").agg(F.min("id").alias("id")).where("module_id is not null").checkpoint()
    words = spoken.select("module_id", "id", F.explode(name_tokens(F.col("name"))).alias("token"))
    named = connected_components(_linked(words, ["module_id", "token"]), "id", "first").select(F.col("node").alias("id"), F.col("component").alias("joined"))
    groups = spoken.join(named, "id", "left").select("module_id", "name", F.coalesce("joined", "id").alias("named"))
    p = p.join(groups, ["module_id", "name"], "left").select("module_id", "id", F.coalesce("named", "id").alias("group")).checkpoint()
    split = p.groupBy("module_id").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a <> b").select("module_id").checkpoint()
    if split.isEmpty():
        return p.select("module_id", "id", F.col("group").alias("component"))
    open_members = p.join(split, "module_id", "left_semi")
    for end in ("caller", "callee"):
        call = call.join(split.select(F.col("module_id").alias(f"{end}_module"), F.lit(True).alias(f"{end}_open")), f"{end}_module", "left")
    near = both_ways(call.where("caller_open or callee_open"))
    rows = open_members.join(near, "id").select("module_id", F.col("group").alias("id"), "other").distinct().checkpoint()
    other = open_members.select("module_id", F.col("id").alias("other"), F.col("group").alias("first"))
    direct = rows.join(other, ["module_id", "other"]).where("id <> first").select("id", "first")
    found = connected_components(_linked(rows, ["module_id", "other"]).unionAll(direct).distinct(), "id", "first").select(F.col("node").alias("group"), "component")
    return p.join(found, "group", "left").select("module_id", "id", F.coalesce("component", "group").alias("component"))


def under_split(components: DataFrame) -> DataFrame:
    """(module_id, members, components, largest, verdict): modules of four or more members in two or more components; 'damped' if one of them holds more than half."""
    sizes = components.groupBy("module_id", "component").agg(F.count("*").alias("k"))
    rows = sizes.groupBy("module_id").agg(F.sum("k").alias("members"), F.count("*").alias("components"), F.max("k").alias("largest")).where("members >= 4 and components >= 2")
    return rows.withColumn("verdict", F.when(2 * F.col("largest") <= F.col("members"), "under_split").otherwise("damped"))


def module_fanout(call: DataFrame) -> DataFrame:
    """(module_id, fanout): other modules that a module's members use."""
    return call.where("caller_module <> callee_module").select("caller_module", "callee_module").distinct().groupBy(F.col("caller_module").alias("module_id")).agg(F.count("*").alias("fanout"))


def over_split(members: DataFrame, call: DataFrame) -> DataFrame:
    """(id, home, consumer, damped): public members whose users all sit in one other module of their repository; damped if that module uses four or more."""
    p = public_top(members).where(~F.coalesce(F.col("module_path"), F.lit("")).endswith("__init__.py")).select(F.col("id").alias("callee"))
    users = call.join(p, "callee", "left_semi").groupBy("callee", "callee_module", "callee_repo").agg(F.countDistinct("caller_module").alias("n"), F.min("caller_module").alias("consumer"), F.min("caller_repo").alias("repo"))
    rows = users.where("n = 1 and consumer <> callee_module and repo = callee_repo")
    fan = module_fanout(call).withColumnRenamed("module_id", "consumer")
    return rows.join(fan, "consumer", "left").select(F.col("callee").alias("id"), F.col("callee_module").alias("home"), "consumer", (F.coalesce("fanout", F.lit(0)) >= 4).alias("damped"))


def derived_imports(call: DataFrame, override: DataFrame) -> DataFrame:
    """(module_id, target): modules that each module would use if members moved as override (id, new_module) says."""
    rows = call
    for end in ("caller", "callee"):
        rows = rows.join(override.select(F.col("id").alias(end), F.col("new_module").alias(f"{end}_new")), end, "left").withColumn(f"{end}_module", F.coalesce(f"{end}_new", f"{end}_module"))
    return rows.where("caller_module <> callee_module").select(F.col("caller_module").alias("module_id"), F.col("callee_module").alias("target")).distinct()


def api_surface(members: DataFrame, test_prefix: str) -> DataFrame:
    """(repo_key, module_path, members): public top-level members of modules that are no test modules."""
    rows = public_top(members).where(~F.col("module_path").startswith(test_prefix))
    return rows.groupBy("repo_key", "module_path").agg(F.count("*").alias("members"))
