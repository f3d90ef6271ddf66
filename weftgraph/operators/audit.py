"""Reconcilers: they find drift and propose, and never change anything."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import id_tokens
from weftgraph.operators.components import ensure_checkpoint_dir
from weftgraph.operators.facts import top_rows
from weftgraph.operators.traverse import among, maybe_among


def register_rows(members: DataFrame, historic: DataFrame, cached: DataFrame, hubs: DataFrame) -> DataFrame:
    """(value, subject_id, finding): members that a hub does not cache ('missing') and cached subjects that only once were members ('stale').

    members, historic and cached are (value, subject_id), hubs (value).
    """
    m = members.join(hubs, "value", "left_semi")
    missing = m.join(cached, ["value", "subject_id"], "left_anti").distinct().withColumn("finding", F.lit("missing"))
    stale = cached.join(hubs, "value", "left_semi").join(members, ["value", "subject_id"], "left_anti").join(historic, ["value", "subject_id"], "left_semi").distinct().withColumn("finding", F.lit("stale"))
    return missing.unionByName(stale)


def register_drift(members: DataFrame, historic: DataFrame, cached: DataFrame, hubs: DataFrame) -> DataFrame:
    """(value, members, cached, missing_cache, stale_cache) for every value with a hub."""
    rows = register_rows(members, historic, cached, hubs)
    out = hubs.select("value").distinct()
    for frame, name in ((members, "members"), (cached, "cached"), (rows.where("finding = 'missing'"), "missing_cache"), (rows.where("finding = 'stale'"), "stale_cache")):
        out = out.join(frame.select("value", "subject_id").distinct().groupBy("value").agg(F.count("*").alias(name)), "value", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def hubless(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """(value, members): values in use that no hub lists."""
    return members.join(hubs, "value", "left_anti").select("value", "subject_id").distinct().groupBy("value").agg(F.count("*").alias("members"))


def hood(edges: DataFrame) -> DataFrame:
    """(a, b): neighbours by REFERENCES or SHAPES, both ways, without loops."""
    e = edges.where(F.col("relation_type").isin("REFERENCES", "SHAPES")).where("source_id <> target_id").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return e.unionAll(e.select("b", "a")).distinct()


def filing_scores(items: DataFrame, anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """(item_id, anchor_id, score): 2 for a neighbour that is an anchor; for other neighbours 1 for each anchor that they are filed under and 0.5 for each that they cite but are not filed under.

    What a neighbour says of anchors is aggregated by neighbour before it meets the items, so a hub is expanded once.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    near = hood(edges).checkpoint()  # read four times below
    anchor = anchors.select("anchor_id").distinct().checkpoint()
    own = near.join(items.select(F.col("item_id").alias("a")), "a", "left_semi").select(F.col("a").alias("item_id"), "b")
    direct = own.join(anchor, own["b"] == anchor["anchor_id"]).select("item_id", "anchor_id", F.lit(2.0).alias("points"))
    others = near.select(F.col("a").alias("b")).distinct().join(anchor.withColumnRenamed("anchor_id", "b"), "b", "left_anti")
    filed = edges.where("relation_type = 'PART_OF'").select(F.col("source_id").alias("b"), F.col("target_id").alias("anchor_id")).join(anchor, "anchor_id", "left_semi").join(others, "b", "left_semi").distinct()
    cited = near.select(F.col("a").alias("b"), F.col("b").alias("anchor_id")).join(anchor, "anchor_id", "left_semi").join(others, "b", "left_semi").join(filed, ["b", "anchor_id"], "left_anti")
    says = filed.select("b", "anchor_id", F.lit(1.0).alias("points")).unionByName(cited.select("b", "anchor_id", F.lit(0.5).alias("points")))
    through = own.join(says, "b").select("item_id", "anchor_id", "points")
    return direct.unionByName(through).groupBy("item_id", "anchor_id").agg(F.sum("points").alias("score"))


def filing_proposals(scores: DataFrame, filed: DataFrame, top: int = 3) -> DataFrame:
    """(item_id, anchor_id, score, rank) for items without an anchor."""
    return top_rows(scores.join(filed.select("item_id"), "item_id", "left_anti"), ["item_id"], [F.desc("score"), F.asc("anchor_id")], top)


def filing_refile(scores: DataFrame, filed: DataFrame) -> DataFrame:
    """(item_id, anchor_id, score): filed items whose best anchor strictly beats every current one."""
    best = top_rows(scores.join(filed.select("item_id"), "item_id", "left_semi"), ["item_id"], [F.desc("score"), F.asc("anchor_id")], 1).select("item_id", F.col("anchor_id").alias("best"), F.col("score").alias("best_score"))
    current = filed.select("item_id", "anchor_id").distinct().join(scores, ["item_id", "anchor_id"], "left").groupBy("item_id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("now"), F.collect_set("anchor_id").alias("held"))
    return best.join(current, "item_id").where((F.col("best_score") > F.col("now")) & ~F.array_contains("held", F.col("best"))).select("item_id", F.col("best").alias("anchor_id"), F.col("best_score").alias("score"))


def _tokens(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token): distinct tokens of three or more characters."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("[a-z0-9_]{3,}"), F.lit(0)))
    return texts.select(F.col(id_col).alias("id"), F.explode(found).alias("token"))


def near_duplicates(statement: str, corpus: DataFrame, id_col: str, text_col: str, top: int = 5, least: float = 0.1) -> DataFrame:
    """(id, score): the corpus texts nearest to a statement by the cosine of their IDF-weighted token sets."""
    spark = corpus.sparkSession
    n = corpus.count() + 1
    q = _tokens(spark.createDataFrame([("q", statement)], "i string, t string"), "i", "t").select("token", F.lit(1).alias("asked"))
    rows = _tokens(corpus, id_col, text_col)
    df = rows.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(q), "token", "full_outer")
    weight = F.log(F.lit(float(n)) / (F.coalesce("df", F.lit(0)) + F.coalesce("asked", F.lit(0)))) + 1.0
    weights = df.select("token", "asked", weight.alias("w"))
    q_norm = weights.where("asked = 1").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("q_norm"))
    square = F.col("w") * F.col("w")
    both = rows.join(weights, "token").groupBy("id").agg(F.sum(F.when(F.col("asked") == 1, square).otherwise(0.0)).alias("dot"), F.sqrt(F.sum(square)).alias("norm"))
    score = F.col("dot") / (F.col("norm") * F.col("q_norm"))
    return both.join(F.broadcast(q_norm), how="cross").select("id", score.alias("score")).where(F.col("score") >= least).select("id", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "id").limit(top)


def _token_sets(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens): the sorted distinct tokens of texts that have any."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("[a-z0-9_]{3,}"), F.lit(0))))
    return texts.select(F.col(id_col).alias("id"), found.alias("tokens")).where(F.size("tokens") > 0)


def near_duplicate_classes(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, class_id): which class of near_duplicate_pairs() each text with a token belongs to: the smallest id with the same tokens."""
    rows = _token_sets(texts, id_col, text_col).select("id", F.sha2(F.array_join("tokens", " "), 256).alias("key"))
    return rows.join(rows.groupBy("key").agg(F.min("id").alias("class_id")), "key").select(F.col("id").alias(id_col), "class_id")


def candidate_pairs(index: DataFrame, least: float) -> DataFrame:
    """(class_a, class_b): pairs of an index (id, token, low, norm2) that can still reach `least`, class_a the smaller id.

    low is the squared weight of a token and of all that are not rarer in its text.  The rarest token that two texts share
    has all they share at or below it, so their dot product is at most the smaller of its two lows.
    """
    side = lambda end: index.select("token", F.col("id").alias(f"class_{end}"), F.col("low").alias(f"low_{end}"), F.col("norm2").alias(f"norm_{end}"))
    needed = least * F.sqrt(F.col("norm_a") * F.col("norm_b")) * (1 - 1e-9)
    met = side("a").join(side("b"), "token").where((F.col("class_a") < F.col("class_b")) & (F.least("low_a", "low_b") >= needed))
    return met.select("class_a", "class_b").distinct()


def near_duplicate_pairs(texts: DataFrame, id_col: str, text_col: str, least: float = 0.8) -> DataFrame:
    """(class_a, class_b, score): classes of texts with the same tokens, by their smallest id, whose cosine reaches `least`.

    Lossless prefix filter: a text is indexed by its rarest tokens only, up to the point where the rest holds less
    than least² of its squared norm, so two texts as near as that share an indexed token; a pair goes on only if what it
    can share below that token is enough.  Copies are classes of one representative, so a group of equal texts makes no
    pairs among itself.
    """
    ensure_checkpoint_dir(texts.sparkSession)
    sets, total = _token_sets(texts, id_col, text_col), texts.count()
    entries = token_entries(sets.select(F.explode("tokens").alias("token")), total)
    classed = sets.select("id", "tokens", F.substring(F.unhex(F.sha2(F.array_join("tokens", " "), 256)), 1, 16).alias("class"))  # once for a text, before its tokens are rows
    rows = classed.select("id", "class", F.explode("tokens").alias("token"))
    # A class's tokens are packed where they are read and dealt once: an entry tells a token and its weight, so that what two texts
    # share is one intersection by hash.
    dealt = _with_entries(rows, entries).groupBy("class").agg(F.min("id").alias("id"), F.collect_set("entry").alias("e"))
    weighted = dealt.select("class", "id", F.explode("e").alias("entry")).withColumn("w", F.log(F.lit(float(total)) / (F.col("entry") % (total + 1))) + 1.0)
    by_weight = Window.partitionBy("class").orderBy(F.asc("w"), F.asc("entry"))
    run = weighted.withColumn("low", F.sum(F.col("w") * F.col("w")).over(by_weight)).withColumn("norm2", F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("class")))
    high = F.when(F.col("low") >= least * least * F.col("norm2") * (1 - 1e-9), F.struct(F.col("entry").alias("token"), "low"))
    packed = run.groupBy("class").agg(F.first("id").alias("id"), F.collect_list("entry").alias("e"), F.collect_list(high).alias("high"), F.first("norm2").alias("norm2")).checkpoint()
    index = packed.select("id", "norm2", F.explode("high").alias("h")).select("id", "h.token", "h.low", "norm2")
    pairs = candidate_pairs(index, least).checkpoint()
    ends = pairs.select(F.col("class_a").alias("id")).unionAll(pairs.select("class_b")).distinct()
    texts_met = among(packed, ends).select("id", "e", F.sqrt("norm2").alias("norm"))
    joined = pairs.join(texts_met.select(F.col("id").alias("class_a"), F.col("e").alias("ea"), F.col("norm").alias("na")), "class_a").join(texts_met.select(F.col("id").alias("class_b"), F.col("e").alias("eb"), F.col("norm").alias("nb")), "class_b")
    weight = lambda e: F.log(F.lit(float(total)) / (e % (total + 1))) + 1.0
    dot = F.aggregate(F.array_intersect("ea", "eb"), F.lit(0.0), lambda acc, e: acc + weight(e) * weight(e))
    return joined.select("class_a", "class_b", (dot / (F.col("na") * F.col("nb"))).alias("score")).where(F.col("score") >= least).select("class_a", "class_b", F.round("score", 4).alias("score"))


def token_entries(rows: DataFrame, total: int) -> DataFrame:
    """(token, df, entry) of the tokens (token) of `total` texts: entry is a number of the token times (total + 1), plus df."""
    found = rows.groupBy("token").agg(F.count("*").alias("df")).withColumn("at", F.monotonically_increasing_id()).checkpoint()  # the numbers hold from here on
    part = F.shiftright("at", 33)
    sizes = found.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each task that counted
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    number = F.col("start") + F.col("at") - F.shiftleft(F.col("part"), 33)
    return found.withColumn("part", part).join(F.broadcast(starts), "part").select("token", "df", (number * (total + 1) + F.col("df")).alias("entry"))


COMMON = 1 << 16  # tokens that are sent to the texts; the others' texts are dealt to them


def _with_entries(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """rows (id, class, token) with entry instead of token: most rows have one of the most frequent tokens, so few are shuffled to meet theirs."""
    common = entries.orderBy(F.desc("df"), "token").limit(COMMON).select("token", "entry").checkpoint()
    met = rows.join(F.broadcast(common), "token", "left")
    rare = entries.join(F.broadcast(common.select("token")), "token", "left_anti").select("token", "entry")
    return met.where("entry is not null").select("id", "class", "entry").unionAll(met.where("entry is null").select("id", "class", "token").join(rare, "token").select("id", "class", "entry"))


def prose_references(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, token, id): id tokens in texts (source_id, text) with every node that they name; id is null if none does.

    Short tokens meet the nodes by their eight characters, full ids exactly; a text's own id is skipped.
    """
    tokens = texts.select("source_id", F.explode(id_tokens(F.col("text"))).alias("token")).where(~F.col("source_id").startswith(F.col("token")))
    tokens = tokens.withColumn("eight", F.substring("token", 1, 8))
    ids = maybe_among(nodes.select("id", F.substring("id", 1, 8).alias("eight")), "eight", tokens.select(F.col("eight").alias("id")))
    hits = tokens.join(ids, "eight", "left")
    hits = hits.withColumn("id", F.when(F.col("id").startswith(F.col("token")), F.col("id"))).select("source_id", "token", "id").distinct()
    named = hits.where("id is not null")
    return named.unionByName(hits.select("source_id", "token").distinct().join(named, ["source_id", "token"], "left_anti").withColumn("id", F.lit(None).cast("string")))


def prose_refs_unlinked(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, token, id, ambiguous): tokens that name nodes none of which has an edge with the text's node; the smallest is reported."""
    ensure_checkpoint_dir(found.sparkSession)
    found = found.where("id is not null").checkpoint()  # read for the edges that may link and for their join
    pair = F.concat("source_id", "id")
    e = edges.select("source_id", F.col("target_id").alias("id"))
    both = e.unionAll(e.select("id", "source_id")).withColumn("pair", pair)
    linked = maybe_among(both, "pair", found.select(pair.alias("id"))).select("source_id", "id").distinct().withColumn("linked", F.lit(1))
    rows = found.join(linked, ["source_id", "id"], "left")
    return rows.groupBy("source_id", "token").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.count("linked").alias("n_linked")).where("n_linked = 0").select("source_id", "token", "id", (F.col("n") > 1).alias("ambiguous"))


def degree_zero(nodes: DataFrame, edges: DataFrame, labels: list[str]) -> DataFrame:
    """(id, label): nodes of these labels without any edge."""
    ends = edges.select(F.col("source_id").alias("id")).unionAll(edges.select("target_id"))
    return nodes.where(F.col("label").isin(*labels)).select("id", "label").join(ends, "id", "left_anti")


def orphaned_links(ops: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, relation_type, target_id, source_missing, target_missing): logged links with an absent end, each once; a triple that was ever unlinked is ignored; empty ids are not missing."""
    triple = ["source_id", "relation_type", "target_id"]
    links = ops.where("verb = 'link'").select(*triple).distinct().join(ops.where("verb = 'unlink'").select(*triple), triple, "left_anti")
    for end in ("source", "target"):
        links = links.join(nodes.select(F.col("id").alias(f"{end}_id"), F.lit(True).alias(f"{end}_there")), f"{end}_id", "left")
        links = links.withColumn(f"{end}_missing", F.col(f"{end}_there").isNull() & (F.col(f"{end}_id") != ""))
    return links.where("source_missing or target_missing").select(*triple, "source_missing", "target_missing")


def orphan_healed(orphans: DataFrame, proposals: DataFrame, edges: DataFrame) -> DataFrame:
    """Orphans not all of whose proposed triples are live: proposals (missing_id, new_id) give the triple's new ends."""
    p = proposals
    moved = orphans.join(p.select(F.col("missing_id").alias("source_id"), F.col("new_id").alias("new_source")), "source_id", "left").join(p.select(F.col("missing_id").alias("target_id"), F.col("new_id").alias("new_target")), "target_id", "left")
    moved = moved.withColumn("s", F.when(F.col("source_missing"), F.col("new_source")).otherwise(F.col("source_id"))).withColumn("t", F.when(F.col("target_missing"), F.col("new_target")).otherwise(F.col("target_id")))
    live = edges.select(F.col("source_id").alias("s"), "relation_type", F.col("target_id").alias("t"), F.lit(True).alias("live"))
    judged = moved.join(live, ["s", "relation_type", "t"], "left").groupBy("source_id", "relation_type", "target_id").agg(F.bool_and(F.coalesce("live", F.lit(False))).alias("healed"))
    return judged.where("not healed").select("source_id", "relation_type", "target_id")


#: Letters of names from rare to frequent; all others are rarer.  Only the speed depends on the order.
RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate_-"


def _letters(column: str) -> Column:
    """The letters of a text as 'rank:letter:repeat', rarest first; two texts have as many in common as letters."""
    each = F.filter(F.split(F.col(column), ""), lambda c: c != "")
    counted = F.transform(F.array_distinct(each), lambda c: F.struct(F.lpad(F.instr(F.lit(RARE_FIRST), c).cast("string"), 2, "0").alias("rank"), c.alias("letter"), F.size(F.filter(each, lambda x: x == c)).alias("n")))
    spread = F.flatten(F.transform(counted, lambda s: F.transform(F.sequence(F.lit(1), s["n"]), lambda k: F.concat_ws(":", s["rank"], s["letter"], k.cast("string")))))
    return F.array_sort(spread)


def fuzzy_suggest(wanted: DataFrame, names: DataFrame, cutoff: float = 0.6, top: int = 1) -> DataFrame:
    """(wanted, name, ratio): the best names by the matching-blocks ratio, at least the cutoff.

    Lossless filters before any comparison: the ratio is at most 2·min/(a+b) of the lengths, and at most
    2·common/(a+b) of the letters in common.  Two strings of a ratio of 0.6 need not share any two letters in a row, so
    no key of several letters would be lossless.  Names meet by every length that the cutoff allows and by one of their
    letters: of the letters of a text, rarest first and repeats numbered, all but the ones that a partner may lack must
    be among its first.  That is an equi-join; letters in common are counted natively, and the exact ratio is computed on
    Arrow batches of what is left.
    """
    w = wanted.select("wanted").distinct().select("wanted", F.length("wanted").alias("la"), _letters("wanted").alias("ca"))
    n = names.select("name").distinct().select("name", F.length("name").alias("lb"), _letters("name").alias("cb"))
    spans = F.sequence(F.ceil(F.col("la") * (cutoff / (2 - cutoff)) - 1e-9).cast("int"), F.floor(F.col("la") * ((2 - cutoff) / cutoff) + 1e-9).cast("int"))
    # A pair shares `least` letters, so one of the first la - least + 1 of the one is among the first lb - least + 1 of the other.
    least = F.ceil((F.col("la") + F.col("lb")) * (cutoff / 2) - 1e-9).cast("int")
    shortest = F.ceil(F.col("lb") * (cutoff / (2 - cutoff)) - 1e-9).cast("int")
    least_of_any = F.ceil((F.col("lb") + shortest) * (cutoff / 2) - 1e-9).cast("int")
    first = lambda tokens, size, common: F.slice(tokens, F.lit(1), F.greatest(size - common + 1, F.lit(0)))
    w = w.withColumn("lb", F.explode(spans)).withColumn("key", F.explode(first(F.col("ca"), F.col("la"), least)))
    n = n.withColumn("key", F.explode(first(F.col("cb"), F.col("lb"), least_of_any)))
    rows = w.join(n, ["lb", "key"]).where(2 * F.size(F.array_intersect("ca", "cb")) >= cutoff * (F.col("la") + F.col("lb")) - 1e-9).select("wanted", "name").distinct()

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            m = difflib.SequenceMatcher(None, y, x)
            out.append(m.ratio() if m.real_quick_ratio() >= cutoff and m.quick_ratio() >= cutoff else 0.0)
        return pd.Series(out)

    scored = rows.withColumn("ratio", ratio("wanted", "name")).where(F.col("ratio") >= cutoff)
    return top_rows(scored, ["wanted"], [F.desc("ratio"), F.asc("name")], top).select("wanted", "name", F.round("ratio", 6).alias("ratio"))


def mentions(wanted: DataFrame, bodies: DataFrame, most: int = 8) -> DataFrame:
    """(wanted, name): every name whose body contains the wanted text.

    A body that contains a text contains all its pieces of `most` characters (of its own length, if it is shorter), so
    each text meets bodies by the piece that the fewest bodies hold, which is an equi-join; what is left is compared whole.
    """
    piece = lambda text, size: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))
    w = wanted.select("wanted").where("wanted <> ''").distinct().withColumn("size", F.least(F.length("wanted"), F.lit(most)))
    own = w.select("wanted", F.explode(piece(F.col("wanted"), F.col("size"))).alias("piece"))
    sizes = F.broadcast(w.select("size").distinct())
    b = bodies.select("name", "body").where("body is not null").distinct()
    held = b.join(sizes, F.length("body") >= F.col("size")).select("name", "body", F.explode(piece(F.col("body"), F.col("size"))).alias("piece"))
    often = held.join(own.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    rare = own.join(often, "piece", "left").groupBy("wanted").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
    return rare.join(held, "piece").where(F.contains("body", "wanted")).select("wanted", "name").distinct()


def orphan_proposals(wanted: DataFrame, names: DataFrame, bodies: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """(wanted, name, ratio, evidence): of the other names whose body contains the wanted one the most alike (the last of equals); only if there is none, the closest name."""
    ensure_checkpoint_dir(wanted.sparkSession)
    wanted, bodies = wanted.select("wanted").distinct().checkpoint(), bodies.select("name", "body").checkpoint()
    found = mentions(wanted, bodies).where("name <> wanted").join(names.select("name").distinct(), "name", "left_semi")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    said = top_rows(found.withColumn("ratio", ratio("wanted", "name")), ["wanted"], [F.desc("ratio"), F.desc("name")], 1).select("wanted", "name", F.round("ratio", 6).alias("ratio"), F.lit("body-mention").alias("evidence")).checkpoint()
    rest = wanted.join(said, "wanted", "left_anti")
    return said.unionByName(fuzzy_suggest(rest, names, cutoff).withColumn("evidence", F.lit("name-similarity")))


def dangling(references: DataFrame, declared: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """References (.., slug) that no declared slug or alias answers."""
    known = declared.select("slug") if aliases is None else declared.select("slug").unionAll(aliases.select("slug"))
    return references.join(known.distinct(), "slug", "left_anti")


def section_divergence(old: DataFrame, new: DataFrame) -> DataFrame:
    """(note_id, anchor, change, old_raw, new_raw): sections changed, added or removed between two versions, compared byte by byte."""
    o, n = old.select("note_id", "anchor", F.col("raw").alias("old_raw")), new.select("note_id", "anchor", F.col("raw").alias("new_raw"))
    rows = o.join(n, ["note_id", "anchor"], "full_outer")
    change = F.when(F.col("old_raw").isNull(), "added").when(F.col("new_raw").isNull(), "removed").when(F.col("old_raw") != F.col("new_raw"), "changed")
    return rows.withColumn("change", change).where("change is not null").select("note_id", "anchor", "change", "old_raw", "new_raw")


def source_check(live: DataFrame, artifact: DataFrame) -> DataFrame:
    """(key, verdict): equal, drifted, only_live or only_artifact, by a hash of the content."""
    a = live.select("key", F.sha2("content", 256).alias("x"))
    b = artifact.select("key", F.sha2("content", 256).alias("y"))
    verdict = F.when(F.col("x").isNull(), "only_artifact").when(F.col("y").isNull(), "only_live").when(F.col("x") == F.col("y"), "equal").otherwise("drifted")
    return a.join(b, "key", "full_outer").select("key", verdict.alias("verdict"))


def edge_remap(edges: DataFrame, id_map: DataFrame) -> DataFrame:
    """(source_id, relation_type, target_id, outcome): link ends through a map old_id → new_id; an end with several survivors blocks the edge."""
    m = id_map.groupBy("old_id").agg(F.countDistinct("new_id").alias("n"), F.min("new_id").alias("new_id"))
    rows = edges.select("source_id", "relation_type", "target_id")
    for end in ("source", "target"):
        rows = rows.join(m.select(F.col("old_id").alias(f"{end}_id"), F.col("n").alias(f"{end}_n"), F.col("new_id").alias(f"{end}_new")), f"{end}_id", "left")
    rows = rows.where("source_n is not null or target_n is not null")
    blocked = (F.coalesce("source_n", F.lit(1)) > 1) | (F.coalesce("target_n", F.lit(1)) > 1)
    moved = lambda end: F.when(blocked, F.col(f"{end}_id")).otherwise(F.coalesce(f"{end}_new", f"{end}_id")).alias(f"{end}_id")
    return rows.select(moved("source"), "relation_type", moved("target"), F.when(blocked, "blocked").otherwise("moved").alias("outcome")).distinct()
