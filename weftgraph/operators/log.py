"""Operation logs: folds, windows of time and sessions, ledgers.  Order is always seq, given at ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID_SHAPED = r"^(?=.*[a-f])[0-9a-f-]{6,36}$"


def latest_state(ops: DataFrame) -> DataFrame:
    """(key, content) of live keys: the last of 'source' and 'retire' decides; other operations do not matter here."""
    last = ops.where(F.col("op").isin("source", "retire")).groupBy("key").agg(F.max_by(F.struct("op", "content"), "seq").alias("s"))
    return last.where("s.op = 'source'").select("key", "s.content")


def sourced_keys(ops: DataFrame) -> DataFrame:
    """(key): keys whose last of 'cutover' and 'retire' is a cutover."""
    last = ops.where(F.col("op").isin("cutover", "retire")).groupBy("key").agg(F.max_by("op", "seq").alias("op"))
    return last.where("op = 'cutover'").select("key")


def genesis_paths(ops: DataFrame, verbs: tuple[str, ...]) -> DataFrame:
    """(key): keys with any operation of these verbs."""
    return ops.where(F.col("op").isin(*verbs)).select("key").distinct()


def genesis_import(selected: DataFrame, known: DataFrame, logged: DataFrame) -> DataFrame:
    """(key, outcome): 'unknown' without a baseline, 'skipped' if already logged, else 'imported'."""
    k, l = known.select("key", F.lit(True).alias("k")), logged.select("key", F.lit(True).alias("l"))
    rows = selected.select("key").distinct().join(k, "key", "left").join(l, "key", "left")
    return rows.select("key", F.when(F.col("k").isNull(), "unknown").when(F.col("l"), "skipped").otherwise("imported").alias("outcome"))


def touch_rows(journal: DataFrame, refs: Column) -> DataFrame:
    """(seq, verb, ts, session, actor, ref): a row for every reference that an operation touches; repeats count."""
    return journal.select("seq", "verb", "ts", "session", "actor", F.explode(refs).alias("ref"))


def touched_by_verb(verb: Column, args: dict[str, Column]) -> Column:
    """References of an operation by verb: decide → itself, supports, supersedes, session; assert → its subject if id-shaped; link and unlink → both ends."""
    none = F.array().cast("array<string>")

    def arr(*names: str) -> Column:
        return F.array(*(args[n] for n in names if n in args))

    decided = F.concat(arr("own_id"), *(F.coalesce(args[n], none) for n in ("supports", "supersedes") if n in args))
    found = (
        F.when(verb == "decide", decided)
        .when(verb == "assert", F.when(args["subject"].rlike(ID_SHAPED), arr("subject")).otherwise(none))
        .when(verb.isin("link", "unlink"), arr("source_id", "target_id"))
        .when(verb.isin("session", "retract-session"), arr("session_id"))
        .when(verb == "check", arr("item"))
        .otherwise(none)
    )
    return F.filter(found, lambda x: x.isNotNull())


def session_windows(ops: DataFrame) -> DataFrame:
    """(key, started_at, ended_at): the last registration of each key; a window ends at the next strictly later start, the last stays open.

    ops: (seq, key, started_at).  The next start is found within a slot of time, and for the last of a slot in the next
    slot that has any: all slots together are one row for each SLOT seconds, whatever the number of sessions.
    """
    last = ops.groupBy("key").agg(F.max_by("started_at", "seq").alias("started_at"))
    starts = last.select("started_at").distinct().withColumn("slot", _slot("started_at"))
    slots = starts.groupBy("slot").agg(F.min("started_at").alias("first"))
    slots = slots.select("slot", F.lead("first").over(Window.orderBy("slot")).alias("later"))
    within = starts.withColumn("next", F.lead("started_at").over(Window.partitionBy("slot").orderBy("started_at")))
    ends = within.join(slots, "slot").select("started_at", F.coalesce("next", "later").alias("ended_at"))
    return last.join(ends, "started_at").select("key", "started_at", "ended_at")


SLOT = 900.0  # seconds


def _slot(column: str, width: float = SLOT) -> Column:
    return F.floor(F.col(column) / width)


def last_start(times: DataFrame, starts: DataFrame, width: float = SLOT) -> DataFrame:
    """(ts, started_at): for each time the last start that is not after it; times before all starts are left out.

    An as-of join: times and starts are ordered within slots of time, and a slot begins with the last start of the
    slots before it.  Only distinct times are ordered, so many operations at one moment are one row here.
    """
    rows = times.select("ts").distinct().select("ts", F.lit(None).cast("double").alias("start"))
    rows = rows.unionAll(starts.select("started_at").distinct().select(F.col("started_at").alias("ts"), F.col("started_at").alias("start"))).withColumn("slot", _slot("ts", width))
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = rows.groupBy("slot").agg(F.max("start").alias("latest")).select("slot", F.max("latest").over(before).alias("carried"))
    running = Window.partitionBy("slot").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("here", F.max("start").over(running)).where("start is null").join(slots, "slot")
    return found.select("ts", F.coalesce("here", "carried").alias("started_at")).where("started_at is not null")


def in_window(ops: DataFrame, start: float | None = None, end: float | None = None, exclusive_start: bool = False) -> DataFrame:
    """Operations between two times, the end included, the start too unless exclusive."""
    c = F.lit(True)
    if start is not None:
        c = c & ((F.col("ts") > start) if exclusive_start else (F.col("ts") >= start))
    if end is not None:
        c = c & (F.col("ts") <= end)
    return ops.where(c)


def session_ops(ops: DataFrame, windows: DataFrame, width: float = SLOT) -> DataFrame:
    """ops with window_key: an operation belongs to a session by its tag, or by its time within the session's window.

    A window ends at the next start, so a time lies in the windows of the last start before it: an as-of join on time,
    then an equi-join on the start.
    """
    tagged = ops.where("session is not null").withColumn("window_key", F.col("session"))
    hits = ops.join(last_start(ops, windows, width), "ts").join(windows.select("key", "started_at"), "started_at")
    by_time = hits.where(F.col("session").isNull() | (F.col("session") != F.col("key"))).withColumn("window_key", F.col("key"))
    columns = [*ops.columns, "window_key"]
    return tagged.select(*columns).unionByName(by_time.select(*columns))


def journal_window(touches: DataFrame, key_cols: tuple[str, ...] = ()) -> DataFrame:
    """(ref, touches, first_ts, last_ts) of touch rows."""
    return touches.groupBy(*key_cols, "ref").agg(F.count("*").alias("touches"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def window_verbs(touches: DataFrame) -> DataFrame:
    return touches.groupBy("ref", "verb").agg(F.count("*").alias("n"))


def node_trace(touches: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, first_ts, last_ts, sessions, actors, op_count) for refs (full ids or prefixes of 8 or more characters).

    Times up to 0 are ignored; an operation counts once however many of its references match.
    """
    exact = touches.join(refs.where(F.length("ref") == 36).select(F.col("ref").alias("asked")), F.col("ref") == F.col("asked"))
    short = refs.where((F.length("ref") >= 8) & (F.length("ref") < 36)).select(F.col("ref").alias("asked"), F.substring("ref", 1, 8).alias("p"))
    prefix = touches.withColumn("p", F.substring("ref", 1, 8)).join(short, "p").where(F.col("ref").startswith(F.col("asked"))).drop("p")
    rows = exact.select("asked", "seq", "ts", "session", "actor").unionByName(prefix.select("asked", "seq", "ts", "session", "actor")).distinct()
    valid = F.when(F.col("ts") > 0, F.col("ts"))
    return rows.groupBy(F.col("asked").alias("ref")).agg(F.min(valid).alias("first_ts"), F.max(valid).alias("last_ts"), F.countDistinct("session").alias("sessions"), F.countDistinct("actor").alias("actors"), F.count("*").alias("op_count"))


def replay_edges(ops: DataFrame) -> DataFrame:
    """(source_id, relation_type, target_id) after a log of link and unlink: the last operation on a triple decides."""
    last = ops.where(F.col("verb").isin("link", "unlink")).groupBy("source_id", "relation_type", "target_id").agg(F.max_by("verb", "seq").alias("verb"))
    return last.where("verb = 'link'").select("source_id", "relation_type", "target_id")


def replay_counts(ops: DataFrame, offset: int = 0) -> DataFrame:
    return ops.where(F.col("seq") >= offset).groupBy("verb").agg(F.count("*").alias("n"))


def merge_properties(ops: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields): each property's last value that is not null."""
    return ops.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields))


def active_path(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """messages (session, id, source, ts) plus active: on the way from a session's first message to its latest one, along NEXT.

    Composer parts are always active.  The walk goes back from every session's tip at once, and the rounds double their
    reach, so a chain of n messages takes about log2(n) of them.  A round deals only messages that still have one so far
    before them: sessions that are walked through cost nothing more, however long others are.
    """
    transcript = messages.where("source <> 'composer'").select("session", "id", "ts").checkpoint()
    tips = transcript.groupBy("session").agg(F.max_by("id", F.struct("ts", "id")).alias("id"))
    known = transcript.select("id", "session")
    nexts = edges.where("relation_type = 'NEXT'").join(known.select(F.col("id").alias("source_id"), F.col("session").alias("s1")), "source_id").join(known.select(F.col("id").alias("target_id"), F.col("session").alias("s2")), "target_id").where("s1 = s2")
    jump = nexts.groupBy(F.col("target_id").alias("node")).agg(F.max("source_id").alias("up")).checkpoint()
    found = walking = tips.select("id").checkpoint()
    reach, longest = 1, transcript.count()  # no walk has more messages, not even one that comes to a cycle
    while reach < longest:
        steps = walking.join(jump, walking["id"] == jump["node"]).select("id", "up").checkpoint()
        if steps.isEmpty():
            break
        found = found.unionAll(steps.select("up"))
        walking = steps.select(F.explode(F.array("id", "up")).alias("id")).distinct()
        far = jump.select("node", F.col("up").alias("mid")).join(jump.select(F.col("node").alias("mid"), "up"), "mid").select("node", "up")
        jump, reach = far.checkpoint(), reach * 2
    active = found.distinct()
    marked = messages.join(active.withColumn("on_path", F.lit(True)), "id", "left")
    return marked.withColumn("active", (F.col("source") == "composer") | F.coalesce("on_path", F.lit(False))).drop("on_path")


def session_document(entries: DataFrame, sent: DataFrame | None = None, superseded: bool = False) -> DataFrame:
    """(session, document, n): one text per session in the order of ts; messages off the path are left out unless asked for; sent parts are marked, and a session without any text has none."""
    rows = entries if superseded else entries.where("active")
    if sent is not None:
        rows = rows.join(sent.select("id").distinct().withColumn("mark", F.lit(" [sent]")), "id", "left")
    else:
        rows = rows.withColumn("mark", F.lit(None).cast("string"))
    part = F.concat(F.lit("## "), F.col("role"), F.coalesce("mark", F.lit("")), F.lit("\n"), F.col("text"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "id", part.alias("part")))), lambda x: x["part"]), "\n\n")
    return rows.groupBy("session").agg(F.when(F.count(part) > 0, text).alias("document"), F.count("*").alias("n"))


def edit_fold(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """messages with the text of their last edit, if any."""
    last = edits.groupBy("id").agg(F.max_by("text", "seq").alias("edited"))
    return messages.join(last, "id", "left").withColumn("text", F.coalesce("edited", "text")).drop("edited")
