"""Conversation repair: the dynamic program against all edit sequences, and the query against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from weftgraph.llm import queries, turnrepair

GOOD = re.compile("(s?(ua)+)?")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def brute_edits(rows):
    """The least (cost, edits, roles) of rows (initial, must_go, cut_off), from all edits of every row and up to three insertions in one place."""

    @lru_cache(None)
    def best(i, last, inserted):
        wanted = "a" if last == "u" else "u"
        out = [(10**6, "", "")]
        if i == len(rows) and last in ("", "a"):
            out.append((0, "", ""))
        if inserted < 3:
            c, e, r = best(i, wanted, inserted + 1)
            out.append((c + 3, "I" + e, wanted + r))
        if i < len(rows):
            initial, must, cut = rows[i]
            c, e, r = best(i + 1, last, 0)
            out.append((c + 4, "D" + e, r))
            if not must:
                c, e, r = best(i + 1, wanted, 0)
                out.append((c + 3 + 3 * cut, "R" + e, wanted + r))
                if initial == wanted or (initial == "s" and last == ""):
                    c, e, r = best(i + 1, initial, 0)
                    out.append((c + 3 * cut, "K" + e, initial + r))
        return min(out)

    return best(0, "", 0)


def symbol(row):
    initial, must, cut = row
    return 8 if must else ("sua".index(initial) if initial in "sua" else 3) << 1 | cut


def test_edits_are_the_cheapest_and_ascii_least():
    rng = np.random.default_rng(2)
    for n in [0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 5] * 8:
        rows = tuple((str(rng.choice(list("suax"), p=[0.2, 0.35, 0.35, 0.1])), bool(rng.random() < 0.2), bool(rng.random() < 0.3)) for _ in range(n))
        cost, edits, roles = brute_edits(rows)
        assert GOOD.fullmatch(roles)
        assert turnrepair.cheapest(bytes(map(symbol, rows))) == (cost, edits), rows


def stepwise(symbols):
    """The cost by one step a row, without runs."""
    costs = turnrepair.AT_END
    for s in reversed(symbols):
        costs = (turnrepair._times(turnrepair.INSERTED, turnrepair._row_costs(s)) + costs).min(1)
    return int(costs[0])


def test_long_runs():
    rng = np.random.default_rng(4)
    for _ in range(12):
        symbols = b"".join(bytes([int(rng.integers(0, 9))]) * int(rng.choice([1, 2, 5, 700, 9000])) for _ in range(5))
        cost, edits = turnrepair.cheapest(symbols)
        assert cost == stepwise(symbols) and len(edits) - edits.count("I") == len(symbols)


def brute(rows):
    """The whole report from rows (conv_id, turn, role, text); nulls are None."""
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c]
        r, x = " " if r is None else r, " " if x is None else x
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fault = zlib.crc32(key.encode()) % 20
        x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
        groups[c] += [] if fault == 0 else [(t, "user" if fault == 4 else r, x)] * (2 if fault == 3 else 1)
    out = []
    for c, g in groups.items():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in g if t is not None}
        counts, seen, symbols = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
        for _, r, x in g:
            inner = re.findall(r"[^\x20\x09-\x0D]", x)
            fault = "blank" if not inner else "duplicate" if (r, x) in seen else "truncated" if inner[-1] not in ".!?" else None
            seen.add((r, x))
            if fault:
                counts[fault] += 1
            symbols.append((r[:1] or "x", fault in ("blank", "duplicate"), fault == "truncated"))
        cost, edits, roles = brute_edits(tuple(symbols))
        done, rest, names = [], iter(g), iter(roles)
        for e in edits:
            r, x = ("", "") if e == "I" else next(rest)[1:]
            if e != "D":
                n = next(names)
                done.append(f"{r if e == 'K' else {'u': 'user', 'a': 'assistant'}[n]}:{x}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(g, g[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((c, gaps, *counts.values(), illegal, cost, edits, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query_over_the_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.QUERIES["op11_conversation_repair"](spark, sf_dir)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in found.schema] == [f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'bigint'}" for c in COLUMNS]
    assert got(found) == brute(rows)


def test_nulls_ties_repeats_odd_roles_and_lost_conversations(spark):
    rng = np.random.default_rng(9)
    texts = ["Good day.", "Good day.", "Well?", "cut off", " \t\n", "", "é!  ", None]
    roles = ["user", "assistant", "system", "tool", "", "User", None]
    rows = [(None if c == 3 else c, None if rng.random() < 0.1 else int(rng.integers(0, 6)), roles[int(rng.integers(0, 7))], texts[int(rng.integers(0, 8))]) for c in range(60) for _ in range(int(rng.integers(1, 6)))]
    lost = next(c for c in range(100, 10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "alone."))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id int, turn int, role string, text string, cost string")
    found = got(turnrepair.report(turnrepair.damage(df)))
    assert found == brute(rows)
    assert (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in found
    texts = defaultdict(list)
    for r in turnrepair.repaired(turnrepair.damage(df)).orderBy("position").collect():
        texts[r.conv_id].append(f"{r.role}:{r.text}")
    for r in found:
        assert hashlib.sha256("\n".join(texts[r[0]]).encode()).hexdigest() == r[-1]


def test_one_conversation_beyond_memory(spark, monkeypatch):
    kept = turnrepair.Texts()
    monkeypatch.setattr(turnrepair, "KEEP", 1000)
    for k in range(500):
        kept.add("user", str(k))
    assert kept.file is not None and [t for _, t in kept] == [str(k) for k in range(500)]
    kept.close()
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}.") for t in range(5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = turnrepair.report(df).first()
    want = hashlib.sha256("\n".join(f"{role}:{text}" for _, _, role, text in rows).encode()).hexdigest()
    assert (r.cost, r.audit, r.repaired_sha256) == (0, "K" * 5000, want)


@pytest.mark.parametrize("f", [turnrepair.report, turnrepair.repaired])
def test_empty_table(spark, f):
    assert f(turnrepair.damage(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_sql_gives_the_same_rows(sf_dir):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    rows = db.execute(queries.ORACLE_SQL["op11_conversation_repair"]).fetchall()
    assert sorted(rows, key=str) == brute(db.execute("select conv_id, turn, role, text from conversations").fetchall())
