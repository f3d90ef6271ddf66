"""Repair of the turn structure of conversations by a dynamic program over runs of equal rows.

Rows of a conversation become symbols: the role's initial and whether the row must go or is cut off.  The edits of one
row are a 4 x 4 matrix over the states of `(s?(ua)+)?` in min-plus algebra, insertions before the row included.  Equal
symbols in a row collapse to a run, and a run of n is passed by the cached powers 2^k of its matrix, so the costs to the
end cost log n steps a run; the choices are then read off forwards, the ASCII-least first, with the costs inside a run
worked out a block at a time.

Conversations are dealt whole and streamed through a task in order.  For the one at hand a task keeps one byte a row, the
digests of its distinct rows and its texts, which go to a temporary file of the task beyond KEEP bytes.

Nulls: a null role or text is one space, and so is a null id or turn in the text that the damage is drawn from.  A null
conv_id is a conversation of its own.  A role that is empty or begins with another letter than s, u or a can only be
deleted or rewritten.  Rows with an equal turn are ordered by role, then text; repeated rows count as duplicates.  An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrow import picked, slices

KEEP = 16_000_000  # bytes of a conversation's texts that a task keeps in memory
SHORT = 64  # rows of a conversation whose repair is remembered
BLOCK = 4096  # rows of a run whose costs are worked out together
WHITE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE = 4, 3, 3
CUT_OFF = 3  # added for a cut-off row that stays
MUST_GO = 8
START, S, U, A = range(4)
FAR = 1 << 40
NEXT = {START: U, S: U, U: A, A: U}  # what an inserted or rewritten row leads to
KEPT = ({START: S}, {START: U, S: U, A: U}, {U: A}, {})  # what a kept row leads to, by role: s, u, a, other
NAMES = {U: "user", A: "assistant"}


def _row_costs(symbol: int) -> np.ndarray:
    m = np.full((4, 4), FAR)
    np.fill_diagonal(m, DELETE)
    if symbol != MUST_GO:
        role, more = symbol >> 1, CUT_OFF * (symbol & 1)
        for q, to in NEXT.items():
            m[q, to] = min(m[q, to], REROLE + more)
        for q, to in KEPT[role].items():
            m[q, to] = min(m[q, to], more)
    return m


def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum((x[:, :, None] + y[None, :, :]).min(1), FAR)


def _insertions() -> np.ndarray:
    m = np.full((4, 4), FAR)
    np.fill_diagonal(m, 0)
    for q, to in NEXT.items():
        m[q, to] = INSERT
    return _times(_times(m, m), m)


INSERTED = _insertions()
AT_END = (INSERTED + np.array([0, FAR, FAR, 0])).min(1)
_POWERS: dict[int, list[np.ndarray]] = {}


def _power(symbol: int, k: int) -> np.ndarray:
    """The costs of 2^k rows of a symbol."""
    known = _POWERS.setdefault(symbol, [_times(INSERTED, _row_costs(symbol))])
    while len(known) <= k:
        known.append(_times(known[-1], known[-1]))
    return known[k]


def _advance(symbol: int, n: int, costs: np.ndarray) -> np.ndarray:
    """Costs to the end before n rows of a symbol, from those behind them."""
    k = 0
    while n:
        if n & 1:
            costs = (_power(symbol, k) + costs).min(1)
        n >>= 1
        k += 1
    return costs


def runs(symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, length) of the runs of equal symbols."""
    x = np.frombuffer(symbols, np.uint8)
    edges = np.r_[0, np.flatnonzero(np.diff(x)) + 1, len(x)]
    return [(int(x[a]), int(b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)] if len(x) else []


def cheapest(symbols: bytes) -> tuple[int, str]:
    """The least cost, and the ASCII-least edits of that cost."""
    found, behind = runs(symbols), [AT_END]
    for symbol, n in reversed(found):
        behind.append(_advance(symbol, n, behind[-1]))
    cost, q, out = int(behind.pop()[START]), START, []
    for symbol, n in found:
        end = behind.pop()
        must, role, more = symbol == MUST_GO, symbol >> 1, CUT_OFF * (symbol & 1)
        kept = {} if must else KEPT[role]
        for at in range(0, n, BLOCK):
            size = min(BLOCK, n - at)
            costs, one = [_advance(symbol, n - at - size, end)], _power(symbol, 0)
            for _ in range(size):
                costs.append((one + costs[-1]).min(1))
            costs = [c.tolist() for c in reversed(costs)]
            for here, after in zip(costs, costs[1:], strict=False):
                while True:
                    left = here[q]
                    if DELETE + after[q] == left:
                        out.append("D")
                    elif INSERT + here[NEXT[q]] == left:
                        out.append("I")
                        q = NEXT[q]
                        continue
                    elif q in kept and more + after[kept[q]] == left:
                        out.append("K")
                        q = kept[q]
                    else:
                        out.append("R")
                        q = NEXT[q]
                    break
    while AT_END[q]:
        out.append("I")
        q = NEXT[q]
    return cost, "".join(out)


_remembered = lru_cache(1 << 16)(cheapest)


class Texts:
    """Roles and texts of a conversation in order, in memory up to KEEP bytes and in a file of the task beyond."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str]] = []
        self.size, self.file = 0, None

    def add(self, role: str, text: str) -> None:
        self.rows.append((role, text))
        self.size += len(text) + 120
        if self.size > KEEP:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.rows, self.file)
            self.rows, self.size = [], 0

    def __iter__(self) -> Iterator[tuple[str, str]]:
        if self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
        yield from self.rows

    def close(self) -> None:
        if self.file:
            self.file.close()


@dataclass
class Conversation:
    """What is known of a conversation once its rows have been added in order."""

    conv_id: int | None
    texts: Texts = field(default_factory=Texts)
    symbols: bytearray = field(default_factory=bytearray)
    seen: set[bytes] = field(default_factory=set)
    first: int | None = None
    last: int | None = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    initial: str | None = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        end = text.rstrip(WHITE)[-1:]
        if not end:
            self.blank += 1
            self.symbols.append(MUST_GO)
        elif digest in self.seen:
            self.duplicate += 1
            self.symbols.append(MUST_GO)
        else:
            cut = end not in ".!?"
            self.truncated += cut
            self.symbols.append(("sua".find(role[:1]) if role and role[0] in "sua" else 3) << 1 | cut)
        self.seen.add(digest)
        self.texts.add(role, text)

    @property
    def gaps(self) -> int:
        return self.last - self.first + 1 - self.turns if self.turns else 0

    def repair(self) -> tuple[int, str]:
        """The cost and the edits."""
        return (_remembered if len(self.symbols) <= SHORT else cheapest)(bytes(self.symbols))

    def repaired(self, edits: str) -> Iterator[tuple[str, str]]:
        """(role, text) after the edits."""
        q, rows = START, iter(self.texts)
        for e in edits:
            role, text = ("", "") if e == "I" else next(rows)
            if e == "D":
                continue
            q = KEPT["sua".find(role[0])][q] if e == "K" else NEXT[q]
            yield (role if e == "K" else NAMES[q]), text


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost): faults drawn from the CRC-32 of `conv_id:turn`, modulo 20.

    0 loses the row (it stays to name its conversation, with lost true), 1 empties its text, 2 takes [.!?] out of it, 3 repeats the
    row, 4 gives it to the user.
    """
    rows = picked(conversations, "conv_id", "turn", "role", "text")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault: Column = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = rows.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("lost"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))))
    return rows.drop("col")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[Conversation]:
    now: Conversation | None = None
    for batch in (x for whole in batches for x in slices(whole, 3_000_000)):
        for conv_id, turn, role, text, lost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield now
                    now.texts.close()
                now = Conversation(conv_id)
            if not lost:
                now.add(turn, " " if role is None else role, " " if text is None else text)
    if now is not None:
        yield now
        now.texts.close()


def _dealt(rows: DataFrame) -> DataFrame:
    """Whole conversations in order; conv_id and turn as 64-bit numbers."""
    lost = F.coalesce(F.col("lost"), F.lit(False)) if "lost" in rows.columns else F.lit(False)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", lost.alias("lost"))
    return rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")


def _rows_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about `size` characters."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += 64 + sum(len(x) for x in row if isinstance(x, str))
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation in rows.

    rows: (conv_id, turn, role, text), and lost if rows that only name their conversation are among them.  Each row's first
    fault counts: blank, duplicate (role and text seen earlier) or truncated.  audit: the initials of the cheapest edits
    (Delete, Insert, Keep, Rerole) in order.  The hash is that of the repaired `role:text`, joined by line breaks.
    """
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for c in _conversations(batches):
            (cost, audit), sha, between = c.repair(), hashlib.sha256(), ""
            for role, text in c.repaired(audit):
                sha.update(f"{between}{role}:{text}".encode())
                between = "\n"
            yield c.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, cost, audit, sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows_of(lines(batches), schema)

    return _dealt(rows).mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations, their rows numbered from 0."""
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((c.conv_id, k, *row) for c in _conversations(batches) for k, row in enumerate(c.repaired(c.repair()[1])))
        yield from _rows_of(found, schema)

    return _dealt(rows).mapInArrow(run, "conv_id long, position long, role string, text string")
