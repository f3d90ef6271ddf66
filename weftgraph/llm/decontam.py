"""Benchmark decontamination by one Aho-Corasick automaton over the normalised windows of all test items.

Texts are normalised byte by byte (A-Z lowered, every other ASCII non-word byte a space), then words are joined by
one space, so the position of a match gives the words that it covers, and these have their places in the original.
The automaton is built once in each worker from the broadcast items.  Benchmarks are small, and this is checked: items
are dealt into blocks of at most BLOCK_CHARS characters, each with its own automaton and its own pass, and passes are cut
from each other by a checkpoint, so that a worker holds one automaton.  A block of random words, whose windows share
nothing, makes one of about 470 MB; real text shares beginnings and needs less.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrow import map_columns, picked, slices, use_checkpoints

WINDOW = 10
BLOCK_CHARS = 1_000_000  # of items; their windows repeat each word up to WINDOW times in the automaton
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class Windows:
    """The automaton over the windows of items [(item_id, text)]."""

    def __init__(self, items: list[tuple], width: int = WINDOW) -> None:
        self.width = width
        found: dict[bytes, set] = {}
        for item, text in items:
            words = words_of(text)
            for at in range(max(1, len(words) - width + 1) if words else 0):
                found.setdefault(b" ".join(words[at : at + width]), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for key, owners in found.items():
            self.automaton.add_word(f" {key.decode('latin-1')} ", (key.count(b" ") + 1, tuple(owners)))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """The number of words, the covered word ranges [from, to), and the items with an occurring window."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), [], set()
        joined = b" " + b" ".join(words) + b" "
        spans, items, ends = [], set(), None
        for last, (n, owners) in self.automaton.iter(joined.decode("latin-1")):
            if ends is None:
                ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)[1:]
            stop = int(np.searchsorted(ends, last)) + 1
            spans.append((stop - n, stop))
            items.update(owners)
        return len(words), spans, items


_WINDOWS: dict[int, Windows] = {}


def _windows(shared) -> Windows:
    """The automaton of a broadcast block, built once in a worker; only the last one stays."""
    key = shared.id if hasattr(shared, "id") else hash(tuple(shared.value))
    if key not in _WINDOWS:
        _WINDOWS.clear()
        _WINDOWS[key] = Windows(shared.value)
    return _WINDOWS[key]


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges as sorted disjoint ranges."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character ranges of the original text that word ranges come from."""
    raw = text.encode("utf-8", "replace")
    at = [m.span() for m in _WORD.finditer(raw)]
    return [(len(raw[: at[a][0]].decode()), len(raw[: at[b - 1][1]].decode())) for a, b in ranges]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """(broadcast, last) of the items in blocks of bounded size, one block on the driver at a time; never documents."""
    context, block, room = benchmark.sparkSession.sparkContext, [], BLOCK_CHARS
    for item, text in benchmark.select(F.col(f"`{item_col}`"), F.col(f"`{text_col}`")).where(F.col(f"`{text_col}`").isNotNull()).toLocalIterator():
        if len(text) > room and block:
            yield context.broadcast(block), False
            block, room = [], BLOCK_CHARS
        block.append((item, text))
        room -= len(text)
    yield context.broadcast(block), True


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items array<string>, char_spans array<struct<from:int,to:int>>) for every row of docs.

    items are sorted as strings; char_spans are places in the original text.  Null texts have no words; items with
    null or wordless text have no window; a null item id counts as an item of name 'null'; repeated rows stay.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scanner(shared, last: bool):
        def start():
            windows = _windows(shared)

            def work(ids, texts, *before):
                """before: the word ranges and items that earlier blocks found."""
                n, ranges, items = [], [], []
                for i, text in enumerate(texts):
                    count, spans, owners = windows.scan(text)
                    if before:
                        spans += [(s["from"], s["to"]) for s in before[0][i]]
                    n.append(count)
                    ranges.append(covered(spans))
                    items.append(sorted({"null" if x is None else str(x) for x in owners}.union(*(b[i] for b in before[1:]))))
                if not last:
                    return [ids, texts, [_structs(r) for r in ranges], items]
                places = [_structs(original_spans(t, r)) if r else [] for t, r in zip(texts, ranges, strict=True)]
                return [ids, n, [sum(b - a for a, b in r) for r in ranges], items, places]

            return work

        return start

    found, spans = picked(docs, id_col, text_col), "array<struct<from:int,to:int>>"
    shapes = {False: f"`{text_col}` string, ranges {spans}, items array<string>", True: f"n_words long, n_hit long, items array<string>, char_spans {spans}"}
    for shared, last in _blocks(benchmark, item_col, item_text_col):
        found = map_columns(found, f"`{id_col}` {kind}, {shapes[last]}", scanner(shared, last))
        if not last:
            use_checkpoints(docs.sparkSession)
            found = found.checkpoint()
    return found


def _structs(ranges: list[tuple[int, int]]) -> list[dict]:
    return [{"from": a, "to": b} for a, b in ranges]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs.

    Null texts have no words and hold nothing; rows with a null id are judged and repeated rows stay, as in find_hits().
    """
    found = find_hits(docs, benchmark, id_col, text_col)
    return found.select(F.col(f"`{id_col}`"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a window of a test item; all columns stay and the text is scanned in place, once for each block of items.

    Null and wordless texts stay, as rows with a null id do; equal texts stay or go together; without items all stay.
    """
    out, at = docs.schema, docs.columns.index(text_col)

    def keeper(shared):
        def run(batches):
            windows = _windows(shared)
            for batch in (part for whole in batches for part in slices(whole, 3_000_000)):
                yield batch.filter(pa.array([not windows.scan(t)[1] for t in batch.column(at).to_pylist()], pa.bool_()))

        return run

    for shared, last in _blocks(benchmark, "item_id", "text"):
        docs = docs.mapInArrow(keeper(shared), out)
        if not last:
            use_checkpoints(docs.sparkSession)
            docs = docs.checkpoint()
    return docs
