"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

A vocabulary in the JSON form of public tokenizers is broadcast once (its size is that of one file and does not
grow with the data).  Each distinct word is encoded once in a worker: an Aho-Corasick automaton gives every token
that starts at a position; the longest is taken if it is compatible with the token before, else a shorter one, else
the encoder goes back.  Two tokens are compatible if merging their symbols by rank gives back just these two; a
sequence whose neighbours are all compatible is the one that the merges give, so the result is exact.  Positions
that failed once are not tried again, which keeps the work linear in the word's length.

Words of a slice of texts are told apart by Arrow's dictionary encoding, so Python sees each distinct word of a slice
once.  Encodings are kept by an Encoder within bounds in bytes and go with the task that made it.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrow import map_columns, picked

SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
SPACES = regex.compile(SPACE)
CACHE_BYTES = 80_000_000  # of encodings that a task keeps
PAIR_BYTES = 24_000_000  # of compatible pairs that a worker keeps
PIECE = 1 << 20  # characters of a long text that are cut into words at once
MOST_WORDS = 1 << 19  # words told apart at once


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and tables of one tokenizer file (normaliser, word pattern, byte-level BPE with word ends).

    A byte at a word's end is another symbol than the same byte elsewhere: it is written 0x10000 code points higher.
    """

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace("^\\s", "^" + SPACE[1:-1]))
        self.table = dict(enumerate(byte_symbols()))
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        tokens = {self._internal(t): i for t, i in self.vocab.items()}
        self.token_of = {i: t for t, i in tokens.items()}
        self.rank = {}
        for at, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self._internal(a), self._internal(b)] = at
        # Decoding: the strings of all tokens in one buffer, and where each starts.
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.buffer, self.offset = bytearray(), array("q", [0])
        for i in range(max(names) + 1):
            self.buffer += names.get(i, "").encode()
            self.offset.append(len(self.buffer))
        # How each token comes about: its last merge.  Tokens that the merges never make are left out.
        self.automaton = ahocorasick.Automaton()
        self.right_spine: dict[int, list[tuple[str, int]]] = {}
        self.left_spine: dict[int, list[tuple[str, int]]] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        for t, i in tokens.items():
            parts, last = self.merge(t)
            if parts == [t]:
                self.automaton.add_word(t, (len(t), i))
                if last:
                    self.halves[t] = last
        self.automaton.make_automaton()
        # The longest token that begins each token, if there is one.
        self.shorter: list[tuple[int, int] | None] = [None] * (max(names) + 1)
        for t, i in tokens.items():
            if t in self.automaton:
                at = next((k for k in range(len(t) - 1, 0, -1) if t[:k] in self.automaton), 0)
                self.shorter[i] = self.automaton.get(t[:at]) if at else None
        self.compatible: dict[int, bool] = {}
        # The decimal and the decoded form of every id.
        self.decimals = pa.array([str(i) for i in range(len(self.offset) - 1)])
        self.names = pa.array([names.get(i, "") for i in range(len(self.offset) - 1)])

    def _internal(self, token: str) -> str:
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return body[:-1] + chr(ord(body[-1]) + 0x10000) if body else ""
        return token

    def merge(self, symbols: str) -> tuple[list[str], tuple[str, str] | None]:
        """The merges in order of rank, leftmost first: the definition, used on the vocabulary only.  The parts, and the last merge."""
        parts, last = list(symbols), None
        while len(parts) > 1:
            best = min(((self.rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def _spine(self, token: int, side: int) -> list[tuple[str, int]]:
        """The parts of a token at its left (0) or right (1) edge, smallest first, each with the rank of the merge that takes it up."""
        cache = self.right_spine if side else self.left_spine
        found = cache.get(token)
        if found is None:
            part, taken, found = self.token_of[token], len(self.rank), []
            while True:
                found.append((part, taken))
                halves = self.halves.get(part)
                if halves is None:
                    break
                taken, part = self.rank[halves], halves[side]
            found.reverse()
            cache[token] = found
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge ever joins the two tokens: the table is filled as pairs turn up.

        Over time the boundary lies between growing parts of a and b.  A pair of them is merged if its rank comes
        before either part is taken up; at equal ranks the left pair goes first.
        """
        known = self.compatible.get(a << 32 | b)
        if known is None:
            left, right, i, j, known = self._spine(a, 1), self._spine(b, 0), 0, 0, True
            while True:
                (x, x_taken), (y, y_taken) = left[i], right[j]
                rank = self.rank.get((x, y))
                if rank is not None and rank < x_taken and rank <= y_taken:
                    known = False
                    break
                if i + 1 == len(left) and j + 1 == len(right):
                    break
                if x_taken <= y_taken:
                    i += 1
                else:
                    j += 1
            if len(self.compatible) * 120 >= PAIR_BYTES:  # a number, its hash entry and their share of the table
                self.compatible.clear()
            self.compatible[a << 32 | b] = known
        return known

    def encode_word(self, word: str) -> list[int]:
        text = word.encode("utf-8", "replace").decode("latin-1").translate(self.table)
        n = len(text)
        if self.end:
            text = text[:-1] + chr(ord(text[-1]) + 0x10000)
        longest: list[tuple[int, int] | None] = [None] * n
        for last, found in self.automaton.iter(text):  # by their ends, so the longest token at a place comes last
            longest[last - found[0] + 1] = found
        path: list[tuple[int, int]] = []
        compatible, shorter, failed = self.compatible.get, self.shorter, set()
        at, before, option = 0, -1, longest[0]
        while True:
            while option is not None:
                length, token = option
                if before < 0 or ((ok := compatible(before << 32 | token)) is None and self.fits(before, token)) or ok:
                    if not failed or (at, token) not in failed:
                        break
                option = shorter[token]
            if option is not None:
                path.append(option)
                at += length
                if at == n:
                    return [t for _, t in path]
                before, option = token, longest[at]
            elif path:
                length, token = path.pop()
                at -= length
                failed.add((at, token))
                before, option = path[-1][1] if path else -1, shorter[token]
            else:
                raise ValueError(f"the vocabulary has no encoding of {word!r}")

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final sigma: characters are lowered one by one

    def words_of(self, text: str) -> list[str]:
        """The words of a text in order; a special token is a word of its own with a space before it, which no other word has."""
        if self.split and "<|" in text:
            out = []
            for part in self.split.split(text):
                out += [" " + part] if part in self.special else self.words.findall(self.normalise(part))
            return out
        return self.words.findall(self.normalise(text))

    def encode(self, text: str) -> list[int]:
        return Encoder(self).ids([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        buffer, offset = self.buffer, self.offset
        return b" ".join([buffer[offset[i] : offset[i + 1]] for i in ids]).decode()


class Encoder:
    """Encodes slices of texts for one task.

    Encodings of words are kept in two generations: a word found in the older one moves to the younger, and when the
    younger holds half of CACHE_BYTES it becomes the older and the one before goes.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def word(self, word: str) -> bytes:
        """The ids of a word as 4-byte numbers."""
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                v = self.vocabulary
                found = array("i", [v.special[word[1:]]] if word[0] == " " else v.encode_word(word)).tobytes()
            self.held += 220 + 4 * len(word) + len(found)
            if self.held > CACHE_BYTES // 2:
                self.young, self.old, self.held = {}, self.young, 0
            self.young[word] = found
        return found

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in order, and how many each word has."""
        index = pa.array(words, pa.large_string()).dictionary_encode()
        found = [self.word(w) for w in index.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = index.indices.to_numpy()
        lists = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(sizes)], np.frombuffer(b"".join(found), np.int32))
        return lists.take(pa.array(at)).flatten().to_numpy(), sizes[at]

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (one place more than texts)."""
        values, sizes, words, ends, n = [], [], [], [], 0

        def flush() -> None:
            if words:
                ids, count = self._encoded(words)
                values.append(ids)
                sizes.append(count)
                words.clear()

        for text in texts:
            for piece in pieces(text or ""):
                found = self.vocabulary.words_of(piece)
                n += len(found)
                words.extend(found)
                if len(words) >= MOST_WORDS:
                    flush()
            ends.append(n)
        flush()
        total = np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes]))
        return np.concatenate([np.empty(0, np.int32), *values]), total[np.array([0, *ends], np.int64)]

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        values, at = self.flat(texts)
        return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def joined(self, values: np.ndarray, at: np.ndarray, forms: pa.Array) -> pa.Array:
        """The forms of each text's ids, joined by spaces."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), forms.take(pa.array(values))), " ")


def pieces(text: str) -> list[str]:
    """A long text in parts that end at a space, which no word or special token crosses."""
    out, at = [], 0
    while len(text) - at > PIECE:
        m = SPACES.search(text, at + PIECE)
        if m is None:
            break
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


_LOADED: dict[int, Vocabulary] = {}


def loaded(source) -> Vocabulary:
    """The broadcast vocabulary's tables, built once in each Python worker; they do not grow with the data."""
    key = source.id if hasattr(source, "id") else hash(source.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(source.value)
    return _LOADED[key]


def broadcast_vocabulary(docs: DataFrame, path: str):
    """The tokenizer file, read where the driver runs and sent to the workers (about 2 MB)."""
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) for every row of docs: ids of the whole text and their decoding.

    A null text is read as empty: no ids, decoded ''.  Strings of special tokens in a text become these tokens, as
    the tokenizer's own library does.  Repeated rows stay; other columns are not read.
    """
    source, kind = broadcast_vocabulary(docs, path), docs.schema[id_col].dataType.simpleString()

    def start():
        coder = Encoder(loaded(source))

        def work(ids, texts):
            values, at = coder.flat(texts)
            return [ids, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values)), coder.joined(values, at, coder.vocabulary.names)]

        return work

    return map_columns(picked(docs, id_col, text_col), f"`{id_col}` {kind}, ids array<int>, decoded string", start, size=1_000_000)


def decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) for rows of token ids.  Null ids decode to null, an unknown id or a null one to nothing."""
    source, kind = broadcast_vocabulary(ids, path), ids.schema[id_col].dataType.simpleString()

    def start():
        v = loaded(source)
        n = len(v.offset) - 1
        return lambda keys, lists: [keys, [None if x is None else v.decode([i for i in x if i is not None and 0 <= i < n]) for x in lists]]

    return map_columns(picked(ids, id_col, ids_col), f"`{id_col}` {kind}, decoded string", start)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode() without shipping the ids themselves back to Spark."""
    source, kind = broadcast_vocabulary(docs, path), docs.schema[id_col].dataType.simpleString()

    def start():
        coder, sha = Encoder(loaded(source)), hashlib.sha256

        def work(ids, texts):
            values, at = coder.flat(texts)
            digests = [[sha(x.as_buffer()).hexdigest() for x in coder.joined(values, at, forms)] for forms in (coder.vocabulary.decimals, coder.vocabulary.names)]
            return [ids, np.diff(at), *digests]

        return work

    return map_columns(picked(docs, id_col, text_col), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", start)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long) for every row; null and empty texts have 0."""
    source, kind = broadcast_vocabulary(docs, path), docs.schema[id_col].dataType.simpleString()

    def start():
        coder = Encoder(loaded(source))
        return lambda ids, texts: [ids, np.diff(coder.flat(texts)[1])]

    return map_columns(picked(docs, id_col, text_col), f"`{id_col}` {kind}, n_tokens long", start)
