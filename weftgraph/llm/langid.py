"""Language identification by error-correcting output codes.

Languages get codewords; one linear classifier of hashed character n-grams is trained for each bit by averaged
gradient steps on the logistic loss; a text goes to the codeword with the smallest loss-weighted distance.  It is
flagged as ambiguous if the second codeword is almost as near, or if no codeword is near: the classifiers then give
bits that no language has.  Training takes at most TRAIN_ROWS labelled texts of each language and about TRAIN_TOTAL of
all (those with the smallest hash of their id, LEAST_ROWS of every language in any case), as n-gram vectors made where
the texts are, so what reaches the driver is bounded; the model is a matrix of 2^BITS by the codeword length.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.arrow import map_columns, picked, slices

BITS = 13  # of the n-gram hash
TRAIN_ROWS = 500  # labelled texts of each language
TRAIN_TOTAL = 4000  # labelled texts of all languages
LEAST_ROWS = 8  # of each language, however many there are
EPOCHS = 12
SLICE = 1 << 20  # characters hashed at once
AMBIGUOUS = 0.15  # scores below this are flagged,
FAR = 0.4  # and losses to the nearest codeword above this; a bit at random has ln 2
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: every split for few languages, else Hadamard-like parities of the index and its reverse."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(splits, float).T
    length = 1 << (n - 1).bit_length() + 1
    index = np.arange(n, dtype=np.uint64)
    columns = [1 - 2.0 * (np.bitwise_count(index & np.uint64(m)) & 1) for m in range(1, length // 2)]
    columns += [np.where(index == i, 1.0, -1.0) for i in range(n)]
    return np.array([c for c in columns if len(set(c)) > 1]).T


def ngrams(text: str) -> np.ndarray:
    """Counts of hashed 1- to 4-grams of lower-cased letters, everything else a space, scaled to length one; summed in slices."""
    total = np.zeros(1 << BITS)
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[at : at + SLICE + 3].lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        letters = (codes >= 128) | ((codes >= 97) & (codes <= 122))
        codes = np.where(letters, codes, np.uint64(32))
        grams = codes * np.uint64(0x9E3779B97F4A7C15)
        for width in (1, 2, 3, 4):
            if width > 1:
                grams = (grams[:-1] ^ (codes[width - 1 :] * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xBF58476D1CE4E5B9)
            if len(grams):
                total += np.bincount((grams >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    root = np.sqrt(total)
    return (root / max(np.linalg.norm(root), 1e-9)).astype(np.float32)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, codes: np.ndarray) -> None:
        self.languages, self.weights, self.codes = languages, weights, codes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """A language, a score (how much nearer the best codeword is than the second, from 0 to 1) and the loss to the best codeword for each text."""
        known = [bool(self.languages) and t is not None and any(map(str.isalpha, t)) for t in texts]
        names, scores, nearest = [UNKNOWN] * len(texts), [0.0] * len(texts), [math.log(2)] * len(texts)
        rows = [i for i, k in enumerate(known) if k]
        for a in range(0, len(rows), 256):
            part = rows[a : a + 256]
            margins = np.stack([ngrams(texts[i]) for i in part]) @ self.weights
            losses = np.log1p(np.exp(-np.clip(margins[:, None, :] * self.codes[None, :, :], -30, 30))).mean(axis=2)
            order = np.argsort(losses, axis=1, kind="stable")
            best = losses[np.arange(len(part)), order[:, 0]]
            second = losses[np.arange(len(part)), order[:, 1]] if len(self.languages) > 1 else best + 1
            for i, o, b, s in zip(part, order, best, second, strict=True):
                names[i], scores[i], nearest[i] = self.languages[o[0]], float(min(1.0, max(0.0, (s - b) / max(s, 1e-9)))), float(b)
        return names, scores, nearest


def _sample(rows: DataFrame, counts: dict[str, int], most: int) -> DataFrame:
    """(l, i, t, draw): the `most` ids with the smallest hashes of each label l.

    Rows are thinned by their hash before they are ranked, with room to spare, so no task ranks all rows of a label.
    """
    draw = F.xxhash64("i").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    shares = [(name, min(1.0, (most + 8 * math.sqrt(most) + 16) / n)) for name, n in sorted(counts.items())]
    near = rows.withColumn("draw", draw).join(F.broadcast(rows.sparkSession.createDataFrame(shares, "l string, share double")), "l").where("draw < share")
    near = near.groupBy("l", "i", "draw").agg(F.min("t").alias("t"))
    return near.withColumn("place", F.row_number().over(Window.partitionBy("l").orderBy("draw", "i"))).where(F.col("place") <= most).drop("place")


def _vectors(texts: list[str]) -> tuple[list[bytes], list[bytes]]:
    """The places and values of the n-gram vectors that are not zero, two bytes each."""
    places, values = [], []
    for t in texts:
        x = ngrams(t)
        at = np.flatnonzero(x)
        places.append(at.astype(np.uint16).tobytes())
        values.append(x[at].astype(np.float16).tobytes())
    return places, values


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of rows with a language and a text; without any, the model knows no language.

    Every label is learned; the same rows in any order and partitioning give the same model.
    """
    rows = labelled.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l")).where("l is not null and t is not null and i is not null")
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.approx_count_distinct("i", 0.02).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((1 << BITS, 1), np.float32), np.ones((0, 1)))
    most = max(LEAST_ROWS, min(TRAIN_ROWS, TRAIN_TOTAL // len(languages)))
    found = map_columns(_sample(rows, counts, most).select("l", "draw", "i", "t"), "l string, draw double, i string, places binary, vals binary", lambda: lambda l, draw, i, t: [l, draw, i, *_vectors(t)])
    sample = sorted(found.collect(), key=lambda r: (r.l, r.draw, r.i))
    x = np.zeros((len(sample), 1 << BITS), np.float32)
    for k, r in enumerate(sample):
        x[k, np.frombuffer(r.places, np.uint16)] = np.frombuffer(r.vals, np.float16)
    codes = codewords(len(languages))
    y = codes[[languages.index(r.l) for r in sample]]
    rng = np.random.default_rng(6)
    weight = np.zeros((x.shape[1], y.shape[1]))
    total, steps = np.zeros_like(weight), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 64):
            part = order[a : a + 64]
            margin = np.clip(y[part] * (x[part] @ weight), -30, 30)
            weight += (20.0 / len(part)) * (x[part].T @ (y[part] / (1 + np.exp(margin)))) - 1e-4 * weight
            if epoch >= EPOCHS // 2:
                total += weight
                steps += 1
    return Model(languages, (total / max(steps, 1)).astype(np.float32), codes)


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """(id, held_out, lang_pred, score, ambiguous) for every row of docs.

    lang_pred is a learned language, or 'und' (score 0, ambiguous) for null texts and texts without a letter, and for
    all texts if there is nothing to learn from.  Rows with a null id are never learned from and not held out; equal
    texts get equal answers.  The language column is read in training only.
    """
    if model is None:
        model = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        own = shared.value
        return lambda ids, texts: [ids, *own.predict(texts)]

    found = map_columns(picked(docs, id_col, text_col), f"`{id_col}` {kind}, lang_pred string, score double, loss double", start)
    return found.select(F.col(f"`{id_col}`"), held_out(id_col).alias("held_out"), "lang_pred", "score", ((F.col("score") < AMBIGUOUS) | (F.col("loss") > FAR)).alias("ambiguous"))


def keep_identified(docs: DataFrame, text_col: str = "text", least_score: float = AMBIGUOUS, most_loss: float = FAR, model: Model | None = None, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """docs whose text has a language that the decoder does not flag as ambiguous; all columns stay as they are.

    Null texts and texts without a letter go, and so does every row if there is no label to learn from; rows with a
    null id are judged like any other; repeated rows stay or go together; an empty table stays empty.
    """
    if model is None:
        model = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 3_000_000)):
            yield batch.filter(pa.array([n != UNKNOWN and s >= least_score and loss <= most_loss for n, s, loss in zip(*shared.value.predict(batch.column(at).to_pylist()), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, out)
