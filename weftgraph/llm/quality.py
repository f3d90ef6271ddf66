"""Quality rules: fixed base rules, then robust multivariate outliers of each language and source.

Every text gives a vector of transformed statistics.  For each (language, source) group, each language and all rows
the minimum-covariance-determinant estimate is found by concentration steps from two starts (means and variances;
medians and quartiles): distances to the current centre, the nearest SHARE of the rows, their mean and covariance,
again.  A step is one grouped aggregation: rows are counted and summed by (group, start, distance bin) before the
shuffle, so a group of any size becomes at most BINS rows, and the bin in which the share is reached bounds the next
subset.  The start with the smaller determinant wins.  An estimate then leans on that of the level above it by the
weight of PRIOR rows, so a small group is judged by its language and a small language by all rows, without a switch.
Rows whose squared Mahalanobis distance exceeds FACTOR times the median of all rows' distances are rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.arrow import map_columns, picked, use_checkpoints

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BINS = 400
STEPS = 5
SHARE = 0.75  # of a group's rows that the estimate rests on
PRIOR = 50.0  # rows that the estimate of the level above counts for
#: What is added to the variance of each statistic: differences below this root are never unlikely, even if all other texts agree.
FLOORS = (0.3**2, 0.03**2, 0.35**2, 0.5**2, 0.8**2)
FACTOR = 22.0  # of the median squared distance; the labelled clean texts of sf0.1 reach 20.5, 97.7 % of the junk lies beyond 23
SMALL = 100_000  # rows of estimates that may be broadcast
FEATURES = ("x0", "x1", "x2", "x3", "x4")
_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def statistics_of(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null has none of them."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\x0b\x0c\r")] if b"\n" in raw else []
    repeated = 0
    if n > WINDOW:
        index: dict[bytes, int] = {}
        if len(set(words)) < n:
            ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
            # Ranks of 1, 2, 4 and 8 words: windows are equal exactly if their ranks are.
            for width in (1, 2, 4):
                pairs = ids[:-width] * np.int64(n + 1) + ids[width:]
                distinct, ids = np.unique(pairs, return_inverse=True)
                if len(distinct) == len(pairs):
                    ids = None
                    break
            if ids is not None:
                often = (np.bincount(ids) > 1)[ids]
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, np.flatnonzero(often), 1)
                np.add.at(edge, np.flatnonzero(often) + WINDOW, -1)
                repeated = int((np.cumsum(edge[:-1]) > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, groups, the five counts) for every row of docs."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, *groups)}

    def start():
        def work(*columns):
            *keys, texts = columns
            found = np.array([statistics_of(t) for t in texts], np.int64).reshape(-1, 5)
            return [*keys, *found.T]

        return work

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return map_columns(picked(docs, id_col, *groups, text_col), schema, start)


def vectors(stats: DataFrame) -> DataFrame:
    """The transformed statistics x0..x4 of texts that pass the base rules."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.select(
        "*",
        F.log(words).alias("x0"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words).alias("x1"),
        F.log1p(100.0 * F.col("n_symbols") / words).alias("x2"),
        F.log1p(100.0 * F.col("n_dup_lines") / words).alias("x3"),
        F.log1p(100.0 * F.col("n_repeat_words") / words).alias("x4"),
    )


def _distance():
    """Squared Mahalanobis distance of x0..x4 to the joined centre m0..m4 and inverse w0_0..w4_4, as a column."""
    centred = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(FEATURES)]
    terms = [(1.0 if i == j else 2.0) * centred[i] * centred[j] * F.col(f"w{i}_{j}") for i, j in _PAIRS]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


#: Squared distances by bin, evenly spaced in the logarithm.
def _bin(distance):
    return F.least(F.lit(BINS - 1), F.floor(F.log1p(distance * 50.0) * 25.0)).cast("int")


_MEANS = [f"m{i}" for i in range(len(FEATURES))]
_COVS, _INVERSE = ([f"{c}{i}_{j}" for i, j in _PAIRS] for c in "cw")


def _square(values: np.ndarray) -> np.ndarray:
    """Symmetric matrices from rows of their lower halves."""
    out = np.empty((len(values), len(FEATURES), len(FEATURES)))
    for at, (i, j) in enumerate(_PAIRS):
        out[:, i, j] = out[:, j, i] = values[:, at]
    return out


def _lower(matrices: np.ndarray) -> list[np.ndarray]:
    return [matrices[:, i, j] for i, j in _PAIRS]


def _fit(rows: pd.DataFrame) -> list:
    """n, determinant, mean, covariance and inverse from at most BINS rows of counts, sums and products: the nearest bins that hold the share."""
    rows = rows.sort_values("bin")
    n = rows["n"].to_numpy(float)
    take = slice(0, int(np.searchsorted(np.cumsum(n), SHARE * n.sum() - 1e-9)) + 1)
    count = n[take].sum()
    mean = np.array([rows[f"s{i}"].to_numpy()[take].sum() for i in range(len(FEATURES))]) / count
    cov = _square(np.array([[rows[f"p{i}_{j}"].to_numpy()[take].sum() / count - mean[i] * mean[j] for i, j in _PAIRS]]))
    cov += np.diag(FLOORS)
    return [int(n.sum()), float(np.linalg.det(cov[0])), *mean, *(x[0] for x in _lower(cov)), *(x[0] for x in _lower(np.linalg.inv(cov)))]


def _with_keys(rows: DataFrame, groups: tuple[str, ...], level: int | None = None) -> DataFrame:
    """rows with `key`, one row for each level (or the one asked for): how many of the groups it tells apart, and their values."""

    def key(depth: int):
        return F.struct(F.lit(depth).alias("level"), *((F.col(f"`{g}`") if i < depth else F.lit(None).cast(rows.schema[g].dataType)).alias(f"k{i}") for i, g in enumerate(groups)))

    return rows.withColumn("key", F.explode(F.array(*map(key, range(len(groups) + 1)))) if level is None else key(level))


def _joined(rows: DataFrame, params: DataFrame, small: bool) -> DataFrame:
    params = params.withColumnRenamed("key", "_key")
    return rows.join(F.broadcast(params) if small else params, rows["key"].eqNullSafe(params["_key"])).drop("_key")


def _starts(rows: DataFrame) -> DataFrame:
    """(key, start, means, inverse): first centres and variances of each key, by moments (0) and by quartiles (1)."""
    found = rows.groupBy("key").agg(*(x for f in FEATURES for x in (F.avg(f).alias(f"a{f}"), F.var_pop(f).alias(f"v{f}"), F.percentile_approx(f, [0.25, 0.5, 0.75], 200).alias(f"q{f}"))))
    kinds = []
    for start in (0, 1):
        centre = [F.col(f"a{f}") if start == 0 else F.col(f"q{f}")[1] for f in FEATURES]
        spread = [F.col(f"v{f}") if start == 0 else F.pow((F.col(f"q{f}")[2] - F.col(f"q{f}")[0]) / 1.349, 2) for f in FEATURES]
        inverse = [(1.0 / (spread[i] + FLOORS[i])) if i == j else F.lit(0.0) for i, j in _PAIRS]
        kinds.append(F.struct(F.lit(start).alias("start"), *(c.alias(n) for c, n in zip(centre, _MEANS, strict=True)), *(c.alias(n) for c, n in zip(inverse, _INVERSE, strict=True))))
    return found.select("key", F.explode(F.array(*kinds)).alias("s")).select("key", "s.*")


def _step(rows: DataFrame, params: DataFrame, small: bool) -> DataFrame:
    """One concentration step: sums by (key, start, bin) of the distances to the estimates before, then new estimates."""
    binned = _joined(rows, params, small).withColumn("bin", _bin(_distance()))
    sums = binned.groupBy("key", "start", "bin").agg(F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(FEATURES)), *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in _PAIRS))
    names = ["n", "det", *_MEANS, *_COVS, *_INVERSE]
    out = "name string, start int, n long, " + ", ".join(f"{c} double" for c in names[1:])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[pdf["name"].iloc[0], pdf["start"].iloc[0], *_fit(pdf)]], columns=["name", "start", *names])

    # The key travels as JSON through pandas, in which its numbers and nulls would change their types.
    kind = rows.schema["key"].dataType
    fitted = sums.withColumn("name", F.to_json("key", {"ignoreNullFields": "false"})).drop("key").groupBy("name", "start").applyInPandas(fit, out)
    return fitted.select(F.from_json("name", kind).alias("key"), "start", *names).checkpoint()


def _leaning(params: DataFrame, levels: int) -> DataFrame:
    """(key, means, inverse) of the deepest level: each level's estimate drawn to that of the level above by PRIOR rows."""
    above = None
    for level in range(levels):
        own = params.where(F.col("key.level") == level)
        if above is not None:
            up = above.select(F.col("key").alias("_up"), *(F.col(c).alias(f"_{c}") for c in (*_MEANS, *_COVS)))
            parent = F.struct(F.lit(level - 1).alias("level"), *((F.col(f"key.k{i}") if i < level - 1 else F.lit(None).cast(params.schema["key"].dataType[f"k{i}"].dataType)).alias(f"k{i}") for i in range(levels - 1)))
            joined = own.withColumn("_parent", parent).join(up, F.col("_parent").eqNullSafe(F.col("_up")))
            a = F.col("n") / (F.col("n") + PRIOR)
            gap = [F.col(m) - F.col(f"_{m}") for m in _MEANS]
            means = [(a * F.col(m) + (1 - a) * F.col(f"_{m}")).alias(m) for m in _MEANS]
            covs = [(a * F.col(c) + (1 - a) * F.col(f"_{c}") + a * (1 - a) * gap[i] * gap[j]).alias(c) for c, (i, j) in zip(_COVS, _PAIRS, strict=True)]
            own = joined.select("key", "n", *means, *covs)
        above = own.select("key", "n", *_MEANS, *_COVS)

    def invert():
        return lambda names, *columns: [names, *columns[: len(_MEANS)], *_lower(np.linalg.inv(_square(np.array(columns[len(_MEANS) :], float).T)))]

    rows = above.select(F.to_json("key", {"ignoreNullFields": "false"}).alias("name"), *_MEANS, *_COVS)
    done = map_columns(rows, "name string, " + ", ".join(f"{c} double" for c in (*_MEANS, *_INVERSE)), invert)
    return done.select(F.from_json("name", params.schema["key"].dataType).alias("key"), *_MEANS, *_INVERSE).checkpoint()


def _limit(judged: DataFrame) -> DataFrame:
    """(limit): FACTOR times the median distance, to a thousandth.  Distances are counted by logarithmic bins, which are some ten thousand at most."""
    fine = judged.groupBy(F.floor(F.log1p(F.col("distance") * 50.0) * 1000.0).alias("bin")).agg(F.count("*").alias("n"))
    so_far = fine.select("bin", F.sum("n").over(Window.orderBy("bin")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    middle = so_far.where(2 * F.col("upto") >= F.col("total")).agg(F.min("bin").alias("bin"))
    return middle.select((FACTOR * F.expm1((F.col("bin") + 0.5) / 1000.0) / 50.0).alias("limit"))


def robust_outliers(passing: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """passing (with x0..x4) plus distance (squared, by the estimate of its group) and outlier."""
    rows = _with_keys(passing, groups).select("key", *FEATURES)
    params = _starts(rows).checkpoint()
    small = params.count() <= SMALL
    for _ in range(STEPS):
        params = _step(rows, params, small)
    fields = ["n", *_MEANS, *_COVS]
    best = params.groupBy("key").agg(F.min_by(F.struct(*fields), F.struct("det", "start")).alias("b")).select("key", "b.*")
    final = _leaning(best, len(groups) + 1)
    judged = _joined(_with_keys(passing, groups, len(groups)), final, small).withColumn("distance", _distance()).select(*passing.columns, "distance").checkpoint()
    return judged.join(F.broadcast(_limit(judged)), how="cross").select(*passing.columns, "distance", (F.col("distance") > F.col("limit")).alias("outlier"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, groups, counts, base_failed, distance, kept) for every row of docs.

    base_failed: fewer than 20 words, or over 30 % of the words in 8-word windows that occur twice or more.  kept:
    false if base_failed, else false for a robust outlier of its language and source.  A null text has no words and
    fails; rows with a null language or source form groups of their own; a group of any size is judged, a small one
    mostly by the estimate of its language; equal rows get equal verdicts; an empty table gives an empty one.
    """
    use_checkpoints(docs.sparkSession)
    stats = statistics(docs, id_col, text_col, groups).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).checkpoint()
    passing = vectors(stats.where("not base_failed"))
    judged = robust_outliers(passing, groups).select(*stats.columns, "distance", (~F.col("outlier")).alias("kept"))
    return judged.unionByName(stats.where("base_failed").select("*", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))
