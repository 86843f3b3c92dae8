"""Quality classifier from positive and unlabelled texts.

Trusted positives are the labelled good documents of the training folds; all documents of
those folds are the unlabelled texts. Labels of bad documents are not used. With the
squared loss l(z) = (1 - z)^2 / 4 and a score linear in features of the text, the risks
depend on the data through first and second moments alone:

    R_p+(w) = E_p l(g)    R_p-(w) = E_p l(-g)    R_u-(w) = E_u l(-g)

so one distributed pass sums the moments of both samples, over every row, and the driver
minimises the non-negative unbiased risk  pi R_p+ + max(0, R_u- - pi R_p-)  exactly on
matrices whose size depends on the features only. The minimiser of this loss estimates
2 P(good | text) - 1, so (1 + g) / 2 is a probability.

The class prior pi is estimated from positives and unlabelled texts: the part of the
unlabelled ones that score t or more, over the part of the positives that do, is at
least pi and comes near it where hardly a bad text scores t. It is taken at the t where
its upper confidence bound is least. The scores for that are of each half of the rows
under weights learnt from the other half.

Features are steps of a few measures of the text (repetition, symbols, capitals, bars,
line and word lengths) and its hashed words and byte trigrams, as square roots of their
shares in 256 steps. Ids, labels, language and source are never part of them.

Defined results
    null or empty text: all measures 0, scored like any other; very long texts: measured
    whole; repeated rows: one result for each, all weighing in the moments; several
    labels of an id: good if any says so; null labels or ids: no label; without
    positives every score is ``DEFAULT_PRIOR``, which is also the prior where a half of
    the rows has none; an empty table: no rows; further columns, whatever their names,
    pass through ``quality_filter`` unchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import TMP, add_up, bounded_batches, drop, materialize, split_fold

HELD_OUT = 2
THRESHOLD = 0.7
DEFAULT_PRIOR = 0.5
RIDGE = 1e-2
MEASURES = 10
#: Buckets of hashed trigrams, and of hashed words.
HASHED = 64
#: Upper ends of the steps, the same for every measure; all lie between 0 and 1.
STEPS = (0.002, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95)
#: Bins of scores, and the chance that a bound on the prior fails.
BINS, DELTA = 400, 0.1

_KIND = np.zeros(256, np.uint8)
_KIND[list(b"#$%&*|<>")] = 1
_KIND[np.arange(ord("A"), ord("Z") + 1)] = 2
_KIND[list(b"!?")] = 3
_KIND[np.arange(ord("0"), ord("9") + 1)] = 4
_KIND[list(b" \t\n\r\x0b\x0c")] = 5


def measures(text: str | None) -> list[float]:
    """What the score sees of a text: shares between 0 and 1."""
    data = (text or "").encode()
    words = (text or "").split()
    if not words:
        return [0.0] * MEASURES
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=6)
    solid = len(data) - kinds[5]
    n = len(words)
    again = sum(map(str.__eq__, words[1:], words))
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda a, b: float(a / b) if b else 0.0
    return [
        share(kinds[1], n), share(kinds[2], solid), share(kinds[3], n), share(kinds[4], solid),
        share(again, n), 1 - share(len(set(words)), n), 1 - share(len(set(lines)), len(lines)),
        share(text.count(" | "), n), min(1.0, solid / n / 20), min(1.0, n / 400),
    ]


def basis(x: np.ndarray) -> np.ndarray:
    """A constant and a step for each measure and threshold that it exceeds."""
    steps = (x[:, :, None] > np.array(STEPS)).reshape(len(x), -1)
    return np.hstack([np.ones((len(x), 1)), steps.astype(np.float64)])


def hashed(text: str | None) -> bytes:
    """Square roots of the shares of hashed byte trigrams, then of hashed words, in bytes."""
    lower = (text or "").lower()
    b = np.frombuffer(f" {lower} ".encode(), np.uint8).astype(np.uint32)
    grams = ((b[:-2] * 0x9E3B + b[1:-1] * 0x1F35 + b[2:] * 0x6D) >> 3) % HASHED
    words = [zlib.crc32(w.encode()) % HASHED for w in lower.split()]
    counts = [np.bincount(x, minlength=HASHED) for x in (grams, np.array(words, np.int64))]
    return np.concatenate([np.rint(255 * np.sqrt(c / max(1, c.sum()))) for c in counts]).astype(np.uint8).tobytes()


SIZE = 1 + MEASURES * len(STEPS) + 2 * HASHED
_UPPER = np.triu_indices(SIZE)


def vectors(x: pd.Series, h: pd.Series) -> np.ndarray:
    """The features of rows: the basis of their measures, and what is hashed."""
    shares = np.frombuffer(b"".join(h), np.uint8).reshape(len(h), 2 * HASHED) / 255
    return np.hstack([basis(np.stack(x.to_numpy())), shares])


def measured(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and, under an internal name, ``x`` and ``h`` of each text."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("x array<double>, h binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"x": [measures(t) for t in texts], "h": [hashed(t) for t in texts]})

    return docs.select(*keep, run(F.col(text_col)).alias(f"{TMP}f"))


def moments(rows: DataFrame, parts: int | None = None) -> dict[str, np.ndarray]:
    """For ``x, h, half, positive`` rows: the sums of z z' by half, "u0" and "u1" over all rows
    and "p0" and "p1" over positive ones (z starts with a constant, so that counts and
    means are in them)."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {k: np.zeros((SIZE, SIZE)) for k in ("u0", "u1", "p0", "p1")}
        for b in batches:
            if len(b):
                z, half, good = vectors(b["x"], b["h"]), b["half"].to_numpy(), b["positive"].to_numpy(bool)
                for k in (0, 1):
                    for name, rows in ((f"u{k}", z[half == k]), (f"p{k}", z[(half == k) & good])):
                        sums[name] += rows.T @ rows
        n = TaskContext.get().partitionId()
        yield pd.DataFrame({"part": [n] * 4, "key": [*sums], "sums": [s[_UPPER].tobytes() for s in sums.values()]})

    whole = {}
    for k, upper in add_up(rows, part, np.float64, parts).items():
        m = np.zeros((SIZE, SIZE))
        m[_UPPER] = upper
        whole[k] = m + np.triu(m, 1).T
    return {k: whole.get(k, np.zeros((SIZE, SIZE))) for k in ("u0", "u1", "p0", "p1")}


def minimise(unlabelled: np.ndarray, positive: np.ndarray, prior: float, ridge: float = RIDGE) -> np.ndarray:
    """Weights of least non-negative unbiased risk for the moment matrices given.

    Where the part under max(0, .) is positive the minimum solves a linear system. If it
    is negative there, the risk is the convex combination with weight t in [0, 1] on that
    part for which it is 0; t is found by bisection.
    """
    u, p = unlabelled / unlabelled[0, 0], positive / positive[0, 0]
    m_u, m_p, eye = u[0], p[0], ridge * np.eye(len(u))
    eye[0, 0] = 1e-9

    def solve(t: float) -> np.ndarray:
        quadratic = prior * p + t * (u - prior * p) + eye
        linear = prior * m_p - t * (m_u - prior * m_p)
        return np.linalg.solve(quadratic, linear)

    def negative(w: np.ndarray) -> float:
        return float((1 + 2 * w @ m_u + w @ u @ w) / 4 - prior * (1 + 2 * w @ m_p + w @ p @ w) / 4)

    w = solve(1.0)
    if negative(w) >= 0:
        return w
    low, high = 0.0, 1.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if negative(solve(mid)) > 0 else (low, mid)
    return solve(low)


def tail_prior(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The class prior from counts of scores in rising bins."""
    n_u, n_p = unlabelled.sum(), positive.sum()
    if not n_u or not n_p:
        return DEFAULT_PRIOR
    tail_u, tail_p = np.cumsum(unlabelled[::-1]) / n_u, np.cumsum(positive[::-1]) / n_p
    seen = tail_p > 0
    ratio = tail_u[seen] / tail_p[seen]
    doubt = np.sqrt(np.log(4 / DELTA) / (2 * n_u)) + np.sqrt(np.log(4 / DELTA) / (2 * n_p))
    return float(min(1.0, ratio[np.argmin(ratio + doubt / tail_p[seen])]))


def estimated_prior(train: DataFrame, sums: dict[str, np.ndarray]) -> float:
    """The prior of ``train`` (x, h, half, positive); at most ``BINS`` counts for each half and
    sample go to the driver."""
    if not all(m[0, 0] for m in sums.values()):
        return DEFAULT_PRIOR
    weights = [minimise(sums[f"u{1 - k}"], sums[f"p{1 - k}"], DEFAULT_PRIOR) for k in (0, 1)]

    @F.pandas_udf("int")
    def place(x: pd.Series, h: pd.Series, half: pd.Series) -> pd.Series:
        g = vectors(x, h) @ np.stack(weights, axis=1) if len(x) else np.zeros((0, 2))
        g = g[np.arange(len(g)), half.to_numpy()]
        return pd.Series(np.clip(np.floor((g + 1) / 2 * BINS), 0, BINS - 1).astype(np.int32))

    counts = np.zeros((2, BINS))
    for r in train.groupBy(place("x", "h", "half").alias("place"), "positive").count().collect():
        counts[int(r["positive"]), r["place"]] += r["count"]
    return tail_prior(counts.sum(axis=0), counts[1])


def scored(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, np.ndarray | None, float]:
    """(``doc_id`` and the features of every row, the weights, the prior)."""
    spark, fold = docs.sparkSession, split_fold("doc_id")
    good = labels.where("doc_id is not null and quality = 1").where(fold != HELD_OUT).select(F.col("doc_id").alias("good")).distinct()
    features = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias(f"{TMP}text")), f"{TMP}text", ("doc_id",))
    features = materialize(features, "features")
    train = features.where(fold != HELD_OUT).join(good, F.col("doc_id") == F.col("good"), "left")
    train = train.select(F.col(f"{TMP}f.x").alias("x"), F.col(f"{TMP}f.h").alias("h"), F.least(fold, F.lit(1)).alias("half"), F.col("good").isNotNull().alias("positive"))
    parts = max(features.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sums = moments(train, parts)
    prior = estimated_prior(train, sums)
    u, p = sums["u0"] + sums["u1"], sums["p0"] + sums["p1"]
    return features, minimise(u, p, prior) if p[0, 0] else None, prior


def _score(column: str, weights: np.ndarray | None) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, h: pd.Series) -> pd.Series:
        if weights is None or not len(x):
            return pd.Series(np.full(len(x), DEFAULT_PRIOR))
        return pd.Series(np.clip((1 + vectors(x, h) @ weights) / 2, 0.0, 1.0))

    return run(F.col(f"{column}.x"), F.col(f"{column}.h"))


def quality_scores(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    features, weights, _ = scored(docs, labels, text_col, id_col)
    df = features.select("doc_id", (split_fold("doc_id") == HELD_OUT).alias("held_out"), _score(f"{TMP}f", weights).alias("score"))
    return df.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _score_of(text_col: str, weights: np.ndarray | None) -> Column:
    """The same from the text, in one function."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if weights is None or not len(texts):
            return pd.Series(np.full(len(texts), DEFAULT_PRIOR))
        z = vectors(pd.Series([measures(t) for t in texts]), pd.Series([hashed(t) for t in texts]))
        return pd.Series(np.clip((1 + z @ weights) / 2, 0.0, 1.0))

    return run(F.col(text_col))


def quality_filter(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are predicted good; each row is judged by its own text."""
    features, weights, _ = scored(docs, labels, text_col, id_col)
    drop(features)
    return docs.where(_score_of(text_col, weights) >= THRESHOLD)
