"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk of an additive model.

Trusted positives are documents whose label is 1, the unlabelled text is every document of the learning rows, labels
0 are never used.  A document is described by shares (symbols, capitals, repetitions, ...), each cut into bins at
quantiles over all documents; the score is linear in the bins.  With squared loss the risks depend on the data only
through first and second moments of the bins, which one Spark pass sums over all rows, so nothing is sampled.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FEATURES = ["symbols", "bare_symbols", "capitals", "repeated_words", "distinct_words", "word_bytes", "digits",
            "distinct_lines", "words"]
BINS = 12
THRESHOLD = 0.7
RIDGE = 1e-4
STEPS = 3000
#: Share of the positives that a score range must hold to bound the class prior.
PRIOR_MASS = 0.2

_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS = bytes(range(48, 58))
_SPACES = b" \t\n\r\x0b\x0c"
_PLAIN = _LETTERS + _DIGITS + _SPACES
_SYMBOLS = bytes(b for b in range(128) if b not in _PLAIN)
_COMMON = b".,"
_CAPITALS = bytes(range(65, 91))


def describe(text: bytes | None) -> list[float]:
    """The features of a text in UTF-8 (of an empty or null one: zeros and ones of a text without faults)."""
    text = text or b""
    words = text.split()
    n, m = len(text), len(words)
    if not m:
        return [0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0]
    lines = text.split(b"\n")
    bare = m - len(text.translate(None, _SYMBOLS).split())
    letters = n - len(text.translate(None, _LETTERS))
    # a few plain words are assumed so that very short texts don't look extreme
    return [(n - len(text.translate(None, _PLAIN + _COMMON))) / (n + 40),
            bare / (m + 5),
            (n - len(text.translate(None, _CAPITALS))) / (letters + 40),
            sum(map(operator.eq, words, words[1:])) / (m + 5),
            (len(set(words)) + 5) / (m + 5),
            n / m,
            (n - len(text.translate(None, _DIGITS))) / (n + 40),
            len(set(lines)) / len(lines),
            float(np.log1p(m))]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, f (array of the features) per row of ``docs`` (doc_id, text)."""
    def run(batches):
        for batch in batches:
            f = np.array([describe(t) for t in batch.column(2).to_pylist()]).reshape(-1, len(FEATURES))
            values = pa.FixedSizeListArray.from_arrays(pa.array(f.ravel(), pa.float64()), len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values.cast(pa.list_(pa.float64()))],
                                             ["doc_id", "held_out", "f"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 4 == 2, F.lit(False))
    return (docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("binary"))
            .mapInArrow(run, "doc_id long, held_out boolean, f array<double>"))


@dataclass
class Model:
    """Bin edges per feature and a weight per bin (a few hundred numbers); no weights: nothing was learnt."""

    edges: list[np.ndarray]
    weights: np.ndarray | None

    def bins(self, f: np.ndarray) -> np.ndarray:
        """0/1 matrix of bins, the last column constant."""
        n, size = len(f), BINS + 1
        x = np.zeros((n, size * len(FEATURES) + 1))
        for i, e in enumerate(self.edges):
            x[np.arange(n), i * size + np.searchsorted(e, f[:, i], side="right")] = 1
        x[:, -1] = 1
        return x

    def margin(self, f: np.ndarray) -> np.ndarray:
        return self.bins(f) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(f))
        return np.clip((self.margin(f) + 1) / 2, 0, 1)


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(FEATURES))


def _sums(rows: DataFrame, make) -> np.ndarray:
    """Sum over all rows of ``make(features, positive)``, a vector for each batch, added up in Spark."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(_matrix(batch.column(0)), np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool))
                total = part if total is None else total + part
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], ["i", "v"])
    got = rows.select("f", "positive").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(len(make(np.zeros((0, len(FEATURES))), np.zeros(0, bool))))
    for i, v in got.collect():  # one number per pair of bins
        out[i] = v
    return out


def non_negative_fit(mp: np.ndarray, sp: np.ndarray, mu: np.ndarray, su: np.ndarray, prior: float) -> np.ndarray:
    """Weights that minimise prior * Rp(+1) + max(0, Ru(-1) - prior * Rp(-1)) with loss (1 - y g)^2.

    mp, sp / mu, su: mean and second moments of the bins of positives / unlabelled rows.  Where the estimated risk of
    the negatives is below zero, the step goes along its own rising gradient instead, as the non-negative estimator
    asks.
    """
    ridge = RIDGE * np.eye(len(mp))
    # begins at the minimum of the risk without the bound, which is final unless the bound is met there
    w = np.linalg.solve(su + ridge, 2 * prior * mp - mu)
    rate = 0.5 / np.linalg.eigvalsh(su)[-1]
    for _ in range(STEPS):
        negative = (1 + 2 * mu @ w + w @ su @ w) - prior * (1 + 2 * mp @ w + w @ sp @ w)
        if negative >= 0:
            step = -2 * prior * mp + mu + su @ w + ridge @ w
            if np.abs(step).max() < 1e-7:
                break
        else:
            step = -(mu + su @ w - prior * (mp + sp @ w))
        w = w - rate * step
    return w


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """Model of ``rows`` (doc_id, held_out, f; stored) and ``labels`` (doc_id, quality), without held-out rows.

    A document is a trusted positive if all its labels are 1.  The class prior is the smallest ratio, over ranges of
    high scores that hold PRIOR_MASS of the positives, of unlabelled share to positive share: first per single bin,
    then once more with the scores of a first fit.  Without positives the model has no weights and scores 1.
    """
    cuts = [i / BINS for i in range(1, BINS)]
    known = rows.where(~F.col("held_out"))
    quantiles = known.agg(*[F.percentile_approx(F.col("f")[i], cuts, 10_000) for i in range(len(FEATURES))]).first()
    # one more edge than quantiles: the far tail, where faults are that few documents have
    tails = known.agg(*[F.percentile_approx(F.col("f")[i], 0.97, 10_000) for i in range(len(FEATURES))]).first()
    edges = [np.unique([*(q or []), *([t] if t is not None else [])]) for q, t in zip(quantiles, tails)]
    model = Model(edges, None)
    trusted = (labels.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
               .agg(F.min("quality").alias("__q")).where("__q = 1").select("doc_id", F.lit(True).alias("__p")))
    known = common.stored(known.join(trusted, "doc_id", "left")
                          .select("f", F.coalesce("__p", F.lit(False)).alias("positive")), "quality")
    d = (BINS + 1) * len(FEATURES) + 1

    def moments(f, positive):
        x = model.bins(f)
        return np.concatenate([(x[positive].T @ x[positive]).ravel(), (x.T @ x).ravel()])
    sp, su = _sums(known, moments).reshape(2, d, d)
    if not sp[-1, -1]:
        return model
    sp, su = sp / sp[-1, -1], su / su[-1, -1]
    mp, mu = sp[-1], su[-1]
    wide = mp >= PRIOR_MASS
    prior = float(min(1, (mu[wide] / mp[wide]).min()))
    model.weights = non_negative_fit(mp, sp, mu, su, prior)
    grid = np.linspace(-1, 1.5, 251)

    def histogram(f, positive):
        at = np.searchsorted(grid, model.margin(f)) if len(f) else np.zeros(0, int)
        return np.concatenate([np.bincount(at[positive], minlength=252), np.bincount(at, minlength=252)]).astype(float)
    hp, hu = _sums(known, histogram).reshape(2, -1)
    above = lambda h: h[::-1].cumsum()[::-1] / h.sum()
    p, u = above(hp), above(hu)
    prior = float(min(1, (u[p >= PRIOR_MASS] / p[p >= PRIOR_MASS]).min()))
    model.weights = non_negative_fit(mp, sp, mu, su, prior)
    return model


def score(rows: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of ``rows`` (doc_id, held_out, f)."""
    def run(batches):
        for batch in batches:
            s = model.score(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()),
                                              pa.array((s >= threshold).astype(np.int32), pa.int32())],
                                             ["doc_id", "held_out", "score", "predicted"])
    return rows.select("doc_id", "held_out", "f").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns and without a shuffle."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            f = np.array([describe(t.encode() if t is not None else None) for t in texts])
            yield batch.filter(pa.array(model.score(f.reshape(-1, len(FEATURES))) >= threshold, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """Scores of all rows of ``docs`` (doc_id, text) by a model fitted on them and ``labels`` (doc_id, quality).

    Null, empty and very long texts are scored like any other.  A null doc_id is never held out nor labelled.
    Repeated documents count and are scored each; conflicting labels are no trusted positive.  Without positives
    every score is 1.  Empty documents: no rows.  Other columns are ignored.
    """
    rows = common.stored(features(docs), "features")
    model = fit(rows, labels)
    return score(rows, model), model


def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))[0]
