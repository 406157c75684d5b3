"""Quality classification by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are training rows of label 1; the unlabelled rows are a sample of the corpus, whatever their labels.
The class prior p is the share of label 1 among the training rows; where they hold positives only, it is estimated from
the unlabelled rows by how often they score like positives under a positive-against-unlabelled fit. The risk

    p * R_pos(+) + max(0, R_unl(-) - p * R_pos(-))

is minimised for a logistic model over surface statistics of the text (byte classes, repetition, word and line shape);
where the second term falls below zero its gradient is reversed, as the non-negative estimator asks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import annotate, fold
from graphloom.llm.sampling import bounded, labelled, texts_of

#: Rows of each kind (trusted positives, unlabelled) that the fit reads at most.
SAMPLE = 12_000
STEPS = 600
RATE = 0.05
RIDGE = 1e-4
SEED = 3

_SYMBOLS = [c for c in range(32, 127) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)]
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
N_FEATURES = len(_SYMBOLS) + 12


def features(raw: bytes) -> np.ndarray:
    """Surface statistics of a UTF-8 text; all zero for an empty one."""
    out = np.zeros(N_FEATURES)
    if not raw:
        return out
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    k = len(_SYMBOLS)
    out[:k] = np.sqrt(count[_SYMBOLS])
    words = raw.split()
    m = max(1, len(words))
    distinct = len(set(words))
    lines = raw.split(b"\n")
    out[k:] = (
        np.sqrt(count[48:58].sum()),
        np.sqrt(count[65:91].sum()),
        np.sqrt(count[_LOWER].sum()),
        np.sqrt(count[128:].sum()),
        np.sqrt(count[10]),
        np.log1p(n) / 10,
        np.log1p(m) / 10,
        distinct / m,
        np.log1p(m / max(1, distinct)),
        np.log1p(n / m) / 3,
        len(set(lines)) / len(lines),
        np.log1p(len(lines)) / 10,
    )
    return out


def _arrays(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return _sigmoid((z * self.weight).sum(1) + self.bias)


def _descend(gradient: Callable[[np.ndarray], np.ndarray], size: int, start: float) -> np.ndarray:
    """Adam from a zero weight vector with the given bias."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = start
    for t in range(1, STEPS + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _prior_from_unlabelled(p: np.ndarray, u: np.ndarray) -> float:
    """Elkan and Noto's estimate: the mean odds of a positive-against-unlabelled fit, over those of positives."""

    def gradient(w: np.ndarray) -> np.ndarray:
        gp, gu = _sigmoid(p @ w) - 1, _sigmoid(u @ w)
        return p.T @ gp / len(p) / 2 + u.T @ gu / len(u) / 2 + RIDGE * np.append(w[:-1], 0)

    w = _descend(gradient, p.shape[1] - 1, 0.0)
    sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
    return float(np.clip(np.mean(su / (1 - su)) / np.mean(sp / (1 - sp)), 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Model:
    """Minimises the non-negative risk with the logistic loss by full-batch descent."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]) for x in (positive, unlabelled))
    if prior is None:
        prior = _prior_from_unlabelled(p, u)

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        as_positive = p.T @ (sp - 1) / len(p)
        rest = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        below = risk_of(su) - prior * risk_of(sp)
        decay = RIDGE * np.append(w[:-1], 0)
        return prior * as_positive + rest + decay if below >= 0 else decay - rest

    def risk_of(s: np.ndarray) -> float:
        return float(-np.log(np.maximum(1 - s, 1e-12)).mean())

    w = _descend(gradient, p.shape[1] - 1, float(np.log(prior / (1 - prior))))
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def train(docs: DataFrame, labels: DataFrame, training: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """A model fitted in one task to at most `sample` positives and `sample` unlabelled rows; None if there are none of either.

    training(id column) says which rows may be learnt from, for labels and unlabelled texts alike.
    """
    known = labelled(labels, id_col, label_col, training(F.col(id_col)), 2 * sample, SEED)
    share = known.agg(F.avg("label")).first()[0]
    trusted = bounded(known.where("label = 1"), id_col, sample, SEED).select(id_col, F.lit(1).alias("kind"))
    web = bounded(docs.where(training(F.col(id_col)) & F.col(id_col).isNotNull()).select(id_col), id_col, sample, SEED + 1).select(id_col, F.lit(0).alias("kind"))
    texts = texts_of(docs, trusted.union(web.distinct()), id_col, text_col)  # at most twice `sample` ids
    rows = annotate(texts, "text", [id_col, "kind"], "x array<double>", lambda: lambda batch: [pa.array(list(_arrays(batch)), pa.list_(pa.float64()))])
    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(SEED), F.col(id_col)), id_col, "kind").select("kind", "x")
    prior = None if share in (None, 1.0) else float(np.clip(share, 0.05, 0.95))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {0: [], 1: []}
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, N_FEATURES)
            for kind, part in seen.items():
                part.append(x[batch.column(0).to_numpy() == kind])
        unlabelled, positive = (np.vstack([*part, np.empty((0, N_FEATURES))]) for part in seen.values())
        if len(positive) and len(unlabelled):
            m = fit(positive, unlabelled, prior)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (m.mean, m.scale, m.weight, m.bias, m.prior)], ["mean", "scale", "weight", "bias", "prior"])

    found = ordered.mapInArrow(fitted, "mean array<double>, scale array<double>, weight array<double>, bias double, prior double").collect()
    return Model(*(np.array(v) for v in found[0][:3]), *found[0][3:]) if found else None


def scorer(model: Model | None) -> Callable[[], Callable[[list[bytes]], list[pa.Array]]]:
    return lambda: lambda texts: [pa.array(np.full(len(texts), 0.5) if model is None else model.score(_arrays(texts)), pa.float64())]


def training_fold(key: Column) -> Column:
    return fold(key, 3) != 1


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: id_col, held_out, score, predicted.

    Null and empty texts are scored as empty ones; with nothing to learn from every score is 0.5. Null ids belong to the
    fold of the empty text. Ties and repeated rows get equal scores; other columns are ignored.
    """
    model = train(docs, labels, training_fold, id_col, text_col, label_col, sample)
    rows = annotate(docs, text_col, [id_col], "score double", scorer(model))
    return rows.select(id_col, (fold(F.col(id_col), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with their columns, that score 0.5 or more.

    Null and empty texts are judged as empty ones, null ids and repeated rows like any others; with nothing to learn
    from every row stays. An empty table gives an empty result.
    """
    model = train(docs, labels, training_fold, id_col, text_col, label_col, sample)
    rows = annotate(docs, text_col, docs.columns, "score double", scorer(model))
    names = [f"c{k}" for k in range(len(docs.columns))]
    return rows.toDF(*names, "score").where("score >= 0.5").drop("score").toDF(*docs.columns)
