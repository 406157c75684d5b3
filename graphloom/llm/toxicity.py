"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, its pairs of adjacent words and its pairs with one word
between. The fit is online, with a learning rate of its own for each coordinate and an L1 term that leaves most weights
at exactly zero, so the model is a short list of (index, weight). One task follows the sampled rows as a stream, as
often as there are epochs, and holds two numbers for each coordinate, whatever the length of the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import annotate, discard, fold, materialize
from graphloom.llm.decontaminate import words_of
from graphloom.llm.sampling import labelled, texts_of

#: Labelled rows that the fit reads at most: those whose ids have the smallest hashes.
SAMPLE = 12_000
EPOCHS = 6
BITS = 21
ALPHA, BETA, L1, L2 = 3.0, 1.0, 5.0, 0.05
SEED = 2
_PART = 1 << 16


class _Hashes(dict):
    """Word to hash; forgets everything when it has grown to its bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = zlib.crc32(word)
        return h


def hashed(words: list[bytes], cache: _Hashes) -> Iterator[np.ndarray]:
    """Feature indices of a text, repeats included, in parts of bounded size."""
    for at in range(0, max(1, len(words)), _PART):
        part = words[at : at + _PART + 2]
        h = np.fromiter(map(cache.__getitem__, part), np.uint64, len(part))
        n = min(len(part), _PART)
        one = h[:n] * np.uint64(0x9E3779B97F4A7C15)
        two = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:] * np.uint64(0x165667B19E3779F9) + np.uint64(1))[:n]
        skip = (h[:-2] * np.uint64(0xD6E8FEB86659FD93) + h[2:] * np.uint64(0xA0761D6478BD642F) + np.uint64(2))[:n]
        x = np.concatenate([one, two, skip])
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        yield (x >> np.uint64(64 - BITS)).astype(np.int64)


def distinct(words: list[bytes], cache: _Hashes) -> np.ndarray:
    return np.unique(np.concatenate([np.unique(p) for p in hashed(words, cache)]))


@dataclass(frozen=True)
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.weight
        return out


class Ftrl:
    """The proximally regularised leader; the last coordinate is the bias, which L1 spares."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n, self.size = np.zeros(size + 1), np.zeros(size + 1), size

    def weights(self, x: np.ndarray) -> np.ndarray:
        z = self.z[x]
        l1 = np.where(x == self.size, 0.0, L1)
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((BETA + np.sqrt(self.n[x])) / ALPHA + L2)

    def learn(self, x: np.ndarray, y: int) -> None:
        """One step with the rates of the row's own coordinates."""
        x = np.append(x, self.size)
        w, n = self.weights(x), self.n[x]
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        self.z[x] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[x] = n + g * g

    def model(self) -> Model:
        w = self.weights(np.arange(self.size + 1))
        index = np.flatnonzero(w[:-1])
        return Model(index, w[index].astype(np.float32), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, epochs: int = EPOCHS) -> Model:
    """A model fitted in one task to at most `sample` labelled rows outside the held-out fold; all of each row's features count."""
    known = labelled(labels, id_col, label_col, fold(F.col(id_col), 5) != 0, sample, SEED).withColumn("order", F.xxhash64(F.lit(SEED + 1), F.col(id_col)))
    texts = texts_of(docs, known, id_col, text_col)

    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        cache = _Hashes()
        return lambda batch: [pa.array([distinct(words_of(t), cache).astype(np.int32).tobytes() for t in batch], pa.binary())]

    rows = materialize(annotate(texts, "text", [id_col, "order", "label"], "x binary", make), "features")
    # All epochs are the same pass, so it does not matter in which order the one task gets them.
    one = rows.coalesce(1).sortWithinPartitions("order", id_col).select("label", "x")
    passes = reduce(lambda a, b: a.union(b), [one] * epochs).coalesce(1)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = Ftrl()
        for batch in batches:
            for y, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                leader.learn(np.frombuffer(x.as_buffer(), np.int32).astype(np.int64), y)
        m = leader.model()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(m.index, -1), pa.int64()), pa.array(np.append(m.weight, m.bias).astype(np.float64))], ["index", "weight"])

    found = passes.mapInArrow(fit, "index long, weight double").collect()  # 2^BITS rows at most, a few thousand in practice
    discard(rows)
    pairs = [(r["index"], r["weight"]) for r in found if r["index"] >= 0]
    index, weight = (np.array([p[k] for p in pairs], t) for k, t in ((0, np.int64), (1, np.float32)))
    return Model(index, weight, next((r["weight"] for r in found if r["index"] < 0), 0.0))


def scorer(model: Model) -> Callable[[], Callable[[list[bytes]], list[pa.Array]]]:
    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        cache, table = _Hashes(), model.table()

        def one(raw: bytes) -> float:
            hit = [p[table[p] != 0] for p in hashed(words_of(raw), cache)]
            w = float(table[np.unique(np.concatenate(hit))].astype(np.float64).sum()) + model.bias
            return 1 / (1 + float(np.exp(-max(-35.0, min(35.0, w)))))

        return lambda texts: [pa.array([one(t) for t in texts], pa.float64())]

    return make


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: id_col, held_out, score, predicted.

    Null and empty texts get the score of a text without words; with nothing to learn from every score is 0.5. Null ids
    belong to the fold of the empty text. Ties and repeated rows get equal scores; other columns are ignored.
    """
    model = train(docs, labels, id_col, text_col, label_col, sample)
    rows = annotate(docs, text_col, [id_col], "score double", scorer(model))
    return rows.select(id_col, (fold(F.col(id_col), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
