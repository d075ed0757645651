"""Quality classifier: a linear hinge-loss model over naive Bayes scaled n-gram indicators.

Features are the n-grams that a text holds: byte trigrams, words, word pairs, how far
runs of one repeated word reach and their share, hashed to a table of fixed size.  Indicators are scaled
by the log-count ratio of their class counts; dual coordinate descent fits the hinge loss;
a sigmoid fitted on rows that the descent didn't see turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaguelens.llm.common import hash_sample

BITS = 18
#: Most labelled documents that a fit takes, chosen by a hash of the id.
FIT_ROWS = 6000


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct feature numbers of the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    shift = np.uint64(64 - bits)
    parts = []
    if len(raw) >= 3:
        seen = np.zeros(0, np.uint32)
        data = np.frombuffer(raw, np.uint8)
        for at in range(0, len(data) - 2, 1 << 20):
            b = data[at : at + (1 << 20) + 2].astype(np.uint32)
            seen = np.union1d(seen, b[:-2] << 16 | b[1:-1] << 8 | b[2:])
        parts.append(seen.astype(np.uint64) + np.uint64(1 << 40))
    if words:
        w = np.fromiter(map(crc32, words), np.uint64, len(words))
        parts += [np.unique(w), np.unique(w[:-1] * np.uint64(0x100000001B3) ^ w[1:] + np.uint64(1 << 41))]
        same = np.concatenate(([False], w[1:] == w[:-1], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        longest = int((edge[1::2] - edge[::2]).max()) if len(edge) else 0
        parts.append(np.arange(longest.bit_length(), dtype=np.uint64) + np.uint64(1 << 42))
        parts.append(np.arange(8 * int(same.sum()) // len(words), dtype=np.uint64) + np.uint64(1 << 43))
    if not parts:
        return np.zeros(0, np.int32)
    return np.unique((np.concatenate(parts) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int32)


@dataclass
class QualityModel:
    """score = sigmoid(slope * margin + offset); margin = bias + sum of weights over the root of their number."""

    weight: np.ndarray
    bias: float = 0.0
    slope: float = 0.0
    offset: float = 0.0

    def margin(self, found: np.ndarray) -> float:
        return self.bias + float(self.weight[found].sum(dtype=np.float64)) / max(1, len(found)) ** 0.5

    def score(self, found: np.ndarray) -> float:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -50, 50)))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; the bias is one more feature."""
    alpha, w, bias = np.zeros(len(rows)), np.zeros(len(ratio)), 0.0

    def values(i: int) -> np.ndarray:
        # anew each time, as those of all rows would take more of the driver's memory than the rows
        return ratio[rows[i]] / max(1, len(rows[i])) ** 0.5

    norm = np.array([(v := values(i)) @ v + 1 for i in range(len(rows))])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            v = values(i)
            gap = y[i] * (w[rows[i]] @ v + bias) - 1
            step = min(max(alpha[i] - gap / norm[i], 0.0), c) - alpha[i]
            if step:
                alpha[i] += step
                w[rows[i]] += step * y[i] * v
                bias += step * y[i]
                most = max(most, abs(step))
        if most < 1e-3 * c:
            break
    return w, bias


def calibrate(margin: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a sigmoid by Newton steps, with smoothed targets."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g, h = p - target, p * (1 - p) + 1e-9
        grad = np.array([g @ margin, g.sum()])
        hess = np.array([[h @ margin**2 + 1e-6, h @ margin], [h @ margin, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 0.0), float(b)


def fit(rows: list[np.ndarray], label: np.ndarray, bits: int = BITS, c: float = 1.0, smooth: float = 1.0, epochs: int = 30, seed: int = 11) -> QualityModel:
    """Fit on feature lists and 0/1 labels; one class only: its smoothed share for every text."""
    n, ones = len(label), int(label.sum())
    if ones in (0, n):
        share = (ones + 1) / (n + 2)
        return QualityModel(np.zeros(1 << bits, np.float32), offset=float(np.log(share / (1 - share))))
    held = np.random.default_rng(seed).permutation(n) % 5 == 0
    if len(set(label[~held])) < 2 or len(set(label[held])) < 2:
        held = np.zeros(n, bool)
    p, q = np.full(1 << bits, smooth), np.full(1 << bits, smooth)
    for r, y, out in zip(rows, label, held):
        if not out:
            (p if y == 1 else q)[r] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    y = np.where(label == 1, 1.0, -1.0)
    take = np.flatnonzero(~held)
    w, bias = descend([rows[i] for i in take], y[take], ratio, c, epochs, seed)
    model = QualityModel((w * ratio).astype(np.float32), bias)
    on = np.flatnonzero(held) if held.any() else np.arange(n)
    model.slope, model.offset = calibrate(np.array([model.margin(rows[i]) for i in on]), label[on])
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on at most ``fit_rows`` labelled documents.

    Rows of ``labels`` count where ``usable`` (a condition on its id column) holds and the
    label is 0 or 1; contradicting labels of an id count as 0.  Only feature numbers of
    the sample reach the driver.
    """
    named = labels.where(usable & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    sample = hash_sample(named, "id", fit_rows, named.count())
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(sample), "id")
    texts = texts.groupBy("id", "y").agg(F.min("t").alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "f": [features(t).tobytes() for t in pdf["t"]]})

    # the lists are views of Arrow's buffers: rows of objects would stay in the driver's memory
    got = texts.mapInPandas(run, f"id {dict(labels.dtypes)[id_col]}, y int, f binary").toArrow()
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    found = [np.frombuffer(f.as_buffer(), np.int32) for f in got["f"]]
    return fit([found[i] for i in order], got["y"].to_numpy().astype(int)[order])


def score_documents(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with a double column ``score``: 0 to 1, higher where label 1 is likelier.

    Null and empty texts have no feature and get the score of the bias; rows and columns
    stay as they are (an own column named ``score`` is replaced).
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sent.value.score(features(t)) for t in texts], dtype=float)

    return docs.withColumn("score", score(F.col(text_col)))
