"""A quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; all other text is unlabelled,
a mixture of good and bad. With the share of good text (the class prior)
estimated from the scores of both, the risk of a scorer on good and bad text can be written by
positives and unlabelled text alone: prior * R_p(+) + max(0, R_u(-) - prior *
R_p(-)). The second term estimates a risk and so can't be negative; where a
batch makes it so, the step goes the other way. The scorer is a small network
on features of the whole text's bytes, trained in numpy on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Bounds of the training sample, in documents.
POSITIVES, UNLABELLED = 4000, 8000
HIDDEN = 24
CHUNK = 1 << 20

#: Kinds of bytes: fixed groups, then each ASCII mark that junk is made of by itself.
_SINGLE = b" \n.,!?;:'\"-_|/\\<>{}[]()=+*#$%&@~^`"
KINDS = len(_SINGLE) + 7


def _kinds() -> np.ndarray:
    k = np.full(256, len(_SINGLE) + 6, np.int64)  # control
    for i, b in enumerate(_SINGLE):
        k[b] = i
    n = len(_SINGLE)
    k[97:123], k[65:91], k[48:58], k[128:192], k[192:], k[9] = n, n + 1, n + 2, n + 3, n + 4, n + 5
    return k


_KIND = _kinds()
#: Kinds that follow one another, in fewer groups: letters, capitals, digits, high bytes, space, line feed, stops, other marks.
_GROUPS = 8


def _groups() -> np.ndarray:
    g = np.full(256, 7, np.int64)
    g[97:123], g[65:91], g[48:58], g[128:], g[32], g[10] = 0, 1, 2, 3, 4, 5
    g[list(b".,;:?'\"-()")] = 6
    return g


_GROUP = _groups()
FEATURES = KINDS + _GROUPS * _GROUPS + 8


def features(data: bytes) -> np.ndarray:
    """Shares of kinds of bytes and of pairs of them, and how long and how repetitive words and lines are."""
    kinds, pairs, last = np.zeros(KINDS), np.zeros(_GROUPS * _GROUPS), np.empty(0, np.int64)
    for i in range(0, len(data), CHUNK):
        b = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - i), i)
        kinds += np.bincount(_KIND[b], minlength=KINDS)
        g = np.concatenate([last, _GROUP[b]])
        pairs += np.bincount(g[:-1] * _GROUPS + g[1:], minlength=len(pairs))
        last = g[-1:]
    n = max(1, len(data))
    words, lines = data.split(), data.split(b"\n")
    w, distinct, distinct_lines = max(1, len(words)), len(set(words)), len(set(lines))
    shape = [
        np.log1p(len(data)) / 10,
        np.log1p(len(words)) / 10,
        np.log1p(n / w) / 3,
        distinct / w,
        np.log1p(w / max(1, distinct)),
        distinct_lines / len(lines),
        np.log1p(len(lines) / distinct_lines),
        np.log1p(n / len(lines)) / 10,
    ]
    return np.concatenate([np.sqrt(kinds / n), np.sqrt(pairs / n), shape]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, higher for good text."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        g = np.tanh(z @ self.hidden + self.hidden_bias) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(g.astype(np.float64), -500, 500)))


def held_out_scores(positive: np.ndarray, unlabelled: np.ndarray, parts: int = 3, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a ridge regression of positives against unlabelled rows, each row scored by a fit without its part."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-2
    p, u = (np.concatenate([np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))], axis=1) for x in (positive, unlabelled))
    of_p, of_u = rng.permutation(len(p)) % parts, rng.permutation(len(u)) % parts
    found_p, found_u = np.zeros(len(p)), np.zeros(len(u))
    for k in range(parts):
        a, b = p[of_p != k], u[of_u != k]
        a, b = (a if len(a) else p), (b if len(b) else u)
        square = a.T @ a / len(a) + b.T @ b / len(b) + 0.05 * np.eye(p.shape[1])
        w = np.linalg.solve(square, a.mean(axis=0) - b.mean(axis=0))
        found_p[of_p == k], found_u[of_u == k] = p[of_p == k] @ w, u[of_u == k] @ w
    return found_p, found_u


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least_share: float = 0.1) -> float:
    """Share of good text among the unlabelled, from positives and unlabelled text alone.

    Above any score lies the share q of the unlabelled and the share r of the
    positives; the good among the unlabelled are no more than all of them, so
    prior * r <= q and q / r bounds the prior, closely where few bad ones score so
    high. The smallest such bound, with an allowance for the spread of small
    counts and only where r is at least ``least_share``, is the estimate. It stays off 0 and 1.
    """
    if len(positive) < 2 or len(unlabelled) < 2:
        return 0.5
    p, u = map(np.sort, held_out_scores(positive.astype(np.float64), unlabelled.astype(np.float64)))
    edges = np.unique(np.quantile(p, np.linspace(0, 1 - least_share, 200)))
    r = 1 - np.searchsorted(p, edges) / len(p)
    q = 1 - np.searchsorted(u, edges) / len(u)
    spread = np.sqrt(q * (1 - q) / len(u)) + np.sqrt(r * (1 - r) / len(p))
    return float(np.clip(np.min((q + spread) / r), 0.02, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 40, seed: int = 5) -> Model:
    """Minimise the non-negative unbiased risk with the sigmoid loss."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-2
    p, u = (np.clip((x - mean) / scale, -6, 6).astype(np.float32) for x in (positive, unlabelled))
    params = [
        rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)).astype(np.float32),
        np.zeros(HIDDEN, np.float32),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32),
        np.zeros(1, np.float32),
    ]
    state, step = [[np.zeros_like(w), np.zeros_like(w)] for w in params], 0
    batches = max(1, min(len(u) // 256, 32))
    for epoch in range(epochs):
        pi, ui = np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches)
        for a, b in zip(pi, ui, strict=True):
            a = a if len(a) else rng.integers(0, len(p), 1)
            x = np.concatenate([p[a], u[b]])
            h = np.tanh(x @ params[0] + params[1])
            g = h @ params[2] + params[3]
            s = 1 / (1 + np.exp(-np.clip(g, -60, 60)))  # the loss as a bad text; 1 - s as a good one
            slope, m = s * (1 - s), len(a)
            bad_risk = s[m:].mean() - prior * s[:m].mean()
            d = np.zeros_like(g)
            if bad_risk >= 0:
                d[:m] = -prior * slope[:m] / m * 2  # good ones: their loss falls, and they leave the unlabelled ones' risk
                d[m:] = slope[m:] / len(b)
            else:
                d[:m] = prior * slope[:m] / m
                d[m:] = -slope[m:] / len(b)
            dh = d[:, None] * params[2][None, :] * (1 - h * h)
            grads = [x.T @ dh + 1e-4 * params[0], dh.sum(axis=0), h.T @ d + 1e-4 * params[2], d.sum(keepdims=True)]
            step += 1
            rate = 3e-3 * (0.3 if epoch >= epochs * 2 // 3 else 1)
            for w, q, (v1, v2) in zip(params, grads, state, strict=True):
                v1 += 0.1 * (q - v1)
                v2 += 0.001 * (q * q - v2)
                w -= (rate * (v1 / (1 - 0.9**step)) / (np.sqrt(v2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, *params)


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py() or b"") for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "x"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, x array<float>")


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Train on rows whose fold (crc32 of the id, modulo 3) is not 1; None without a positive or without unlabelled text.

    The first ``positives`` documents labelled good and the first
    ``unlabelled`` of all, by hash of the id: a bounded number of feature
    vectors reaches the driver. Rows labelled bad play no part, not in the class prior either.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    good = labels.filter((fold(F.col("doc_id"), 3) != 1) & F.col("quality").isNotNull())
    good = good.groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1").select("doc_id")
    good = good.orderBy(*order).limit(positives).withColumn("good", F.lit(True))
    ids = docs.select("doc_id").filter(fold(F.col("doc_id"), 3) != 1).distinct()
    text = ids.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled)
    picked = good.unionByName(text.withColumn("good", F.lit(False)))
    marks = sorted((r["doc_id"], r["good"]) for r in picked.collect())
    chosen = docs.sparkSession.createDataFrame(sorted({(i,) for i, _ in marks}), docs.select("doc_id").schema)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    x = {r["doc_id"]: np.array(r["x"], np.float32) for r in _features(rows.groupBy("doc_id").agg(F.min("text").alias("text"))).collect()}
    p, u = (np.array([x[i] for i, good in marks if good == want and i in x]) for want in (True, False))
    return train(p, u, class_prior(p, u)) if len(p) and len(u) else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) for each row from its whole text alone; 0.5 without a model. Null texts are empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                s = np.full(len(batch), 0.5)
            else:
                x = np.array([features(t.as_py() or b"") for t in batch.column(1)], np.float32).reshape(-1, FEATURES)
                s = model.score(x)
            yield pa.record_batch([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    found = score(docs, fit(docs, labels))
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
