"""Language identification by a convolutional network on bytes.

A text's UTF-8 bytes (A-Z in lower case) fall into windows of fixed length
that overlap by the widest filter less one, so the windows cover the whole
text. Filters of several widths read the bytes as one-hot vectors, the largest
answer of each filter in a window goes through a ReLU to a softmax over the
languages, and a document has the mean of its windows' logits. Training is
plain numpy on the driver, over a bounded sample of labelled windows; scoring
runs in Arrow batches on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_batches, fold, materialize

UNKNOWN = "und"
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bounds of the training sample: labelled documents a language, and windows a document. With many languages
#: each has fewer documents, so that there are about SAMPLE in all, but no fewer than LEAST_DOCS: every language is learned.
DOCS_A_LANGUAGE, WINDOWS_A_DOC, SAMPLE, LEAST_DOCS = 300, 3, 60_000, 10
#: Languages whose counts are broadcast; more are joined.
MANY = 50_000
#: A document's language counts as known for filtering from this score on.
LEAST_SCORE = 0.3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


@dataclass
class Model:
    languages: list[str]
    filters: list[np.ndarray]  # a width's: (width, 256, FILTERS)
    bias: np.ndarray  # (widths * FILTERS,)
    weight: np.ndarray  # (widths * FILTERS, languages)
    offset: np.ndarray  # (languages,)

    def answers(self, windows: np.ndarray, f: np.ndarray) -> np.ndarray:
        """(windows, places, FILTERS): the answers of the filters of one width at each place."""
        reach = windows.shape[1] - len(f) + 1
        z = f[0].take(windows[:, :reach], axis=0)
        for k in range(1, len(f)):
            z += f[k].take(windows[:, k : k + reach], axis=0)
        return z

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of each filter in each window, and its place."""
        best, place = [], []
        for f in self.filters:
            z = self.answers(windows, f)
            at = z.argmax(axis=1)
            place.append(at)
            best.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0])
        return np.concatenate(best, axis=1), np.concatenate(place, axis=1)

    def peaks(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.answers(windows, f).max(axis=1) for f in self.filters], axis=1)

    def logits(self, windows: np.ndarray, step: int = 64) -> np.ndarray:
        out = [np.maximum(self.peaks(windows[i : i + step]) + self.bias, 0) @ self.weight + self.offset for i in range(0, len(windows), step)]
        return np.concatenate(out) if out else np.empty((0, len(self.languages)), np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: bytes, length: int = WINDOW) -> np.ndarray:
    """All windows of a text, one a row; the last is filled with spaces."""
    step = length - max(WIDTHS) + 1
    b = _LOWER[np.frombuffer(data, np.uint8)]
    n = max(1, -(-(len(b) - length) // step) + 1) if len(b) > length else 1
    padded = np.full(step * (n - 1) + length, 32, np.uint8)
    padded[: len(b)] = b
    return np.lib.stride_tricks.sliding_window_view(padded, length)[::step]


def train(texts: list[str], languages: list[str], epochs: int = 6, seed: int = 7) -> Model:
    """Fit the network to texts (cut to one window) and their languages; short cuts of them are added, so short texts are known too."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    full = [windows_of(t.encode())[0] for t in texts]
    cut = []
    for w in full:
        n = int(np.exp(rng.uniform(np.log(8), np.log(WINDOW))))
        short = np.full(WINDOW, 32, np.uint8)
        short[:n] = w[:n]
        cut.append(short)
    x, y = np.array(full + cut), np.concatenate([y, y])
    m = len(WIDTHS) * FILTERS
    model = Model(
        names,
        [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(m, np.float32),
        rng.normal(0, 0.3, (m, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    share = np.bincount(y, minlength=len(names))
    cost = (len(y) / (len(names) * np.maximum(share, 1)))[y].astype(np.float32)  # languages count alike
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (*model.filters, model.bias, model.weight, model.offset)]
    step = 0
    for epoch in range(epochs):
        order, rate = rng.permutation(len(x)), 0.01 * 0.5 ** (epoch // 2)
        for i in range(0, len(order), 64):
            pick = order[i : i + 64]
            w, t = x[pick], y[pick]
            best, place = model.pooled(w)
            h = np.maximum(best + model.bias, 0)
            d = _softmax(h @ model.weight + model.offset)
            d[np.arange(len(t)), t] -= 1
            d *= cost[pick][:, None] / len(t)
            dh = (d @ model.weight.T) * (h > 0)
            grads = []
            for j, f in enumerate(model.filters):
                g = np.zeros_like(f)
                part, at = dh[:, j * FILTERS : (j + 1) * FILTERS], place[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(len(f)):
                    np.add.at(g[k], (np.take_along_axis(w, at + k, 1), np.arange(FILTERS)[None, :]), part)
                grads.append(g)
            grads += [dh.sum(axis=0), h.T @ d, d.sum(axis=0)]
            step += 1
            for p, g, (a, b) in zip((*model.filters, model.bias, model.weight, model.offset), grads, state, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def shares(model: Model, data: bytes) -> np.ndarray:
    """The languages' shares for a whole text, from the mean logits of all its windows."""
    total, n = np.zeros(len(model.languages)), 0
    for i in range(0, len(data), 1 << 20):
        w = windows_of(data[max(0, i - max(WIDTHS) + 1) : i + (1 << 20)])
        total += model.logits(w).sum(axis=0, dtype=np.float64)
        n += len(w)
    return _softmax(total[None, :] / n)[0]


def fit(docs: DataFrame, docs_a_language: int = DOCS_A_LANGUAGE, sample: int = SAMPLE) -> Model | None:
    """Train on rows of ``docs`` with a language whose fold (crc32 of the id, modulo 4) is not 2; None if there are none.

    Of every language the sample holds the first ``docs_a_language`` documents by hash
    (fewer where there are so many languages that they would exceed ``sample`` in all),
    and three windows of each text at most: a bounded number of short strings for each language on the driver.
    """
    rows = docs.filter((fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    labelled = materialize(rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")), "labelled")
    counts = materialize(labelled.groupBy("lang").count(), "languages")
    languages = counts.count()
    each = min(docs_a_language, max(LEAST_DOCS, sample // max(1, languages)))
    counts = F.broadcast(counts) if languages <= MANY else counts
    # Of a language only the lowest hashes are ranked, about four times as many as are taken, however many rows it has.
    share = (F.col("h") / 2.0**64 + 0.5) * F.col("count")
    some = labelled.join(counts, "lang").filter(share < 4 * each)
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    picked = some.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= each)
    picked = picked.select("doc_id", F.col("lang").alias("__lang"))
    free = F.greatest(F.lit(0), F.length("text") - WINDOW)
    cuts = [F.substring("text", (free * at).cast("int") + 1, F.lit(WINDOW)) for at in (0, 0.5, 1)][:WINDOWS_A_DOC]
    windows = rows.join(F.broadcast(picked), "doc_id").filter(F.col("lang") == F.col("__lang"))
    windows = windows.select("doc_id", "lang", F.explode(F.array_distinct(F.array(*cuts))).alias("w"))
    sample = sorted((r["doc_id"], r["lang"], r["w"]) for r in windows.collect())
    return train([x[2] for x in sample], [x[1] for x in sample]) if sample else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) from whole texts; a text that is null or has no letter is ``und`` with score 0.

    Without a model (no labelled rows) every text is ``und``. Equal texts have
    equal results; the id, language and source of a row play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, letters = batch.columns
            found = [(UNKNOWN, 0.0)] * len(ids)
            if model is not None:
                for at, (text, letter) in enumerate(zip(texts, letters.to_pylist(), strict=True)):
                    if not letter:
                        continue
                    p = shares(model, text.as_py())
                    found[at] = (model.languages[int(p.argmax())], float(p.max()))
            names, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.record_batch([ids, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), letter.alias("letter"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fit on the labelled rows outside the held-out fold, then predict every row."""
    found = predict(docs, fit(docs))
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, model: Model | None, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is found with ``least_score`` or more; ``und`` goes."""
    names = docs.columns
    byte_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts = zip(table["text"], table["__letter"].to_pylist(), strict=True)
            keep = [letter and model is not None and bool(shares(model, text.as_py().encode()).max() >= least_score) for text, letter in texts]
            yield from table.filter(pa.array(keep, pa.bool_())).select(names).to_batches()

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn("__letter", letter).mapInArrow(run, docs.schema)
