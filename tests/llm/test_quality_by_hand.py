"""The quality classifier against features, scores and risk written out plainly."""

import math
from collections import Counter

import numpy as np
import pytest

from folioframe.llm import quality


def plain_features(data):
    kind = {b: i for i, b in enumerate(quality._SINGLE)}
    n = len(quality._SINGLE)
    letter = lambda b: n if 97 <= b < 123 else n + 1 if 65 <= b < 91 else n + 2 if 48 <= b < 58 else n + 3 if 128 <= b < 192 else n + 4 if b >= 192 else n + 5 if b == 9 else n + 6
    group = lambda b: 0 if 97 <= b < 123 else 1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 3 if b >= 128 else 4 if b == 32 else 5 if b == 10 else 6 if b in b".,:;?'\"-()" else 7
    kinds = Counter(kind.get(b, letter(b)) for b in data)
    pairs = Counter((group(a), group(b)) for a, b in zip(data, data[1:]))  # noqa: B905
    size = max(1, len(data))
    out = [math.sqrt(kinds[k] / size) for k in range(n + 7)] + [math.sqrt(pairs[a, b] / size) for a in range(8) for b in range(8)]
    words, lines = data.split(), data.split(b"\n")
    w, d = max(1, len(words)), len(set(words))
    out += [math.log1p(len(data)) / 10, math.log1p(len(words)) / 10, math.log1p(size / w) / 3, d / w, math.log1p(w / max(1, d))]
    return out + [len(set(lines)) / len(lines), math.log1p(len(lines) / len(set(lines))), math.log1p(size / len(lines)) / 10]


def plain_score(model, x):
    z = [min(6, max(-6, (a - m) / s)) for a, m, s in zip(x, model.mean, model.scale, strict=True)]
    h = [math.tanh(sum(a * w for a, w in zip(z, column, strict=True)) + b) for column, b in zip(model.hidden.T, model.hidden_bias, strict=True)]
    return 1 / (1 + math.exp(-(sum(a * w for a, w in zip(h, model.out, strict=True)) + float(model.out_bias[0]))))


@pytest.mark.parametrize("data", [b"", b" ", b"\n\n", "Grüße, a\tb\x00\x7f.\nGrüße!\n".encode(), b"word " * 500, bytes(range(256)) * 3])
def test_features(data, monkeypatch):
    for chunk in (1 << 20, 7):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        assert np.allclose(quality.features(data), plain_features(data), atol=1e-6)


def test_scores_of_all_documents(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    for r in docs.collect():
        want = plain_score(model, plain_features((r["text"] or "").encode()))
        assert abs(got[r["doc_id"]]["score"] - want) < 1e-4
        assert got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.5)


@pytest.mark.parametrize("prior", [0.3, 0.97])
def test_first_step_follows_the_numeric_slope_of_the_risk(prior):
    rng = np.random.default_rng(9)
    positive, unlabelled = rng.normal(0.4, 1, (30, 5)), rng.normal(0, 1, (60, 5))
    start = np.random.default_rng(5)
    first = [start.normal(0, 1 / np.sqrt(5), (5, quality.HIDDEN)).astype(np.float32), np.zeros(quality.HIDDEN, np.float32), start.normal(0, 1 / np.sqrt(quality.HIDDEN), quality.HIDDEN).astype(np.float32), np.zeros(1, np.float32)]
    model = quality.train(positive, unlabelled, prior, epochs=1)  # one batch, so one step, whose length is the same for every weight
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-2
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))

    def risks(params):
        s = lambda x: 1 / (1 + np.exp(-(np.tanh(x @ params[0] + params[1]) @ params[2] + params[3])))
        return prior * (1 - s(p)).mean(), s(u).mean() - prior * s(p).mean()

    negative = risks(first)[1] < 0

    def aim(params):
        good, bad = risks(params)
        return (-bad if negative else good + bad) + 5e-5 * sum((params[i] ** 2).sum() for i in (0, 2))

    same = total = 0
    for i, w in enumerate(first):
        for at in np.ndindex(w.shape):
            slope = 0.0
            for side in (1, -1):
                moved = [x.astype(float).copy() for x in first]
                moved[i][at] += side * 1e-5
                slope += side * aim(moved) / 2e-5
            if abs(slope) > 1e-5:
                after = (model.hidden, model.hidden_bias, model.out, model.out_bias)[i][at]
                total += 1
                same += np.sign(w[at] - after) == np.sign(slope)
    assert total > 100 and same == total
