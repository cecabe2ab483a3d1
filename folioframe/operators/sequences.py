"""Decoding of score sequences.

A sequence is a row with ``steps``: an array of time steps, each an array of
class scores. Greedy decoding is a fold over the steps in array expressions;
beam search keeps a list of candidates and runs on Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import let

LOG_GAP, LEAST_SCORE = 10.0, 1e-7


def argmax(scores: Column) -> Column:
    """Index of the largest score, the first of equal ones; -1 for none."""
    return F.coalesce(F.array_position(scores, F.array_max(scores)) - 1, F.lit(-1)).cast("int")


def softmax_at(scores: Column, index: Column) -> Column:
    """Probability of a class; scores that are a distribution already (sum within 0.01 of 1, all between 0 and 1) are taken as they are."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    plain = (total > 0.99) & (total < 1.01) & F.forall(scores, lambda x: (x >= 0) & (x <= 1))
    own = F.get(scores, index)
    scaled = let(F.array_max(scores), lambda most: F.exp(own - most) / F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - most)))
    return F.when(plain, own).otherwise(scaled)


def time_major(data: Column, shape: Column, classes: int) -> Column:
    """Steps of a flat tensor [T, C] or [C, T] (leading and trailing ones of the shape are dropped); the dimension equal to ``classes`` is the classes'."""
    dims = F.filter(shape, lambda d: d > 1)
    first, second = F.get(dims, F.lit(0)), F.coalesce(F.get(dims, F.lit(1)), F.lit(1))
    classes_first = (first == classes) & (second != classes)
    t = F.when(classes_first, second).otherwise(first)
    c = F.when(classes_first, first).otherwise(second)
    at = lambda i, j: F.get(data, F.when(classes_first, j * t + i).otherwise(i * c + j).cast("int"))
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    return F.transform(up_to(t), lambda i: F.transform(up_to(c), lambda j: at(i, j)))


def best_path(seqs: DataFrame) -> DataFrame:
    """The sequences with path: (idx, prob) of the best class of each step."""
    return seqs.withColumn("path", F.transform("steps", lambda s: F.struct(argmax(s).alias("idx"), softmax_at(s, argmax(s)).alias("prob"))))


def collapse(path: Column, blank: int = 0) -> Column:
    """The path without blanks and without repeats of the step before (a blank between makes two)."""
    return let(path, lambda p: F.filter(p, lambda x, i: (x["idx"] != blank) & ((i == 0) | (x["idx"] != F.get(p, F.greatest(i - 1, F.lit(0)))["idx"]))))


def greedy(seqs: DataFrame, blank: int = 0) -> DataFrame:
    """The sequences with out: (idx, prob) of the decoded classes, prob being that of a run's first step."""
    return best_path(seqs).withColumn("out", collapse(F.col("path"), blank))


def mean_confidence(probs: Column) -> Column:
    """Mean, 0 for none."""
    return F.when(F.size(probs) > 0, F.aggregate(probs, F.lit(0.0), lambda a, x: a + x) / F.size(probs)).otherwise(0.0)


def with_tokens(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The rows with ``__tokens``: the dictionary's tokens as one array by idx, which is one broadcast row.

    A dictionary (idx, token) is a character set: idx from 0, unique, some ten thousand entries at most. Nothing of it is read while the plan is built.
    """
    top = dictionary.agg(F.max("idx").alias("top")).select(F.explode(F.sequence(F.lit(0), F.col("top").cast("int"))).alias("i"))
    known = top.join(dictionary.select(F.col("idx").alias("i"), "token"), "i", "left")
    entries = F.array_sort(F.collect_list(F.struct("i", "token")))
    one = known.agg(F.transform(entries, lambda e: e["token"]).alias("__tokens")).withColumn("__one", F.lit(1))
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one").drop("__one")


def spelled(classes: Column, tokens: Column) -> Column:
    """Text of decoded classes: class idx stands for token idx - 1; classes without one are left out."""
    return F.array_join(F.filter(F.transform(classes, lambda c: F.get(tokens, c - 1)), lambda t: t.isNotNull()), "")


def to_text(decoded: DataFrame, dictionary: DataFrame, key: str = "seq_id") -> DataFrame:
    """(key, text) of decoded sequences; ``dictionary`` (idx, token) is a character set, idx from 0 and unique."""
    rows = with_tokens(decoded.select(key, F.col("out.idx").alias("__classes")), dictionary)
    return rows.select(key, spelled(F.col("__classes"), F.col("__tokens")).alias("text"))


def _beam(steps: list[list[float]], blank: int, width: int) -> list[tuple[tuple[int, ...], float, tuple[float, ...]]]:
    """Candidates (classes, log score, class scores), best first.

    Scores are taken as they are; those up to 1e-7 are skipped, candidates over
    10 below the best so far too. A blank does not end a run: the same class
    after it is the same run. Equal sequences are not merged.
    """
    beam: list[tuple] = [((), 0.0, (), -1)]
    for scores in steps:
        best = beam[0][1] if beam else 0.0
        grown = []
        for classes, total, own, last in beam:
            if total < best - LOG_GAP:
                continue
            for c, p in enumerate(scores):
                if p is None or p <= LEAST_SCORE:
                    continue
                value = total + math.log(p)
                grown.append((classes, value, own, last) if c in (blank, last) else ((*classes, c), value, (*own, p), c))
                best = max(best, value)
        beam = sorted(grown, key=lambda x: -x[1])[:width]
    return [x[:3] for x in beam]


def beam_search(seqs: DataFrame, blank: int = 0, width: int = 10, key: str = "seq_id") -> DataFrame:
    """(key, rank, classes, log_score, confidence) of the candidates of each sequence; rank from 1."""
    kind = seqs.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, steps in zip(part[key], part["steps"], strict=True):
                for rank, (classes, total, own) in enumerate(_beam([list(s) for s in steps], blank, width), 1):
                    rows.append((k, rank, list(classes), total, sum(own) / len(own) if own else 0.0))
            yield pd.DataFrame(rows, columns=[key, "rank", "classes", "log_score", "confidence"])

    return seqs.select(key, "steps").mapInPandas(run, f"{key} {kind}, rank int, classes array<int>, log_score double, confidence double")
