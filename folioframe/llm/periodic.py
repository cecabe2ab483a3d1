"""Runs of words with a period, by probing a harmonic grid.

A run is a stretch of words in which words q apart are the same, at least two
periods and LEAST words long, that no neighbouring word extends; q is its
smallest period. A run of period p covers two neighbouring multiples of p
whatever its place, so it is enough to compare the words at jp and (j+1)p, for
all p: n log n pairs. A pair that survives, and whose surroundings agree at
offsets of powers of two, is extended in both directions by comparing chunks of
the word numbers. Pairs inside a found run of a period that divides p can only
give that run again, and are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import let
from .common import slices

#: Words of a run at least.
LEAST = 12
#: Texts up to this number of words share one grid, made once.
SHARED = 4096
#: Word numbers that are compared at a time, at first and at most.
CHUNK, CHUNKS = 64, 1 << 16


def _shared_grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mate, period, ends): all pairs (mate - period, mate) of neighbouring multiples of the period, by mate; those below n are the first ends[n]."""
    found = [(np.arange(p, SHARED, p), p) for p in range(1, SHARED // 2 + 1)]
    mate = np.concatenate([m for m, _ in found])
    period = np.repeat([p for _, p in found], [len(m) for m, _ in found])
    order = np.argsort(mate, kind="stable")
    mate, period = mate[order].astype(np.int32), period[order].astype(np.int32)
    return mate, period, np.searchsorted(mate, np.arange(SHARED + 1))


_GRID: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _equal_pairs(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, period) of the grid's pairs of equal words, in parts by period, each with no more pairs than there are words."""
    n = len(ids)
    if n <= SHARED:
        if not _GRID:
            _GRID.append(_shared_grid())
        mate, period, ends = (x for x in _GRID[0])
        mate, period = mate[: ends[n]], period[: ends[n]]
        hit = np.flatnonzero(ids[mate] == ids[mate - period])
        yield (mate[hit] - period[hit]).astype(np.int64), period[hit].astype(np.int64)
        return
    low = 1
    while low <= n // 2:
        high = min(2 * low, n // 2 + 1)
        starts, periods = [], []
        if low <= isqrt(n):  # few periods with many multiples
            for p in range(low, high):
                hit = np.flatnonzero(ids[: n - p : p] == ids[p::p])
                starts.append(hit * p)
                periods.append(np.full(len(hit), p))
        else:  # many periods with few multiples: the same multiple of all of them
            for j in range(n // low):
                p = np.arange(low, min(high, (n - 1) // (j + 1) + 1))
                hit = p[ids[j * p] == ids[(j + 1) * p]]
                starts.append(j * hit)
                periods.append(hit)
        yield np.concatenate(starts), np.concatenate(periods)
        low = high


def _probed(ids: np.ndarray, start: np.ndarray, period: np.ndarray, least: int) -> np.ndarray:
    """Whether a run may go on from each pair, forwards or backwards: half of what it needs, by offsets of powers of two."""
    need = np.maximum(period, least - period) // 2
    forward, backward = np.ones(len(start), bool), np.ones(len(start), bool)
    last, offset = len(ids) - 1, 1
    while len(need) and offset <= need.max():
        asked = offset <= need
        a, b = start + offset, start + period + offset
        forward &= ~asked | (b <= last) & (ids[np.minimum(a, last)] == ids[np.minimum(b, last)])
        a, b = start - offset, start + period - offset
        backward &= ~asked | (a >= 0) & (ids[np.maximum(a, 0)] == ids[np.maximum(b, 0)])
        offset *= 2
    return forward | backward


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first values are equal."""
    at, step = 0, CHUNK
    while at < len(a):
        differ = a[at : at + step] != b[at : at + step]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = at + step, min(2 * step, CHUNKS)
    return len(a)


def _inside(found: tuple[list[int], list[int]], start: np.ndarray, mate: np.ndarray) -> np.ndarray:
    """Whether pairs lie in one of the runs of a period, given as starts and ends in their order; such runs overlap by less than a period."""
    begins, ends = (np.array(x) for x in found)
    at = np.searchsorted(begins, start, "right") - 1
    return (at >= 0) & (mate < ends[np.maximum(at, 0)])


def runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period."""
    n = len(ids)
    known: dict[int, tuple[list[int], list[int]]] = {}  # runs by their smallest period
    spans: set[tuple[int, int]] = set()
    out = []
    for start, period in _equal_pairs(ids) if n >= least else ():
        keep = (2 * period <= n) & _probed(ids, start, period, least)
        start, period = start[keep], period[keep]
        order = np.lexsort((start, period))
        start, period = start[order], period[order]
        for p, a, b in zip(*_groups(period), strict=True):
            own = start[a:b]
            for q in [q for q in known if p % q == 0] if len(known) < p else _divisors(p):
                if q in known and len(own):
                    own = own[~_inside(known[q], own, own + p)]
            i = 0
            while i < len(own):
                s = int(own[i])
                ahead = _agree(ids[s : n - p], ids[s + p :])
                behind = _agree(ids[:s][::-1], ids[p : s + p][::-1])
                begin, end = s - behind, s + p + ahead
                if end - begin >= max(least, 2 * p) and (begin, end) not in spans:
                    spans.add((begin, end))
                    out.append((begin, end - begin, p))
                    starts, ends = known.setdefault(p, ([], []))
                    starts.append(begin)
                    ends.append(end)
                i = max(i + 1, int(np.searchsorted(own, end - p)))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _groups(period: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Distinct values of a sorted array, and where each begins and ends."""
    if not len(period):
        return [], [], []
    cuts = np.flatnonzero(np.diff(period)) + 1
    begins = np.r_[0, cuts]
    return period[begins].tolist(), begins.tolist(), np.r_[cuts, len(period)].tolist()


def _divisors(p: int) -> list[int]:
    small = [q for q in range(1, isqrt(p) + 1) if p % q == 0]
    return small + [p // q for q in small if q * q != p]


def collapse(data: bytes, least: int = LEAST) -> tuple[list[tuple[int, int, int]], bytes]:
    """The runs of a text's words, and the text without what follows the first period of each, single spaces between words."""
    words = data.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    found = runs(ids, least) if len(number) < len(words) else []
    if found:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
    return found, b" ".join(words)


RUN = "struct<start:long,length:long,period:long>"


def collapsed(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, runs, collapsed): a row for each row of ``docs``; runs by start, then period; collapsed is the text without repeats.

    Words are what ASCII white space separates. Null and empty texts have no
    runs and an empty collapsed text; null doc_ids stay, equal rows give
    equal rows, no rows give none; other columns are ignored. A text is one task's work, whatever its length.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                both = [collapse(t.as_py() or b"", least) for t in batch.column(1)]
                found = [[{"start": s, "length": k, "period": p} for s, k, p in r] for r, _ in both]
                texts = pa.array([t for _, t in both], pa.binary()).cast(pa.string(), safe=False)
                yield pa.record_batch([batch.column(0), pa.array(found, run_type), texts], names=["doc_id", "runs", "collapsed"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, runs array<{RUN}>, collapsed string")


# ---- planted repeats and digests ----------------------------------------------------


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): ``docs`` in which a tenth of the texts, by crc32 of doc_id, repeat a stretch of their words to the end.

    Such a text's words are joined by single spaces; rows without doc_id and texts without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    spaces = F.lit(" \t\n\x0b\x0c\r")

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        source = lambda a, p: F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")
        return let(F.struct(a.alias("a"), p.alias("p")), lambda x: source(x["a"], x["p"]))

    trimmed = F.btrim("text", spaces)
    text = F.when((h % 10 == 0) & (trimmed != ""), let(F.split(trimmed, r"[\x20\x09-\x0D]+"), repeat)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def digested(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of :func:`collapsed` rows; the run is the longest."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(F.transform("runs", line), "").alias("lines"), "collapsed")
    length = -F.col("best.shorter")
    return rows.select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
