"""Probability maps: thresholds, statistics and morphology.

A map is a row with its values as one array in raster order (``p``), of a
given width. Whatever concerns one map only is an array expression over that
row, so no statistic of a map needs a shuffle; windows run on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AdaptiveThresholds, Morphology

BIMODAL_BINS, OTSU_BINS = 50, 256


def foreground(maps: DataFrame, threshold: float) -> DataFrame:
    """(image_id, pos, p): the values at or above the threshold."""
    return maps.select("image_id", F.posexplode("p").alias("pos", "p")).filter(F.col("p") >= threshold)


def _total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def histogram(maps: DataFrame, bins: int) -> DataFrame:
    """(image_id, bin, n): the bins that have values."""
    values = maps.select("image_id", F.explode("p").alias("v"))
    bin_ = F.least(F.floor(F.col("v") * (bins - 1)), F.lit(bins - 1)).cast("int")
    return values.groupBy("image_id", bin_.alias("bin")).agg(F.count("*").alias("n"))


def statistics(maps: DataFrame) -> DataFrame:
    """The maps with n, mean, sd (population), median (upper), least, most, span, high (share above 0.5) and sorted values."""
    rows = maps.filter(F.size("p") > 0).withColumn("sorted", F.array_sort("p")).withColumn("n", F.size("p"))
    rows = rows.withColumn("mean", _total(F.col("p")) / F.col("n"))
    square = F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x) / F.col("n") - F.col("mean") * F.col("mean")
    return rows.select(
        "*",
        F.sqrt(F.greatest(F.lit(0.0), square)).alias("sd"),
        F.get("sorted", F.floor(F.col("n") / 2).cast("int")).alias("median"),
        F.array_min("p").alias("least"),
        F.array_max("p").alias("most"),
        (F.array_max("p") - F.array_min("p")).alias("span"),
        (F.size(F.filter("p", lambda x: x > 0.5)) / F.col("n")).alias("high"),
    )


def _bins(maps: DataFrame, bins: int) -> DataFrame:
    """(image_id, h, n, total): the histogram as an array of (bin, n) in the order of the bins, its sum and that of bin * n."""
    cells = F.struct("bin", F.col("n").cast("long").alias("n"))
    return histogram(maps, bins).groupBy("image_id").agg(
        F.array_sort(F.collect_list(cells)).alias("h"), F.sum("n").alias("n"), F.sum(F.col("bin") * F.col("n")).alias("total")
    )


def bimodality(maps: DataFrame) -> DataFrame:
    """(image_id, bimodality): 1 for two or more strict peaks of over a hundredth of the values, 0.5 for one, 0 for none."""
    rows = _bins(maps, BIMODAL_BINS)
    least = F.floor(F.col("n") / 100)
    # The histogram has no empty bins, so a neighbour is the one before or after in the array if it is next to it.
    size = lambda i, bin_: F.when(F.get("h", i)["bin"] == bin_, F.get("h", i)["n"]).otherwise(0)

    def peak(c: Column, i: Column) -> Column:
        before = F.when(i > 0, size(F.greatest(i - 1, F.lit(0)), c["bin"] - 1)).otherwise(0)
        after = F.coalesce(size(i + 1, c["bin"] + 1), F.lit(0))
        return (c["bin"] > 0) & (c["bin"] < BIMODAL_BINS - 1) & (c["n"] > before) & (c["n"] > after) & (c["n"] > least)

    peaks = F.filter("h", peak)
    return rows.select("image_id", F.when(F.size(peaks) >= 2, 1.0).when(F.size(peaks) == 1, 0.5).otherwise(0.0).alias("bimodality"))


def otsu(maps: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """(image_id, threshold, variance, confidence): the first bin at which the variance between both sides is largest."""
    zero = F.lit(0).cast("long")
    rows = _bins(maps, OTSU_BINS)
    # Weight and sum change only at bins that have values, so only these can be the first best.
    start = F.struct(zero.alias("w"), zero.alias("s"), F.lit(0.0).alias("best"), F.lit(0).alias("at"))

    def step(a: Column, c: Column) -> Column:
        w, s = a["w"] + c["n"], a["s"] + c["bin"] * c["n"]
        front = F.col("n") - w
        gap = s / w - (F.col("total") - s) / front
        variance = F.when(front > 0, w.cast("double") * front * gap * gap).otherwise(0.0)
        more = variance > a["best"]
        return F.struct(w.alias("w"), s.alias("s"), F.when(more, variance).otherwise(a["best"]).alias("best"), F.when(more, c["bin"]).otherwise(a["at"]).alias("at"))

    rows = rows.withColumn("found", F.aggregate("h", start, step))
    return rows.select(
        "image_id",
        (F.col("found.at") / F.lit(OTSU_BINS - 1.0) * multiplier).alias("threshold"),
        F.col("found.best").alias("variance"),
        F.least(F.col("found.best") / (F.col("n").cast("double") * F.col("n")), F.lit(1.0)).alias("confidence"),
    )


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def histogram_thresholds(maps: DataFrame) -> DataFrame:
    """(image_id, db, box, confidence) from mean, deviation, bimodality and the share of high values."""
    rows = statistics(maps).join(bimodality(maps), "image_id")
    two, flat = F.col("bimodality") > 0.7, F.col("bimodality") < 0.3
    db = F.col("mean") - F.when(two, 0.3).when(flat, 0.7).otherwise(0.5) * F.col("sd")
    box = F.col("mean") + F.when(two, 0.3).when(flat, 0.1).otherwise(0.2) * F.col("sd")
    db = db + F.when(F.col("high") > 0.3, 0.1).when(F.col("high") < 0.05, -0.1).otherwise(0.0)
    box = box + F.when(F.col("high") > 0.3, 0.1).when(F.col("high") < 0.05, -0.05).otherwise(0.0)
    sure = F.col("span") * (0.5 + 0.5 * F.col("bimodality"))
    return rows.select("image_id", _clamp(db, 0.0, 1.0).alias("db"), _clamp(box, 0.0, 1.0).alias("box"), sure.alias("confidence"))


def dynamic_thresholds(maps: DataFrame) -> DataFrame:
    """(image_id, db, box, confidence) from order statistics at n/4, 3n/4 and 9n/10, rounded down."""
    rows = statistics(maps)
    rank = lambda a, b: F.get("sorted", F.floor(F.col("n") * a / b).cast("int"))
    p25, p75, p90 = rank(1, 4), rank(3, 4), rank(9, 10)
    db = F.when(F.col("span") > 0.8, p25 + 0.3 * (p75 - p25)).otherwise(F.col("mean") - 0.5 * F.col("sd"))
    box = F.when(F.col("high") > 0.2, p75).otherwise(F.col("median") + 0.2 * (p90 - F.col("median")))
    return rows.select("image_id", db.alias("db"), box.alias("box"), (F.col("span") * F.least(p75 - p25, F.lit(1.0))).alias("confidence"))


def thresholds(maps: DataFrame, cfg: AdaptiveThresholds) -> DataFrame:
    """(image_id, db, box, confidence, method) within the configured bounds; maps without values have the fixed ones."""
    fixed = maps.select("image_id", F.lit(0.3).alias("db"), F.lit(0.5).alias("box"), F.lit(0.0).alias("confidence"))
    if not cfg.enabled:
        return fixed.withColumn("method", F.lit("disabled"))
    if cfg.method == "otsu":
        found = otsu(maps, cfg.otsu_multiplier).select("image_id", F.col("threshold").alias("db"), (F.col("threshold") + 0.2).alias("box"), "confidence")
    elif cfg.method == "histogram":
        found = histogram_thresholds(maps)
    elif cfg.method == "dynamic":
        found = dynamic_thresholds(maps)
    else:
        found = fixed
    db, box = _clamp(F.col("db"), cfg.min_db, cfg.max_db), _clamp(F.col("box"), cfg.min_box, cfg.max_box)
    box = F.when(box < db, F.least(db + 0.1, F.lit(cfg.max_box))).otherwise(box)
    name = cfg.method if cfg.method in ("otsu", "histogram", "dynamic") else "fallback"
    return found.select("image_id", db.alias("db"), box.alias("box"), "confidence", F.lit(name).alias("method"))


# ---- morphology ------------------------------------------------------------------


def _window(stack: np.ndarray, half: int, axis: int, fold: np.ufunc, edge: float) -> np.ndarray:
    """Fold the values in reach along one axis; cells outside the map count as ``edge``."""
    pad = [(0, 0)] * stack.ndim
    pad[axis] = (half, half)
    wide = np.pad(stack, pad, constant_values=edge)
    n = stack.shape[axis]
    out = wide.take(range(n), axis=axis)
    for d in range(1, 2 * half + 1):
        out = fold(out, wide.take(range(d, d + n), axis=axis))
    return out


def morph(stack: np.ndarray, operation: str, half: int) -> np.ndarray:
    """Dilate, erode or smooth maps (maps, rows, columns): windows are products of ranges, so one axis follows the other."""
    if operation == "smooth":
        total, cells = (_window(_window(a, half, 2, np.add, 0.0), half, 1, np.add, 0.0) for a in (stack, np.ones_like(stack)))
        return total / cells
    fold, edge = (np.maximum, 0.0) if operation == "dilate" else (np.minimum, 1.0)
    return _window(_window(stack, half, 2, fold, edge), half, 1, fold, edge)


STEPS = {"dilate": ("dilate",), "erode": ("erode",), "smooth": ("smooth",), "opening": ("erode", "dilate"), "closing": ("dilate", "erode")}


def morphology(maps: DataFrame, cfg: Morphology, width: int) -> DataFrame:
    """(image_id, p): the maps after the operation; a kernel or a number of iterations of 0 or less leaves them.

    Windows are squares of 2 * (kernel // 2) + 1; dilation is at least 0,
    erosion at most 1, smoothing the mean of the cells inside the map. Whole
    maps stay in their rows, so there is no shuffle; maps of one size in an
    Arrow batch are done together.
    """
    if cfg.operation == "none" or cfg.kernel <= 0 or cfg.iterations <= 0:
        return maps
    if cfg.operation not in STEPS:
        raise ValueError(f"unknown operation {cfg.operation}")
    half, steps = cfg.kernel // 2, STEPS[cfg.operation] * cfg.iterations
    kind = maps.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(pc.fill_null(pc.list_value_length(batch.column(1)), 0))
            flat, start = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                stack = flat[start[rows][:, None] + np.arange(n)].reshape(len(rows), -1, width)
                for step in steps if n else ():
                    stack = morph(stack, step, half)
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(n))
                done = pa.ListArray.from_arrays(offsets, pa.array(stack.reshape(-1)))
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), done], names=["image_id", "p"])

    return maps.select("image_id", "p").mapInArrow(run, f"image_id {kind}, p array<double>")


def long_form(maps: DataFrame, width: int) -> DataFrame:
    """(image_id, y, x, p)."""
    rows = maps.select("image_id", F.posexplode("p").alias("pos", "p"))
    return rows.select("image_id", F.floor(F.col("pos") / width).cast("int").alias("y"), (F.col("pos") % width).cast("int").alias("x"), "p")
