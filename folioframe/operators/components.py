"""Connected components of probability maps, their statistics and confidences.

Labelling is the one kernel here that columns can't express; it works on Arrow
batches of whole maps, stacked so that a batch is labelled at once, and needs
no shuffle. All that follows is plain aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label(mask: np.ndarray) -> np.ndarray:
    """Labels of the 4-connected components of a mask: 0 outside, then 1, 2, ... in raster order of their first cells."""
    height, width = mask.shape
    edge = np.zeros((height, width + 2), np.int8)
    edge[:, 1:-1] = mask
    turn = np.diff(edge, axis=1)
    row, start = np.nonzero(turn == 1)  # a run of cells in a row: its row, first cell and the cell after its last
    end = np.nonzero(turn == -1)[1]
    n = len(row)
    out = np.zeros((height, width), np.int64)
    if not n:
        return out
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    firsts = np.searchsorted(row, np.arange(height + 1))
    for y in range(1, height):
        i, j = firsts[y - 1], firsts[y]
        while i < firsts[y] and j < firsts[y + 1]:
            if start[i] < end[j] and start[j] < end[i]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(n)])
    number = np.cumsum(roots == np.arange(n))[roots]
    length = end - start
    place = np.repeat(row * width + start - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
    out.reshape(-1)[place] = np.repeat(number, length)
    return out


def components(maps: DataFrame, threshold: float, width: int) -> DataFrame:
    """(image_id, y, x, p, label) for each value at or above the threshold; maps are arrays ``p`` of rows of ``width``."""
    kind = maps.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0), batch.column(1)
            flat = values.flatten().to_numpy(zero_copy_only=False)
            sizes = np.array([len(v) if v.is_valid else 0 for v in values], np.int64)
            heights = sizes // width
            gaps = np.cumsum(heights + 1) - (heights + 1)  # each map's first row; an empty row follows each
            owner = np.repeat(np.arange(len(sizes)), sizes)
            inner = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            tall = np.zeros((int((heights + 1).sum()), width), bool)
            tall.reshape(-1)[np.repeat(gaps * width, sizes) + inner] = flat >= threshold
            labels = label(tall).reshape(-1)[np.repeat(gaps * width, sizes) + inner]
            on = labels > 0
            owner, inner, labels = owner[on], inner[on], labels[on]
            least = np.full(len(sizes), np.iinfo(np.int64).max)
            np.minimum.at(least, owner, labels)
            columns = [ids.take(pa.array(owner)), pa.array((inner // width).astype(np.int32)), pa.array((inner % width).astype(np.int32)), pa.array(flat[on]), pa.array(labels - least[owner] + 1)]
            yield pa.record_batch(columns, names=["image_id", "y", "x", "p", "label"])

    return maps.select("image_id", "p").mapInArrow(run, f"image_id {kind}, y int, x int, p double, label long")


def component_stats(cells: DataFrame) -> DataFrame:
    """(image_id, label, n, sum_p, sum_sq, max_p, min_x, min_y, max_x, max_y)."""
    return cells.groupBy("image_id", "label").agg(
        F.count("*").alias("n"),
        F.sum("p").alias("sum_p"),
        F.sum(F.col("p") * F.col("p")).alias("sum_sq"),
        F.max("p").alias("max_p"),
        F.min("x").alias("min_x"),
        F.min("y").alias("min_y"),
        F.max("x").alias("max_x"),
        F.max("y").alias("max_y"),
    )


def confidence(method: str = "mean", gamma: float = 0.0) -> Column:
    """A component's confidence from its statistics, between 0 and 1.

    mean, max, or mean_var: the mean, less up to half of it as the variance
    nears mean * (1 - mean). A gamma other than 0 or 1 is an exponent.
    """
    mean = F.col("sum_p") / F.col("n")
    if method == "max":
        found = F.col("max_p")
    elif method == "mean_var":
        variance = F.greatest(F.lit(0.0), F.col("sum_sq") / F.col("n") - mean * mean)
        room = mean * (1 - mean)
        ratio = F.when(room > 1e-6, F.least(F.greatest(variance / room, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        found = mean * (1 - 0.5 * ratio)
    else:
        found = mean
    if gamma > 0 and gamma != 1:
        found = F.pow(found, F.lit(gamma))
    return F.least(F.greatest(found, F.lit(0.0)), F.lit(1.0))


def boxes(stats: DataFrame, map_width: int, map_height: int) -> DataFrame:
    """Adds the box of each component: (bx0, by0, bx1, by1), one past its last cell, within the map."""
    return stats.select(
        "*",
        F.col("min_x").cast("double").alias("bx0"),
        F.col("min_y").cast("double").alias("by0"),
        F.least(F.col("max_x") + 1, F.lit(map_width)).cast("double").alias("bx1"),
        F.least(F.col("max_y") + 1, F.lit(map_height)).cast("double").alias("by1"),
    )


def adaptive_filter(rows: DataFrame, threshold: float | Column, map_area: float, scale: float = 0.2) -> DataFrame:
    """Rows whose confidence reaches the threshold, which is lower by up to ``scale`` for boxes of under a hundredth of the map."""
    scale = 0.2 if scale <= 0 else min(scale, 1.0)
    w, h = F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")
    share = w * h / map_area if map_area > 0 else F.lit(0.0)
    cut = F.when(share < 0.01, scale * (1 - share / 0.01)).otherwise(0.0)
    return rows.filter((w >= 0) & (h >= 0) & (F.col("confidence") >= (1 - cut) * threshold))


def boundary(cells: DataFrame) -> DataFrame:
    """The cells of which one of the four neighbours is not of the same component, by four sums over one shuffle."""
    shifted = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
    near = cells.select("image_id", "label", "x", "y", "p", shifted.alias("d"))
    own = (F.col("d.dx") == 0) & (F.col("d.dy") == 0)
    near = near.groupBy("image_id", "label", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"))
    found = near.agg(F.max(F.when(own, F.col("p"))).alias("p"), F.count("*").alias("n"))
    return found.filter(F.col("p").isNotNull() & (F.col("n") < 5)).select("image_id", "label", "x", "y", "p")
