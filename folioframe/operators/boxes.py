"""Scored boxes: overlap, suppression, fusion of scales, scaling, order.

Boxes are rows (image_id, region_id, min_x, min_y, max_x, max_y, confidence).
Order is by falling confidence, ties by region_id. Suppression goes through the
boxes of an image in their order and takes one shuffle by image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Detector, MultiScale

BOX = ("min_x", "min_y", "max_x", "max_y")
#: Side of the cells in which overlaps are looked for.
CELL = 64.0


def area(b: Column) -> Column:
    return (b["max_x"] - b["min_x"]) * (b["max_y"] - b["min_y"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the boxes are apart or touch."""
    w = F.least(a["max_x"], b["max_x"]) - F.greatest(a["min_x"], b["min_x"])
    h = F.least(a["max_y"], b["max_y"]) - F.greatest(a["min_y"], b["min_y"])
    common = w * h
    union = area(a) + area(b) - common
    return F.when((w > 0) & (h > 0) & (union > 0), common / union).otherwise(0.0)


def overlaps(boxes: DataFrame, least: float = 0.0, cell: float = CELL) -> DataFrame:
    """(image_id, a, b, iou) for pairs a < b of an image with IoU above ``least``.

    Boxes meet in the grid cells that they cover, by an equi-join; a pair
    counts in the first cell that both cover, so each comes once.
    """
    box = F.struct("region_id", *BOX)
    span = lambda low, high: F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))
    rows = boxes.select("image_id", box.alias("r"), F.explode(span("min_x", "max_x")).alias("cx"), "min_y", "max_y")
    rows = rows.select("image_id", "r", "cx", F.explode(span("min_y", "max_y")).alias("cy"))
    other = rows.withColumnRenamed("r", "s")
    pairs = rows.join(other, ["image_id", "cx", "cy"]).filter(F.col("r.region_id") < F.col("s.region_id"))
    first = (F.col("cx") == F.floor(F.greatest("r.min_x", "s.min_x") / cell)) & (F.col("cy") == F.floor(F.greatest("r.min_y", "s.min_y") / cell))
    pairs = pairs.filter(first).select("image_id", F.col("r.region_id").alias("a"), F.col("s.region_id").alias("b"), iou(F.col("r"), F.col("s")).alias("iou"))
    return pairs.filter(F.col("iou") > least)


# ---- suppression -----------------------------------------------------------------

#: Boxes, the filled up ones too, that are compared at a time.
TOGETHER = 1 << 20

#: From (images, boxes) corners, best first, their scores and which places are filled: the new scores, and which boxes stay.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _by_image(boxes: DataFrame, kernel: Kernel) -> DataFrame:
    """The boxes that a kernel leaves in each image.

    One shuffle by image puts each image's boxes in a list, best first, ties by
    region_id. The kernel then takes many images at once, those of like number
    of boxes side by side, so its steps are as many as one image has boxes.
    """
    more = [c for c in boxes.columns if c not in ("image_id", "region_id", *BOX, "confidence")]
    item = F.struct((-F.col("confidence")).alias("rank"), "region_id", *more, *[F.col(c).cast("double").alias(c) for c in (*BOX, "confidence")])
    lists = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    names = ["image_id", "region_id", *BOX, "confidence", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values
            x = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in BOX], axis=1)
            score = flat.field("confidence").to_numpy(zero_copy_only=False).copy()
            keep, sizes = np.zeros(len(score), bool), np.diff(starts)
            order = np.argsort(sizes, kind="stable")
            at = int(np.searchsorted(sizes[order], 1))
            while at < len(order):
                # Images of up to twice the boxes of the first, as many as fit.
                to = int(np.searchsorted(sizes[order], 2 * sizes[order[at]], "right"))
                to = max(at + 1, min(to, at + TOGETHER // int(sizes[order[to - 1]])))
                some = order[at:to]
                n = int(sizes[some].max())
                filled = np.arange(n)[None, :] < sizes[some][:, None]
                place = np.where(filled, starts[some][:, None] + np.arange(n)[None, :], starts[some][:, None])
                new, stays = kernel(x[place], score[place], filled)
                score[place[filled]], keep[place[filled]] = new[filled], stays[filled]
                at = to
            rows = np.flatnonzero(keep)
            image = np.repeat(np.arange(len(batch)), sizes)[rows - starts[0]]
            chosen = pa.array(rows)
            columns = [batch.column(0).take(pa.array(image)), flat.field("region_id").take(chosen), *[pa.array(x[rows, i]) for i in range(4)], pa.array(score[rows])]
            yield pa.record_batch([*columns, *[flat.field(c).take(chosen) for c in more]], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema} | {c: "double" for c in (*BOX, "confidence")}
    return lists.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def _sizes(x: np.ndarray) -> np.ndarray:
    return (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])


def _shares(one: np.ndarray, x: np.ndarray) -> np.ndarray:
    """IoU of one box an image (images, 4) with all its boxes (images, boxes, 4)."""
    a = one[:, None, :]
    w = np.minimum(a[..., 2], x[..., 2]) - np.maximum(a[..., 0], x[..., 0])
    h = np.minimum(a[..., 3], x[..., 3]) - np.maximum(a[..., 1], x[..., 1])
    common = np.where((w > 0) & (h > 0), w * h, 0.0)
    union = _sizes(a) + _sizes(x) - common
    return np.divide(common, union, out=np.zeros_like(common), where=union > 0)


def _suppress(boxes: DataFrame, threshold: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray | float]) -> DataFrame:
    """Boxes that no kept box before them overlaps by more than the pair's threshold, of the two sizes and the two confidences."""

    def kernel(x: np.ndarray, score: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stays, size = filled.copy(), _sizes(x)
        for k in range(x.shape[1] - 1):
            over = _shares(x[:, k], x) > threshold(size[:, k, None], size, score[:, k, None], score)
            over[:, : k + 1] = False
            stays &= ~(over & stays[:, k, None])
        return score, stays

    return _by_image(boxes, kernel)


def nms(boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Hard suppression: IoU above the threshold."""
    return _suppress(boxes, lambda *_: threshold)


def nms_adaptive(boxes: DataFrame, base: float = 0.3, scale: float = 1.0) -> DataFrame:
    """Hard suppression with a threshold between 0.1 and 0.8 that grows with the pair's area and falls with its confidence."""

    def threshold(a: np.ndarray, b: np.ndarray, sure: np.ndarray, other: np.ndarray) -> np.ndarray:
        size = np.minimum(1.0, (a + b) / 2.0 / 10000.0)
        return np.clip(base * scale + 0.1 * size - 0.05 * ((sure + other) / 2.0 - 0.5), 0.1, 0.8)

    return _suppress(boxes, threshold)


def nms_size_aware(boxes: DataFrame, base: float = 0.3, factor: float = 0.1, least: int = 32, most: int = 1024) -> DataFrame:
    """Hard suppression with a threshold that moves by up to half of ``factor`` with the pair's mean area between the bounds."""

    def threshold(a: np.ndarray, b: np.ndarray, *_: np.ndarray) -> np.ndarray | float:
        if most <= least:
            return base
        return base + factor * (np.clip(((a + b) / 2.0 - least) / float(most - least), 0.0, 1.0) - 0.5)

    return _suppress(boxes, threshold)


def soft_nms(boxes: DataFrame, method: str = "linear", threshold: float = 0.3, sigma: float = 0.5, least: float = 0.1) -> DataFrame:
    """Boxes with lowered confidences of at least ``least``.

    linear: 1 - IoU from the threshold on; gaussian: exp(-IoU^2 / sigma);
    otherwise 0 from the threshold on. One box is left as it is, whatever its
    score; where at most one reaches ``least``, only that is left.
    """

    def lowered(share: np.ndarray) -> np.ndarray:
        if method == "gaussian":
            return np.exp(-share * share / sigma)
        return np.where(share >= threshold, 1 - share if method == "linear" else 0.0, 1.0)

    def kernel(x: np.ndarray, score: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alone = filled.sum(axis=1) == 1
        left = filled & (((score >= least) & filled).sum(axis=1) > 1)[:, None]
        images = np.arange(len(x))
        for _ in range(x.shape[1]):
            best = np.where(left, score, -np.inf).argmax(axis=1)
            left[images, best] = False
            score = np.where(left, score * lowered(_shares(x[images, best], x)), score)
        return score, filled & ((score >= least) | alone[:, None])

    return _by_image(boxes, kernel)


def suppress(boxes: DataFrame, cfg: Detector, threshold: float | None = None) -> DataFrame:
    """The suppression that the options choose."""
    t = cfg.nms_iou if threshold is None else threshold
    if cfg.nms_method in ("linear", "gaussian"):
        return soft_nms(boxes, cfg.nms_method, t, cfg.soft_sigma, cfg.soft_score)
    if cfg.adaptive_nms:
        return nms_adaptive(boxes, t, cfg.adaptive_nms_scale)
    if cfg.size_aware_nms:
        return nms_size_aware(boxes, t, cfg.size_scale, cfg.min_region_size, cfg.max_region_size)
    return nms(boxes, t)


# ---- scales ----------------------------------------------------------------------


def scale_ladder(width: int, height: int, cfg: MultiScale) -> list[float]:
    """Scales to detect at: 1 first; the explicit ones once each, or steps of 0.75, within the bounds of levels and of the shorter side."""
    scales, side = [1.0], min(width, height)
    if side <= 0:
        return scales
    if cfg.scales:
        for s in (s for s in cfg.scales if s > 0):
            if s not in scales:
                scales.append(s)
            if (cfg.max_levels > 0 and len(scales) >= cfg.max_levels) or int(side * s) <= cfg.min_side:
                break
        return scales
    while len(scales) < (cfg.max_levels if cfg.max_levels > 0 else 3) and int(side * scales[-1] * 0.75) > cfg.min_side:
        scales.append(scales[-1] * 0.75)
    return scales


def rescale(boxes: DataFrame, sx: Column | float, sy: Column | float) -> DataFrame:
    """Boxes with their coordinates multiplied, corners in order."""
    x = [F.col("min_x") * sx, F.col("max_x") * sx]
    y = [F.col("min_y") * sy, F.col("max_y") * sy]
    return boxes.withColumns({"min_x": F.least(*x), "max_x": F.greatest(*x), "min_y": F.least(*y), "max_y": F.greatest(*y)})


def merge_scales(levels: list[tuple[float, DataFrame]], cfg: Detector) -> DataFrame:
    """Boxes found at several scales, mapped back and suppressed together."""
    whole = None
    for scale, boxes in levels:
        back = rescale(boxes, 1 / scale, 1 / scale)
        whole = back if whole is None else whole.unionByName(back)
    t = cfg.multi_scale.merge_iou if cfg.multi_scale.merge_iou > 0 else cfg.nms_iou if cfg.nms_iou > 0 else 0.3
    return suppress(whole, cfg, t)


# ---- coordinates, checks, order ----------------------------------------------------


def unrotate(boxes: DataFrame, angle: Column, width: Column | float, height: Column | float) -> DataFrame:
    """Boxes of an image turned by ``angle`` back in the original of ``width`` and ``height``, as whole numbers x, y, w, h."""
    w, h = (F.lit(v) if isinstance(v, int | float) else v for v in (width, height))
    corner = lambda x, y: (
        F.when(angle == 90, w - 1 - y).when(angle == 180, w - 1 - x).when(angle == 270, y).otherwise(x),
        F.when(angle == 90, x).when(angle == 180, h - 1 - y).when(angle == 270, h - 1 - x).otherwise(y),
    )
    corners = [corner(F.col(x), F.col(y)) for x in ("min_x", "max_x") for y in ("min_y", "max_y")]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    near = lambda v: (v + 0.5).cast("int")
    left, top, right, bottom = F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)
    return boxes.select("*", near(left).alias("x"), near(top).alias("y"), near(right - left).alias("w"), near(bottom - top).alias("h"))


def crop_box(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Adds the pixel rectangle of each box within an image: x0, y0, x1, y1."""
    bound = lambda v, most: F.greatest(F.lit(0), F.least(v.cast("int"), F.lit(most)))
    return boxes.select("*", bound(F.floor("min_x"), width).alias("x0"), bound(F.floor("min_y"), height).alias("y0"), bound(F.ceil("max_x"), width).alias("x1"), bound(F.ceil("max_y"), height).alias("y1"))


def valid(width: Column | float, height: Column | float) -> Column:
    """Whether a box has a size and lies in the image."""
    return (F.col("max_x") > F.col("min_x")) & (F.col("max_y") > F.col("min_y")) & (F.col("min_x") >= 0) & (F.col("min_y") >= 0) & (F.col("max_x") <= width) & (F.col("max_y") <= height)


def valid_result(width: Column | float, height: Column | float) -> Column:
    """Whether a result's box lies in its image and its confidences are between 0 and 1."""
    ok = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("w") >= 0) & (F.col("h") >= 0)
    ok = ok & (F.col("x") + F.col("w") <= width) & (F.col("y") + F.col("h") <= height)
    return ok & F.col("det_conf").between(0, 1) & F.col("rec_conf").between(0, 1)


def top_left_order(boxes: DataFrame) -> DataFrame:
    """Adds ord (from 1): top to bottom, then left to right, in each image."""
    return boxes.withColumn("ord", F.row_number().over(Window.partitionBy("image_id").orderBy("min_y", "min_x", "region_id")))


def top_k(boxes: DataFrame, k: int) -> DataFrame:
    """The k most confident boxes of each image, with rank."""
    order = Window.partitionBy("image_id").orderBy(F.desc("confidence"), "region_id")
    return boxes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
