"""Pixels on their way to recognition: images turned upright, and tensors of their regions.

An image is shipped once for all its regions: the regions of an image, a few
numbers each, meet it as one list in one join, and its crops leave the task in
batches of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Orientation, Recognizer
from . import boxes as B
from . import geometry as G
from . import images as I

#: Bytes of tensors that leave a task together.
BATCH_BYTES = 1 << 24
TENSOR = "image_id long, region_id long, crop_w int, crop_h int, turned boolean, width int, shape array<int>, data array<float>"


def grey(a: np.ndarray) -> np.ndarray:
    return a[..., 0].astype(float) if a.shape[2] < 3 else a[..., :3].mean(axis=2)


def flips(a: np.ndarray) -> tuple[int, int]:
    """Changes between dark and light along rows and along columns, light being at or above the mean."""
    g = grey(a)
    light = g >= g.mean()
    return int((light[:, 1:] != light[:, :-1]).sum()), int((light[1:] != light[:-1]).sum())


def orientations(images: DataFrame, cfg: Orientation | None = None, classify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(image_id, angle, confidence) of images; angle 0 where it is not sure enough.

    ``classify`` gives the scores (image_id, scores) of four angles for images.
    Without it, and for images that it leaves out, changes of brightness
    decide if the options say so, else the angle is 0 with confidence 0.
    """
    cfg = cfg or Orientation()

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(r.image_id, r.width, r.height, *flips(I.pixels_of(r))) for r in part.itertuples()]
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "rows", "columns"])

    if cfg.heuristic_fallback:
        counts = images.select("image_id", "width", "height", "channels", "data").mapInPandas(count, "image_id long, width int, height int, rows int, columns int")
        total = F.col("rows") + F.col("columns")
        sure = F.when(total > 0, F.abs(F.col("rows") - F.col("columns")) / total).otherwise(0.0)
        found = counts.select("image_id", "width", "height", F.when(F.col("columns") > F.col("rows"), 90).otherwise(0).alias("angle"), sure.alias("confidence"))
    else:
        found = images.select("image_id", "width", "height", F.lit(0).alias("angle"), F.lit(0.0).alias("confidence"))
    if classify is not None:
        told = classify(images).select("image_id", I.from_logits(F.col("scores")).alias("told"))
        found = found.join(told, "image_id", "left").withColumns({c: F.coalesce(F.col(f"told.{c}"), F.col(c)) for c in ("angle", "confidence")})
    return I.orientation(found, cfg).select("image_id", F.col("angle").cast("int").alias("angle"), "confidence")


def upright(images: DataFrame, cfg: Orientation | None = None, classify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(image_id, width, height, channels, data): images turned by their :func:`orientations`, as they are where the options are off."""
    cfg = cfg or Orientation()
    rows = images.select("image_id", "width", "height", "channels", "data")
    if not cfg.enabled:
        return rows
    return I.turned(rows.join(orientations(rows, cfg, classify).select("image_id", "angle"), "image_id"))


def _patch(a: np.ndarray, box: tuple, polygon: np.ndarray | None, straight: bool) -> np.ndarray:
    """A region's pixels: what lies between four corners seen straight, else the box around the polygon, or the region's own box, within the image."""
    if straight and polygon is not None and len(polygon) == 4:
        c = G.ordered_corners(polygon)
        high = (np.hypot(*(c[3] - c[0])) + np.hypot(*(c[2] - c[1]))) / 2
        return G.rectified(a, polygon, max(1, round(high)))
    if polygon is not None and len(polygon):
        box = (*polygon.min(axis=0), *polygon.max(axis=0))
    height, width = a.shape[:2]
    x0, y0 = (min(max(int(np.floor(v)), 0), most) for v, most in zip(box[:2], (width, height), strict=True))
    x1, y1 = (min(max(int(np.ceil(v)), 0), most) for v, most in zip(box[2:], (width, height), strict=True))
    return a[y0:y1, x0:x1]


def line_sizes(w: int, h: int, cfg: Recognizer) -> tuple[int, int]:
    """The width of a crop at the fixed height, and that filled up to the multiple."""
    wide = max(1, w * cfg.height // h)
    wide = min(wide, cfg.max_width) if cfg.max_width > 0 else wide
    multiple = max(1, cfg.pad_multiple)
    return wide, -(-wide // multiple) * multiple


SCORES = "image_id long, region_id long, steps array<array<double>>"
_SCORES = {"image_id": pa.int64(), "region_id": pa.int64(), "steps": pa.list_(pa.list_(pa.float64()))}


def recognised(images: DataFrame, regions: DataFrame, recognise: Callable[[DataFrame], DataFrame], cfg: Recognizer | None = None) -> DataFrame:
    """The scores (see ``SCORES``) that ``recognise`` gives for the :func:`tensors` of regions.

    If it has a function ``batch``, which does the same for one batch of tensors, this runs in the tasks that make them:
    a tensor is a hundred times its pixels, and leaves no task then.
    """
    batch = getattr(recognise, "batch", None)
    return recognise(tensors(images, regions, cfg)) if batch is None else tensors(images, regions, cfg, then=batch)


def tensors(images: DataFrame, regions: DataFrame, cfg: Recognizer | None = None, turn: bool = True, straight: bool = False, then: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """A tensor [1, 3, height, width] of each region (image_id, region_id, box, polygon if there is one), see ``TENSOR``.

    Crops much higher than wide are turned counter-clockwise if ``turn`` is set;
    all are brought to the fixed height and filled with black to the width of
    the widest of their image. Regions without a pixel in the image, and those of other images, give none.
    With ``then`` each batch of tensors becomes scores in its task, and these are returned.
    """
    cfg = cfg or Recognizer()
    has = "polygon" in regions.columns
    points = F.col("polygon") if has else F.lit(None).cast("array<struct<x: double, y: double>>")
    one = F.struct("region_id", *[F.col(c).cast("double").alias(c) for c in B.BOX], points.alias("polygon"))
    lists = regions.groupBy("image_id").agg(F.collect_list(one).alias("regions"))
    rows = images.select("image_id", "width", "height", "channels", "data").join(lists, "image_id")

    def crops(a: np.ndarray, region: dict) -> np.ndarray:
        polygon = None if region["polygon"] is None else np.array([(p["x"], p["y"]) for p in region["polygon"]], float).reshape(-1, 2)
        patch = _patch(a, tuple(region[c] for c in B.BOX), polygon, straight)
        return patch[..., : 3 if patch.shape[2] >= 3 else 1]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in TENSOR.split(", ")]
        if then is not None:
            scores = then(pd.DataFrame(out, columns=names))
            return pa.record_batch([pa.array(scores[c], k) for c, k in _SCORES.items()], names=list(_SCORES))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.int32())]
        columns = [pa.array(v, k) for v, k in zip(list(zip(*out, strict=True))[:-1], kinds, strict=True)]
        data = [r[-1] for r in out]
        ends = np.r_[0, np.cumsum([len(x) for x in data])].astype(np.int32)
        return pa.record_batch([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(data)))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for part in batches:
            for i in range(len(part)):
                image_id, width, height, channels, data, found = (part.column(k)[i].as_py() for k in range(6))
                a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                sizes = []
                for region in found:  # sizes of all first, so that crops need not be kept
                    h, w = crops(a, region).shape[:2]
                    turned = bool(turn and h > int(w * 1.2))
                    sizes.append((h, w, turned, line_sizes(*((h, w) if turned else (w, h)), cfg) if h and w else (0, 0)))
                widest = max((s[3][1] for s in sizes), default=0)
                for region, (h, w, turned, (wide, _)) in zip(found, sizes, strict=True):
                    if not h or not w:
                        continue
                    patch = crops(a, region)
                    line = I.filled(I.resized(np.rot90(patch) if turned else patch, wide, cfg.height), widest)
                    line = np.repeat(line, 3, axis=2) if line.shape[2] == 1 else line
                    flat = I.tensor(line).astype(np.float32).reshape(-1)
                    out.append((image_id, region["region_id"], w, h, turned, wide, [1, 3, cfg.height, widest], flat))
                    size += flat.nbytes
                    if size >= BATCH_BYTES:
                        yield batch(out)
                        out, size = [], 0
        if out:
            yield batch(out)

    return rows.mapInArrow(run, TENSOR if then is None else SCORES)
