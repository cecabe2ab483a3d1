"""Polygons and planes: simplification, growth, hulls, rectangles, homographies.

Polygons are arrays of (x, y) with an implicit closure. What is a fold or a
formula is columns; what recurses or pivots runs on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Rectify
from ..functions import let

POINTS = "array<struct<x: double, y: double>>"
FAR = -1e9


def _array(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2)


def _rows(a: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in a]


def on_polygons(fn: Callable[[np.ndarray], np.ndarray]):
    """A column function that applies ``fn`` to each polygon; null stays null."""

    @F.pandas_udf(POINTS)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else _rows(fn(_array(p))) for p in s])

    return run


def bounding_box(polygon: Column) -> Column:
    """The box of the points; all zero for none."""
    of = lambda f, c: F.coalesce(f(F.transform(polygon, lambda p: p[c])), F.lit(0.0))
    return F.struct(of(F.array_min, "x").alias("min_x"), of(F.array_min, "y").alias("min_y"), of(F.array_max, "x").alias("max_x"), of(F.array_max, "y").alias("max_y"))


def scale_points(polygon: Column, sx: float | Column, sy: float | Column) -> Column:
    return F.transform(polygon, lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * sy).alias("y")))


def offset_points(polygon: Column, dx: float | Column, dy: float | Column) -> Column:
    return F.transform(polygon, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def unclip(polygon: Column, factor: float) -> Column:
    """The polygon scaled about the mean of its points; a factor of 0 or less, or 1, leaves it."""
    if factor <= 0 or factor == 1:
        return polygon
    mean = lambda c: (F.aggregate(F.transform(polygon, lambda p: p[c]), F.lit(0.0), lambda a, v: a + v) / F.size(polygon)).alias(c)
    move = lambda p, m, c: (m[c] + (p[c] - m[c]) * factor).alias(c)
    return let(F.struct(mean("x"), mean("y")), lambda m: F.transform(polygon, lambda p: F.struct(move(p, m, "x"), move(p, m, "y"))))


def simplify_points(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Points of an open line, less those within ``tolerance`` of the lines between kept ones; the ends stay."""
    if len(p) <= 3 or tolerance <= 0:
        return p
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    spans = [(0, len(p) - 1)]
    while spans:
        i, j = spans.pop()
        if j - i < 2:
            continue
        d, q = p[j] - p[i], p[i + 1 : j] - p[i]
        length = np.hypot(*d)
        away = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / length if length else np.hypot(q[:, 0], q[:, 1])
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[i + 1 + k] = True
            spans += [(i, i + 1 + k), (i + 1 + k, j)]
    return p[keep]


def hull_points(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the smallest (x, y); points on its sides are left out."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points: np.ndarray) -> list[list[float]]:
        out: list[list[float]] = []
        for c in points.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(c)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def rectangle_points(p: np.ndarray) -> np.ndarray:
    """The four corners of the smallest rectangle around the points that has a side along the hull.

    One point is repeated four times, two points span it back and forth.
    """
    h = hull_points(p)
    if len(h) == 0:
        return h
    if len(h) == 1:
        return np.repeat(h, 4, axis=0)
    if len(h) == 2:
        return h[[0, 1, 1, 0]]
    best, corners = np.inf, h
    for a, b in zip(h, np.roll(h, -1, axis=0), strict=True):
        u = (b - a) / np.hypot(*(b - a))
        v = np.array([-u[1], u[0]])
        s, t = h @ u, h @ v
        size = (s.max() - s.min()) * (t.max() - t.min())
        if size < best:
            best = size
            corners = np.array([x * u + y * v for x, y in ((s.min(), t.min()), (s.max(), t.min()), (s.max(), t.max()), (s.min(), t.max()))])
    return corners


def convex_hull(polygon: Column) -> Column:
    return on_polygons(hull_points)(polygon)


def min_area_rect(polygon: Column) -> Column:
    return on_polygons(rectangle_points)(polygon)


def simplify(polygon: Column, tolerance: float) -> Column:
    return on_polygons(lambda p: simplify_points(p, tolerance))(polygon)


def polygon_area(polygon: Column) -> Column:
    """Area by the shoelace sum."""
    n = F.size(polygon)
    term = lambda p, i: p["x"] * F.get(polygon, (i + 1) % n)["y"] - F.get(polygon, (i + 1) % n)["x"] * p["y"]
    return F.abs(F.aggregate(F.transform(polygon, term), F.lit(0.0), lambda a, x: a + x)) / 2


# ---- homographies ----------------------------------------------------------------------


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The eight coefficients that take four points to four others; None if they don't determine them."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    a = np.array(rows, float)
    if abs(np.linalg.det(a)) < 1e-12:
        return None
    return np.append(np.linalg.solve(a, np.array(right, float)), 1.0)


def apply_homography(h: list[float] | Column, x: Column, y: Column) -> Column:
    """(x, y) taken by the nine coefficients; far outside where the denominator is 0."""
    c = [F.lit(float(v)) for v in h] if isinstance(h, list) else [F.get(h, F.lit(i)) for i in range(9)]
    d = c[6] * x + c[7] * y + c[8]
    one = lambda i: F.when(d == 0, F.lit(FAR)).otherwise((c[i] * x + c[i + 1] * y + c[i + 2]) / d)
    return F.struct(one(0).alias("x"), one(3).alias("y"))


def warp(image: np.ndarray, h: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image (rows, columns, channels) seen through ``h``, which takes output places to input places; black outside."""
    ys, xs = np.mgrid[0:height, 0:width]
    d = h[6] * xs + h[7] * ys + h[8]
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.where(d == 0, FAR, (h[0] * xs + h[1] * ys + h[2]) / d)
        v = np.where(d == 0, FAR, (h[3] * xs + h[4] * ys + h[5]) / d)
    inside = (u >= 0) & (v >= 0) & (u <= image.shape[1] - 1) & (v <= image.shape[0] - 1)
    u, v = np.where(inside, u, 0), np.where(inside, v, 0)
    x0, y0 = np.floor(u).astype(int), np.floor(v).astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    fx, fy = (u - x0)[..., None], (v - y0)[..., None]
    im = image.astype(float)
    top = im[y0, x0] * (1 - fx) + im[y0, x1] * fx
    low = im[y1, x0] * (1 - fx) + im[y1, x1] * fx
    return np.where(inside[..., None], np.floor(top * (1 - fy) + low * fy + 0.5), 0).astype(image.dtype)


# ---- gates of rectification ---------------------------------------------------------------


def mask_gate(maps: DataFrame, cfg: Rectify | None = None, least: int | None = None) -> DataFrame:
    """(image_id, n, coverage, ok): whether enough of a mask is at the threshold."""
    cfg = cfg or Rectify()
    n = F.size(F.filter("p", lambda x: x >= cfg.mask_threshold))
    share = n / F.size("p")
    return maps.select("image_id", n.alias("n"), share.alias("coverage"), ((share >= cfg.min_coverage) & (n >= (cfg.min_points if least is None else least))).alias("ok"))


def rectangle_gate(corners: Column, width: Column | float, height: Column | float, cfg: Rectify | None = None) -> Column:
    """Whether a rectangle of four corners covers enough of the image and is neither too flat nor too steep."""
    cfg = cfg or Rectify()
    side = lambda i, j: F.hypot(F.get(corners, F.lit(i))["x"] - F.get(corners, F.lit(j))["x"], F.get(corners, F.lit(i))["y"] - F.get(corners, F.lit(j))["y"])
    w, h = (side(0, 1) + side(2, 3)) / 2, (side(1, 2) + side(3, 0)) / 2
    ratio = F.when(h > 0, w / h).otherwise(0.0)
    return (polygon_area(corners) / (width * height) >= cfg.min_area) & (ratio >= cfg.min_aspect) & (ratio <= cfg.max_aspect)


def corner_gate(corners: Column, width: Column, height: Column, cfg: Rectify | None = None) -> Column:
    """Corners between 0 and 1 are scaled to the image, then clamped to it; null if two of them are nearer than a share of its width."""
    cfg = cfg or Rectify()
    unit = F.forall(corners, lambda p: (p["x"] >= 0) & (p["x"] <= 1) & (p["y"] >= 0) & (p["y"] <= 1))
    fit = lambda v, most: F.least(F.greatest(F.when(unit, v * most).otherwise(v), F.lit(0.0)), most - 1.0)
    placed = F.transform(corners, lambda p: F.struct(fit(p["x"], width).alias("x"), fit(p["y"], height).alias("y")))
    near = F.lit(False)
    for i in range(4):
        for j in range(i + 1, 4):
            a, b = F.get(placed, F.lit(i)), F.get(placed, F.lit(j))
            near = near | (F.hypot(a["x"] - b["x"], a["y"] - b["y"]) < width * cfg.min_corner_distance)
    return F.when(~near, placed)


def ordered_corners(p: np.ndarray) -> np.ndarray:
    """Four corners from the top left one clockwise."""
    s, d = p.sum(axis=1), p[:, 0] - p[:, 1]
    return p[[s.argmin(), d.argmax(), s.argmax(), d.argmin()]]


def rectified(image: np.ndarray, corners: np.ndarray, out_height: int) -> np.ndarray:
    """What lies between four corners of an image, upright, at a height; the image itself where the corners determine nothing."""
    c = ordered_corners(corners)
    w = (np.hypot(*(c[1] - c[0])) + np.hypot(*(c[2] - c[3]))) / 2
    h = (np.hypot(*(c[3] - c[0])) + np.hypot(*(c[2] - c[1]))) / 2
    if w <= 0 or h <= 0:
        return image
    width = max(1, round(out_height * w / h))
    frame = np.array([(0, 0), (width - 1, 0), (width - 1, out_height - 1), (0, out_height - 1)], float)
    found = homography(frame, c)
    return image if found is None else warp(image, found, width, out_height)


def mask_corners(mask: np.ndarray, cfg: Rectify) -> np.ndarray | None:
    """Corners (in the mask's cells) of the smallest rectangle around a mask's cells, if the gates of mask and rectangle let it pass."""
    y, x = np.nonzero(mask >= cfg.mask_threshold)
    if len(x) < cfg.min_points or len(x) < cfg.min_coverage * mask.size:
        return None
    p = rectangle_points(np.stack([x, y], axis=1).astype(float))
    w = (np.hypot(*(p[1] - p[0])) + np.hypot(*(p[3] - p[2]))) / 2
    h = (np.hypot(*(p[2] - p[1])) + np.hypot(*(p[0] - p[3]))) / 2
    ratio = w / h if h > 0 else 0.0
    if w * h < cfg.min_area * mask.size or not cfg.min_aspect <= ratio <= cfg.max_aspect:
        return None
    return p


def rectify(images: DataFrame, masks: DataFrame, cfg: Rectify | None = None) -> DataFrame:
    """Images (image_id, width, height, channels, data) seen straight by their masks (image_id, p, mask_w), with ``rectified``.

    An image without a mask, or whose mask doesn't pass the gates, stays as it is; so do all if the options are off.
    """
    cfg = cfg or Rectify()
    shape = "image_id long, width int, height int, channels int, data binary, rectified boolean"
    rows = images.select("image_id", "width", "height", "channels", "data").join(masks.select("image_id", F.col("p").alias("mask"), "mask_w"), "image_id", "left")
    if not cfg.enabled:
        return images.select("image_id", "width", "height", "channels", "data", F.lit(False).alias("rectified"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                a, corners = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels), None
                if r.mask is not None and len(r.mask):
                    mask = np.asarray(r.mask, float).reshape(-1, int(r.mask_w))
                    corners = mask_corners(mask, cfg)
                if corners is not None:
                    scale = np.array([r.width / mask.shape[1], r.height / mask.shape[0]])
                    a = rectified(a, corners * scale, cfg.out_height)
                out.append((r.image_id, a.shape[1], a.shape[0], r.channels, a.tobytes(), corners is not None))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "channels", "data", "rectified"])

    return rows.mapInPandas(run, shape)
