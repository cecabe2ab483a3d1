"""Pixel work: sizes, padding, normalising, quality, orientation, tensors.

Sizes are column arithmetic; pixels are NumPy on Arrow batches. An image is a
row (image_id, width, height, channels, data) with data row by row, RGB(A).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ImageConstraints, Orientation, Recognizer
from ..functions import let

IMAGE = "image_id long, width int, height int, channels int, data binary"


def fit_size(w: Column, h: Column, cfg: ImageConstraints | None = None) -> Column:
    """(w, h) to detect at: within the maximum, never larger, down to the multiple, at least the minimum; null for images under the minimum."""
    cfg = cfg or ImageConstraints()
    scale = F.least(F.lit(1.0), cfg.max_width / w, cfg.max_height / h)
    side = lambda v, least: F.greatest(F.floor(F.floor(v * scale) / cfg.multiple) * cfg.multiple, F.lit(least)).cast("int")
    return F.when((w >= cfg.min_width) & (h >= cfg.min_height), F.struct(side(w, cfg.min_width).alias("w"), side(h, cfg.min_height).alias("h")))


def too_small(w: Column, h: Column, cfg: ImageConstraints | None = None) -> Column:
    cfg = cfg or ImageConstraints()
    return (w < cfg.min_width) | (h < cfg.min_height)


def line_size(w: Column, h: Column, cfg: Recognizer | None = None) -> Column:
    """(w, padded) at which a crop is read: width at the fixed height, limited, and padded to the multiple."""
    cfg = cfg or Recognizer()
    wide = F.greatest(F.lit(1), F.floor(w * cfg.height / h).cast("int"))
    wide = F.least(wide, F.lit(cfg.max_width)) if cfg.max_width > 0 else wide
    multiple = max(1, cfg.pad_multiple)
    return F.struct(wide.alias("w"), (F.ceil(wide / multiple) * multiple).cast("int").alias("padded"))


def batch_width(crops: DataFrame, batch: str = "image_id") -> DataFrame:
    """Adds the width that all crops of a batch are filled up to, the largest padded one, and the columns that each lacks."""
    widest = F.max("padded").over(Window.partitionBy(batch))
    return crops.withColumn("batch_w", widest).withColumn("fill", F.col("batch_w") - F.col("padded"))


def filled(a: np.ndarray, width: int) -> np.ndarray:
    """The image with black columns to the right up to the width."""
    return np.pad(a, ((0, 0), (0, max(0, width - a.shape[1])), *[(0, 0)] * (a.ndim - 2)))


def turn_crop(w: Column, h: Column, factor: float = 1.2) -> Column:
    """Whether a crop is so high that it is turned by 90 degrees before it is read."""
    return h > F.floor(w * factor).cast("int")


def pixels_of(row) -> np.ndarray:
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)


def _lanczos(n: int, m: int) -> np.ndarray:
    """Weights (m, n) of a three-lobed Lanczos filter from n to m samples."""
    scale = max(1.0, n / m)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    d = (np.arange(n)[None, :] - centre[:, None]) / scale
    w = np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


_weights = lru_cache(maxsize=256)(_lanczos)


@lru_cache(maxsize=4096)
def _columns_first(shape: tuple[int, ...], width: int, height: int) -> bool:
    """Whether columns are the cheaper ones to begin with; the search for it takes longer than a small image."""
    empty = np.empty((height, shape[0])), np.empty((width, shape[1])), np.empty(shape)
    return np.einsum_path("yi,xj,ijc->yxc", *empty, optimize=True)[0][1] == (1, 2)


def resized(a: np.ndarray, width: int, height: int) -> np.ndarray:
    rows, columns = _weights(a.shape[0], height), _weights(a.shape[1], width)
    if _columns_first(a.shape, width, height):
        out = np.tensordot(rows, np.tensordot(columns, a.astype(float), (1, 1)), (1, 1))
    else:
        out = np.einsum("yi,xj,ijc->yxc", rows, columns, a.astype(float), optimize=True)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def padded(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image in the middle of a black one; what is larger is cut to its middle."""
    for axis, size in ((0, height), (1, width)):
        n = a.shape[axis]
        if n > size:
            at = (n - size) // 2
            a = np.take(a, range(at, at + size), axis=axis)
        elif n < size:
            before = (size - n) // 2
            around = [(0, 0)] * a.ndim
            around[axis] = (before, size - n - before)
            a = np.pad(a, around)
    return a


def tensor(a: np.ndarray) -> np.ndarray:
    """Planes R, G, B of values between 0 and 1, as [1, 3, height, width]."""
    return (a[..., :3].astype(np.float32) / 255).transpose(2, 0, 1)[None]


def resize(images: DataFrame, cfg: ImageConstraints | None = None) -> DataFrame:
    """Images at the size of :func:`fit_size`; those under the minimum go."""
    rows = images.withColumn("__fit", fit_size(F.col("width"), F.col("height"), cfg)).filter("__fit is not null")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(r.image_id, int(r.fw), int(r.fh), r.channels, resized(pixels_of(r), int(r.fw), int(r.fh)).tobytes()) for r in part.itertuples()]
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "channels", "data"])

    return rows.select("image_id", "width", "height", "channels", "data", F.col("__fit.w").alias("fw"), F.col("__fit.h").alias("fh")).mapInPandas(run, IMAGE)


def turned(images: DataFrame, angle: str = "angle") -> DataFrame:
    """Images turned counter-clockwise by the column's 0, 90, 180 or 270 degrees."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                a = np.rot90(pixels_of(r), int(r.angle) // 90 % 4)
                out.append((r.image_id, a.shape[1], a.shape[0], r.channels, a.tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "channels", "data"])

    return images.select("image_id", "width", "height", "channels", "data", F.col(angle).alias("angle")).mapInPandas(run, IMAGE)


def image_quality(images: DataFrame) -> DataFrame:
    """(image_id, width, height, aspect, grey, alpha): whether all pixels are grey, and whether one is not opaque."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                a = pixels_of(r)
                grey = r.channels == 1 or bool((a[..., 0] == a[..., 1]).all() and (a[..., 1] == a[..., 2]).all())
                out.append((r.image_id, r.width, r.height, r.width / r.height, grey, bool(r.channels == 4 and (a[..., 3] < 255).any())))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "aspect", "grey", "alpha"])

    return images.mapInPandas(run, "image_id long, width int, height int, aspect double, grey boolean, alpha boolean")


# ---- orientation -----------------------------------------------------------------------


def nearly_square(w: Column, h: Column, ratio: float = 1.2) -> Column:
    return F.greatest(w / h, h / w) <= ratio


def transitions(maps: DataFrame, width: int) -> DataFrame:
    """(image_id, rows, columns): changes between dark and light along rows and along columns, light being at or above the mean."""
    n = F.size("p")
    mean = F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / n
    bits = let(mean, lambda m: F.transform("p", lambda x: x >= m))
    flips = lambda step, inner: let(bits, lambda b: F.size(F.filter(b, lambda x, i: inner(i) & (x != F.get(b, i + step)))))
    along = flips(1, lambda i: i % width < width - 1)
    down = flips(width, lambda i: i + width < n)
    rows = maps
    return rows.select("image_id", along.alias("rows"), down.alias("columns"))


def heuristic(counts: DataFrame) -> DataFrame:
    """(image_id, angle, confidence): 90 where columns change more than rows."""
    total = F.col("rows") + F.col("columns")
    sure = F.when(total > 0, F.abs(F.col("rows") - F.col("columns")) / total).otherwise(0.0)
    return counts.select("image_id", F.when(F.col("columns") > F.col("rows"), 90).otherwise(0).alias("angle"), sure.alias("confidence"))


def orientation(found: DataFrame, cfg: Orientation | None = None, line: bool = False) -> DataFrame:
    """The angle where it is sure enough, else 0 with the low confidence; near-square images are (0, 1)."""
    cfg = cfg or Orientation()
    least = cfg.line_threshold if line else cfg.threshold
    square = nearly_square(F.col("width"), F.col("height"), cfg.square_ratio) & F.lit(cfg.skip_square)
    angle = F.when(square | (F.col("confidence") < least), 0).otherwise(F.col("angle"))
    return found.withColumns({"angle": angle, "confidence": F.when(square, 1.0).otherwise(F.col("confidence"))})


def from_logits(scores: Column) -> Column:
    """(angle, confidence) from the scores of 0, 90, 180 and 270 degrees."""
    four = F.slice(scores, 1, 4)
    total = let(F.array_max(four), lambda most: F.aggregate(four, F.lit(0.0), lambda a, x: a + F.exp(x - most)))
    return F.struct(((F.array_position(four, F.array_max(four)) - 1) * 90).cast("int").alias("angle"), (F.lit(1.0) / total).alias("confidence"))


# ---- tensors ---------------------------------------------------------------------------


def valid_tensor(data: Column, shape: Column) -> Column:
    """Whether a tensor has four positive dimensions and as many values as they say."""
    size = F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)
    return (F.size(shape) == 4) & F.forall(shape, lambda d: d > 0) & (F.size(data) == size)


def tensor_stats(data: Column) -> Column:
    """(least, most, mean); all 0 for none."""
    n = F.size(data)
    mean = F.when(n > 0, F.aggregate(data, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
    return F.struct(F.coalesce(F.array_min(data), F.lit(0.0)).alias("least"), F.coalesce(F.array_max(data), F.lit(0.0)).alias("most"), mean.alias("mean"))


def batched(tensors: list[np.ndarray], model: Callable[[np.ndarray], np.ndarray], most: int = 32) -> list[np.ndarray]:
    """The flat output of a model for each tensor [1, ...]: those of equal shape go through it together, ``most`` at a time."""
    out: list[np.ndarray] = [np.empty(0, np.float32)] * len(tensors)
    by_shape: dict[tuple[int, ...], list[int]] = {}
    for i, x in enumerate(tensors):
        by_shape.setdefault(x.shape, []).append(i)
    for shape, places in by_shape.items():
        step = most if shape[0] == 1 else 1  # a tensor that holds several already goes alone
        for at in range(0, len(places), step):
            some = places[at : at + step]
            found = model(np.concatenate([tensors[i] for i in some]))
            for i, y in zip(some, np.split(found, len(some)), strict=True):
                out[i] = y.reshape(-1)
    return out


def infer(rows: DataFrame, column: str, out: str, model: str, providers: tuple[str, ...] = ("CPUExecutionProvider",)) -> DataFrame:
    """Adds ``out``, the flat output of an ONNX model, for tensors (data, shape) in ``column``; a session is made once for each task."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import onnxruntime

        session = onnxruntime.InferenceSession(model, providers=list(providers))
        taken = session.get_inputs()[0]
        name, most = taken.name, 1 if isinstance(taken.shape[0], int) else 32
        for part in parts:
            shapes = [tuple(int(d) for d in shape) for shape in part["shape"]]
            tensors = [np.asarray(data, np.float32).reshape(shape) for data, shape in zip(part["data"], shapes, strict=True)]
            out = batched(tensors, lambda x: session.run(None, {name: x})[0], most)
            yield pd.Series(out)

    return rows.withColumn(out, run(F.col(column)))


def synthetic_map(kind: str, width: int, height: int, value: float = 0.9, stripes: int = 4) -> np.ndarray:
    """A made-up probability map: uniform, blob (a bell in the middle) or stripes."""
    y, x = np.mgrid[0:height, 0:width]
    if kind == "blob":
        sigma = max(1.0, min(width, height) / 6)
        return value * np.exp(-((x - (width - 1) / 2) ** 2 + (y - (height - 1) / 2) ** 2) / (2 * sigma * sigma))
    if kind == "stripes":
        return np.where(y * 2 * stripes // height % 2 == 1, value, 0.05)
    return np.full((height, width), value)


def synthetic_logits(path: list[int], classes: int, high: float = 0.9) -> np.ndarray:
    """Scores [T, C] whose best path is the given one."""
    out = np.full((len(path), classes), (1 - high) / max(1, classes - 1))
    out[np.arange(len(path)), path] = high
    return out
