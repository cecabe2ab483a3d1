"""Outlines of labelled components, and drawing on images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import label as label_cells
from .geometry import rectangle_points, simplify_points

#: The eight neighbours clockwise from the left one, as (dx, dy), y downwards.
RING = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))


def trace(mask: np.ndarray) -> list[tuple[int, int]]:
    """The corners (x, y) of one lap around the component that holds the first cell in raster order, clockwise.

    The walk ends when it is about to leave its first cell the way it did at
    first. Points between two others in a line are left out.
    """
    cells = np.argwhere(mask)
    if not len(cells):
        return []
    first = (int(cells[0][1]), int(cells[0][0]))
    rows = np.pad(mask, 1).tolist()
    inside = lambda x, y: bool(rows[y + 1][x + 1])
    at, back, out, begun = first, 0, [first], None
    while True:
        for turn in range(1, 9):
            d = (back + turn) % 8
            to = (at[0] + RING[d][0], at[1] + RING[d][1])
            if inside(*to):
                break
        else:
            return out  # one cell
        if begun is None:
            begun = (at, d)
        elif (at, d) == begun:
            break
        out.append(to)
        at, back = to, (d + 4) % 8
    if len(out) > 1 and out[-1] == first:
        out.pop()
    n = len(out)
    if n < 3:
        return out
    corner = lambda a, b, c: (b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0]) or a == c
    return [p for i, p in enumerate(out) if corner(out[i - 1], p, out[(i + 1) % n])]


POINTS = "array<struct<x: double, y: double>>"
_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def _traced(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    x0, y0 = int(x.min()), int(y.min())
    mask = np.zeros((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), bool)
    mask[y - y0, x - x0] = True
    return [(float(u + x0), float(v + y0)) for u, v in trace(mask)]


def _points(p) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in p]


def outlines(cells: DataFrame) -> DataFrame:
    """(image_id, label, points): the outline of each component of (image_id, y, x, label) rows.

    The cells of an image are put together by the JVM; each Arrow batch then holds many images.
    """
    lists = cells.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("label", "y", "x"))).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values
            label, y, x = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("label", "y", "x"))
            image, labels, points = [], [], []
            for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                cuts = i + np.flatnonzero(np.diff(label[i:j])) + 1
                for a, b in zip([i, *cuts], [*cuts, j], strict=True):
                    image.append(k)
                    labels.append(int(label[a]))
                    points.append(_points(_traced(x[a:b], y[a:b])))
            yield pa.record_batch([batch.column(0).take(pa.array(image, pa.int64())), pa.array(labels, pa.int64()), pa.array(points, _POINTS)], names=["image_id", "label", "points"])

    kind = cells.schema["image_id"].dataType.simpleString()
    return lists.mapInArrow(run, f"image_id {kind}, label long, points {POINTS}")


def region_polygon(outline: list[tuple[float, float]], extent: float, mode: str = "minrect") -> np.ndarray:
    """A component's polygon: its outline, simplified by a hundredth of its extent (half a cell at least), grown by a tenth about its middle, and for ``minrect`` boxed."""
    p = np.array(outline, float)
    p = simplify_points(p, max(0.5, 0.01 * extent))
    p = p.mean(axis=0) + (p - p.mean(axis=0)) * 1.10
    return rectangle_points(p) if mode == "minrect" and len(p) >= 3 else p


def map_polygons(maps: DataFrame, threshold: float, width: int, height: int, mode: str = "minrect") -> DataFrame:
    """(image_id, label, polygon, bx0, by0, bx1, by1) of the components of each map, labelled as :func:`components.components` does.

    The box is that of the polygon, one more to the right and below, within the map. Maps stay in their rows: there is no shuffle.
    """
    kind = maps.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            image, rows = [], []
            for k, p in enumerate(batch.column(1)):
                if not p.is_valid or not len(p):
                    continue
                labels = label_cells(p.values.to_numpy(zero_copy_only=False).reshape(-1, width) >= threshold).ravel()
                cells = np.flatnonzero(labels)
                cells = cells[np.argsort(labels[cells], kind="stable")]  # each component's cells in their order, all in one sort
                for own in np.split(cells, np.flatnonzero(np.diff(labels[cells])) + 1) if len(cells) else ():
                    n, (y, x) = int(labels[own[0]]), divmod(own, width)
                    polygon = region_polygon(_traced(x, y), float(max(np.ptp(x), np.ptp(y)) + 1), mode)
                    (x0, y0), (x1, y1) = polygon.min(axis=0), polygon.max(axis=0)
                    image.append(k)
                    rows.append((n, _points(polygon), max(0.0, x0), max(0.0, y0), min(float(width), x1 + 1), min(float(height), y1 + 1)))
            columns = list(zip(*rows, strict=True)) or [[] for _ in range(6)]
            kinds = [pa.int64(), _POINTS, *[pa.float64()] * 4]
            yield pa.record_batch([batch.column(0).take(pa.array(image, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["image_id", "label", "polygon", "bx0", "by0", "bx1", "by1"])

    return maps.select("image_id", "p").mapInArrow(run, f"image_id {kind}, label long, polygon {POINTS}, bx0 double, by0 double, bx1 double, by1 double")


# ---- drawing -------------------------------------------------------------------------------


def draw_line(a: np.ndarray, x0: int, y0: int, x1: int, y1: int, colour: tuple[int, ...], thickness: int = 1) -> None:
    """A straight line in place; what lies outside the image is left out."""
    n = max(abs(x1 - x0), abs(y1 - y0))
    t = np.arange(n + 1)
    xs = np.floor(x0 + (x1 - x0) * t / max(1, n) + 0.5).astype(int)
    ys = np.floor(y0 + (y1 - y0) * t / max(1, n) + 0.5).astype(int)
    low = -((thickness - 1) // 2)
    for dy in range(low, low + thickness):
        for dx in range(low, low + thickness):
            x, y = xs + dx, ys + dy
            ok = (x >= 0) & (y >= 0) & (x < a.shape[1]) & (y < a.shape[0])
            a[y[ok], x[ok], : len(colour)] = colour


def draw_polygon(a: np.ndarray, points: list[tuple[float, float]], colour: tuple[int, ...], thickness: int = 1) -> None:
    for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1], strict=True):
        draw_line(a, round(x0), round(y0), round(x1), round(y1), colour, thickness)


def overlay(images: DataFrame, regions: DataFrame, box: tuple[int, int, int] = (255, 0, 0), polygon: tuple[int, int, int] = (0, 255, 0), thickness: int = 1) -> DataFrame:
    """Images (image_id, width, height, channels, data) with the boxes of their regions (image_id, x, y, w, h) drawn, and their polygons where there is such a column; both in the image's own coordinates."""
    shape = "image_id long, width int, height int, channels int, data binary"

    def run(pictures: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pictures.itertuples():
            a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels).copy()
            for m in marks.itertuples():
                x1, y1 = m.x + m.w - 1, m.y + m.h - 1
                draw_polygon(a, [(m.x, m.y), (x1, m.y), (x1, y1), (m.x, y1)], box[: r.channels], thickness)
                if m.polygon is not None and len(m.polygon):
                    draw_polygon(a, [(p["x"], p["y"]) for p in m.polygon], polygon[: r.channels], thickness)
            out.append((r.image_id, r.width, r.height, r.channels, a.tobytes()))
        return pd.DataFrame(out, columns=["image_id", "width", "height", "channels", "data"])

    points = F.col("polygon") if "polygon" in regions.columns else F.lit(None).cast(POINTS)
    rows = regions.select("image_id", "x", "y", "w", "h", points.alias("polygon"))
    return images.groupBy("image_id").cogroup(rows.groupBy("image_id")).applyInPandas(run, shape)


# ---- barcodes ------------------------------------------------------------------------------

# The symbologies that a backend can be asked for.
FORMATS = ("QR", "DataMatrix", "Aztec", "PDF417", "Code128", "Code39", "EAN8", "EAN13", "UPCA", "UPCE", "ITF", "Codabar")
# Other names of these.
ALIASES = {"data-matrix": "DataMatrix", "code-128": "Code128", "code-39": "Code39", "ean-8": "EAN8", "ean-13": "EAN13", "upc-a": "UPCA", "upc-e": "UPCE", "interleaved2of5": "ITF", "i2/5": "ITF"}


def barcode_format(name: str) -> str | None:
    """The symbology that a name stands for, whatever its case and the space around it; None for other names."""
    plain = name.strip().lower()
    return {f.lower(): f for f in FORMATS}.get(plain) or ALIASES.get(plain)


def decode_barcodes(images: DataFrame, backend, scales: tuple[float, ...] = (1.0, 1.5, 2.0), largest: int = 2000) -> DataFrame:
    """(image_id, type, value, confidence, x, y, w, h, points) by a backend ``(pixels) -> [(type, value, [(x, y), ...])]``.

    Where nothing is found the image is tried again larger, while its longer
    side stays within ``largest``; coordinates are mapped back and rounded, the
    box takes in its last pixel, and an unknown confidence is -1.
    """
    from .images import resized

    shape = "image_id long, type string, value string, confidence double, x int, y int, w int, h int, points array<struct<x: int, y: int>>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                for s in scales:
                    if s != 1 and max(r.width, r.height) * s > largest:
                        break
                    found = backend(a if s == 1 else resized(a, int(r.width * s), int(r.height * s)))
                    for kind, value, points in found:
                        xs, ys = ([int(np.floor(p[i] / s + 0.5)) for p in points] for i in (0, 1))
                        box = (min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1)
                        out.append((r.image_id, barcode_format(kind) or kind, value, -1.0, *box, [{"x": x, "y": y} for x, y in zip(xs, ys, strict=True)]))
                    if found:
                        break
            yield pd.DataFrame(out, columns=["image_id", "type", "value", "confidence", "x", "y", "w", "h", "points"])

    return images.select("image_id", "width", "height", "channels", "data").mapInPandas(run, shape)
