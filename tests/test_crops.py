"""Crops of pixels and the plan from pages to texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.config import Orientation, Recognizer
from folioframe.operators import crops as C
from folioframe.operators import images as I
from folioframe.plans import builder
from folioframe.sources import fixtures as X

REGION = "image_id long, region_id long, min_x double, min_y double, max_x double, max_y double, polygon array<struct<x: double, y: double>>"


def image_rows(spark, arrays):
    rows = [(i, a.shape[1], a.shape[0], a.shape[2], bytearray(a.tobytes())) for i, a in arrays.items()]
    return spark.createDataFrame(rows, I.IMAGE)


def test_tensors_are_literal_crops(spark):
    rng = np.random.default_rng(1)
    arrays = {1: rng.integers(0, 256, (60, 100, 3), np.uint8), 2: rng.integers(0, 256, (40, 30, 1), np.uint8), 3: rng.integers(0, 256, (20, 20, 4), np.uint8)}
    square = [(10.0, 10.0), (50.0, 10.0), (50.0, 29.0), (10.0, 29.0)]
    regions = [
        (1, 1, 5.5, 3.2, 40.1, 20.0, None),
        (1, 2, 0.0, 0.0, 10.0, 50.0, None),  # high: turned
        (1, 3, 0.0, 0.0, 1.0, 1.0, square),  # the polygon counts, not the box
        (1, 4, 200.0, 10.0, 210.0, 20.0, None),  # no pixel
        (2, 1, -5.0, -5.0, 99.0, 99.0, None),  # clamped to the whole image, high
        (9, 1, 0.0, 0.0, 5.0, 5.0, None),  # no such image
    ]
    cfg = Recognizer(height=16, pad_multiple=8, max_width=64)
    got = {(r.image_id, r.region_id): r for r in C.tensors(image_rows(spark, arrays), spark.createDataFrame(regions, REGION), cfg).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (2, 1)}
    literal = {
        (1, 1): (arrays[1][3:20, 5:41], False),
        (1, 2): (np.rot90(arrays[1][0:50, 0:10]), True),
        (1, 3): (arrays[1][10:29, 10:50], False),
        (2, 1): (np.rot90(np.repeat(arrays[2], 3, axis=2)), True),
    }
    widths = {k: min(64, max(1, p.shape[1] * 16 // p.shape[0])) for k, (p, _) in literal.items()}
    widest = {i: max(-(-w // 8) * 8 for (j, _), w in widths.items() if j == i) for i in (1, 2)}
    for key, (patch, turned) in literal.items():
        r, w = got[key], widths[key]
        want = np.zeros((16, widest[key[0]], 3), np.uint8)
        want[:, :w] = I.resized(patch, w, 16)
        assert (r.turned, r.width, list(r.shape)) == (turned, w, [1, 3, 16, widest[key[0]]])
        assert np.allclose(np.array(r.data).reshape(3, 16, -1), want.transpose(2, 0, 1) / 255, atol=1e-6)


def test_straight_crops_small_batches_and_none(spark, monkeypatch):
    a = np.zeros((40, 60, 3), np.uint8)
    a[10:30, 20:50] = 200
    corners = [(20.0, 10.0), (49.0, 10.0), (49.0, 29.0), (20.0, 29.0)]
    regions = spark.createDataFrame([(1, k, 0.0, 0.0, 9.0, 9.0, corners) for k in range(5)], REGION)
    rows = C.tensors(image_rows(spark, {1: a}), regions, Recognizer(height=8), straight=True).collect()
    assert len(rows) == 5 and all(abs(np.array(r.data).reshape(3, 8, -1)[:, :, : r.width] - 200 / 255).max() < 1e-6 for r in rows)
    empty = spark.createDataFrame([], REGION)
    assert C.tensors(image_rows(spark, {1: a}), empty).count() == 0
    assert C.tensors(image_rows(spark, {1: a}), regions.drop("polygon").withColumn("max_x", F.col("min_x"))).count() == 0


def test_orientations_and_upright(spark):
    lines = np.full((60, 30, 1), 255, np.uint8)
    lines[:, ::4] = 0  # many changes along rows
    square = np.full((30, 30, 1), 255, np.uint8)
    arrays = {1: lines, 2: np.ascontiguousarray(np.rot90(lines)), 3: square}
    images, cfg = image_rows(spark, arrays), Orientation(enabled=True)
    found = {r.image_id: (r.angle, round(r.confidence, 3)) for r in C.orientations(images, cfg).collect()}
    assert found == {1: (0, 1.0), 2: (90, 1.0), 3: (0, 1.0)}
    turned = {r.image_id: I.pixels_of(r) for r in C.upright(images, cfg).collect()}
    assert (turned[1] == lines).all() and (turned[2] == np.rot90(lines, 2)).all()
    assert C.upright(images, Orientation()).count() == 3
    scores = lambda rows: rows.filter("image_id = 1").select("image_id", F.array(*map(F.lit, (0.0, 0.0, 9.0, 0.0))).alias("scores"))
    told = {r.image_id: r.angle for r in C.orientations(images, Orientation(heuristic_fallback=False), scores).collect()}
    assert told == {1: 180, 2: 0, 3: 0}


def test_pages_to_texts(spark):
    a = np.full((64, 128, 1), 255, np.uint8)
    a[8:16, 16:96] = 0
    pages = [("f", 1, "own", 600.0, 800.0, 0.9, 0.9, True, 0), ("f", 2, "", 600.0, 800.0, 0.0, 0.0, False, 1), ("f", 3, "own three", 600.0, 800.0, 0.9, 0.9, True, 1), ("f", 4, "", 600.0, 800.0, 0.0, 0.0, False, 0)]
    pages = spark.createDataFrame(pages, "file string, page int, text string, page_w double, page_h double, quality double, coverage double, has_text boolean, image_count int")
    images = spark.createDataFrame([("f", p, 1, 128, 64, 1, bytearray(a.tobytes())) for p in (1, 2, 3)] + [("f", 2, 2, 8, 8, 1, bytearray(64))], "file string, page int, image_index int, width int, height int, channels int, data binary")
    dictionary = spark.createDataFrame([(0, "D"), (1, "L")], "idx int, token string")
    seen = []

    def detect(rows):
        seen.append(rows)
        return X.dark_maps(rows)

    reader = builder.Reader().with_hybrid(strategy="append").with_images(min_width=16, min_height=16).with_detector(polygon="minrect")
    got = {r.page: r for r in reader.run_pages(pages, images, detect, X.shade_scores, dictionary, 16, 16).collect()}
    assert seen[0].count() == 2  # pages 2 and 3: no image of the vector page, and none under the least size
    assert {p: r.strategy for p, r in got.items()} == {1: "vector", 2: "ocr", 3: "hybrid"}
    assert got[1].read == "own" and got[1].images == [] and got[2].read == "D"
    assert "own three" in got[3].read and "D" in got[3].read
    (image,) = got[2].images
    (region,) = image.regions
    assert (image.width, image.height) == (128, 64) and abs(region.x - 16) <= 8 and abs(region.y - 8) <= 8 and region.w >= 64
    turned = reader.with_orientation(enabled=True, threshold=0.0, skip_square=False)
    back = {r.page: r for r in turned.run_pages(pages, images, detect, X.shade_scores, dictionary, 16, 16).collect()}
    again = back[2].images[0].regions[0]
    assert abs(again.x + again.w / 2 - region.x - region.w / 2) <= 8 and abs(again.y + again.h / 2 - region.y - region.h / 2) <= 8
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("MapIn") < plan.index("LeftSemi")  # the branch lies under the work on pixels
    with pytest.raises(ValueError):
        reader.with_pages(quality=2.0).run_pages(pages, images, detect, X.shade_scores, dictionary, 16, 16)


def test_masks_and_limits(spark):
    a = np.zeros((64, 128, 1), np.uint8)
    a[16:48, 32:96] = 255
    pages = spark.createDataFrame([("f", 1, "", 600.0, 800.0, 0.0, 0.0, False, 1)], "file string, page int, text string, page_w double, page_h double, quality double, coverage double, has_text boolean, image_count int")
    images = spark.createDataFrame([("f", 1, 1, 128, 64, 1, bytearray(a.tobytes()))], "file string, page int, image_index int, width int, height int, channels int, data binary")
    mask = [1.0 if 16 <= i // 128 < 48 and 32 <= i % 128 < 96 else 0.0 for i in range(64 * 128)]
    masks = lambda rows: rows.select("image_id", F.lit(mask).alias("p"), F.lit(128).alias("mask_w"))
    dictionary = spark.createDataFrame([(0, "D"), (1, "L")], "idx int, token string")
    reader = builder.Reader().with_rectify(enabled=True, out_height=32)
    (page,) = reader.run_pages(pages, images, X.dark_maps, X.shade_scores, dictionary, 16, 16, masks=masks).collect()
    assert page.images[0].height == 32 and page.images[0].regions == []  # what the mask shows is light all over
    requests = spark.createDataFrame([(i, 1, f"2024-01-01 00:00:0{i}", 5, "a") for i in range(4)], "event_id long, user_id long, ts string, data_size long, kind string").withColumn("ts", F.to_timestamp("ts"))
    passed = builder.Reader().with_limits(per_minute=2).admitted(requests)
    assert [r.event_id for r in passed.orderBy("event_id").collect()] == [0, 1] and passed.columns == requests.columns


def test_query_reads_every_page(spark):
    from folioframe.plans.catalogue import QUERIES

    rows = QUERIES["page_reading"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = {r.doc_id: r.strategy for r in QUERIES["page_strategy"](spark, "/root/testdata/sf0.001").collect() if r.strategy != "skip"}
    assert {r.doc_id: r.strategy for r in rows} == want
    for r in rows:
        if r.strategy == "vector":
            assert r.read == docs[r.doc_id].text and r.n_regions == 0
        else:
            assert r.n_regions >= 1 and 8 <= r.x <= 30 and r.x + r.w <= 11 * (6 + len(str(r.doc_id))) * 2 + 60
            lines = r.read.split("\n")
            # a region one cell wide has a polygon without area, so no pixels and no text
            assert set(lines) <= {"d", "l"} and len(lines) <= r.n_regions if r.strategy == "ocr" else {"d", "l"} & set(lines)
