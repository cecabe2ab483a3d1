"""Operators on literal examples and invariants."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioframe.config import AdaptiveThresholds, CleanText, Detector, Hybrid, MultiScale, RateLimit, Recognizer
from folioframe.functions import text as T
from folioframe.operators import boxes, components, geometry, images, limits, maps, pages, sequences
from folioframe.sources import files, sinks

BOXES = "image_id long, region_id long, min_x double, min_y double, max_x double, max_y double, confidence double"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# ---- sequences -----------------------------------------------------------------------------


def test_ctc_collapse(spark):
    path = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(0.9).alias("prob")) for i in (1, 1, 0, 2, 2, 2, 3, 0, 3)])
    assert [x["idx"] for x in one(spark, sequences.collapse(path))] == [1, 2, 3, 3]


def test_greedy_and_layout(spark):
    steps = images.synthetic_logits([1, 1, 0, 2], 4).tolist()
    df = spark.createDataFrame([(1, steps)], "seq_id long, steps array<array<double>>")
    assert [x["idx"] for x in sequences.greedy(df).first()["out"]] == [1, 2]
    flat = [v for s in steps for v in s]
    by_class = [steps[t][c] for c in range(4) for t in range(4)]
    shape = F.array(F.lit(1), F.lit(3), F.lit(4))
    assert one(spark, sequences.time_major(F.array(*map(F.lit, flat[:12])), shape, 4)) == steps[:3]
    assert len(by_class) == 16


def test_beam_keeps_runs_across_blanks():
    steps = [[0.1, 0.9], [0.9, 0.1], [0.1, 0.9]]
    best = sequences._beam(steps, 0, 5)[0]
    assert best[0] == (1,)
    assert [x[1] for x in sequences._beam(steps, 0, 5)] == sorted((x[1] for x in sequences._beam(steps, 0, 5)), reverse=True)


# ---- components ----------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.randoms(use_true_random=False))
def test_labels_against_flood_fill(h, w, rng):
    mask = np.array([[rng.random() < 0.55 for _ in range(w)] for _ in range(h)])
    want, n = np.zeros((h, w), int), 0
    for y in range(h):
        for x in range(w):
            if mask[y, x] and not want[y, x]:
                n += 1
                todo = [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < h and 0 <= b < w and mask[a, b] and not want[a, b]:
                        want[a, b] = n
                        todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    assert (components.label(mask) == want).all()


def test_components_of_mixed_maps(spark):
    rows = [(1, [0.9, 0.1, 0.9, 0.9]), (2, None), (3, []), (4, [0.0] * 4), (5, [0.9, 0.9])]
    df = spark.createDataFrame(rows, "image_id long, p array<double>")
    got = sorted((r["image_id"], r["y"], r["x"], r["label"]) for r in components.components(df, 0.5, 2).collect())
    assert got == [(1, 0, 0, 1), (1, 1, 0, 1), (1, 1, 1, 1), (5, 0, 0, 1), (5, 0, 1, 1)]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 4), st.randoms(use_true_random=False))
def test_morphology_invariants(half, rng):
    a = np.array([[[rng.random() for _ in range(7)] for _ in range(6)]])
    assert (maps.morph(a, "dilate", half) >= a).all() and (maps.morph(a, "erode", half) <= a).all()
    assert maps.morph(a, "smooth", half).var() <= a.var() + 1e-12
    want = np.array([[a[0, max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1].mean() for x in range(7)] for y in range(6)])
    assert np.allclose(maps.morph(a, "smooth", half)[0], want)


def test_thresholds_are_bounded(spark):
    df = spark.createDataFrame([(i, np.random.default_rng(i).random(64).tolist()) for i in range(5)], "image_id long, p array<double>")
    for method in ("otsu", "histogram", "dynamic", "other"):
        for r in maps.thresholds(df, AdaptiveThresholds(enabled=True, method=method)).collect():
            assert 0.1 <= r["db"] <= 0.8 and 0.3 <= r["box"] <= 0.9 and r["box"] >= r["db"]


# ---- boxes ---------------------------------------------------------------------------------


def test_nms_literal(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 1.0, 11.0, 11.0, 0.8), (1, 3, 50.0, 50.0, 60.0, 60.0, 0.7), (2, 4, 0.0, 0.0, 1.0, 1.0, 0.1)]
    df = spark.createDataFrame(rows, BOXES)
    assert {r["region_id"] for r in boxes.nms(df, 0.3).collect()} == {1, 3, 4}
    soft = {r["region_id"]: r["confidence"] for r in boxes.soft_nms(df, "linear").collect()}
    assert soft[1] == 0.9 and soft[2] == pytest.approx(0.8 * (1 - 81 / 119)) and soft[4] == 0.1


def test_scale_ladder():
    assert boxes.scale_ladder(1000, 2000, MultiScale()) == [1.0, 0.75, 0.5]
    assert boxes.scale_ladder(400, 400, MultiScale(scales=())) == [1.0]
    assert boxes.scale_ladder(1000, 1000, MultiScale(scales=())) == [1.0, 0.75, 0.5625]
    assert boxes.scale_ladder(0, 5, MultiScale()) == [1.0]


# ---- text ----------------------------------------------------------------------------------


def test_clean_text(spark):
    raw = "​ á\x07 “x” – «y»\t\n z "
    assert one(spark, T.clean(F.lit(raw))) == "á “x” – «y» z"
    assert one(spark, T.clean(F.lit(raw), CleanText(language="fr"))) == 'á "x" - "y" z'


def test_language_and_validity(spark):
    assert one(spark, T.language(F.lit("über süß"))) == "de"
    assert one(spark, T.language(F.lit("plain words"))) == "en"
    assert one(spark, T.language(F.lit("123"))) == ""
    assert one(spark, T.is_valid(F.lit(""))) and not one(spark, T.is_valid(F.lit(".......ab")))


def test_similarity_counts_repeats(spark):
    assert one(spark, T.similarity(F.lit("x"), F.lit("x x x"))) == 3.0


def test_parsers(spark):
    assert one(spark, T.memory_size(F.lit("1.5 gb"))) == 1610612736 and one(spark, T.memory_size(F.lit("x"))) is None
    assert tuple(one(spark, T.hex_colour(F.lit("#0aFF10")))) == (10, 255, 16)
    assert one(spark, T.client_key(F.lit(" 1.2.3.4, 5.6.7.8"), F.lit(None), F.lit("9.9.9.9:80"))) == "1.2.3.4"
    assert one(spark, T.client_key(F.lit(None), F.lit(""), F.lit("[::1]:80"))) == "::1"


# ---- pages ---------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("q", "c", "text", "images_", "want"),
    [(0.9, 0.9, True, 1, "hybrid"), (0.9, 0.9, True, 0, "vector"), (0.9, 0.5, True, 1, "ocr"), (0.9, 0.5, True, 0, "vector"), (0.6, 0.1, True, 2, "hybrid"), (0.0, 0.0, False, 1, "ocr"), (0.0, 0.0, False, 0, "skip")],
)
def test_strategy(spark, q, c, text, images_, want):
    assert one(spark, pages.strategy(F.lit(q), F.lit(c), F.lit(text), F.lit(images_)))["strategy"] == want


def test_page_ranges(spark):
    df = spark.createDataFrame([(1, "1-3, 2,7")], "id long, spec string")
    assert [r["page"] for r in pages.page_ranges(df).orderBy("ord").collect()] == [1, 2, 3, 2, 7]
    with pytest.raises(Exception, match="high to low"):
        pages.page_ranges(spark.createDataFrame([(1, "5-2")], "id long, spec string")).collect()


def test_spatial_merge_prefers_own_text(spark):
    shape = "page_id long, elem_id long, text string, source string, x double, y double, w double, h double, rec_conf double"
    rows = [(1, 1, "own", "vector", 50.0, 10.0, 40.0, 10.0, 0.0), (1, 2, "read", "ocr", 52.0, 10.0, 40.0, 10.0, 0.9), (1, 3, "far", "ocr", 200.0, 10.0, 40.0, 10.0, 0.9), (1, 4, "weak", "ocr", 50.0, 90.0, 40.0, 10.0, 0.1)]
    df = spark.createDataFrame(rows, shape)
    assert pages.merge_spatial(df).first()["combined"] == "own far"
    assert pages.merge_spatial(df, Hybrid(prefer_vector=False)).first()["combined"] == "own far"


# ---- limits --------------------------------------------------------------------------------


def test_limits_are_gaps():
    usage, rules = limits.Usage(), RateLimit(per_minute=2)
    s = 1_000_000
    assert [usage.check(t * s, 1, rules)[0] for t in (0, 10, 20, 69, 70, 200)] == ["ok", "ok", "minute", "minute", "ok", "ok"]
    usage, rules = limits.Usage(), RateLimit(bytes_per_day=10)
    assert [usage.check(t, 6, rules)[0] for t in (0, limits.MINUTE, limits.DAY)] == ["ok", "data", "ok"]


def test_stream_equals_replay(spark, tmp_path):
    from folioframe.streaming import limiter

    rows = [(i, i % 3, f"2024-01-0{1 + i // 60} 00:{i % 60:02d}:{i * 7 % 60:02d}", 10 + i) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, data_size long").withColumn("ts", F.to_timestamp("ts"))
    rules = RateLimit(per_minute=2, per_hour=15, requests_per_day=25, bytes_per_day=2000)
    df.filter("event_id < 60").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.filter("event_id >= 60").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = limiter.limited(stream, rules).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {r["event_id"]: r["verdict"] for r in spark.table("limited").collect()}
    want = {r["event_id"]: r["verdict"] for r in limits.replay(df, rules).collect()}
    assert got == want and set(want.values()) > {"ok"}


# ---- geometry ------------------------------------------------------------------------------

points = st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=25)


@settings(max_examples=80, deadline=None)
@given(points)
def test_hull_and_rectangle(p):
    a = np.array(p, float)
    hull = geometry.hull_points(a)
    assert (geometry.hull_points(hull) == hull).all()
    if len(hull) > 2:
        e = np.roll(hull, -1, axis=0) - hull
        for q in a:
            assert (e[:, 0] * (q[1] - hull[:, 1]) - e[:, 1] * (q[0] - hull[:, 0]) >= -1e-9).all()
        r = geometry.rectangle_points(a)
        size = np.linalg.norm(r[1] - r[0]) * np.linalg.norm(r[2] - r[1])
        assert size <= np.ptp(a[:, 0]) * np.ptp(a[:, 1]) + 1e-6


def test_simplify_keeps_ends():
    p = np.array([(0, 0), (1, 0.1), (2, -0.1), (3, 5), (4, 6), (5, 7)], float)
    s = geometry.simplify_points(p, 0.5)
    assert (s[0] == p[0]).all() and (s[-1] == p[-1]).all() and len(s) < len(p)
    assert (geometry.simplify_points(p, 0) == p).all()


def test_homography_round_trip(spark):
    src, dst = np.array([(0, 0), (4, 0), (4, 3), (0, 3)], float), np.array([(1, 1), (9, 2), (8, 7), (0, 6)], float)
    h = geometry.homography(src, dst)
    for (x, y), (u, v) in zip(src, dst, strict=True):
        got = one(spark, geometry.apply_homography(list(h), F.lit(float(x)), F.lit(float(y))))
        assert (got["x"], got["y"]) == pytest.approx((u, v))
    assert geometry.homography(src[[0, 0, 0, 0]], dst) is None
    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert (geometry.warp(image, np.eye(3).reshape(-1), 4, 4) == image).all()


# ---- images and files ------------------------------------------------------------------------


def test_resize_and_pad():
    a = np.full((40, 60, 3), 77, np.uint8)
    assert (images.resized(a, 32, 32) == 77).all()
    assert images.padded(a, 50, 50).shape == (50, 50, 3) and images.padded(a, 50, 50)[0].sum() == 0
    t = images.tensor(a)
    assert t.shape == (1, 3, 40, 60) and t.max() == np.float32(77 / 255)


def test_fit_size(spark):
    assert tuple(one(spark, images.fit_size(F.lit(2048), F.lit(1000)))) == (1024, 480)
    assert one(spark, images.fit_size(F.lit(31), F.lit(1000))) is None


def test_discovery(spark, tmp_path):
    for name in ("a.png", "b.JPG", "c.txt", "skip_d.png"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/e.bmp").write_bytes(b"x")
    names = lambda df: sorted(r["path"].rsplit("/", 1)[1] for r in df.collect())
    assert names(files.discover(spark, str(tmp_path), exclude=["skip_*"])) == ["a.png", "b.JPG"]
    assert names(files.discover(spark, str(tmp_path), recursive=True, include=["?.*"])) == ["a.png", "b.JPG", "e.bmp"]


def test_dictionaries(spark, tmp_path):
    (tmp_path / "one.txt").write_text("﻿a\nb\n \n")
    (tmp_path / "two.txt").write_text("b\nc")
    lines = files.dictionary_lines(spark, [str(tmp_path / "one.txt"), str(tmp_path / "two.txt")])
    assert [tuple(r) for r in files.merged_dictionary(lines).orderBy("idx").collect()] == [(0, "a"), (1, "b"), (2, " "), (3, "c")]


def test_json_round_trip(spark):
    rows = [(1, 1, 3, 4, 5, 6, 'say "hi"\n'), (1, 2, 0, 0, 1, 1, "b")]
    df = spark.createDataFrame(rows, "image_id long, ord int, x int, y int, w int, h int, text string")
    assert sorted(map(tuple, sinks.regions_from_json(sinks.json_regions(df)).collect())) == sorted(rows)


# ---- outlines ------------------------------------------------------------------------------


def test_outline_is_one_lap():
    from folioframe.operators import contours

    mask = np.zeros((8, 8), bool)
    mask[2:6, 2:6] = True
    assert sorted(contours.trace(mask)) == [(2, 2), (2, 5), (5, 2), (5, 5)]
    bar = np.zeros((3, 7), bool)
    bar[1, 1:6] = True
    assert {(1, 1), (5, 1)} <= set(contours.trace(bar))
    dot = np.zeros((3, 3), bool)
    dot[1, 1] = True
    assert contours.trace(dot) == [(1, 1)] and contours.trace(dot & False) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 8), st.integers(1, 8), st.randoms(use_true_random=False))
def test_outline_spans_the_component(h, w, rng):
    from folioframe.operators import contours

    labels = components.label(np.array([[rng.random() < 0.6 for _ in range(w)] for _ in range(h)]))
    if labels.max():
        ys, xs = np.nonzero(labels == 1)
        out = contours.trace(labels == 1)
        assert all(labels[y, x] == 1 for x, y in out)
        assert (min(x for x, _ in out), max(x for x, _ in out), min(y for _, y in out), max(y for _, y in out)) == (xs.min(), xs.max(), ys.min(), ys.max())


# ---- neighbouring benchmark items --------------------------------------------------------


def test_all_neighbours_have_figures(spark, tmp_path):
    """Accented items too; figures by brute force."""
    from collections import Counter

    from folioframe.plans import catalogue

    texts = ["plain words here", "Größe der Tür", "größe der Türen", "", "été à Paris", "漢字 𝒳 here", "plain"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    car, war, similarity = {}, {}, {}
    for i, (a, b) in enumerate(zip(texts, texts[1:])):
        a, b = a.lower(), b.lower()
        x, y = a.split(), b.split()
        car[i] = 1 - distance(a, b) / max(len(a), len(b))
        war[i] = sum(min(n, Counter(x)[w]) for w, n in Counter(y).items()) / len(y) if y else 1
        common = sum(w in x for w in y)
        similarity[i] = common / (len(x) + len(y) - common) if x and y else 0
    for name, want in (("levenshtein_car", car), ("war", war), ("text_similarity", similarity)):
        rows = catalogue.QUERIES[name](spark, str(tmp_path)).collect()
        assert {r["item_id"]: r[1] for r in rows} == pytest.approx(want, abs=1e-6), name


# ---- polygons, scales, beam in the plan --------------------------------------------------


def square_map(*boxes, side=16, value=0.9):
    a = np.full((side, side), 0.05)
    for x0, y0, x1, y1 in boxes:
        a[y0:y1, x0:x1] = value
    return [float(v) for v in a.reshape(-1)]


MAP = "image_id long, p array<double>"


def test_polygons_of_maps(spark):
    from folioframe.operators import contours

    maps = spark.createDataFrame([(1, square_map((2, 3, 8, 7), (10, 10, 13, 15))), (2, square_map()), (3, None)], MAP)
    got = {(r["image_id"], r["label"]): r for r in contours.map_polygons(maps, 0.5, 16, 16).collect()}
    assert set(got) == {(1, 1), (1, 2)}
    r = got[(1, 1)]  # cells 2..7 by 3..6, grown by a tenth about the middle (4.5, 4.5)
    assert (r["bx0"], r["by0"], r["bx1"], r["by1"]) == pytest.approx((1.75, 2.85, 8.25, 7.15))
    assert sorted((round(p["x"], 6), round(p["y"], 6)) for p in r["polygon"]) == [(1.75, 2.85), (1.75, 6.15), (7.25, 2.85), (7.25, 6.15)]
    line = contours.region_polygon([(0.0, 0.0), (4.0, 4.0)], 5, "contour")
    assert len(line) == 2


def test_regions_carry_polygons_through_suppression(spark):
    from folioframe.plans import reading

    maps = spark.createDataFrame([(1, square_map((2, 3, 8, 7), (10, 10, 13, 15)))], MAP)
    for method in ("hard", "linear", "gaussian"):
        got = reading.regions(maps, 16, 16, Detector(nms_method=method)).collect()
        assert len(got) == 2 and all(len(r["polygon"]) == 4 for r in got)


def test_scales_are_joined_and_fall_back(spark):
    from folioframe.plans import reading

    full = spark.createDataFrame([(1, square_map((2, 2, 8, 8))), (2, square_map((9, 9, 15, 15)))], MAP)
    half = spark.createDataFrame([(1, square_map((1, 1, 4, 4), (5, 5, 8, 8), side=8)), (2, square_map(side=8))], MAP)
    at = lambda s: (full, 16, 16) if s == 1 else (half, 8, 8)
    cfg = Detector(multi_scale=MultiScale(enabled=True, scales=(1.0, 0.5)))
    got = sorted((r["image_id"], round(r["min_x"])) for r in reading.regions_at_scales(at, 16, 16, cfg).collect())
    assert got == [(1, 2), (1, 10), (2, 9)]  # one of the two sightings of the first square, and the one only seen at a half
    only_half = Detector(multi_scale=MultiScale(enabled=True, scales=(0.5,)))
    got = sorted((r["image_id"], round(r["min_x"])) for r in reading.regions_at_scales(at, 16, 16, only_half).collect())
    assert got == [(1, 2), (1, 10), (2, 9)]  # the second image has nothing at a half


def test_beam_and_greedy_in_the_plan(spark):
    from folioframe.plans import reading

    steps = [[float(v) for v in row] for row in images.synthetic_logits([1, 0, 1, 2], 4)]
    scores = spark.createDataFrame([(1, 1, steps)], "image_id long, region_id long, steps array<array<double>>")
    dictionary = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx int, token string")
    read = lambda how: reading.texts(scores, dictionary, Recognizer(decode=how, beam_width=4)).first()["text"]
    assert read("greedy") == "aab" and read("beam") == "ab"  # a blank doesn't end a run of the beam's
    assert reading.texts(scores, dictionary.limit(0)).first()["text"] == ""


def test_read_images_is_made_of_its_parts(spark, data):
    """The composed plan against its parts, put together here."""
    from folioframe.plans import catalogue

    got = catalogue.read_images(spark, data).collect()
    maps, logits = catalogue.X.maps(spark, data), catalogue.X.logits(spark, data)
    path = {r["seq_id"]: r["text"] for r in catalogue.S.to_text(catalogue.S.greedy(logits), catalogue.X.dictionary(spark)).collect()}
    cells = catalogue.C.component_stats(catalogue.C.components(maps, Detector().db_threshold, 8)).collect()
    sure = {}
    for r in cells:
        if r["sum_p"] / r["n"] >= 0.7:
            sure.setdefault(r["image_id"], []).append(round(r["sum_p"] / r["n"], 6))
    assert got and {r["image_id"] for r in got} == set(sure)
    for r in got:
        assert r["det_conf"] in sure[r["image_id"]] and r["text"] == path[r["image_id"]]


# ---- pixels ----------------------------------------------------------------------------


def picture(spark, a, image_id=1):
    return spark.createDataFrame([(image_id, a.shape[1], a.shape[0], a.shape[2], a.tobytes())], images.IMAGE)


def pixels(row):
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"])


def test_overlay_draws_boxes_and_polygons(spark):
    from folioframe.operators import contours

    a = np.zeros((20, 30, 3), np.uint8)
    regions = spark.createDataFrame([(1, 2, 3, 6, 5, [(10.0, 10.0), (14.0, 10.0), (14.0, 14.0)])], "image_id long, x int, y int, w int, h int, polygon array<struct<x: double, y: double>>")
    got = pixels(contours.overlay(picture(spark, a), regions).first())
    assert got[3, 2].tolist() == got[7, 7].tolist() == [255, 0, 0] and got[5, 4].tolist() == [0, 0, 0]
    assert got[10, 12].tolist() == [0, 255, 0] and got[12, 14].tolist() == [0, 255, 0]
    plain = pixels(contours.overlay(picture(spark, a), regions.drop("polygon")).first())
    assert plain[10, 12].tolist() == [0, 0, 0]


def test_rectify_or_leave(spark):
    from folioframe.config import Rectify

    a = np.zeros((60, 80, 1), np.uint8)
    a[15:45, 20:60] = 200
    mask = (a[..., 0] > 0).astype(float)
    masks = spark.createDataFrame([(1, [float(v) for v in mask.reshape(-1)], 80)], "image_id long, p array<double>, mask_w int")
    on = Rectify(enabled=True, out_height=30)
    got = geometry.rectify(picture(spark, a), masks, on).first()
    assert got["rectified"] and got["height"] == 30 and abs(got["width"] - 40) <= 2 and (pixels(got) == 200).mean() > 0.95
    for cfg, m in ((Rectify(enabled=False), masks), (on, masks.limit(0)), (Rectify(enabled=True, min_area=0.9), masks)):
        left = geometry.rectify(picture(spark, a), m, cfg).first()
        assert not left["rectified"] and (pixels(left) == a).all()


def test_turned_quality_and_orientation(spark):
    from folioframe.config import Orientation

    a = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    got = images.turned(picture(spark, a).withColumn("angle", F.lit(90))).first()
    assert (pixels(got) == np.rot90(a)).all()
    q = images.image_quality(picture(spark, np.repeat(a[..., :1], 3, axis=2))).first()
    assert q["grey"] and not q["alpha"] and q["aspect"] == 2
    rows = spark.createDataFrame([(1, 100, 110, 90, 0.99), (2, 200, 100, 90, 0.9), (3, 200, 100, 90, 0.5)], "image_id long, width int, height int, angle int, confidence double")
    got = {r["image_id"]: (r["angle"], r["confidence"]) for r in images.orientation(rows, Orientation()).collect()}
    assert got == {1: (0, 1.0), 2: (90, 0.9), 3: (0, 0.5)}
    logits = one(spark, images.from_logits(F.array(*[F.lit(v) for v in (0.0, 3.0, 0.0, 0.0)])))
    assert logits["angle"] == 90 and logits["confidence"] == pytest.approx(np.exp(3) / (np.exp(3) + 3))
    assert images.filled(a, 7).shape == (2, 7, 3)


def test_corner_and_result_gates(spark):
    corners = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])
    got = one(spark, geometry.corner_gate(corners((0, 0), (1, 0), (1, 1), (0, 1)), F.lit(100.0), F.lit(50.0)))
    assert [(p["x"], p["y"]) for p in got] == [(0, 0), (99, 0), (99, 49), (0, 49)]
    assert one(spark, geometry.corner_gate(corners((0, 0), (0.01, 0), (1, 1), (0, 1)), F.lit(100.0), F.lit(50.0))) is None
    assert one(spark, geometry.rectangle_gate(corners((0, 0), (50, 0), (50, 40), (0, 40)), 100.0, 50.0))
    assert not one(spark, geometry.rectangle_gate(corners((0, 0), (90, 0), (90, 2), (0, 2)), 100.0, 50.0))
    rows = spark.createDataFrame([(0, 0, 10, 10, 0.5, 0.5), (5, 0, 100, 10, 0.5, 0.5), (0, 0, 1, 1, 1.5, 0.5)], "x int, y int, w int, h int, det_conf double, rec_conf double")
    assert [r[0] for r in rows.select(boxes.valid_result(100, 50)).collect()] == [True, False, False]


def test_barcodes_are_mapped_back(spark):
    from folioframe.operators import contours

    a = np.zeros((10, 10, 1), np.uint8)

    def backend(p):
        return [("data-matrix", "v", [(2, 2), (8, 2), (8, 8), (2, 8)])] if p.shape[0] == 20 else []

    r = contours.decode_barcodes(picture(spark, a), backend).first()
    assert (r["type"], r["value"], r["confidence"], r["x"], r["y"], r["w"], r["h"]) == ("DataMatrix", "v", -1.0, 1, 1, 4, 4)
    assert [contours.barcode_format(n) for n in (" UPC-A", "i2/5", "qr", "none")] == ["UPCA", "ITF", "QR", None]


# ---- options, documents, files -----------------------------------------------------------


def test_options_are_checked(spark):
    from folioframe.plans import builder

    o = builder.options({"detector": {"box_threshold": 0.6, "multi_scale": {"enabled": True, "scales": [1.0, 0.5]}}, "recognizer": {"decode": "beam"}})
    assert o.detector.multi_scale.scales == (1.0, 0.5) and o.recognizer.decode == "beam" and o.detector.db_threshold == 0.3
    for bad in ({"detector": {"box_threshold": 2}}, {"detector": {"polygon": "round"}}, {"nothing": 1}, {"detector": {"nothing": 1}}, {"recognizer": {"height": 0}}, {"detector": {"max_region_size": 3}}):
        with pytest.raises(ValueError):
            builder.options(bad)
    maps = spark.createDataFrame([(1, square_map((2, 3, 8, 7)))], MAP)
    steps = [[float(v) for v in row] for row in images.synthetic_logits([1, 2], 4)]
    give = lambda r: r.select("image_id", "region_id", F.array(*[F.array(*[F.lit(v) for v in s]) for s in steps]).alias("steps"))
    dictionary = spark.createDataFrame([(0, "a"), (1, "b")], "idx int, token string")
    reader = builder.Reader().with_detector(box_threshold=0.8).with_text(trim=True)
    assert [r["text"] for r in reader.run(maps, 16, 16, give, dictionary).collect()] == ["ab"]
    assert reader.with_detector(box_threshold=0.95).run(maps, 16, 16, give, dictionary).count() == 0
    with pytest.raises(ValueError):
        builder.Reader().with_detector(box_threshold=7).run(maps, 16, 16, give, dictionary)


def test_page_results_and_merges(spark):
    from folioframe.plans import documents

    analysis = spark.createDataFrame([("f", 1, "hybrid"), ("f", 2, "skip"), ("f", 3, "vector")], "file string, page int, strategy string")
    own = spark.createDataFrame([("f", p, f"own {p}", 612.0, 792.0) for p in (1, 2, 3)], "file string, page int, text string, page_w double, page_h double")
    pics = spark.createDataFrame([("f", 1, 1, 300, 200), ("f", 1, 2, 100, 400), ("f", 3, 1, 50, 60), ("f", 4, 1, 70, 80)], "file string, page int, image_index int, width int, height int")
    regions = spark.createDataFrame([("f", 1, 1, 1, 10, 150, 20, 10, 0.9, "read me", 0.9), ("f", 4, 1, 1, 0, 0, 5, 5, 0.5, "alone", 0.8)], "file string, page int, image_index int, ord int, x int, y int, w int, h int, det_conf double, text string, rec_conf double")
    got = {r["page"]: r for r in documents.page_results(analysis, own, pics, regions).collect()}
    assert set(got) == {1, 3, 4}
    assert (got[1]["width"], got[1]["height"], got[1]["own_text"], [len(i["regions"]) for i in got[1]["images"]]) == (300, 400, "own 1", [1, 0])
    assert (got[3]["width"], got[3]["height"], got[3]["own_text"], got[3]["images"]) == (612, 792, "own 3", [])
    assert (got[4]["strategy"], got[4]["width"], got[4]["own_text"]) == ("ocr", 70, None)
    rows = documents.elements(own, pics, regions)
    for how, want in (("append", "own 1\nread me"), ("confidence", "own 1 read me"), ("spatial", "read me own 1"), ("smart", "own 1 read me")):
        texts = [r["combined"] for r in documents.merged_text(rows, None, Hybrid(strategy=how)).collect() if "own 1" in r["combined"]]
        assert sorted(texts[0].split()) == sorted(want.split())
    assert '"total_pages":3' in documents.document_results(documents.page_results(analysis, own, pics, regions)).first()["json"]


def test_models_and_dictionaries_are_found(spark, tmp_path):
    (tmp_path / "det").mkdir()
    (tmp_path / "det" / "m.onnx").write_bytes(b"x")
    (tmp_path / "n.onnx").write_bytes(b"y")
    (tmp_path / "dict_de.txt").write_text("a")
    here = str(tmp_path)
    assert files.resolve_model(spark, "m.onnx", "det", here) == f"{here}/det/m.onnx" and files.resolve_model(spark, "n.onnx", "det", here) == f"{here}/n.onnx"
    assert files.resolve_model(spark, "gone.onnx", "rec", here) == f"{here}/rec/gone.onnx"
    assert files.available_models(spark, here).count() == 2
    assert files.dictionary_paths(spark, here, ["de", "xx"], "default.txt") == [f"{here}/dict_de.txt", "default.txt"]


def test_images_are_read_with_their_channels_in_order(spark, tmp_path):
    """A bitmap of two pixels, red and blue, and a file that is no image."""
    import struct

    row = bytes([0, 0, 255, 255, 0, 0, 0, 0])
    head = b"BM" + struct.pack("<IHHI", 54 + 8, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 24, 0, 8, 0, 0, 0, 0)
    (tmp_path / "a.bmp").write_bytes(head + row)
    (tmp_path / "b.png").write_bytes(b"no image")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.images(spark, str(tmp_path)).collect()}
    assert pixels(got["a.bmp"]).tolist() == [[[255, 0, 0], [0, 0, 255]]] and got["b.png"]["data"] is None


def test_batches_of_equal_shapes():
    """Each tensor's output is its own, whatever it went through the model with."""
    rng, calls = np.random.default_rng(0), []
    tensors = [rng.random((1, 3, 2 + i % 3)).astype(np.float32) for i in range(20)] + [rng.random((2, 3, 2)).astype(np.float32)]

    def model(x):
        calls.append(len(x))
        return x.sum(axis=1) * 2

    got = images.batched(tensors, model, most=4)
    assert all(np.allclose(y, (x.sum(axis=1) * 2).reshape(-1)) for x, y in zip(tensors, got, strict=True)) and max(calls) == 4


def test_replay_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, 1, 10, "web", "old"), (2, 1, 10, "app", "old")], "event_id long, user_id int, data_size long, client string, verdict string").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    got = limits.replay(df, RateLimit(per_minute=1)).orderBy("event_id").collect()
    assert [(r["client"], r["verdict"]) for r in got] == [("web", "ok"), ("app", "minute")]
