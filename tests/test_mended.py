"""Long texts, large maps and combined options."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioframe.config import AdaptiveThresholds, Detector
from folioframe.functions import text as T
from folioframe.operators import contours as N
from folioframe.operators import crops
from folioframe.operators import limits as L
from folioframe.operators import pages as P
from folioframe.plans import catalogue
from folioframe.plans import reading as R
from folioframe.plans.catalogue import QUERIES


def share(a, b):
    x, y = a.lower().split(), b.lower().split()
    known = set(x)
    common = sum(w in known for w in y)
    if not x or not y:
        return 1.0 if not x and not y else 0.0
    rest = len(x) + len(y) - common
    return common / rest if rest else 1.0


def test_similarity_and_accuracy_against_counts(spark):
    rng = np.random.default_rng(3)
    some = [" ".join(rng.choice(["a", "B", "c", "dd", "é"], n)) for n in (0, 1, 1, 2, 5, 9, 30, 31)]
    data = [(i * 10 + j, a, b) for i, a in enumerate(some) for j, b in enumerate(some)]
    rows = spark.createDataFrame(data, "k int, a string, b string")
    got = {r.k: r.s for r in rows.select("k", T.similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got == {k: pytest.approx(share(a, b)) for k, a, b in data}
    found = {r.k: r.war for r in T.word_accuracy(rows, "k", "a", "b").collect()}
    for k, a, b in data:
        x, y = Counter(a.lower().split()), Counter(b.lower().split())
        assert found[k] == pytest.approx(sum((x & y).values()) / sum(y.values()) if y else 1.0)


def test_long_texts_take_one_sort(spark):
    rng = np.random.default_rng(4)
    a, b = (" ".join(f"w{i}" for i in rng.integers(0, 5000, 20000)) for _ in range(2))
    rows = spark.createDataFrame([(1, a, b)], "k int, a string, b string")
    rows.select(T.similarity(F.col("a"), F.col("b"))).first()
    began = time.time()
    found = rows.select(T.similarity(F.col("a"), F.col("b"))).first()[0]
    assert time.time() - began < 5 and found == pytest.approx(share(a, b))


def test_similar_lines_go_once(spark):
    rows = spark.createDataFrame([(1, "a b c d e\n x y \n\nA B C D E\nx y z\n  x   y"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: r.text for r in P.distinct_lines(rows).collect()}
    assert got == {1: "a b c d e\nx y\nx y z", 2: "", 3: None} or got[3] in (None, "")


def test_polygons_of_a_large_map(spark):
    """Components of 960 x 960 cells: their boxes are those of the blocks drawn, whatever their number."""
    p, want = np.zeros((960, 960)), set()
    for y in range(0, 960, 16):
        for x in range(0, 960, 16):
            h, w = 2 + (x // 16 + y // 16) % 9, 2 + (x // 16) % 11
            p[y : y + h, x : x + w] = 0.9
            want.add((y, x, h, w))
    maps = spark.createDataFrame([(7, p.ravel().tolist())], "image_id long, p array<double>")
    rows = N.map_polygons(maps, 0.5, 960, 960, "contour").collect()
    assert len(rows) == len(want) == 3600
    assert sorted(r.label for r in rows) == list(range(1, 3601))
    for r, (y, x, h, w) in zip(sorted(rows, key=lambda r: r.label), sorted(want), strict=True):
        assert x - 1 <= r.bx0 <= x + 0.01 and y - 1 <= r.by0 <= y + 0.01 and x + w - 0.01 <= r.bx1 <= x + w + 1.2 and y + h - 0.01 <= r.by1 <= y + h + 1.2


def test_adaptive_thresholds_with_adaptive_confidence(spark):
    """Each map's own threshold is what the filter lowers for small boxes, not the fixed one."""
    rng = np.random.default_rng(6)
    data = []
    for i in range(30):
        p = rng.uniform(0, 0.3, (40, 40))
        for _ in range(5):
            y, x = rng.integers(0, 36, 2)
            p[y : y + 3, x : x + 3] = rng.uniform(0.2, 1.0)
        data.append((i, p.ravel().tolist()))
    maps = spark.createDataFrame(data, "image_id long, p array<double>")
    on = AdaptiveThresholds(enabled=True, method="dynamic")
    both = Detector(thresholds=on, adaptive_confidence=True, nms=False)
    low, high = (R.regions(maps, 40, 40, Detector(thresholds=on, adaptive_confidence=True, nms=False, box_threshold=t)) for t in (0.01, 0.99))
    found = R.regions(maps, 40, 40, both).select("image_id", "region_id").collect()
    assert sorted(found) == sorted(low.select("image_id", "region_id").collect()) == sorted(high.select("image_id", "region_id").collect())
    fixed = R.regions(maps, 40, 40, Detector(thresholds=on, nms=False)).select("image_id", "region_id").collect()
    assert set(fixed) <= set(found)


def test_counters_and_memory_of_a_hot_user_by_hours(spark):
    rng = random.Random(4)
    rows, at = [], 1_704_067_200
    for i in range(3000):
        at += rng.choice([0, 1, 20, 59, 60, 61]) if i % 40 else rng.choice([1, 3599, 3600, 3601, 9000])
        rows.append((i, None if i % 50 == 7 else 1 if i % 9 else 2, None if i in (5, 6, 2000) else at, None if i % 97 == 0 else rng.randrange(10**6)))
    df = spark.createDataFrame(rows, "event_id long, user_id long, at long, bytes long").withColumn("ts", F.timestamp_seconds("at")).repartition(5)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    plain = df.withColumn("gap", F.col("at") - F.lag("at").over(order))
    for k, most in (("minute", 60), ("hour", 3600)):
        plain = plain.withColumn("run", F.sum(F.coalesce((F.col("gap") >= most).cast("int"), F.lit(0))).over(order)).withColumn(k, F.row_number().over(Window.partitionBy("user_id", "run").orderBy("ts", "event_id")))
    found = L.gap_counters(df)
    assert found.columns == [*df.columns, "minute", "hour"] and found.count() == 3000
    assert sorted(found.select("event_id", "minute", "hour").collect()) == sorted(plain.select("event_id", "minute", "hour").collect())

    samples = df.select(F.col("user_id").alias("host"), F.struct("ts", "event_id").alias("ts"), "bytes", "event_id")
    for last, piece in ((60, 64), (60, 4096), (7, 1), (1, 10)):
        whole = L.moving_memory(samples, last).collect()
        pieces = L.moving_memory(samples, last, L.hour_of(F.unix_micros("ts.ts")), piece)
        assert sorted(pieces.select("event_id", "mean", "peak").collect(), key=lambda r: r[0]) == sorted([(r.event_id, r.mean, r.peak) for r in whole])


def test_requests_run_under_shared_accounts(spark):
    """Under five accounts runs are long, so limits and windows are reached; over the users themselves nearly every counter is 1."""
    d = "/root/testdata/sf0.01"
    events = spark.read.parquet(f"{d}/events.parquet").count()
    replay = QUERIES["rate_limit_replay"](spark, d).collect()
    assert len(replay) == events and {r.user_id for r in replay} == set(range(5))
    counters = QUERIES["gap_session_counters"](spark, d).collect()
    assert len(counters) == events and max(r.hour for r in counters) > 10


def test_images_of_pages_are_dealt_to_many_tasks(spark, data, monkeypatch):
    seen, own = [], catalogue.X.dark_maps
    monkeypatch.setattr(catalogue.X, "dark_maps", lambda images: seen.append(images) or own(images))
    QUERIES["page_reading"](spark, data)
    assert len(seen[0].groupBy(F.spark_partition_id().alias("task")).count().collect()) > 3


def test_replay_judges_all_users_beside_the_shared_accounts(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["rate_limit_replay"](spark, d).collect()
    own = L.replay(catalogue.X.requests(spark, d), catalogue.LIMITS).select("event_id", "user_id", "verdict", "wait_us").collect()
    assert sorted((r.event_id, r.own_id, r.own_verdict, r.own_wait_us) for r in got) == sorted(map(tuple, own))
    shared = L.replay(catalogue.X.requests(spark, d).withColumn("user_id", F.col("user_id") % 5), catalogue.SHARED_LIMITS).select("event_id", "user_id", "verdict", "wait_us").collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(map(tuple, shared)) and len({r.own_id for r in got}) > 100


def test_counters_of_all_users_beside_the_shared_accounts(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["gap_session_counters"](spark, d).collect()
    own = L.gap_counters(catalogue.X.requests(spark, d)).select("event_id", "user_id", "minute", "hour").collect()
    assert sorted((r.event_id, r.own_id, r.own_minute, r.own_hour) for r in got) == sorted(map(tuple, own)) and len({r.own_id for r in got}) > 100


def test_memory_of_all_users_beside_the_shared_accounts(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["memory_average"](spark, d).collect()
    samples = catalogue.X.requests(spark, d).select(F.col("user_id").alias("host"), F.struct("ts", "event_id").alias("ts"), F.col("data_size").alias("bytes"), "event_id")
    own = {r.event_id: (r.host, round(r.mean, 6), r.peak) for r in L.moving_memory(samples).collect()}
    assert {r.event_id: (r.own_id, r.own_mean, r.own_peak) for r in got} == own and len({r.own_id for r in got}) > 100


def test_lines_of_long_pages_are_compared_by_shared_rare_words(spark):
    rng = random.Random(6)
    for trial in range(400):
        vocabulary = rng.choice([3, 6, 30])
        lines = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(0, 12))]
        lines += [[w for w in rng.choice(lines) if rng.random() < 0.9] or ["w0"] for _ in range(len(lines))]
        least = rng.choice([0.0, 0.5, 0.8, 1.0])
        plain = []
        for i, x in enumerate(lines):
            common = {k: sum(w in x for w in lines[k]) for k in plain}
            if not any(c / (len(x) + len(lines[k]) - c) > least for k, c in common.items()):
                plain.append(i)
        assert P.kept_lines([" ".join(x) for x in lines], least) == plain, trial
    words = [f"w{i}" for i in range(2000)]
    text = "\n".join(" ".join(rng.choices(words, [1 / (i + 1) for i in range(2000)], k=40)) for _ in range(1000))
    rows = spark.createDataFrame([(1, text), (2, None), (3, "Same  Line\n \nsame line\nother")], "id int, text string")
    begun = time.monotonic()
    got = {r.id: r.text for r in P.distinct_lines(rows).collect()}
    assert time.monotonic() - begun < 20 and got == {1: text, 2: None, 3: "Same  Line\nother"}


def test_tensors_are_recognised_where_they_are_made(spark):
    images = spark.createDataFrame([(i, 40, 24, c, bytes([i * 60] * 960 * c)) for i, c in enumerate((1, 2, 3, 4))], "image_id long, width int, height int, channels int, data binary")
    regions = spark.createDataFrame([(i, k, 4.0 * k, 2.0, 20.0 + k, 20.0) for i in range(4) for k in range(3)], "image_id long, region_id long, min_x double, min_y double, max_x double, max_y double")
    apart = catalogue.X.shade_scores(crops.tensors(images, regions)).collect()

    def never(tensors):
        raise AssertionError("tensors left their task")

    never.batch = catalogue.X.shade_scores.batch
    together = crops.recognised(images, regions, never)
    assert sorted(map(str, together.collect())) == sorted(map(str, apart)) and len(apart) == 12
