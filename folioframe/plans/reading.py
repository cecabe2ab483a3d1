"""From maps and scores to results: the stages composed to one lazy plan.

Models are plugged in as functions of DataFrames: ``detect`` gives maps
(image_id, p, map_w, map_h), ``recognise`` gives scores (image_id, label,
steps) for regions. Without models both can be made-up tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CleanText, Detector, MultiScale, Recognizer
from ..functions import text as T
from ..operators import boxes as B
from ..operators import components as C
from ..operators import contours as N
from ..operators import geometry as G
from ..operators import maps as M
from ..operators import sequences as S


def regions(maps: DataFrame, width: int, height: int, cfg: Detector | None = None) -> DataFrame:
    """(image_id, region_id, box, confidence, polygon): morphology, threshold, components, confidence filter, polygons, suppression."""
    cfg = cfg or Detector()
    maps = M.morphology(maps.select("image_id", "p"), cfg.morphology, width)
    cut, least = cfg.db_threshold, F.lit(cfg.box_threshold)
    if cfg.thresholds.enabled:  # a threshold of its own for each map: what is under it becomes 0, so that one cut serves all
        own = M.thresholds(maps, cfg.thresholds).select("image_id", "db", "box")
        maps = maps.join(own, "image_id").withColumn("p", F.transform("p", lambda x: F.when(x >= F.col("db"), x).otherwise(0.0)))
        stats = C.component_stats(C.components(maps, 1e-9, width)).join(own.select("image_id", "box"), "image_id")
        cut, least = 1e-9, F.col("box")
    else:
        stats = C.component_stats(C.components(maps, cut, width))
    rows = stats.join(N.map_polygons(maps, cut, width, height, cfg.polygon), ["image_id", "label"]).withColumn("confidence", C.confidence(cfg.confidence, cfg.gamma))
    if cfg.adaptive_confidence:
        rows = C.adaptive_filter(rows, least, float(width * height), cfg.adaptive_confidence_scale)
    else:
        rows = rows.filter(F.col("confidence") >= least)
    box = [F.col(c).alias(n) for c, n in (("bx0", "min_x"), ("by0", "min_y"), ("bx1", "max_x"), ("by1", "max_y"))]
    rows = rows.select("image_id", F.col("label").alias("region_id"), *box, "confidence", "polygon")
    return B.suppress(rows, cfg) if cfg.nms else rows


def regions_at_scales(maps_at: Callable[[float], tuple[DataFrame, int, int]], width: int, height: int, cfg: Detector) -> DataFrame:
    """The regions found at several scales, in the coordinates of the maps at scale 1, suppressed together; where there are none, those at scale 1.

    ``maps_at`` gives the maps at a scale with their width and height. Scales are the configured ones, or a ladder by the image's size if they are adaptive.
    """
    multi = cfg.multi_scale
    scales = B.scale_ladder(width, height, replace(multi, scales=())) if multi.adaptive else [s for s in multi.scales or MultiScale().scales if s > 0]
    single, levels = replace(cfg, nms=False), []
    for i, scale in enumerate(scales):
        maps, w, h = maps_at(scale)
        found = regions(maps, w, h, single).withColumn("region_id", F.col("region_id") + F.lit(i << 32))
        levels.append((scale, found.withColumn("polygon", G.scale_points(F.col("polygon"), 1 / scale, 1 / scale))))
    merged = B.merge_scales(levels, cfg)
    maps, w, h = maps_at(1.0)
    rest = maps.join(merged.select("image_id").distinct(), "image_id", "left_anti")
    return merged.unionByName(regions(rest, w, h, cfg))


def texts(scores: DataFrame, dictionary: DataFrame, cfg: Recognizer | None = None, clean: CleanText | None = None) -> DataFrame:
    """(image_id, region_id, text, rec_conf, language) from scores (image_id, region_id, steps), decoded greedily or by beam search."""
    cfg = cfg or Recognizer()
    keyed = scores.select(F.struct("image_id", "region_id").alias("key"), "steps")
    if cfg.decode == "beam":
        best = S.beam_search(keyed, cfg.blank, cfg.beam_width, "key").filter("rank = 1")
        read = best.select("key", "classes", F.col("confidence").alias("rec_conf"))
    else:
        out = S.greedy(keyed, cfg.blank)
        read = out.select("key", F.col("out.idx").alias("classes"), S.mean_confidence(F.col("out.prob")).alias("rec_conf"))
    found = S.with_tokens(read, dictionary).select("key.image_id", "key.region_id", T.clean(S.spelled(F.col("classes"), F.col("__tokens")), clean).alias("text"), "rec_conf")
    return found.withColumn("language", T.language(F.col("text")))


def results(
    maps: DataFrame,
    width: int,
    height: int,
    recognise: Callable[[DataFrame], DataFrame],
    dictionary: DataFrame,
    detector: Detector | None = None,
    recognizer: Recognizer | None = None,
    clean: CleanText | None = None,
    maps_at: Callable[[float], tuple[DataFrame, int, int]] | None = None,
) -> DataFrame:
    """Regions with their texts in reading order: image_id, ord, x, y, w, h, det_conf, text, rec_conf, language.

    ``maps_at`` gives the maps at other scales, where the options ask for them.
    """
    scaled = maps_at is not None and detector is not None and detector.multi_scale.enabled
    found = B.top_left_order(regions_at_scales(maps_at, width, height, detector) if scaled else regions(maps, width, height, detector))
    read = texts(recognise(found), dictionary, recognizer, clean)
    whole = lambda c: F.col(c).cast("int")
    return found.join(read, ["image_id", "region_id"], "left").select(
        "image_id",
        "ord",
        whole("min_x").alias("x"),
        whole("min_y").alias("y"),
        (whole("max_x") - whole("min_x")).alias("w"),
        (whole("max_y") - whole("min_y")).alias("h"),
        F.col("confidence").alias("det_conf"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("rec_conf", F.lit(0.0)).alias("rec_conf"),
        F.coalesce("language", F.lit("")).alias("language"),
    )
