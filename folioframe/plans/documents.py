"""Pages of documents: strategy, own text, recognised images, merged to page and document results.

Tables stand for what a reader of documents gives: ``analysis`` (file, page,
strategy), ``own`` (file, page, text, page_w, page_h), ``images`` (file, page,
image_index, width, height) and ``regions`` (file, page, image_index, ord, x,
y, w, h, det_conf, and text and rec_conf where they were read).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Hybrid
from ..operators import boxes as B
from ..operators import crops as C
from ..operators import geometry as G
from ..operators import images as I
from ..operators import pages as P
from . import reading as R

KEY = ("file", "page")


def elements(own: DataFrame, images: DataFrame, regions: DataFrame) -> DataFrame:
    """(file, page, page_id, elem_id, text, source, x, y, w, h, rec_conf): a page's own text and its recognised texts, as the merges take them.

    Own text is one element across the page; recognised boxes are centred and
    scaled from their image's pixels to the page's points.
    """
    page_id = F.xxhash64(*KEY).alias("page_id")
    first = own.filter("text <> ''").select(*KEY, page_id, F.lit(0).cast("long").alias("elem_id"), "text", F.lit("vector").alias("source"), (F.col("page_w") / 2).alias("x"), (F.col("page_h") / 2).alias("y"), F.lit(100.0).alias("w"), F.lit(12.0).alias("h"), F.lit(1.0).alias("rec_conf"))
    sized = regions.join(images, [*KEY, "image_index"]).join(own.select(*KEY, "page_w", "page_h"), list(KEY), "left")
    sx, sy = F.coalesce(F.col("page_w") / F.col("width"), F.lit(1.0)), F.coalesce(F.col("page_h") / F.col("height"), F.lit(1.0))
    place = (F.col("image_index") * 1_000_000 + F.col("ord")).cast("long").alias("elem_id")
    read = sized.select(*KEY, page_id, place, "text", F.lit("ocr").alias("source"), ((F.col("x") + F.col("w") / 2) * sx).alias("x"), ((F.col("y") + F.col("h") / 2) * sy).alias("y"), (F.col("w") * sx).alias("w"), (F.col("h") * sy).alias("h"), "rec_conf")
    return first.unionByName(read)


def merged_text(rows: DataFrame, scores: DataFrame | None = None, cfg: Hybrid | None = None) -> DataFrame:
    """(page_id, combined) by the strategy that the options choose; smart needs the scores (page_id, score) of the pages' own texts."""
    cfg = cfg or Hybrid()
    if cfg.strategy == "append":
        found = P.merge_append(rows, cfg)
    elif cfg.strategy == "confidence":
        found = P.merge_confidence(rows, cfg)
    elif cfg.strategy == "spatial" or scores is None:
        found = P.merge_spatial(rows, cfg).select("page_id", "combined")
    else:
        found = P.merge_smart(rows, scores, cfg)
    return P.distinct_lines(found, "combined", cfg.similarity) if cfg.deduplicate else found


def page_results(analysis: DataFrame, own: DataFrame, images: DataFrame, regions: DataFrame, default: str = "ocr") -> DataFrame:
    """(file, page, width, height, strategy, own_text, images): a row for each page that is not skipped.

    Pages without an analysis have the ``default`` strategy. A page's own text
    is taken for vector and hybrid, its images (image_index, width, height,
    confidence, regions) for ocr and hybrid. Its size is the largest of its images', else that of its own text in whole points.
    """
    region = F.struct("ord", "x", "y", "w", "h", "det_conf")
    lists = regions.groupBy(*KEY, "image_index").agg(F.array_sort(F.collect_list(region)).alias("regions"), F.avg("det_conf").alias("confidence"))
    seen = images.join(lists, [*KEY, "image_index"], "left")
    none = F.array().cast(lists.schema["regions"].dataType)
    picture = F.struct("image_index", "width", "height", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("regions", none).alias("regions"))
    seen = seen.groupBy(*KEY).agg(F.array_sort(F.collect_list(picture)).alias("images"), F.max("width").alias("width"), F.max("height").alias("height"))
    pages = seen.join(own.select(*KEY, "text", "page_w", "page_h"), list(KEY), "full").join(analysis.select(*KEY, "strategy"), list(KEY), "left")
    pages = pages.withColumn("strategy", F.coalesce("strategy", F.lit(default))).filter("strategy <> 'skip'")
    reads, tells = F.col("strategy").isin("ocr", "hybrid"), F.col("strategy").isin("vector", "hybrid")
    size = lambda image, page: F.coalesce(F.when(reads, F.col(image)), F.when(tells, F.col(page).cast("int")), F.lit(0))
    empty = F.array().cast(seen.schema["images"].dataType)
    return pages.select(
        *KEY,
        size("width", "page_w").alias("width"),
        size("height", "page_h").alias("height"),
        "strategy",
        F.when(tells, F.col("text")).alias("own_text"),
        F.coalesce(F.when(reads, F.col("images")), empty).alias("images"),
    )


def document_results(pages: DataFrame) -> DataFrame:
    """(file, json): one JSON document for each file, its pages in order."""
    item = F.struct("page", "width", "height", "strategy", "own_text", "images")
    lists = pages.groupBy("file").agg(F.count("*").alias("total_pages"), F.array_sort(F.collect_list(item)).alias("pages"))
    return lists.select("file", F.to_json(F.struct("file", "total_pages", "pages")).alias("json"))


def _cut(rows: DataFrame) -> DataFrame:
    """The rows from a checkpoint, where the session has a folder for them: what is used more than once isn't made again, and a lost executor costs its tasks only."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows


def processed(
    pages: DataFrame,
    images: DataFrame,
    detect: Callable[[DataFrame], DataFrame],
    recognise: Callable[[DataFrame], DataFrame],
    dictionary: DataFrame,
    map_w: int,
    map_h: int,
    options: Any,
    classify: Callable[[DataFrame], DataFrame] | None = None,
    masks: Callable[[DataFrame], DataFrame] | None = None,
    texts: DataFrame | None = None,
) -> DataFrame:
    """Page results (see :func:`page_results`) with ``read``, the page's text, from pages and their images' pixels in one lazy plan.

    ``pages`` are (file, page, text, page_w, page_h, quality, coverage,
    has_text, image_count), ``images`` (file, page, image_index, width, height,
    channels, data). The strategy is decided first, and only images of pages
    that are to be recognised, and are no smaller than the options allow, go on: turned
    upright (``classify`` may give scores of the angles), seen straight by their
    ``masks``, resized for ``detect``, which gives maps (image_id, p) of one
    size. Regions become tensors of the pixels, for which ``recognise`` gives
    scores (image_id, region_id, steps). Boxes go back to the image as it came,
    unless it was seen straight. A page's text is its own (vector), what was read
    in reading order (ocr), or both merged (hybrid). Pixels are read anew for maps, sizes and crops, which is less than a shuffle of them.
    ``texts`` may be the pages' (file, page, text, page_w, page_h) once more from where they lie, if ``pages`` have been dealt out to be judged.
    Where ``spark.checkpoint.dir`` is set, decisions, maps, boxes and regions, which hold no pixels, are written there as the plan is made; else all is lazy.
    """
    o, image_key = options, [*KEY, "image_index"]
    decided = pages.withColumn("strategy", P.strategy(F.col("quality"), F.col("coverage"), F.col("has_text"), F.col("image_count"), o.pages)["strategy"])
    decided = _cut(decided.select(*KEY, "strategy", "quality"))
    analysis, own = decided.select(*KEY, "strategy"), (pages if texts is None else texts).select(*KEY, "text", "page_w", "page_h")
    wanted = analysis.filter(F.col("strategy").isin("ocr", "hybrid")).select(*KEY)
    taken = images.filter(~I.too_small(F.col("width"), F.col("height"), o.images)).join(wanted, list(KEY), "left_semi").withColumn("image_id", F.xxhash64(*image_key))
    # Pixels pack well, so by their bytes many images would be one task: they are dealt by number.
    session = pages.sparkSession
    tasks = max(3 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    taken = taken.repartition(tasks, "image_id")
    names = taken.select("image_id", *image_key, "width", "height")
    pixels = C.upright(taken, o.orientation, classify)
    place = names
    if o.orientation.enabled:
        place = place.join(C.orientations(taken, o.orientation, classify).select("image_id", "angle"), "image_id")
    else:
        place = place.withColumn("angle", F.lit(0))
    if masks is not None and o.rectify.enabled:
        pixels = G.rectify(pixels, masks(pixels), o.rectify)
        seen = pixels.select("image_id", F.col("width").alias("rw"), F.col("height").alias("rh"), "rectified")
        place = place.join(seen, "image_id").withColumns({"width": F.when(F.col("rectified"), F.col("rw")).otherwise(F.col("width")), "height": F.when(F.col("rectified"), F.col("rh")).otherwise(F.col("height")), "angle": F.when(F.col("rectified"), 0).otherwise(F.col("angle"))}).drop("rw", "rh", "rectified")
    most = replace(o.images, max_width=min(o.images.max_width, o.detector.max_side), max_height=min(o.images.max_height, o.detector.max_side))
    boxes = _cut(R.regions(_cut(detect(I.resize(pixels, most)).select("image_id", "p")), map_w, map_h, o.detector))
    place = _cut(place)
    sideways = F.col("angle").isin(90, 270)
    now_w, now_h = F.when(sideways, F.col("height")).otherwise(F.col("width")), F.when(sideways, F.col("width")).otherwise(F.col("height"))
    boxes = boxes.join(place, "image_id")
    sx, sy = now_w / map_w, now_h / map_h
    boxes = B.rescale(boxes, sx, sy).withColumn("polygon", G.scale_points(F.col("polygon"), sx, sy))
    read = R.texts(C.recognised(pixels, boxes, recognise, o.recognizer), dictionary, o.recognizer, o.text)
    boxes = B.unrotate(B.top_left_order(boxes), F.col("angle"), F.col("width"), F.col("height"))
    regions = boxes.join(read, ["image_id", "region_id"], "left")
    regions = regions.select(
        *image_key, "ord", "x", "y", "w", "h", F.col("confidence").alias("det_conf"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("rec_conf", F.lit(0.0)).alias("rec_conf")
    )
    regions = _cut(regions)
    sizes = place.select(*image_key, "width", "height")
    results = page_results(analysis, own, sizes, regions)
    both = analysis.filter("strategy = 'hybrid'").select(*KEY)
    rows = elements(own.join(both, list(KEY), "left_semi"), sizes.join(both, list(KEY), "left_semi"), regions.join(both, list(KEY), "left_semi"))
    merged = merged_text(rows, decided.select(F.xxhash64(*KEY).alias("page_id"), F.col("quality").alias("score")), o.hybrid)
    lines = regions.filter("text <> ''").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("image_index", "ord", "text"))).alias("lines"))
    # Lines meet the results first, by the key that these are dealt by, so that texts go to another place only once.
    found = results.join(lines, list(KEY), "left").withColumn("page_id", F.xxhash64(*KEY)).join(merged.select("page_id", "combined"), "page_id", "left")
    text = F.when(F.col("strategy") == "vector", F.col("own_text")).when(F.col("strategy") == "hybrid", F.col("combined")).otherwise(F.array_join("lines.text", "\n"))
    return found.select(*results.columns, F.coalesce(text, F.lit("")).alias("read"))
