"""Pages: how to read them, how well, and how to join their own text with recognised text."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Hybrid, PageAnalyzer
from ..functions import let
from ..functions import text as T

_SPACE = re.compile(r"[\x09-\x0D ]+")


def strategy(quality: Column, coverage: Column, has_text: Column, images: Column, cfg: PageAnalyzer | None = None) -> Column:
    """(strategy, confidence) of a page: vector, ocr, hybrid or skip.

    Good quality with low coverage counts as poor, and a page whose quality is
    poor keeps its text only if there is nothing to recognise.
    """
    cfg = cfg or PageAnalyzer()
    pick = lambda name, sure: F.struct(F.lit(name).alias("strategy"), F.lit(sure).alias("confidence"))
    some = images > 0
    high = (quality >= cfg.quality) & (coverage >= cfg.coverage)
    middle = (quality >= 0.5) & (quality < cfg.quality)
    found = F.when(~has_text & some, pick("ocr", 0.8)).when(~has_text, pick("skip", 0.1))
    found = found.when(high & some, pick("hybrid", 0.9)).when(high, pick("vector", 0.95))
    found = found.when(middle & some & F.lit(cfg.hybrid), pick("hybrid", 0.7)).when(middle & some & F.lit(cfg.fallback), pick("ocr", 0.6)).when(middle, pick("vector", 0.5))
    return found.when(some & F.lit(cfg.fallback), pick("ocr", 0.7)).otherwise(pick("vector", 0.3))


def ocr_benefit(quality: Column, coverage: Column, has_text: Column, images: Column) -> Column:
    """0 without images, 1 without text, else how much quality and coverage lack, at least 0.1."""
    return F.when(images <= 0, 0.0).when(~has_text, 1.0).otherwise(F.greatest(F.lit(0.1), ((1 - quality) + (1 - coverage)) / 2.0))


def coverage(elements: DataFrame, page_area: float) -> DataFrame:
    """(page_id, coverage): area of the boxes over that of the page, at most 1."""
    return elements.groupBy("page_id").agg(F.least(F.lit(1.0), F.sum(F.col("w") * F.col("h")) / page_area).alias("coverage"))


def page_ranges(specs: DataFrame, key: str = "id", column: str = "spec") -> DataFrame:
    """(key, ord, page): pages of specs like ``1-3,5`` in their order, repeats kept; a range from high to low is an error."""
    parts = specs.select(key, F.posexplode(F.split(F.regexp_replace(column, " ", ""), ",")).alias("part", "token")).filter("token <> ''")
    low = F.split_part("token", F.lit("-"), F.lit(1)).cast("int")
    high = F.when(F.contains("token", F.lit("-")), F.split_part("token", F.lit("-"), F.lit(2)).cast("int")).otherwise(low)
    parts = parts.select(key, "part", low.alias("low"), high.alias("high"))
    good = F.when(F.col("low") <= F.col("high"), F.sequence("low", "high")).otherwise(F.raise_error(F.concat(F.lit("range from high to low: "), F.col("low").cast("string"))))
    pages = parts.select(key, "part", F.posexplode(good).alias("at", "page"))
    order = Window.partitionBy(key).orderBy("part", "at")
    return pages.select(key, F.row_number().over(order).alias("ord"), "page")


def page_union(images: DataFrame, analysed: DataFrame) -> DataFrame:
    """Full outer join of the pages that have images and those that were analysed, by (doc_id, page)."""
    return images.join(analysed, ["doc_id", "page"], "full")


# ---- joining texts ---------------------------------------------------------------------


def _ordered(elements: DataFrame, keep: Column, sep: str) -> DataFrame:
    """(page_id, combined): texts of vector elements joined by a space, then those recognised texts that ``keep`` holds for."""
    item = F.struct("elem_id", "text")
    lists = elements.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("source") == "vector", item))).alias("own"),
        F.array_sort(F.collect_list(F.when((F.col("source") == "ocr") & keep, item))).alias("read"),
    )
    own = F.array_join("own.text", " ")
    return lists.select("page_id", F.array_join(F.concat(F.when(own != "", F.array(own)).otherwise(F.array().cast("array<string>")), F.col("read.text")), sep).alias("combined"))


def merge_append(elements: DataFrame, cfg: Hybrid | None = None) -> DataFrame:
    """The page's own text, then each recognised text of enough confidence on a line of its own."""
    return _ordered(elements, F.col("rec_conf") >= (cfg or Hybrid()).min_ocr, "\n")


def merge_confidence(elements: DataFrame, cfg: Hybrid | None = None) -> DataFrame:
    """The page's own text and the recognised texts of high confidence, joined by spaces."""
    return _ordered(elements, F.col("rec_conf") >= (cfg or Hybrid()).confidence, " ")


def reading_order(elements: DataFrame) -> DataFrame:
    """Adds ord (from 1): by lines, then from left to right.

    A line ends where y grows by more than half the height of the element
    before it, in the order of y: a total order, whatever the heights.
    """
    by_y = Window.partitionBy("page_id").orderBy("y", "x", "elem_id")
    jump = F.col("y") - F.lag("y").over(by_y) > F.lag("h").over(by_y) / 2
    rows = elements.withColumn("__new", F.coalesce(jump.cast("int"), F.lit(0)))
    rows = rows.withColumn("__line", F.sum("__new").over(by_y))
    order = Window.partitionBy("page_id").orderBy("__line", "x", "y", "elem_id")
    return rows.withColumn("ord", F.row_number().over(order)).drop("__new", "__line")


def _overlap(a: Column, b: Column) -> Column:
    """Common area of two centred boxes over the smaller area."""
    side = lambda c, s: F.greatest(F.lit(0.0), F.least(a[c] + a[s] / 2, b[c] + b[s] / 2) - F.greatest(a[c] - a[s] / 2, b[c] - b[s] / 2))
    smaller = F.least(a["w"] * a["h"], b["w"] * b["h"])
    return F.when(smaller > 0, side("x", "w") * side("y", "h") / smaller).otherwise(0.0)


def merge_spatial(elements: DataFrame, cfg: Hybrid | None = None) -> DataFrame:
    """(page_id, combined, kept): elements in reading order, each but where it overlaps a kept one.

    Recognised elements need the least confidence. An overlapping element
    replaces the first one it overlaps, unless that is the page's own and these
    are preferred, or these are not and it is surer.
    """
    cfg = cfg or Hybrid()
    rows = reading_order(elements.filter((F.col("source") == "vector") | (F.col("rec_conf") >= cfg.min_ocr)))
    sure = F.when(F.col("source") == "vector", 1.0).otherwise(F.col("rec_conf"))
    lists = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "elem_id", "text", "source", "x", "y", "w", "h", sure.alias("sure")))).alias("all"))

    def step(kept: Column, e: Column) -> Column:
        hit = F.array_position(F.transform(kept, lambda k: _overlap(e, k) > cfg.overlap), F.lit(True)).cast("int")
        old = F.get(kept, hit - 1)
        stays = (old["source"] == "vector") if cfg.prefer_vector else (old["sure"] > e["sure"])
        swapped = F.transform(kept, lambda k, i: F.when(i == hit - 1, e).otherwise(k))
        return F.when(hit == 0, F.array_append(kept, e)).when(stays, kept).otherwise(swapped)

    kept = F.aggregate("all", F.slice("all", 1, 0), step)
    return lists.select("page_id", kept.alias("kept")).select("page_id", F.array_join("kept.text", " ").alias("combined"), "kept")


def merge_smart(elements: DataFrame, scores: DataFrame, cfg: Hybrid | None = None) -> DataFrame:
    """Spatial merge; where the page's own text scores under 0.8 (or there is none), sure recognised texts that it lacks follow."""
    cfg = cfg or Hybrid()
    base = merge_spatial(elements, cfg).join(scores.select("page_id", "score"), "page_id", "left")
    extra = elements.filter((F.col("source") == "ocr") & (F.col("rec_conf") >= cfg.confidence))
    extra = extra.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("elem_id", "text"))).alias("extra"))
    more = F.filter(F.col("extra.text"), lambda t: ~T.included(t, F.col("combined")))
    poor = F.coalesce(F.col("score") < 0.8, F.lit(True))
    text = F.when(poor, F.array_join(F.concat(F.array("combined"), F.coalesce(more, F.array().cast("array<string>"))), " ")).otherwise(F.col("combined"))
    return base.join(extra, "page_id", "left").select("page_id", text.alias("combined"))


def kept_lines(lines: list[str], similarity: float) -> list[int]:
    """The places of lower-case lines that :func:`text.similarity` puts above ``similarity`` to no line kept before.

    Such a kept line of n words lacks at most (n - similarity * words of the other) / (1 + similarity) of them there. So the
    first of its words, rarest first, that is there has no more before it, and only kept lines found by such a word are compared.
    """
    cut = [[w for w in _SPACE.split(line) if w] for line in lines]
    often = Counter(w for words in cut for w in words)
    order = {w: i for i, w in enumerate(sorted(often, key=often.__getitem__))}
    kept, seen, by_word = [], {}, {}

    def near(words: set[str], n: int) -> set[int]:
        least = (similarity * n - 1e-6,)
        lists = filter(None, map(by_word.get, words))
        return {place for found in lists for _, place in found[bisect_left(found, least) :]}

    for place, words in enumerate(cut):
        key, own, n = tuple(words), set(words), len(words)
        known = key in seen and (similarity < 1 or not seen[key])
        for k in () if known else near(own, n):
            common = sum(w in own for w in cut[k])
            if common / (n + len(cut[k]) - common) > similarity:
                known = True
                break
        seen.setdefault(key, not known)
        if not known:
            kept.append(place)
            last = None
            for before, w in enumerate(sorted(words, key=order.__getitem__)):
                room = n - before * (1 + similarity)
                if room < similarity - 1e-6:
                    break
                if w != last and often[w] > 1:  # words that occur once are in no other line
                    insort(by_word.setdefault(w, []), (room, place))
                last = w
    return kept


def distinct_lines(rows: DataFrame, column: str = "text", similarity: float = 0.8) -> DataFrame:
    """The texts with their lines trimmed and without empty ones and those too similar to a line kept before."""

    @F.pandas_udf("array<int>")
    def places(texts: pd.Series) -> pd.Series:
        return texts.map(lambda lines: None if lines is None else kept_lines(list(lines), similarity))

    lines = F.filter(F.transform(F.split(column, "\n"), lambda x: F.regexp_replace(x, f"^{T.EDGES}|{T.EDGES}$", "")), lambda x: x != "")
    kept = rows.withColumn("__lines", lines).withColumn("__kept", places(F.transform("__lines", lambda x: F.lower(x))))
    return kept.withColumn(column, F.array_join(F.transform("__kept", lambda i: F.get("__lines", i)), "\n")).drop("__lines", "__kept")


def merge_quality(elements: DataFrame, merged: DataFrame, scores: DataFrame) -> DataFrame:
    """Per page: shares of own and recognised text (bytes), overall score, coverage, mean confidence, duplication.

    ``merged`` has page_id and combined; scores has the score of the page's own
    text, a page without one having none.
    """
    n = F.octet_length("text")
    sums = elements.groupBy("page_id").agg(
        F.coalesce(F.sum(F.when(F.col("source") == "vector", n)), F.lit(0)).alias("own"),
        F.coalesce(F.sum(F.when(F.col("source") == "ocr", n)), F.lit(0)).alias("read"),
        F.coalesce(F.sum(F.when(F.col("source") == "ocr", F.col("rec_conf"))), F.lit(0.0)).alias("conf"),
        F.count(F.when(F.col("source") == "ocr", 1)).alias("regions"),
    )
    rows = sums.join(merged.select("page_id", "combined"), "page_id").join(scores.select("page_id", "score"), "page_id", "left")
    total, size = F.col("own") + F.col("read"), F.octet_length("combined")
    share = lambda c: F.when(total > 0, F.col(c) / total).otherwise(0.0)
    mean = F.when(F.col("regions") > 0, F.col("conf") / F.col("regions") * 0.4).otherwise(0.0)
    count = F.col("regions") + F.col("score").isNotNull().cast("int")
    return rows.select(
        "page_id",
        share("own").alias("vector_share"),
        share("read").alias("ocr_share"),
        F.least(F.lit(1.0), F.coalesce(F.col("score") * 0.6, F.lit(0.0)) + mean).alias("overall"),
        F.least(F.lit(1.0), size / 1000.0).alias("text_coverage"),
        F.when(count > 0, (F.coalesce("score", F.lit(0.0)) + F.col("conf")) / count).otherwise(0.0).alias("mean_confidence"),
        F.when((total > 0) & (size > 0), F.greatest(F.lit(0.0), 1 - size / total)).otherwise(0.0).alias("duplication"),
    )


# ---- whole pages -----------------------------------------------------------------------


def filter_regions(regions: DataFrame, det: float = 0.0, rec: float = 0.0) -> DataFrame:
    """Regions of enough detection and recognition confidence; avg_det is the mean over what the first leaves."""
    kept = regions.filter(F.col("det_conf") >= det)
    kept = kept.withColumn("avg_det", F.avg("det_conf").over(Window.partitionBy("image_id")))
    return kept.filter(F.col("rec_conf") >= rec)


def barcode_boxes(codes: DataFrame, dpi: Column | float, page_height: Column | float) -> DataFrame:
    """Adds page boxes in points, y upwards, to codes with pixel boxes (x, y, w, h)."""
    f = F.lit(72.0) / dpi
    return codes.select("*", (F.col("x") * f).alias("px"), (page_height - (F.col("y") + F.col("h")) * f).alias("py"), (F.col("w") * f).alias("pw"), (F.col("h") * f).alias("ph"))


def zip_results(regions: DataFrame, texts: DataFrame) -> DataFrame:
    """Regions and what was read in them, by image and place in it."""
    return regions.join(texts, ["image_id", "ord"], "left")


def chunks(parts: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Batches of at most ``size`` rows, for models with a fixed batch."""
    for part in parts:
        for i in range(0, len(part), size):
            yield part.iloc[i : i + size]
