"""A query for each operator, over the base tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import AdaptiveThresholds, Detector, Hybrid, Morphology, MultiScale, RateLimit, Recognizer
from ..functions import let
from ..functions import text as T
from ..operators import barcodes as BC
from ..operators import boxes as B
from ..operators import components as C
from ..operators import contours as N
from ..operators import geometry as G
from ..operators import images as I
from ..operators import limits as L
from ..operators import maps as M
from ..operators import matrix_codes as Q
from ..operators import pages as P
from ..operators import sequences as S
from ..sources import fixtures as X
from ..sources import pdf as PDF
from ..sources import pdf_writer as PW
from ..sources import sinks as K
from . import documents as D
from . import reading as R
from .builder import Reader

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SIDE = X.MAP_SIDE
CUT = 0.5


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits, so that sums in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# ---- maps ------------------------------------------------------------------------------


@query
def binarize_count(spark, d):
    return M.foreground(X.maps(spark, d), CUT).groupBy("image_id").agg(F.count("*").alias("n"))


@query
def prob_stats(spark, d):
    return rounded(M.statistics(X.maps(spark, d)).select("image_id", "mean", "sd", "median", "least", "most", "span", "high"))


@query
def histogram50(spark, d):
    return M.histogram(X.maps(spark, d), 50)


@query
def bimodality(spark, d):
    return M.bimodality(X.maps(spark, d))


@query
def otsu_threshold(spark, d):
    return rounded(M.otsu(X.maps(spark, d)).select("image_id", "threshold", "confidence"))


@query
def hist_thresholds(spark, d):
    return rounded(M.histogram_thresholds(X.maps(spark, d)))


@query
def dynamic_thresholds(spark, d):
    return rounded(M.dynamic_thresholds(X.maps(spark, d)))


@query
def adaptive_thresholds(spark, d):
    return rounded(M.thresholds(X.maps(spark, d), AdaptiveThresholds(enabled=True, method="dynamic")))


def _morphed(operation: str) -> Query:
    def run(spark, d):
        return rounded(M.long_form(M.morphology(X.maps(spark, d), Morphology(operation), SIDE), SIDE))

    return run


QUERIES |= {"dilate3": _morphed("dilate"), "erode3": _morphed("erode"), "smooth3": _morphed("smooth"), "opening3": _morphed("opening"), "closing3": _morphed("closing")}

# ---- components ------------------------------------------------------------------------


def _cells(spark, d):
    return C.components(X.maps(spark, d), CUT, SIDE)


@query
def connected_components(spark, d):
    return _cells(spark, d).select("image_id", "y", "x", "label")


@query
def component_stats(spark, d):
    return rounded(C.component_stats(_cells(spark, d)))


def _confidence(method: str, gamma: float = 0.0) -> Query:
    def run(spark, d):
        return rounded(C.component_stats(_cells(spark, d)).select("image_id", "label", C.confidence(method, gamma).alias("confidence")))

    return run


QUERIES |= {"conf_mean": _confidence("mean"), "conf_max": _confidence("max"), "conf_mean_var": _confidence("mean_var"), "conf_gamma": _confidence("mean", 2.0)}


@query
def adaptive_conf_filter(spark, d):
    """Boxes count as parts of a map of 64 by 64, so that the small ones fall under a hundredth."""
    rows = C.boxes(C.component_stats(_cells(spark, d)), SIDE, SIDE).withColumn("confidence", C.confidence())
    return rounded(C.adaptive_filter(rows, 0.7, 4096.0).select("image_id", "label", "confidence"))


@query
def boundary_pixels(spark, d):
    return C.boundary(_cells(spark, d)).select("image_id", "label", "x", "y")


@query
def detect_regions(spark, d):
    """Map to regions: threshold, components, confidence, filter, box."""
    rows = C.boxes(C.component_stats(_cells(spark, d)), SIDE, SIDE).withColumn("confidence", C.confidence())
    return rounded(rows.filter(F.col("confidence") >= Detector().box_threshold + 0.2).select("image_id", "label", "n", "bx0", "by0", "bx1", "by1", "confidence"))


@query
def component_outlines(spark, d):
    found = N.outlines(_cells(spark, d)).withColumn("box", G.bounding_box(F.col("points")))
    return found.select("image_id", "label", "box.*")


@query
def read_images(spark, d):
    """Maps to texts: regions, made-up scores for each from the vectors, decoding, cleaning, reading order."""
    maps, scores = X.maps(spark, d), X.logits(spark, d)
    give = lambda regions: regions.select("image_id", "region_id").join(scores.withColumnRenamed("seq_id", "image_id"), "image_id")
    return rounded(R.results(maps, SIDE, SIDE, give, X.dictionary(spark), Detector(box_threshold=0.7)))


@query
def region_polygons(spark, d):
    """Each component as a rectangle that may be turned, with its area and box."""
    found = N.map_polygons(X.maps(spark, d), CUT, SIDE, SIDE)
    return rounded(found.select("image_id", "label", F.size("polygon").alias("corners"), G.polygon_area(F.col("polygon")).alias("area"), "bx0", "by0", "bx1", "by1"))


def _maps_at(spark, d):
    """Maps at scale 1, and at a half the means of four values."""
    maps, half = X.maps(spark, d), SIDE // 2

    def at(scale):
        if scale == 1:
            return maps, SIDE, SIDE
        four = lambda i: [(F.floor(i / half) * 2 + dy) * SIDE + i % half * 2 + dx for dy in (0, 1) for dx in (0, 1)]
        mean = lambda i: sum((F.get("p", k.cast("int")) for k in four(i)), F.lit(0.0)) / 4
        return maps.select("image_id", F.transform(F.sequence(F.lit(0), F.lit(half * half - 1)), mean).alias("p")), half, half

    return at


@query
def multiscale_regions(spark, d):
    """Maps at two scales to regions: detection at each, boxes mapped back and suppressed together."""
    cfg = Detector(db_threshold=CUT, box_threshold=0.6, multi_scale=MultiScale(enabled=True, scales=(1.0, 0.5)))
    found = R.regions_at_scales(_maps_at(spark, d), SIDE, SIDE, cfg)
    return rounded(found.select("image_id", "region_id", *B.BOX, "confidence"))


@query
def read_images_beam(spark, d):
    """As read_images, decoded by beam search."""
    maps, scores = X.maps(spark, d), X.logits(spark, d)
    probs = scores.withColumn("steps", F.transform("steps", lambda s: let(F.aggregate(s, F.lit(0.0), lambda a, v: a + F.exp(v)), lambda z: F.transform(s, lambda x: F.exp(x) / z))))
    give = lambda regions: regions.select("image_id", "region_id").join(probs.withColumnRenamed("seq_id", "image_id"), "image_id")
    return rounded(R.results(maps, SIDE, SIDE, give, X.dictionary(spark), Detector(box_threshold=0.7), Recognizer(decode="beam", beam_width=5)))


# ---- boxes -----------------------------------------------------------------------------


@query
def pairwise_iou(spark, d):
    return rounded(B.overlaps(X.region_rows(spark, d)))


@query
def nms_hard(spark, d):
    return B.nms(X.region_rows(spark, d), 0.3).select("image_id", "region_id", "confidence")


@query
def nms_adaptive(spark, d):
    return B.nms_adaptive(X.region_rows(spark, d), 0.3, 1.0).select("image_id", "region_id", "confidence")


@query
def nms_size_aware(spark, d):
    return B.nms_size_aware(X.region_rows(spark, d)).select("image_id", "region_id", "confidence")


@query
def soft_nms_linear(spark, d):
    return rounded(B.soft_nms(X.region_rows(spark, d), "linear").select("image_id", "region_id", "confidence"), 9)


@query
def soft_nms_gaussian(spark, d):
    return rounded(B.soft_nms(X.region_rows(spark, d), "gaussian").select("image_id", "region_id", "confidence"), 9)


@query
def multiscale_merge(spark, d):
    rows = X.region_rows(spark, d)
    full, half = rows.filter("region_id % 2 = 0"), B.rescale(rows.filter("region_id % 2 = 1"), 0.5, 0.5)
    return B.merge_scales([(1.0, full), (0.5, half)], Detector(multi_scale=MultiScale(enabled=True))).select("image_id", "region_id", "confidence")


@query
def scale_regions(spark, d):
    return rounded(B.rescale(X.region_rows(spark, d), 2.5, 1.75))


@query
def inverse_rotation(spark, d):
    rows = X.region_rows(spark, d).withColumn("angle", (F.col("region_id") % 4 * 90).cast("int"))
    return B.unrotate(rows, F.col("angle"), 640, 480).select("region_id", "angle", "x", "y", "w", "h")


@query
def region_validation(spark, d):
    return X.region_rows(spark, d).select("region_id", B.valid(F.lit(160.0), F.lit(96.0)).alias("valid"))


@query
def crop_boxes(spark, d):
    return B.crop_box(X.region_rows(spark, d), 160, 96).select("region_id", "x0", "y0", "x1", "y1")


@query
def reading_order(spark, d):
    return B.top_left_order(X.region_rows(spark, d)).select("image_id", "region_id", "ord")


@query
def topk_regions(spark, d):
    return B.top_k(X.region_rows(spark, d), 3).select("image_id", "region_id", "rank", "confidence")


# ---- sequences -------------------------------------------------------------------------


@query
def argmax_path(spark, d):
    path = S.best_path(X.logits(spark, d)).select("seq_id", F.posexplode("path").alias("t", "p"))
    return path.select("seq_id", "t", F.col("p.idx").alias("idx"))


@query
def softmax_prob(spark, d):
    path = S.best_path(X.logits(spark, d)).select("seq_id", F.posexplode("path").alias("t", "p"))
    return rounded(path.select("seq_id", "t", F.col("p.prob").alias("prob")))


@query
def ctc_greedy(spark, d):
    out = S.greedy(X.logits(spark, d))
    return out.select("seq_id", F.array_join(F.transform("out.idx", lambda i: i.cast("string")), ",").alias("classes"))


@query
def ctc_text(spark, d):
    return S.to_text(S.greedy(X.logits(spark, d)), X.dictionary(spark))


@query
def sequence_confidence(spark, d):
    return rounded(S.greedy(X.logits(spark, d)).select("seq_id", S.mean_confidence(F.col("out.prob")).alias("confidence")))


@query
def ctc_beam(spark, d):
    """Scores as probabilities, so that they can be multiplied."""
    probs = X.logits(spark, d).withColumn("steps", F.transform("steps", lambda s: let(F.aggregate(s, F.lit(0.0), lambda a, v: a + F.exp(v)), lambda z: F.transform(s, lambda x: F.exp(x) / z))))
    out = S.beam_search(probs, width=5).withColumn("classes", F.array_join(F.transform("classes", lambda i: i.cast("string")), ","))
    return rounded(out)


# ---- text ------------------------------------------------------------------------------


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")


@query
def clean_text(spark, d):
    from ..config import CleanText

    rows = _docs(spark, d).select("doc_id", T.clean(F.col("text"), CleanText(language="fr")).alias("t"))
    return rows.select("doc_id", F.length("t").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query
def validate_text(spark, d):
    return _docs(spark, d).select("doc_id", T.is_valid(F.col("text")).alias("valid"))


@query
def detect_language(spark, d):
    return _docs(spark, d).select("doc_id", T.language(F.col("text")).alias("detected"))


@query
def language_confusion(spark, d):
    return _docs(spark, d).select("lang", T.language(F.col("text")).alias("detected")).groupBy("lang", "detected").agg(F.count("*").alias("n"))


@query
def charset_filter(spark, d):
    return _docs(spark, d).select("doc_id", F.length(T.in_charset(F.col("text"), "abcdefß")).alias("n"))


def _quality(text: Column) -> dict[str, Column]:
    return T.quality(text, F.lit(612.0), F.lit(792.0))


@query
def text_quality(spark, d):
    q = _quality(F.col("text"))
    return rounded(X.page_text(spark, d).select("doc_id", *[c.alias(n) for n, c in q.items()]))


@query
def word_stats(spark, d):
    w = T.words(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"), F.octet_length("text").alias("n_bytes"))


def _pairs(spark, d):
    """Neighbouring benchmark items."""
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    other = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return items.join(other, "item_id")


@query
def levenshtein_car(spark, d):
    return rounded(_pairs(spark, d).select("item_id", T.character_accuracy(F.col("text"), F.col("other")).alias("car")))


@query
def war(spark, d):
    return rounded(T.word_accuracy(_pairs(spark, d), "item_id", "text", "other"))


@query
def text_similarity(spark, d):
    return rounded(_pairs(spark, d).select("item_id", T.similarity(F.col("text"), F.col("other")).alias("similarity")))


# ---- pages -----------------------------------------------------------------------------


def _analysed(spark, d):
    q = _quality(F.col("text"))
    reach = F.least(F.lit(1.0), F.length("text") / 3000.0)
    return X.page_text(spark, d).select("doc_id", "image_count", q["score"].alias("score"), q["has_text"].alias("has_text"), reach.alias("reach"))


@query
def page_strategy(spark, d):
    found = P.strategy(F.col("score"), F.col("reach"), F.col("has_text"), F.col("image_count"))
    return _analysed(spark, d).select("doc_id", found.alias("s")).select("doc_id", "s.strategy", "s.confidence")


@query
def ocr_benefit(spark, d):
    return rounded(_analysed(spark, d).select("doc_id", P.ocr_benefit(F.col("score"), F.col("reach"), F.col("has_text"), F.col("image_count")).alias("benefit")))


@query
def text_coverage(spark, d):
    return rounded(P.coverage(X.elements(spark, d), 612.0 * 792.0))


@query
def page_range_expand(spark, d):
    a = F.col("doc_id") % 5 + 1
    spec = F.concat(a.cast("string"), F.lit("-"), (a + F.col("doc_id") % 3).cast("string"), F.lit(","), (F.col("doc_id") % 7 + 1).cast("string"))
    return P.page_ranges(_docs(spark, d).select(F.col("doc_id").alias("id"), spec.alias("spec")))


@query
def page_outer_union(spark, d):
    """Pages with images, and pages whose text was analysed."""
    pages = X.page_text(spark, d)
    left = pages.filter("image_count > 0").select("doc_id", "page", F.lit(True).alias("has_images"))
    right = pages.filter(_quality(F.col("text"))["has_text"]).select("doc_id", "page", F.lit(True).alias("analysed"))
    both = P.page_union(left, right)
    return both.select("doc_id", "page", F.coalesce("has_images", F.lit(False)).alias("has_images"), F.coalesce("analysed", F.lit(False)).alias("analysed"))


def _digested(df: DataFrame) -> DataFrame:
    return df.select("page_id", F.length("combined").alias("n"), F.md5(F.col("combined").cast("binary")).alias("digest"))


@query
def hybrid_append(spark, d):
    return _digested(P.merge_append(X.elements(spark, d)))


@query
def hybrid_confidence(spark, d):
    return _digested(P.merge_confidence(X.elements(spark, d)))


def _scores(spark, d):
    own = P.merge_append(X.elements(spark, d).filter("source = 'vector'"))
    return own.select("page_id", _quality(F.col("combined"))["score"].alias("score"))


@query
def hybrid_quality(spark, d):
    rows = X.elements(spark, d)
    return rounded(P.merge_quality(rows, P.merge_append(rows), _scores(spark, d)))


@query
def hybrid_spatial(spark, d):
    return _digested(P.merge_spatial(X.elements(spark, d)))


@query
def hybrid_smart(spark, d):
    return _digested(P.merge_smart(X.elements(spark, d), _scores(spark, d), Hybrid()))


@query
def element_order(spark, d):
    return P.reading_order(X.elements(spark, d)).select("page_id", "elem_id", "ord")


@query
def fuzzy_line_dedup(spark, d):
    rows = X.elements(spark, d).select(F.col("page_id"), F.col("elem_id"), "text")
    return P.distinct_lines(rows).select("page_id", "elem_id", F.size(F.split("text", "\n")).alias("n_lines"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query
def region_filters(spark, d):
    rows = X.region_rows(spark, d).select("image_id", "region_id", F.col("confidence").alias("det_conf"), ((F.col("region_id") * 31 % 101) / 100.0).alias("rec_conf"))
    return rounded(P.filter_regions(rows, 0.4, 0.5).select("image_id", "region_id", "det_conf", "rec_conf", "avg_det"), 10)


@query
def barcode_page_box(spark, d):
    rows = X.region_rows(spark, d).select("region_id", F.col("min_x").alias("x"), F.col("min_y").alias("y"), (F.col("max_x") - F.col("min_x")).alias("w"), (F.col("max_y") - F.col("min_y")).alias("h"))
    return rounded(P.barcode_boxes(rows, F.lit(150.0), F.lit(792.0)).select("region_id", "px", "py", "pw", "ph"))


@query
def barcode_values(spark, d):
    """A code drawn for every document, in four symbologies and directions, and read back from the pixels."""
    n = F.col("doc_id")
    digits = F.lpad(n.cast("string"), 12, "0")
    odd = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda a, i: a + F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    kind = F.element_at(F.array(*map(F.lit, ("Code128", "Code39", "UPCA", "ITF"))), (n % 4 + 1).cast("int"))
    upc = F.concat(F.substring(digits, 2, 11), F.pmod(-odd, F.lit(10)).cast("string"))
    value = F.when(n % 4 == 0, F.concat(F.lit("doc-"), n.cast("string"))).when(n % 4 == 1, F.concat(F.lit("ID "), n.cast("string"))).when(n % 4 == 2, upc).otherwise(digits)
    rows = X.page_text(spark, d).select(n.alias("image_id"), kind.alias("type"), value.alias("value"), (F.floor(n / 4) % 4).cast("int").alias("turns"))
    found = N.decode_barcodes(BC.drawn_codes(rows), BC.read_lines)
    return found.select(F.col("image_id").alias("doc_id"), "type", "value", F.greatest("w", "h").alias("length"))


@query
def qr_values(spark, d):
    """A QR code for each shelf of sixteen documents with their texts' digests, at every level and turn, damaged within what it can mend, and read back from the pixels."""
    shelf, digest = F.floor(F.col("doc_id") / 16).cast("long"), F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 8)
    lists = X.page_text(spark, d).groupBy(shelf.alias("image_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", digest.alias("digest")))).alias("rows"))
    joined = F.concat_ws("-", F.col("image_id").cast("string"), F.col("rows.digest"))
    n = F.col("image_id")
    value = F.when(n % 2 == 0, F.upper(joined)).otherwise(joined)
    level = F.element_at(F.array(*map(F.lit, "LMQH")), (n % 4 + 1).cast("int"))
    rows = lists.select(n, value.alias("value"), level.alias("level"), (F.floor(n / 4) % 4).cast("int").alias("turns"), (n % 8).cast("int").alias("damage"))
    found = N.decode_barcodes(Q.drawn_codes(rows), Q.read_codes)
    return found.select(F.col("image_id").alias("shelf"), "type", "value")


# ---- documents -------------------------------------------------------------------------


def _pages(spark, d):
    """(analysis, own, images, regions): as many images a page as the fixture says, up to three regions in each."""
    text = X.page_text(spark, d)
    file = F.concat(F.lit("doc,"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file")
    found = _analysed(spark, d).withColumn("s", P.strategy(F.col("score"), F.col("reach"), F.col("has_text"), F.col("image_count")))
    analysis = found.select(file, F.lit(1).alias("page"), F.col("s.strategy").alias("strategy"))
    own = text.select(file, "page", "text", "page_w", "page_h")
    image = text.filter("image_count > 0").select("doc_id", file, "page", F.explode(F.sequence(F.lit(1), F.col("image_count"))).alias("image_index"))
    images = image.select("file", "page", "image_index", (300 + F.col("doc_id") % 7 * 40 + F.col("image_index")).cast("int").alias("width"), (200 + F.col("doc_id") % 5 * 30).cast("int").alias("height"))
    n = ((F.col("doc_id") + F.col("image_index")) % 4).cast("int")
    regions = image.select("*", F.explode(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: i <= n)).alias("ord"))
    whole = lambda c: c.cast("int")
    regions = regions.select(
        "file", "page", "image_index", "ord", whole(F.col("ord") * 20).alias("x"), whole(F.col("doc_id") % 50 + F.col("ord")).alias("y"), whole(F.col("ord") * 5 + 10).alias("w"), F.lit(12).alias("h"),
        ((F.col("doc_id") * 7 + F.col("ord") * 13) % 64 / 64.0).alias("det_conf"), F.concat(F.lit("read "), F.col("ord").cast("string")).alias("text"), F.lit(0.75).alias("rec_conf"),
    )
    return analysis, own, images, regions


@query
def page_reading(spark, d):
    """Pages of all documents from strategy to text: bars drawn as their images, found, cropped, made tensors, read and merged with the pages' own texts."""
    q, file = _quality(F.col("text")), F.col("doc_id").cast("string").alias("file")
    reach = F.least(F.lit(1.0), F.length("text") / 3000.0)
    lying = X.page_text(spark, d)
    rows = PW.dealt(lying, "doc_id")
    pages = rows.select(file, "page", "text", "page_w", "page_h", q["score"].alias("quality"), reach.alias("coverage"), q["has_text"].alias("has_text"), "image_count")
    drawn = BC.drawn_codes(rows.filter("image_count > 0").select(F.col("doc_id").alias("image_id"), F.lit("Code128").alias("type"), F.col("doc_id").cast("string").alias("value"), F.lit(0).alias("turns")))
    images = drawn.select(F.col("image_id").cast("string").alias("file"), F.lit(1).alias("page"), F.lit(1).alias("image_index"), "width", "height", "channels", "data")
    reader = Reader().with_images(min_height=16).with_detector(db_threshold=0.25, box_threshold=0.3).with_hybrid(strategy="append")
    out = reader.run_pages(pages, images, X.dark_maps, X.shade_scores, spark.createDataFrame([(0, "d"), (1, "l")], "idx int, token string"), 16, 16, texts=lying.select(file, "page", "text", "page_w", "page_h"))
    region = F.get(F.get("images", F.lit(0))["regions"], F.lit(0))
    count = F.aggregate("images", F.lit(0), lambda a, i: a + F.size(i["regions"]))
    return out.select(F.col("file").cast("long").alias("doc_id"), "strategy", count.alias("n_regions"), region["x"].alias("x"), region["w"].alias("w"), "read")


@query
def page_results(spark, d):
    found = D.page_results(*_pages(spark, d)).withColumn("n_regions", F.aggregate("images", F.lit(0), lambda a, i: a + F.size(i["regions"])))
    return found.select("file", "page", "width", "height", "strategy", F.length("own_text").alias("own_chars"), F.size("images").alias("n_images"), "n_regions")


@query
def document_text(spark, d):
    return K.document_text(D.page_results(*_pages(spark, d))).select("file", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").alias("n"))


@query
def document_csv_rows(spark, d):
    return K.document_csv_rows(_pages(spark, d)[3]).select("file", "page", "image_index", "ord", "line")


def _texts(spark, d):
    return X.page_text(spark, d).select(F.col("doc_id").alias("number"), "text")


def _read_back(found):
    text = F.sha2("text", 256).alias("text_sha256")
    return found.select(F.regexp_extract("path", "^-?[0-9]+", 0).cast("long").alias("doc_id"), "page", "n_rows", text, F.length("text").alias("chars"), "error")


@query
def pdf_text(spark, d):
    """Every document written as a PDF and read back: a row for each page."""
    return _read_back(PDF.page_texts(PDF.pages(PW.text_files(_texts(spark, d)))))


@query
def pdf_second_pages(spark, d):
    return _read_back(PDF.page_texts(PDF.pages(PW.text_files(_texts(spark, d)), wanted=[2])))


@query
def pdf_images(spark, d):
    found = PDF.images(PW.text_files(_texts(spark, d), with_image=True))
    number = F.regexp_extract("path", "^-?[0-9]+", 0).cast("long").alias("doc_id")
    return found.select(number, "page", "name", "width", "height", "channels", "format", F.sha2("data", 256).alias("data_sha256"), "error")


def _locks(number: int) -> PW.Locked:
    return PW.Locked(f"user{number}", f"owner{number}", 3 if number % 100 == 0 else 4 if number % 100 == 50 else 2)


@query
def pdf_locked(spark, d):
    """Encrypted files of revisions 2 to 4, opened by the user's or the owner's password; every seventh password is wrong."""
    files = PW.text_files(_texts(spark, d), _locks)
    number = F.regexp_extract("path", "^-?[0-9]+", 0).cast("long")
    who = F.when(number % 7 == 3, "nobody").when(number % 2 == 0, "user").otherwise("owner")
    return _read_back(PDF.page_texts(PDF.pages(files, password=F.concat(who, number.cast("string")))))


# ---- limits ----------------------------------------------------------------------------

LIMITS = RateLimit(per_minute=1, per_hour=2, requests_per_day=4, bytes_per_day=20_000)
SHARED_LIMITS = RateLimit(per_minute=3, per_hour=20, requests_per_day=200, bytes_per_day=2_000_000)


def _own(figures, rows, *names):
    """Figures of all users themselves, as columns own_..., for requests that are under shared accounts."""
    rows = figures(rows.withColumnsRenamed({"user_id": "__account", "own_id": "user_id"}))
    return rows.withColumnsRenamed({"user_id": "own_id", "__account": "user_id", **{c: f"own_{c}" for c in names}})


@query
def rate_limit_replay(spark, d):
    """Each request under its shared account's limits and, on its own, under its user's."""
    rows = _own(lambda r: L.replay(r, LIMITS), X.shared_requests(spark, d), "verdict", "wait_us")
    return L.replay(rows, SHARED_LIMITS).select("event_id", "user_id", "verdict", "wait_us", "own_id", "own_verdict", "own_wait_us")


@query
def rejections(spark, d):
    found = L.rejections(L.replay(X.requests(spark, d), LIMITS), LIMITS)
    return found.select("event_id", "user_id", "kind", "type", "limit", "retry_after_us", F.unix_micros("resets").alias("resets_us"))


@query
def run_statistics(spark, d):
    rows = X.requests(spark, d).select(F.when(F.col("event_id") % 10 == 0, F.lit("failed")).alias("error"))
    return rounded(L.run_statistics(rows, 12.5, 4))


@query
def stage_profile(spark, d):
    rows = X.requests(spark, d).select("event_type", (F.col("data_size") * 1000).alias("det_ns"), (F.col("data_size") * 3001).alias("rec_ns"), (F.col("event_id") % 9).alias("regions"))
    return rounded(L.profile(rows, "event_type"))


@query
def gap_session_counters(spark, d):
    """Runs of requests under shared accounts and, on their own, of all users."""
    rows = _own(L.gap_counters, X.shared_requests(spark, d), "minute", "hour")
    return L.gap_counters(rows).select("event_id", "minute", "hour", "own_id", "own_minute", "own_hour")


@query
def quota_daily(spark, d):
    return L.daily_quota(X.requests(spark, d))


@query
def request_histogram(spark, d):
    return L.cumulative_histogram(X.requests(spark, d), "event_type", "data_size", L.UPLOAD_BOUNDS[:3])


@query
def memory_average(spark, d):
    """Windows and peaks under shared accounts and, on their own, of all users."""
    rows = X.shared_requests(spark, d).select("user_id", "own_id", F.struct("ts", "event_id").alias("ts"), F.col("data_size").alias("bytes"), "event_id")
    figures = lambda r: L.moving_memory(r.withColumnRenamed("user_id", "host"), slot=L.hour_of(F.unix_micros("ts.ts"))).withColumnRenamed("host", "user_id")
    return rounded(figures(_own(figures, rows, "mean", "peak")).select("event_id", "mean", "peak", "own_id", "own_mean", "own_peak"))


@query
def batch_summary(spark, d):
    rows = X.requests(spark, d).select(F.col("data_size").alias("ms"), F.when(F.col("event_id") % 10 == 0, F.lit("failed")).alias("error"))
    return rounded(L.batch_summary(rows))


# ---- geometry --------------------------------------------------------------------------


def _outlines(spark, d):
    points = F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))))
    return C.boundary(_cells(spark, d)).groupBy("image_id", "label").agg(points.alias("points"))


@query
def convex_hull(spark, d):
    hull = _outlines(spark, d).select("image_id", "label", G.convex_hull(F.col("points")).alias("h"))
    return rounded(hull.select("image_id", "label", F.size("h").alias("corners"), G.polygon_area(F.col("h")).alias("area")))


@query
def min_area_rect(spark, d):
    rect = _outlines(spark, d).select("image_id", "label", G.min_area_rect(F.col("points")).alias("r"))
    return rounded(rect.select("image_id", "label", G.polygon_area(F.col("r")).alias("area")))


@query
def simplify_polygon(spark, d):
    line = _outlines(spark, d).select("image_id", "label", G.simplify(F.col("points"), 1.0).alias("s"), F.size("points").alias("n"))
    return line.select("image_id", "label", "n", F.size("s").alias("kept"))


@query
def unclip(spark, d):
    grown = X.region_rows(spark, d).select("region_id", G.unclip(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y"))]), 1.5).alias("p"))
    return rounded(grown.select("region_id", G.bounding_box(F.col("p")).alias("b")).select("region_id", "b.*"))


H = [1.25, 0.5, -3.0, -0.25, 1.5, 2.0, 0.0009765625, 0.00048828125, 1.0]


@query
def homography_apply(spark, d):
    return rounded(X.region_rows(spark, d).select("region_id", G.apply_homography(H, F.col("min_x"), F.col("max_y")).alias("p")).select("region_id", "p.x", "p.y"))


@query
def rect_gate(spark, d):
    return rounded(G.mask_gate(X.maps(spark, d), least=30))


# ---- images ----------------------------------------------------------------------------


@query
def resize_dims(spark, d):
    rows = X.region_rows(spark, d).select("region_id", (F.col("max_x") * 11).cast("int").alias("w"), (F.col("max_y") * 13).cast("int").alias("h"))
    return rows.select("region_id", "w", "h", I.fit_size(F.col("w"), F.col("h")).alias("s")).select("region_id", F.col("s.w").alias("to_w"), F.col("s.h").alias("to_h"), I.too_small(F.col("w"), F.col("h")).alias("too_small"))


@query
def recognition_dims(spark, d):
    rows = X.region_rows(spark, d).select("region_id", (F.col("max_x") - F.col("min_x")).cast("int").alias("w"), (F.col("max_y") - F.col("min_y")).cast("int").alias("h"))
    cfg = Recognizer(max_width=320)
    return rows.select("region_id", I.turn_crop(F.col("w"), F.col("h")).alias("turn"), I.line_size(F.col("w"), F.col("h"), cfg).alias("s")).select("region_id", "turn", F.col("s.w").alias("to_w"), "s.padded")


@query
def batch_widths(spark, d):
    rows = X.region_rows(spark, d).select("image_id", "region_id", (F.col("max_x") - F.col("min_x")).cast("int").alias("w"), (F.col("max_y") - F.col("min_y")).cast("int").alias("h"))
    sized = rows.select("image_id", "region_id", I.line_size(F.col("w"), F.col("h"), Recognizer(max_width=320))["padded"].alias("padded"))
    return I.batch_width(sized).select("image_id", "region_id", "padded", "batch_w", "fill")


@query
def orientation_heuristic(spark, d):
    return rounded(I.heuristic(I.transitions(X.maps(spark, d), SIDE)))


@query
def map_tensor_stats(spark, d):
    s = I.tensor_stats(F.col("p"))
    return rounded(X.maps(spark, d).select("image_id", s.alias("s"), I.valid_tensor(F.col("p"), F.array(*[F.lit(v).cast("long") for v in (1, 1, 8, 8)])).alias("valid")).select("image_id", "s.*", "valid"))


# ---- sinks -----------------------------------------------------------------------------


def _results(spark, d):
    """Regions with a line of a document as text."""
    order = Window.partitionBy("image_id").orderBy("region_id")
    rows = X.region_rows(spark, d).withColumn("ord", F.row_number().over(order))
    text = F.concat(F.lit(" line "), F.col("ord").cast("string"), F.when(F.col("ord") % 3 == 0, F.lit(', "quoted" ')).otherwise(F.lit("")))
    return rows.select(
        "image_id",
        "ord",
        F.col("min_x").cast("int").alias("x"),
        F.col("min_y").cast("int").alias("y"),
        (F.col("max_x") - F.col("min_x")).cast("int").alias("w"),
        (F.col("max_y") - F.col("min_y")).cast("int").alias("h"),
        F.col("confidence").alias("det_conf"),
        F.when(F.col("ord") % 5 == 0, F.lit("  ")).otherwise(text).alias("text"),
        (F.col("region_id") % 8 / 8.0).alias("rec_conf"),
        F.lit("en").alias("language"),
    )


@query
def csv_rows(spark, d):
    return K.csv_rows(_results(spark, d))


@query
def batch_csv_rows(spark, d):
    rows = _results(spark, d)
    images = rows.select("image_id").distinct().unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("image_id")))
    images = images.withColumn("file", F.concat(F.lit("img,"), F.col("image_id").cast("string"), F.lit(".png")))
    return K.batch_csv_rows(images, rows)


@query
def json_regions(spark, d):
    return K.json_regions(_results(spark, d))


@query
def text_lines(spark, d):
    return K.text_of_image(_results(spark, d))


def _files(spark, rows):
    images = rows.select("image_id").distinct().unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("image_id")))
    return images.withColumn("file", F.concat(F.lit("img,"), F.col("image_id").cast("string"), F.lit(".png")))


@query
def batch_text(spark, d):
    rows = _results(spark, d)
    return K.batch_text(_files(spark, rows), rows)


@query
def batch_json(spark, d):
    rows = _results(spark, d)
    return K.batch_json(_files(spark, rows), rows)
