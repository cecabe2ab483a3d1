"""Views over the base tables that stand for detector maps, boxes, sequences, pages and requests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VIEWS = {
    "f_regions": """
select region_id, image_id, cast(min_x as double) as min_x, cast(min_y as double) as min_y,
       cast(min_x + w as double) as max_x, cast(min_y + h as double) as max_y, confidence
from (
  select cast(row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) as bigint) as region_id,
         cast(floor(l_orderkey / 8) as bigint) as image_id,
         (l_partkey * 37) % 160 as min_x, (l_suppkey * 53) % 96 as min_y,
         8 + cast(l_quantity as int) as w, 6 + l_linenumber * 3 as h,
         ((l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 31) % 9973 + 1) / cast(10000 as double) as confidence
  from lineitem) t""",
    "f_page_text": """
select doc_id, 1 as page, text, cast(612 as double) as page_w, cast(792 as double) as page_h, cast(doc_id % 3 as int) as image_count from documents""",
    "f_elements": """
select conv_id as page_id, turn as elem_id, text, case when role = 'user' then 'vector' else 'ocr' end as source,
       cast((turn * 137 + conv_id * 11) % 500 as double) as x, cast((turn * 61 + conv_id * 7) % 700 as double) as y,
       cast(60 + (turn * 29) % 120 as double) as w, cast(12 as double) as h,
       ((conv_id * 31 + turn * 17) % 101) / cast(100 as double) as rec_conf
from conversations""",
    "f_requests": """
select event_id, user_id, ts, cast(round(value * 100) as bigint) as data_size, event_type from events""",
    "f_shared_requests": """
select event_id, user_id % 5 as user_id, user_id as own_id, ts, cast(round(value * 100) as bigint) as data_size, event_type from events""",
    "f_dict": """
select * from (values (0,'a'),(1,'b'),(2,'c'),(3,'d'),(4,'e'),(5,'f'),(6,'ß')) as t(idx, token)""",
}

#: The same views, and those that unnest arrays, for DuckDB.
DUCKDB_VIEWS = VIEWS | {
    "f_pixels": """
select vec_id as image_id, cast(floor(pos / 8) as int) as y, cast(pos % 8 as int) as x,
       greatest(cast(0 as double), least(cast(1 as double), cast(0.5 as double) + 2 * cast(v as double))) as p
from (select vec_id, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding) as v from embeddings) t""",
    "f_logits": """
select vec_id as seq_id, cast(floor(pos / 8) as int) as t, cast(pos % 8 as int) as c, cast(v as double) as logit
from (select vec_id, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding) as v from embeddings) q""",
}

MAP_SIDE = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def region_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region_id, image_id, min_x, min_y, max_x, max_y, confidence); region_id numbers the rows in their full order."""
    rows = _table(spark, sf_dir, "lineitem")
    # A global row number by ranges of two sizes: rows are numbered within a small range, after those of the small ranges
    # before it in its large range, after those of the large ranges before. Only one row for 2^20 orders meets in one place.
    sizes = rows.groupBy(F.floor(F.col("l_orderkey") / 1024).alias("part")).count().withColumn("large", F.floor(F.col("part") / 1024))
    earlier = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = sizes.groupBy("large").agg(F.sum("count").alias("count")).select("large", earlier(Window.orderBy("large")).alias("first"))
    starts = sizes.select("part", "large", earlier(Window.partitionBy("large").orderBy("part")).alias("start")).join(tops, "large")
    starts = starts.select("part", (F.col("first") + F.col("start")).alias("start"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    inside = Window.partitionBy("part").orderBy(*order)
    rows = rows.withColumn("part", F.floor(F.col("l_orderkey") / 1024)).withColumn("n", F.row_number().over(inside)).join(starts, "part")
    min_x, min_y = (F.col("l_partkey") * 37) % 160, (F.col("l_suppkey") * 53) % 96
    score = ((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729 + F.col("l_linenumber") * 31) % 9973 + 1) / F.lit(10000.0)
    return rows.select(
        (F.col("start") + F.col("n")).cast("long").alias("region_id"),
        F.floor(F.col("l_orderkey") / 8).cast("long").alias("image_id"),
        min_x.cast("double").alias("min_x"),
        min_y.cast("double").alias("min_y"),
        (min_x + 8 + F.col("l_quantity").cast("int")).cast("double").alias("max_x"),
        (min_y + 6 + F.col("l_linenumber") * 3).cast("double").alias("max_y"),
        score.alias("confidence"),
    )


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, p): a probability map of 8 by 8 for each vector, as one array."""
    p = F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + 2 * v.cast("double"))))
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), p.alias("p"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, p): the maps in long form."""
    long = maps(spark, sf_dir).select("image_id", F.posexplode("p").alias("pos", "p"))
    return long.select("image_id", F.floor(F.col("pos") / MAP_SIDE).cast("int").alias("y"), (F.col("pos") % MAP_SIDE).cast("int").alias("x"), "p")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, steps): an array of steps, each an array of class scores."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.transform(F.slice("embedding", t * 8 + 1, F.lit(8)), lambda v: v.cast("double")))
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq_id"), steps.alias("steps"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.lit(1).alias("page"), "text", F.lit(612.0).alias("page_w"), F.lit(792.0).alias("page_h"), (F.col("doc_id") % 3).cast("int").alias("image_count"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    return _table(spark, sf_dir, "conversations").select(
        c.alias("page_id"),
        t.alias("elem_id"),
        "text",
        F.when(F.col("role") == "user", "vector").otherwise("ocr").alias("source"),
        ((t * 137 + c * 11) % 500).cast("double").alias("x"),
        ((t * 61 + c * 7) % 700).cast("double").alias("y"),
        (F.lit(60) + (t * 29) % 120).cast("double").alias("w"),
        F.lit(12.0).alias("h"),
        (((c * 31 + t * 17) % 101) / F.lit(100.0)).alias("rec_conf"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("data_size"), "event_type")


def shared_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests under five accounts (user_id) that all users (own_id) share: long runs, full windows, reached limits."""
    return requests(spark, sf_dir).withColumn("own_id", F.col("user_id")).withColumn("user_id", F.col("user_id") % 5)


def dictionary(spark: SparkSession) -> DataFrame:
    """(idx, token): a small character dictionary; class idx + 1 stands for the token."""
    return spark.createDataFrame(list(enumerate("abcdefß")), "idx int, token string")


def dark_maps(images: DataFrame, side: int = 16) -> DataFrame:
    """(image_id, p): in place of a detector, maps of how dark the parts of an image are."""
    from ..operators.images import pixels_of, resized

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(r.image_id, (1 - resized(pixels_of(r)[..., :1], side, side).astype(float).ravel() / 255).tolist()) for r in part.itertuples()]
            yield pd.DataFrame(out, columns=["image_id", "p"])

    return images.mapInPandas(run, "image_id long, p array<double>")


def _shades(part: pd.DataFrame) -> pd.DataFrame:
    means = [float(np.asarray(d).reshape(list(s))[..., :w].mean()) for d, s, w in zip(part["data"], part["shape"], part["width"], strict=True)]
    return pd.DataFrame({"image_id": part["image_id"], "region_id": part["region_id"], "steps": [[[0.05, 0.9, 0.05] if m < 0.5 else [0.05, 0.05, 0.9]] for m in means]})


def shade_scores(tensors: DataFrame) -> DataFrame:
    """(image_id, region_id, steps): in place of a recogniser, one step whose class is 1 for dark crops and 2 for light ones."""
    return tensors.select("image_id", "region_id", "width", "shape", "data").mapInPandas(lambda parts: map(_shades, parts), "image_id long, region_id long, steps array<array<double>>")


shade_scores.batch = _shades
