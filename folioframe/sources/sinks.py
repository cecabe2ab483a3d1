"""Results as JSON, text and CSV.

Rows are regions: image_id, file, ord, x, y, w, h, det_conf, text, rec_conf,
language. Every sink is a DataFrame of lines or documents; writing is Spark's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def number(x: Column, digits: int = 3) -> Column:
    """A fixed number of digits; halves of the decimal form go up."""
    return F.format_string(f"%.{digits}f", x)


def csv_field(x: Column) -> Column:
    """A field, in quotes with doubled quotes inside where it needs them."""
    return F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def csv_rows(regions: DataFrame) -> DataFrame:
    """(image_id, ord, line): x, y, w, h, det_conf, text, rec_conf."""
    fields = [F.col(c).cast("string") for c in ("x", "y", "w", "h")] + [number(F.col("det_conf")), csv_field(F.coalesce("text", F.lit(""))), number(F.col("rec_conf"))]
    return regions.select("image_id", "ord", F.concat_ws(",", *fields).alias("line"))


BATCH_HEADER = "file,region_index,text,confidence,det_confidence,x,y,width,height,language"


def batch_csv_rows(images: DataFrame, regions: DataFrame) -> DataFrame:
    """(file, region_index, line) under BATCH_HEADER: a line a region; an image without any has one of zeros."""
    rows = images.select("image_id", "file").join(regions, "image_id", "left")
    index = F.coalesce(F.col("ord") - 1, F.lit(0))
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).cast("string")
    fields = [csv_field(F.col("file")), index.cast("string"), csv_field(F.coalesce("text", F.lit(""))), number(F.coalesce("rec_conf", F.lit(0.0))), number(F.coalesce("det_conf", F.lit(0.0))), zero("x", 0), zero("y", 0), zero("w", 0), zero("h", 0), F.coalesce("language", F.lit(""))]
    return rows.select("file", index.alias("region_index"), F.concat_ws(",", *fields).alias("line"))


def text_of_image(regions: DataFrame, order: str = "ord") -> DataFrame:
    """(image_id, text): the trimmed texts that aren't empty, a line each, in the order of the column."""
    plain = F.regexp_replace("text", f"^{T.EDGES}|{T.EDGES}$", "")
    lists = regions.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(order, plain.alias("t")))).alias("a"))
    return lists.select("image_id", F.array_join(F.filter(F.col("a.t"), lambda t: t != ""), "\n").alias("text"))


def json_regions(regions: DataFrame) -> DataFrame:
    """(image_id, json): boxes with whole numbers, cut towards zero, in their order."""
    item = F.struct("ord", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), "text")
    lists = regions.groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias("regions"))
    return lists.select("image_id", F.to_json(F.struct("regions")).alias("json"))


def regions_from_json(rows: DataFrame) -> DataFrame:
    shape = "struct<regions: array<struct<ord: int, x: int, y: int, w: int, h: int, text: string>>>"
    return rows.select("image_id", F.explode(F.from_json("json", shape)["regions"]).alias("r")).select("image_id", "r.*")


def image_json(regions: DataFrame) -> DataFrame:
    """(image_id, json): one document an image with its mean detection confidence and all that is known of its regions."""
    box = F.struct("x", "y", "w", "h").alias("box")
    item = F.struct("ord", box, F.col("det_conf").alias("det_confidence"), "text", F.col("rec_conf").alias("rec_confidence"), "language")
    lists = regions.groupBy("image_id").agg(F.avg("det_conf").alias("avg_det_confidence"), F.array_sort(F.collect_list(item)).alias("regions"))
    return lists.select("image_id", F.to_json(F.struct("image_id", "avg_det_confidence", "regions")).alias("json"))


def batch_text(images: DataFrame, regions: DataFrame) -> DataFrame:
    """(file, text): a head line with the file's name, then the texts of the image from top left; an image without regions has its head and an empty line."""
    ordered = regions.withColumn("__at", F.struct("y", "x", "ord"))
    lines = text_of_image(ordered, "__at").withColumnRenamed("text", "lines")
    rows = images.select("image_id", "file").join(lines, "image_id", "left")
    return rows.select("file", F.concat(F.lit("# "), F.col("file"), F.lit("\n"), F.coalesce("lines", F.lit(""))).alias("text"))


def batch_json(images: DataFrame, regions: DataFrame) -> DataFrame:
    """(file, json): {"file": ..., "ocr": ...} for each image, with an empty list where nothing was found."""
    box = F.struct("x", "y", "w", "h").alias("box")
    item = F.struct("ord", box, "text", F.round("rec_conf", 6).alias("rec_confidence"), F.round("det_conf", 6).alias("det_confidence"), "language")
    lists = regions.groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias("regions"))
    rows = images.select("image_id", "file").join(lists, "image_id", "left")
    kind = lists.schema["regions"].dataType
    ocr = F.struct(F.coalesce("regions", F.array().cast(kind)).alias("regions")).alias("ocr")
    return rows.select("file", F.to_json(F.struct("file", ocr)).alias("json"))


DOCUMENT_HEADER = "File,Page,Image,Region,X1,Y1,X2,Y2,Width,Height,Confidence"


def document_csv_rows(regions: DataFrame) -> DataFrame:
    """(file, page, image_index, ord, line) under DOCUMENT_HEADER of regions (file, page, image_index, ord, x, y, w, h, det_conf)."""
    whole = lambda c: number(c.cast("double"), 0)
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    fields = [csv_field(F.col("file")), *[F.col(c).cast("string") for c in ("page", "image_index", "ord")], *[whole(c) for c in (x, y, x + w, y + h, w, h)], number(F.col("det_conf"))]
    return regions.select("file", "page", "image_index", "ord", F.concat_ws(",", *fields).alias("line"))


def document_text(pages: DataFrame) -> DataFrame:
    """(file, text) of page results (file, page, width, height, images): a line a page, an image and a region."""
    region = lambda r: F.concat(F.lit("    #"), r["ord"].cast("string"), F.lit(" box=("), r["x"].cast("string"), F.lit(","), r["y"].cast("string"), F.lit(" "), r["w"].cast("string"), F.lit("x"), r["h"].cast("string"), F.lit(") conf="), number(r["det_conf"]), F.lit("\n"))
    image = lambda i: F.concat(F.lit("  Image "), i["image_index"].cast("string"), F.lit(" ("), i["width"].cast("string"), F.lit("x"), i["height"].cast("string"), F.lit("): "), F.size(i["regions"]).cast("string"), F.lit(" region(s), confidence: "), number(i["confidence"]), F.lit("\n"), F.array_join(F.transform(i["regions"], region), ""))
    head = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" ("), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit("):\n"))
    body = F.concat(head, F.array_join(F.transform("images", image), ""), F.lit("\n"))
    lists = pages.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page", body.alias("body")))).alias("p"))
    return lists.select("file", F.concat(F.lit("File: "), F.col("file"), F.lit("\nTotal Pages: "), F.size("p").cast("string"), F.lit("\n\n"), F.array_join("p.body", ""), F.lit("---\n\n")).alias("text"))


def write(df: DataFrame, path: str, form: str) -> None:
    """json, csv (with header), text (one string column) or parquet."""
    writer = df.write.mode("overwrite")
    {"json": writer.json, "csv": lambda p: writer.option("header", True).csv(p), "text": writer.text, "parquet": writer.parquet}[form](path)
