"""Files: discovery, images, dictionaries, models."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pixels

# File name endings of images that can be read.
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".bmp")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]+$", 0)


def glob_to_regex(pattern: str) -> str:
    """A file name pattern (*, ?, [...]) as a regular expression for the whole name."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 1) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif end > 0:
            out += "[" + pattern[i + 1 : end].replace("\\", "\\\\").replace("!", "^", pattern[i + 1 : i + 2] == "!") + "]"
            i = end
        else:
            out += c if c.isalnum() or c in "_- /" else "\\" + c
        i += 1
    return f"^{out}$"


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0)).isin(*IMAGE_ENDINGS)


def selected(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, column: str = "path") -> DataFrame:
    """Files whose name fits one of ``include`` (none: all) and none of ``exclude``."""
    name = base_name(F.col(column))
    any_of = lambda patterns: name.rlike("|".join(glob_to_regex(p) for p in patterns))
    out = files.filter(any_of(include)) if include else files
    return out.filter(~any_of(exclude)) if exclude else out


def discover(spark: SparkSession, folder: str, recursive: bool = False, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, length, modificationTime) of the images in a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return selected(files.select("path", "length", "modificationTime").filter(is_image(F.col("path"))), include, exclude)


def images(spark: SparkSession, folder: str, drop_invalid: bool = False) -> DataFrame:
    """Decoded images (path, width, height, channels, data) by Spark's own reader, data as BGR(A) turned to RGB(A); those that can't be read have nulls."""
    import numpy as np
    import pandas as pd

    rows = spark.read.format("image").option("dropInvalid", drop_invalid).load(folder).select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")

    def run(parts):
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if r.width is None or r.width <= 0:
                    out.append((r.origin, None, None, None, None))
                    continue
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                if r.channels >= 3:
                    a = a[..., [2, 1, 0, *range(3, r.channels)]]
                out.append((r.origin, r.width, r.height, r.channels, a.tobytes()))
            yield pd.DataFrame(out, columns=["path", "width", "height", "channels", "data"])

    return rows.mapInPandas(run, "path string, width int, height int, channels int, data binary")


def within_size(rows: DataFrame, most: int, column: str = "content") -> DataFrame:
    """Uploads of at most ``most`` bytes."""
    return rows.filter(F.length(column) <= most)


def from_base64(text: Column) -> Column:
    """Bytes of base64 text, with or without a data URL's head."""
    return F.unbase64(F.regexp_replace(text, "^data:[^,]*,", ""))


def decoded(rows: DataFrame, content: str = "content", most_pixels: int = 1 << 28) -> DataFrame:
    """The columns of ``rows`` but their bytes, and (width, height, channels, data, error) of PNG and BMP files held in a binary column.

    data are 8-bit samples, row by row: grey, grey and alpha, RGB or RGBA. What can't be read (other formats, cut or
    damaged files, more than ``most_pixels``, nulls) has an error and nulls.
    """
    kept = [c for c in rows.columns if c != content]
    image = "struct<width:int,height:int,channels:int,data:binary,error:string>"
    kind = pa.struct([*[(c, pa.int32()) for c in ("width", "height", "channels")], ("data", pa.binary()), ("error", pa.string())])

    def read(data: bytes | None) -> dict:
        try:
            if data is None:
                raise ValueError("no content")
            found = pixels.decoded(data, most_pixels)
            return {"width": found.shape[1], "height": found.shape[0], "channels": found.shape[2], "data": found.tobytes()}
        except ValueError as error:
            return {"error": str(error)}

    @F.arrow_udf(image)
    def run(contents: pa.Array) -> pa.Array:
        return pa.array([read(x.as_py()) for x in contents], kind)

    found = rows.select(*kept, run(F.col(content)).alias("__image"))
    return found.select(*kept, "__image.*")


# ---- dictionaries ----------------------------------------------------------------------


def dictionary_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line, token): the lines of dictionary files, each a token; white space is kept, a byte order mark is not."""
    out = None
    for i, path in enumerate(paths):
        text = spark.read.text(path, wholetext=True)
        body = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "^\\x{FEFF}", ""), "\r\n", "\n"), "\n$", "")
        rows = text.select(F.lit(i).alias("file"), F.posexplode(F.split(body, "\n")).alias("line", "token"))
        out = rows if out is None else out.unionByName(rows)
    return out


def merged_dictionary(lines: DataFrame) -> DataFrame:
    """(idx, token): each token where it first occurs, numbered from 0 in that order. A dictionary is one small table."""
    first = Window.partitionBy("token").orderBy("file", "line")
    kept = lines.withColumn("r", F.row_number().over(first)).filter("r = 1")
    return kept.select((F.row_number().over(Window.orderBy("file", "line")) - 1).cast("int").alias("idx"), "token")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def dictionary_paths(spark: SparkSession, folder: str, languages: list[str], default: str) -> list[str]:
    """The files there are for the languages, then the default."""
    found = []
    for language in languages:
        named = (f"{folder}/{name}" for name in (f"{language}.txt", f"dict_{language}.txt", f"{language}_dict.txt"))
        found += [path for path in named if exists(spark, path)][:1]
    return [*found, default]


def resolve_model(spark: SparkSession, name: str, kind: str, folder: str | None = None, variable: str = "FOLIOFRAME_MODELS") -> str:
    """The path of a model file: in the folder given, in that of the environment variable, or under ./models; by kind first, then flat."""
    places = [p for p in (folder, os.environ.get(variable), "models") if p]
    paths = [path for place in places for path in (f"{place}/{kind}/{name}", f"{place}/{name}")]
    return next((path for path in paths if exists(spark, path)), paths[0])


def available_models(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the model files under a folder, read from the store's listing."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.onnx").load(folder).select("path", "length")
