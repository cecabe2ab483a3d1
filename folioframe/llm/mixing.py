"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. A source's keys are ranges of equal
width, and word counts are summed in two steps: over the ranges of a source,
then within a range in the order of the keys. This gives each document the
number of words before it, wherever it lies, and the mix cuts each source at
its budget to the word; larger budgets repeat whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its size.
EPOCHS = 3
#: Hexadecimal digits of the key that name its range: 4096 ranges a source.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) for one row a source (source, source_size).

    The sizes' total is shared by weight; no target is above ``epochs`` times
    its source's size, and the excess is shared among the others by weight
    until none is above. Sources are in code point order, null last.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    s = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * epochs).alias("most"))
    # In the order of most / w those at their limit come first: each is, if it is at the share that is left when all before it are.
    ratio = (F.col("most") / F.col("w")).asc()
    before = Window.orderBy(ratio, F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.sum("w").over(every).alias("all_w"),
        F.coalesce(F.sum("most").over(before), F.lit(0)).alias("most_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
    )
    share = (F.col("total") - F.col("most_before")) / (F.col("all_w") - F.col("w_before"))
    s = s.withColumn("full", F.col("most") / F.col("w") <= share)
    at_limit = F.col("full").cast("long")
    s = s.select(
        "*", F.sum(at_limit * F.col("most")).over(every).alias("full_most"), F.sum(at_limit * F.col("w")).over(every).alias("full_w")
    )
    level = (F.col("total") - F.col("full_most")) / F.nullif(F.col("all_w") - F.col("full_w"), F.lit(0))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(level * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, mix_key, source, size, source_size, target, taken): a row for each row of ``docs``.

    taken is the number of words the mix takes of the row: as many whole
    epochs as the source's budget (its target, rounded down) holds, and in the
    order of the keys what is left, to the word. The key is the md5 of doc_id
    and text, so reruns agree; ties go by size. Null texts have size 0, a null
    source is a source, a null doc_id is a value like any other.
    """
    known = F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(known.cast("binary")).alias("mix_key"))
    part = F.substring("mix_key", 1, RANGE_DIGITS)
    ranges = rows.groupBy("source", part.alias("part")).agg(F.sum("size").alias("range_size"))
    sizes = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "part", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("start"))
    targets = source_targets(sizes, weights, epochs).withColumnRenamed("source", "s")
    ranges = ranges.join(targets, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("part").alias("p"), "start", "source_size", "target")
    inside = Window.partitionBy("source", "part").orderBy("mix_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", part).withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    budget = F.floor("target").cast("long")
    whole = F.coalesce(F.expr("floor(target) div nullif(source_size, 0)"), F.lit(0))
    left = budget - whole * F.col("source_size") - F.col("start") - F.col("inner")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least("size", left))
    return rows.select("doc_id", "mix_key", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mix as rows of ``docs``: a row for each epoch of a document, and the cut document of a source to its last word taken.

    Rows that no word is taken of go; rows without words have none to take and
    stay as they are, once. Equal texts under one doc_id are counted source by source, so each source gives what the mix takes of it. The columns are those of ``docs``; where there is
    n_chars, a cut text's is its new length.
    """
    names = docs.columns
    known = F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    rows = docs.withColumn("__size", word_count(F.col("text"))).withColumn("__key", F.md5(known.cast("binary")))
    mixed = mix(docs, weights, epochs).filter("size > 0")
    # Rows with the same key in the same source are numbered on both sides before any of them is left out; together they have the sum of what was taken of them.
    order = Window.partitionBy("mix_key", "source").orderBy(F.col("taken").desc())
    mixed = mixed.select(F.col("mix_key").alias("__k"), F.col("source").alias("__s"), F.row_number().over(order).alias("__i"), "taken").filter("taken > 0")
    same = Window.partitionBy("__key", "source").orderBy("__size")
    found = rows.filter("__size > 0").withColumn("__n", F.row_number().over(same))
    found = found.join(mixed, (F.col("__key") == F.col("__k")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__n") == F.col("__i")))
    found = found.withColumn("__copy", F.expr("explode(sequence(0L, (taken - 1) div __size))"))
    found = found.withColumn("__words", F.least("__size", F.col("taken") - F.col("__copy") * F.col("__size")))
    parts = F.slice(F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1), F.col("__words").cast("int"))
    whole = F.col("__words") >= F.col("__size")
    found = found.withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(parts, "")))
    if "n_chars" in names:
        found = found.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return found.select(*names).unionByName(rows.filter("__size = 0").select(*names))
