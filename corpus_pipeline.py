"""A corpus pipeline over ``documents``: five stages, each one operator over all that its predecessor kept.

language   keeps documents whose language the byte network finds (the rest, ``und`` among them, goes)
lines      takes recurring lines out of the texts, but for the first of each; every row stays, n_chars follows
near       keeps the smallest doc_id of each group of near-duplicates: texts that share 0.8 of their five-word shingles
mix        takes documents by the sources' budgets: a row an epoch, the cut document of a source shortened to its budget
pack       ids in pieces, packed into sequences of 2048: doc_id, piece, start, length, ids_crc32, sequence_id, offset

All but the last return the columns of their input. Null texts have no
language and go in the first stage; an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import langid, mixing, packing, simhash, templates
from folioframe.llm.common import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known_language(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = templates.drop_recurring_lines(docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [("language", language), ("lines", lines), ("near", near), ("mix", mix), ("pack", pack)]

#: Language scores, XXH64 and BPE ids are beyond SQL: the stages are tested one by one against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before it is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
