"""What the operators of this subpackage share: the shared folder, intermediate tables, reading inputs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the checkpoint folder that the session was given.

    Where there is neither, a session in this one process (as in tests) gets a
    new folder; on a cluster that raises RuntimeError, as no other executor would see a folder of this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def clean_up(spark: SparkSession) -> bool:
    """Delete all intermediate tables in the shared folder; for when no result that reads them is needed any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/folioframe")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    The plan above it starts from files that every executor reaches, so a lost
    executor costs only its running tasks, and no later step repeats this one.
    """
    path = f"{shared_dir(df.sparkSession)}/folioframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more than one in HOT of all rows is hot; there are fewer than HOT of them, so they may be broadcast.
HOT = 1024


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """A left join on ``keys`` for which no key brings more than one in HOT of the rows of ``left`` together.

    ``right`` is a written table with one row for each key, without nulls, and the number of rows of ``left`` with
    that key in ``__n``, which is left out. Its hot rows, fewer than HOT, are broadcast; rows of
    ``left`` that met one of them, or lack a key, are dealt out by ``spread``, all others by their keys.
    """
    total = right.agg(F.sum("__n")).first()[0] or 0
    facts = [c for c in right.columns if c not in (*keys, "__n")]
    hot = right.filter(F.col("__n") * HOT > total).select(*keys, F.lit(True).alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in facts])
    met = left.join(F.broadcast(hot), keys, "left")
    # The rows that are served already carry a key that no other row has.
    served = F.coalesce("__hot", F.lit(False))
    for key in keys:
        served = served | F.col(key).isNull()
    met = met.withColumn("__salt", F.when(served, spread).otherwise(F.lit(0)))
    cold = right.filter(F.col("__n") * HOT <= total).select(*keys, F.lit(0).cast("long").alias("__salt"), *facts)
    found = met.join(cold, [*keys, "__salt"], "left")
    return found.select(*left.columns, *[F.coalesce(f"__hot_{c}", c).alias(c) for c in facts])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the fold that held-out rows are chosen by."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def word_count(text: Column) -> Column:
    """Number of words as a long; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Bytes of text that a step of an Arrow function holds, unless a single text has more.
SLICE = 4 << 20

#: The setting that bounds Arrow batches by bytes, and its default.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b")


def byte_batches(spark: SparkSession) -> None:
    """Arrow batches of about SLICE bytes from now on in this session, unless it has a bound of its own.

    Batches of ten thousand whole texts stand several times in memory, in the executor's process and the workers'.
    """
    name, default = BATCH_BYTES
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, str(SLICE))


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose values of a text or binary column have up to ``most`` bytes together, or are one value."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield batch.slice(at, end - at)
        at = end
