"""Approximate nearest neighbours by a hash-prefix forest.

The vectors are dealt to shards of bounded size, each with a forest of its own.
A tree gives every vector of its shard a long hash string (signs of
projections, orthogonal in groups) and keeps the strings in a sorted array, so
vectors that share a prefix are one run. A query descends in every tree to the
longest prefix that the tree holds, of whatever length, and then ascends in
all trees at once, from the longest match of all to the depth at which the runs
together hold enough candidates; at the root that is every vector. The
forest lies in the memory of the task that searches its shard: what is shipped
is each vector once for each chunk of queries, and no hash string.

Vectors are scored by inner product. For hashing they are extended by one
coordinate to equal length, which leaves the order of inner products with a
query as it is and makes it the order of angles that the hash strings see.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TREES, BITS = 128, 48
#: Candidates that the runs of a query hold together at least in a shard: a share of its vectors, and a number.
SHARE, LEAST = 0.4, 2500
#: Vectors in a shard and queries in a chunk, about: what one task holds.
SHARD, CHUNK = 8192, 4096
SEED = 17
#: Queries that are scored at a time.
STEP = 64


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v): vectors as they are, less those that are null, zero or hold a null, NaN or infinity, and rows without id."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    return rows.filter(fine & F.exists("v", lambda x: x != 0))


# ---- the forest of a shard ------------------------------------------------------------


def planes(dim: int, trees: int, seed: int) -> np.ndarray:
    """Directions (dim + 1, trees * BITS), orthogonal in groups of dim + 1."""
    rng, n, out = np.random.default_rng(seed), trees * BITS, []
    while n > 0:
        out.append(np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0][:, :n])
        n -= dim + 1
    return np.concatenate(out, axis=1).astype(np.float32)


def hash_strings(x: np.ndarray, longest: float, directions: np.ndarray) -> np.ndarray:
    """(rows, trees): the tree's number above the BITS of its hash string, for vectors extended to the length ``longest``; 0 for queries, which get a 0."""
    trees, out = directions.shape[1] // BITS, []
    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        size = np.sqrt((part * part).sum(axis=1))
        more = np.sqrt(np.maximum(longest * longest - size * size, 0))
        scale = longest or np.maximum(size, np.finfo(float).tiny)[:, None]
        bits = np.concatenate([part, more[:, None]], axis=1) / scale
        bits = (bits.astype(np.float32) @ directions > 0).reshape(len(part), trees, BITS)
        packed = np.packbits(bits, axis=2).astype(np.int64)
        h = np.zeros(packed.shape[:2], np.int64)
        for k in range(packed.shape[2]):
            h = h << 8 | packed[:, :, k]
        out.append(h)
    return np.concatenate(out) | np.arange(trees, dtype=np.int64) << BITS


class Forest:
    """The sorted hash strings of all trees, one tree after the other, and the vectors they belong to."""

    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = SEED):
        self.n, self.trees, self.directions = len(x), trees, planes(x.shape[1], trees, seed)
        h = hash_strings(x, float(np.sqrt((x * x).sum(axis=1).max())), self.directions)
        order = np.argsort(h, axis=0, kind="stable")
        self.keys = np.take_along_axis(h, order, axis=0).T.reshape(-1)
        self.vector = order.T.reshape(-1).astype(np.int32)

    def descend(self, h: np.ndarray) -> np.ndarray:
        """For each query and tree the length of the longest prefix that the tree holds."""
        at, start = np.searchsorted(self.keys, h), np.arange(self.trees) * self.n
        before, after = self.keys[np.maximum(at - 1, start)], self.keys[np.minimum(at, start + self.n - 1)]
        return BITS - np.frexp(np.minimum(h ^ before, h ^ after).astype(np.float64))[1]

    def at_depth(self, h: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of the runs that share ``depth`` bits with each query."""
        up = (BITS - depth)[:, None]
        prefix = h >> up
        return np.searchsorted(self.keys, prefix << up), np.searchsorted(self.keys, prefix + 1 << up)

    def runs(self, q: np.ndarray, want: float) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of each query's run in each tree, after the ascent to ``want`` candidates in all runs together.

        Runs only grow on the way up, so the depth at which the ascent ends is found by halving the way.
        """
        h = hash_strings(q, 0.0, self.directions)
        root, deepest = np.zeros(len(q), np.int64), self.descend(h).max(axis=1).astype(np.int64)
        while (rising := np.flatnonzero(root < deepest)).size:
            middle = (root[rising] + deepest[rising] + 1) // 2
            low, high = self.at_depth(h[rising], middle)
            enough = (high - low).sum(axis=1) >= want
            root[rising[enough]] = middle[enough]
            deepest[rising[~enough]] = middle[~enough] - 1
        return self.at_depth(h, root)

    def candidates(self, q: np.ndarray, want: float) -> np.ndarray:
        """(queries, vectors): whether a vector is in one of the query's runs."""
        low, high = self.runs(q, want)
        n = (high - low).reshape(-1)
        at = np.repeat(low.reshape(-1) - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = np.zeros((len(q), self.n), bool)
        found[np.repeat(np.arange(len(q)), (high - low).sum(axis=1)), self.vector[at]] = True
        return found


def best_of(forest: Forest, x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, want: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, id, score) of the ``k`` best candidates of each query; equal scores by id.

    Scores are summed one way, coordinate by coordinate, so equal vectors of
    products tie wherever they are scored. The quick products that choose what
    is scored so may differ in their last bits: all that they leave in doubt is kept.
    """
    found = forest.candidates(q, want)
    if found.mean() > 0.1:  # one matrix product is less work than fetching so many vectors one by one
        rough = np.where(found, q @ x.T, -np.inf)
    else:
        r, c = np.nonzero(found)
        rough = np.full(found.shape, -np.inf)
        rough[r, c] = np.einsum("ij,ij->i", q[r], x[c])
    if rough.shape[1] > k:
        doubt = 1e-12 * x.shape[1] * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max())
        edge = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
        found &= rough >= (edge - doubt)[:, None]
    r, c = np.nonzero(found)
    score = np.zeros(len(r))
    for j in range(x.shape[1]):
        score += x[c, j] * q[r, j]
    order = np.lexsort((ids[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], ids[c[place < k]], score[place < k]


# ---- all shards -----------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest(index: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, share: float = SHARE, least: int = LEAST, shard: int = SHARD, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query, itself left out.

    ``index`` and ``queries`` have vec_id and embedding. Ties go to the smaller
    vec_id; scores are inner products in double precision. Equal vectors (by
    128 bits of hash) are
    indexed once with their k + 1 smallest ids, which is all that can be among
    k neighbours, so copies never crowd a run. Rows that :func:`usable` drops
    take no part; repeated ids with equal vectors count once. No usable rows
    give none. Vectors of another length than the first's raise ValueError.
    """
    spark = index.sparkSession
    rows = usable(index).select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    # Which ids share a vector is found on hashes, without shipping the vectors.
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    same = rows.select("vec_id", "h1", "h2").distinct().withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    same = same.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    same = materialize(same.select(F.col("members")[0].alias("id"), "h1", "h2", "members"), "members")
    n = same.count()
    asked = materialize(usable(queries).distinct().select(F.col("vec_id").alias("id"), "v"), "queries")
    about = asked.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n or not about[0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards, chunks, dim = -(-n // shard), -(-about[0] // chunk), about[1]

    first = same.select(F.col("id").alias("vec_id"), "h1", "h2")
    vectors = rows.join(first, ["vec_id", "h1", "h2"]).dropDuplicates(["vec_id", "h1", "h2"]).select(F.col("vec_id").alias("id"), "v")
    vectors = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asking = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(held: pa.Table, seeking: pa.Table) -> pa.Table:
        """Each query's best of this shard."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(held) and len(seeking):
            for column in (held["v"], seeking["v"]):
                if set(np.diff(column.combine_chunks().offsets.to_numpy()).tolist()) != {dim}:
                    raise ValueError("vectors of different lengths")
            ids, x = held["id"].to_numpy(), _matrix(held["v"])
            asks, q = seeking["id"].to_numpy(), _matrix(seeking["v"])
            forest = Forest(x, trees, seed)
            for at in range(0, len(q), STEP):
                r, found, score = best_of(forest, x, ids, q[at : at + STEP], k + 1, max(share * len(x), least, k + 1))
                out.append((asks[at : at + STEP][r], found, score))
        query, found, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query": query, "id": found, "score": score})

    found = vectors.groupBy("shard", "chunk").cogroup(asking.groupBy("shard", "chunk")).applyInArrow(search, "query long, id long, score double")
    found = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).join(same.select("id", "members"), "id")
    found = found.select(F.col("query").alias("query_id"), F.explode("members").alias("vec_id"), "score").filter("vec_id <> query_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id may have several vectors
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
