"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint falls into segments of 23, 23 and 18 bits. The binary
Golay code is perfect: each 23-bit word has one codeword within 3 bits, found
here from its syndrome, and that codeword's 12 information bits are an index.
The words within one bit of a segment decode to one or six such indices, and
two segments within two bits of each other have an index in common. Of four
differing bits, the two best segments hold at most two, so some pair of
segments differs by (0, 0..2), (1, 1) or (2, 0) bits. Keys that join the own
index of one segment to the nearby indices of the other therefore meet for
every pair of fingerprints within four bits. Groups of equal keys are verified
by exact distance and yield links; links are contracted to components.

Texts that share 0.8 of their shingles differ in about ten of 64 bits, beyond
such keys. For these, :func:`similar_texts` makes a longer SimHash of the set of
shingles and decodes its segments softly: the sums whose signs are the bits say
how sure each bit is, and a segment gives the codewords that agree best with
them. Keys join the indices of two segments, the likeliest joins first. Groups of
equal keys are verified by the distance of 256 other bits, and what they link by
the exact Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, join_hot, materialize

SEED = 42
MAX_BITS = 4
#: Bytes of text that are cut into words at a time.
CHUNK = 1 << 20
#: Fingerprints that are compared with one another in one task at most.
BLOCK = 4096
#: Groups up to this size give all their links, larger ones a spanning forest.
SMALL = 8
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Pairs of segments, codewords of a segment and keys of a pair for texts of this similarity or more. Two texts
#: at exactly LEAST have a key of one pair in common in 0.81 of cases (measured), so none of seven pairs' once in 100,000.
BANDS, NEAREST, KEYS, LEAST = 7, 8, 16, 0.8
#: Words of bits that verify such keys, and their differing bits at most: 39 +- 6 at LEAST (48 +- 6 for sets of four and
#: five), 128 +- 8 between texts that share nothing, of which one pair in 10^9 passes: candidates of unrelated texts do
#: not grow together to large groups, however many texts there are.
CHECK, CHECK_BITS = 4, 80
#: Texts, and bytes of text, of a block of texts that are compared in one task.
TEXTS, TEXT_BYTES = 1024, 2 << 20


# ---- fingerprints ----------------------------------------------------------------


def _word_runs(data: bytes) -> Iterator[list[bytes]]:
    """The words in order, a list for about CHUNK bytes."""
    if len(data) <= CHUNK:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[at:end].split()
        at = end


def fingerprint(data: bytes, words: int = 4) -> int:
    """Unsigned SimHash of a text's UTF-8 bytes; see :func:`fingerprints`."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for run in _word_runs(data.lower()):
        run = tail + run
        if len(run) >= words:
            shingles = map(b" ".join, zip(*(run[i:] for i in range(words)), strict=False))
            h = np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles]), np.uint8)
            total += len(h) // 8
            for i in range(0, len(h), 8 << 16):
                ones += np.unpackbits(h[i : i + (8 << 16)]).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        tail = run[len(run) - words + 1 :] if len(run) >= words else run
    if not total:
        if not tail:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, th, fp): a row for each row of ``docs``; th is the text's xxhash64, fp the fingerprint as a signed long.

    Words are runs without ASCII white space, A-Z in lower case, shingles have
    ``words`` words and count as often as they occur; a shorter text is one
    shingle. Null and empty texts have fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            fps = np.fromiter((fingerprint(t.as_py() or b"", words) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "th", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


# ---- Golay keys -------------------------------------------------------------------


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 12 high bits, and the error pattern of each syndrome."""
    poly, high = 0xC75, np.zeros(4096, np.int64)
    for h in range(4096):
        r = h << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= poly << (bit - 11)
        high[h] = r
    errors = np.zeros(2048, np.int64)
    bits = [1 << i for i in range(23)]
    for i, a in enumerate(bits):
        for j in range(i, 23):
            for k in range(j, 23):
                e = a | bits[j] | bits[k]
                errors[high[e >> 11] ^ e & 0x7FF] = e
    return high, errors


_HIGH, _ERRORS = _tables()


def decode(word: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    return (word ^ _ERRORS[_HIGH[word >> 11] ^ word & 0x7FF]) >> 11


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fps``, key) for all keys of each fingerprint."""
    u = fps.view(np.uint64)
    own, near = [], []
    for at, width in SEGMENTS:
        s = (u >> np.uint64(at)).astype(np.int64) & (1 << width) - 1
        around = np.concatenate([s[:, None], s[:, None] ^ (1 << np.arange(width))[None, :]], axis=1)
        index = np.sort(decode(around), axis=1)
        fresh = np.ones_like(index, bool)
        fresh[:, 1:] = index[:, 1:] != index[:, :-1]
        row, col = np.nonzero(fresh)
        own.append(decode(s))
        near.append((row, index[row, col]))
    rows, keys = [], []
    for p, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        row, index = near[j]
        rows.append(row)
        keys.append(p << 24 | own[i][row] << 12 | index)
        row, index = near[i]
        other = index != own[i][row]
        rows.append(row[other])
        keys.append(p << 24 | index[other] << 12 | own[j][row[other]])
    return np.concatenate(rows), np.concatenate(keys)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i in range(0, len(fps), BLOCK):
            part = fps[i : i + BLOCK]
            row, key = golay_keys(part)
            yield pa.record_batch([pa.array(key), pa.array(part[row])], names=["key", "fp"])


# ---- verified links ---------------------------------------------------------------


def _bits(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    n = np.bitwise_count((a ^ b).view(np.uint64))
    return n if n.ndim == 1 else n.sum(axis=1)


def _first(fps: np.ndarray) -> np.ndarray:
    """What links call the fingerprints: themselves, or the first of their words."""
    return fps if fps.ndim == 1 else fps[:, 0]


def _forest(fps: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Links that join what links within max_bits join, fewer than there are fingerprints."""
    rest, a, b = fps, [], []
    while len(rest):
        wave, rest = [rest[0]], rest[1:]
        while wave and len(rest):
            x = wave.pop()
            hit = _bits(rest, x) <= max_bits
            if hit.any():
                found = rest[hit]
                a += [int(_first(x[None])[0])] * len(found)
                b += _first(found).tolist()
                wave += list(found)
                rest = rest[~hit]
    return a, b


def _group_links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the groups of equal keys; rows sorted by key."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    a, b = [], []
    k, f = key[small], fp[small]
    for d in range(1, SMALL):
        if len(k) <= d:
            break
        same = k[d:] == k[:-d]
        if not same.any():
            break
        x, y = f[d:][same], f[:-d][same]
        hit = _bits(x, y) <= max_bits
        a.append(_first(x[hit]))
        b.append(_first(y[hit]))
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        x, y = _forest(np.unique(fp[s : s + n], axis=0), max_bits)
        a.append(np.array(x, np.int64))
        b.append(np.array(y, np.int64))
    a = np.concatenate([np.empty(0, np.int64), *a])
    b = np.concatenate([np.empty(0, np.int64), *b])
    a, b = np.minimum(a, b), np.maximum(a, b)
    pairs = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
    return pairs[:, 0], pairs[:, 1]


def _linker(max_bits: int, block: int | None, words: int):
    """For mapInArrow over (key, fp of ``words`` words) sorted by key: links (a, b, null, nulls) between first words, and
    the rows of groups of over ``block`` as (null, null, key, words)."""
    names = ["a", "b", "key", *[f"w{i}" for i in range(words)]]

    def links(a, b):
        none = pa.nulls(len(a), pa.int64())
        return pa.record_batch([pa.array(a), pa.array(b), *[none] * (words + 1)], names=names)

    def passed_on(k, f):
        none, columns = pa.nulls(len(f), pa.int64()), f.reshape(len(f), words)
        return pa.record_batch([none, none, pa.array(k, pa.int64()), *[pa.array(columns[:, i].copy()) for i in range(words)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.empty(0, np.int64)
        over = None
        for batch in batches:
            k, *f = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            f = f[0] if words == 1 else np.stack(f, axis=1)
            key, fp = (np.concatenate([key, k]), np.concatenate([fp, f])) if len(key) else (k, f)
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if over is not None and key[0] == over:
                n = int(np.searchsorted(key, over, "right"))
                yield passed_on(key[:n], fp[:n])
                key, fp, cut = key[n:], fp[n:], max(0, cut - n)
            if cut:
                yield from whole(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
            if block and len(key) > block:
                over = key[0]
                yield passed_on(key, fp)
                key = fp = np.empty(0, np.int64)
        if len(key):
            if over is not None and key[0] == over:
                yield passed_on(key, fp)
            else:
                yield from whole(key, fp)

    def whole(key, fp):
        if block:
            _, at, n = np.unique(key, return_inverse=True, return_counts=True)
            big = n[at] > block
            if big.any():
                yield passed_on(key[big], fp[big])
                key, fp = key[~big], fp[~big]
        if len(key):
            yield links(*_group_links(key, fp, max_bits))

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the distinct fingerprints of column ``fp``.

    Their components are those of all pairs within ``max_bits`` (4 at most);
    large groups of equal keys contribute a spanning forest, not all pairs.
    A group of over ``block`` fingerprints is dealt out again as pairs of blocks.
    """
    if max_bits > MAX_BITS:
        raise ValueError("the keys find pairs within 4 bits")
    return _verified(fps.select("fp").mapInArrow(_emit_keys, "key long, fp long"), max_bits, block)


def _verified(keyed: DataFrame, max_bits: int, block: int) -> DataFrame:
    """(a, b): links within ``max_bits`` in the groups of equal keys, of rows of a key and a fingerprint of some words; links have the first."""
    words = keyed.columns[1:]
    shape = ", ".join(f"{c} long" for c in ("a", "b", "key", *[f"w{i}" for i in range(len(words))]))
    linked = lambda rows, block: rows.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(max_bits, block, len(words)), shape)
    found = materialize(linked(keyed, block), "links")
    over = found.filter("key is not null").select("key", *[F.col(f"w{i}").alias(w) for i, w in enumerate(words)])
    edges = found.filter("key is null").select("a", "b")
    if not over.isEmpty():
        counts = over.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n"))
        dealt = over.join(counts, "key").withColumn("own", F.pmod(F.xxhash64(words[0]), F.col("n")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        group = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        edges = edges.unionByName(linked(dealt.select(group.alias("key"), *words), None).select("a", "b"))
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the links (a, b), the smallest node that can be reached.

    Each round maps every node to a smaller neighbour, eight steps at most, and
    contracts the links; a round's tables are written, so lineage stays short.
    """
    spark = edges.sparkSession
    left = materialize(edges.filter("a <> b"), "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("up"))
        for _ in range(3):
            again = up.select(F.col("a").alias("up"), F.col("up").alias("up2"))
            up = up.join(again, "up").select("a", F.col("up2").alias("up"))
        up = materialize(up, "up")
        if labels is None:
            labels = up.select(F.col("a").alias("node"), F.col("up").alias("root"))
        else:
            step = up.select(F.col("a").alias("root"), "up")
            labels = labels.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            labels = materialize(labels, "labels")
        left = left.join(up, "a").select("b", F.col("up").alias("x"))
        left = left.join(up.select(F.col("a").alias("b"), F.col("up").alias("y")), "b")
        left = left.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = materialize(left, "edges")
    if labels is None:
        return spark.createDataFrame([], "node long, root long")
    return labels


def _grouped(docs: DataFrame, words: int, max_bits: int) -> DataFrame:
    """(doc_id, th, fp, root, component_id): a row for each row of ``docs``; th stands for the text, root for the component."""
    fps = materialize(fingerprints(docs, words), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes, max_bits)).select(F.col("node").alias("fp"), "root")
    nodes = _component_ids(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    return fps.join(nodes, "fp").select("doc_id", "th", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for each row of ``docs``.

    component_id is the smallest doc_id that links of at most ``max_bits``
    differing bits reach, the own one included. Equal fingerprints are one node,
    whatever their number. Null doc_ids stay, and are no component's id unless
    it has no other (then null). No rows give no rows; other columns are ignored.
    """
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return _grouped(docs, words, max_bits).select("doc_id", hexed, "component_id")


# ---- texts that share most of their shingles ----------------------------------------

#: Segments of a long fingerprint, the bits of a Golay codeword each, and the 64-bit words that hold them after those of the check.
PARTS, WIDTH = 2 * BANDS, 23
LENGTH = CHECK + -(-PARTS * WIDTH // 64)
CHECKS = [f"check{i}" for i in range(CHECK)]
_RNG = np.random.default_rng(SEED)
_FLIPS = _RNG.integers(0, 1 << 64, LENGTH, np.uint64)
_FACTORS, _MIX = _RNG.integers(0, 1 << 64, (2, LENGTH), np.uint64) | np.uint64(1)
#: The 4096 codewords by index, as signs of their bits.
_SIGNS = np.array([[1 if (i << 11 | int(_HIGH[i])) >> b & 1 else -1 for i in range(4096)] for b in range(WIDTH)], np.float32)


def shingle_set(data: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, as :func:`fingerprint` cuts them; a text without words has none."""
    found, tail = [], []
    for run in _word_runs(data.lower()):
        run = tail + run
        if len(run) >= words:
            shingles = map(b" ".join, zip(*(run[i:] for i in range(words)), strict=False))
            found.append(np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles]), ">u8"))
        tail = run[len(run) - words + 1 :] if len(run) >= words else run
    if not found and tail:
        found.append(np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64))
    return np.unique(np.concatenate([np.empty(0, np.uint64), *found]).astype(np.uint64))


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a shingle set before the signs are taken, in 64 x LENGTH bits: how many shingles more have a bit than have it not."""
    ones = np.zeros(64 * LENGTH, np.int64)
    for i in range(0, len(hashes), 255):
        h = (hashes[i : i + 255, None] ^ _FLIPS) * _FACTORS
        h = (h ^ h >> np.uint64(32)) * _MIX
        h ^= h >> np.uint64(29)
        # Eight counts, one a byte, in each number: 255 rows do not overflow them.
        bits = np.unpackbits(h.view(np.uint8).ravel()).view(np.uint64).reshape(len(h), -1)
        ones += bits.sum(axis=0, dtype=np.uint64).view(np.uint8)
    return 2 * ones - len(hashes)


def soft_decode(sums: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the ``count`` codewords that agree best with each row of 23 sums, best first, and how much less each agrees than the best."""
    index, loss = np.empty((len(sums), count), np.int64), np.empty((len(sums), count), np.float32)
    for at in range(0, len(sums), 512):
        agree = sums[at : at + 512].astype(np.float32) @ _SIGNS
        rows = np.arange(len(agree))
        for j in range(count):
            best = agree.argmax(axis=1)
            index[at : at + 512, j], loss[at : at + 512, j] = best, agree[rows, best]
            agree[rows, best] = -np.inf
    return index, loss[:, :1] - loss


def soft_keys(sums: np.ndarray) -> np.ndarray:
    """Keys (BANDS x KEYS a row) of texts with these sums: the joint indices of two segments that agree best, and the pair's number."""
    parts = sums[:, 64 * CHECK :][:, : PARTS * WIDTH].reshape(-1, WIDTH)
    index, loss = (x.reshape(len(sums), BANDS, 2, NEAREST) for x in soft_decode(parts, NEAREST))
    joint = (index[:, :, 0, :, None] << 12 | index[:, :, 1, None, :]).reshape(len(sums), BANDS, NEAREST**2)
    order = np.argsort((loss[:, :, 0, :, None] + loss[:, :, 1, None, :]).reshape(joint.shape), axis=2, kind="stable")
    best = np.take_along_axis(joint, order[:, :, :KEYS], axis=2)
    return (np.arange(BANDS)[:, None] << 24 | best).reshape(len(sums), BANDS * KEYS).astype(np.int32)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, th, bytes, fp, check0 and so on, keys): a row for each row of ``docs``; th stands for the text, fp for its
    shingle set; the checks and keys are of its long SimHash."""
    byte_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                fps, sizes = [], []
                sums = np.zeros((len(part), 64 * LENGTH), np.int32)
                for i, t in enumerate(part.column(2)):
                    data = t.as_py() or b""
                    hashes = shingle_set(data, words)
                    sizes.append(len(data))
                    fps.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0)
                    sums[i] = bit_sums(hashes)
                fps = np.array(fps, np.uint64).view(np.int64)
                checks = np.packbits(sums[:, : 64 * CHECK] > 0, axis=1).view(np.int64)
                # A text without words has no keys.
                keys = soft_keys(sums[fps != 0])
                ends = np.r_[0, np.cumsum(np.where(fps != 0, keys.shape[1], 0))].astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                columns = [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(fps), *[pa.array(checks[:, i].copy()) for i in range(CHECK)], keys]
                yield pa.record_batch(columns, names=["doc_id", "th", "bytes", "fp", *CHECKS, "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, th long, bytes long, fp long, {', '.join(f'{c} long' for c in CHECKS)}, keys array<int>")


def jaccard_links(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links (positions in ``sets``) whose components are those of all pairs with at least this Jaccard similarity."""
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(token, kind="stable")]
    n = np.bincount(token)
    stop = np.cumsum(n)
    rest, a, b = np.ones(len(sets), bool), [], []
    for start in range(len(sets)):
        if not rest[start]:
            continue
        rest[start] = False
        wave = [start]
        while wave and rest.any():
            x = wave.pop()
            own = token[ends[x] - sizes[x] : ends[x]]
            if n[own].sum() <= sizes[rest].sum():
                shared = np.bincount(np.concatenate([owner[stop[t] - n[t] : stop[t]] for t in own]), minlength=len(sets))
            else:
                shared = np.zeros(len(sets), np.int64)
                mark = np.zeros(len(n), bool)
                mark[own] = True
                for y in np.flatnonzero(rest):
                    shared[y] = np.count_nonzero(mark[token[ends[y] - sizes[y] : ends[y]]])
            found = np.flatnonzero(rest & (shared >= similarity * (sizes[x] + sizes - shared) - 1e-9))
            rest[found] = False
            a += [x] * len(found)
            b += found.tolist()
            wave += found.tolist()
    return a, b


def _verifier(words: int, similarity: float):
    """For applyInArrow over (block, fp, text): the links within a block."""

    def run(table: pa.Table) -> pa.Table:
        fps, at = np.unique(table.column("fp").to_numpy(), return_index=True)
        texts = table.column("text")
        a, b = jaccard_links([shingle_set(texts[int(i)].as_py(), words) for i in at], similarity)
        return pa.table({"a": fps[np.array(a, np.int64)], "b": fps[np.array(b, np.int64)]})

    return run


def _blocks() -> Column:
    """Number of blocks that grouped (fp, bytes) rows make."""
    return F.greatest(F.ceil(F.count("*") / F.lit(TEXTS)), F.ceil(F.sum("bytes") / F.lit(TEXT_BYTES))).cast("int")


def _compared(dealt: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links between texts that meet in a block, of rows (fp, th, doc_id, blocks); a text is fetched once and shipped to each of its blocks."""
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__h"), F.col("text").cast("binary").alias("text"))
    met = dealt.join(texts, (F.col("th") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    met = met.select(F.explode("blocks").alias("block"), "fp", "text")
    return met.groupBy("block").applyInArrow(_verifier(words, similarity), "a long, b long")


def _linked_groups(members: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links whose components are those of all pairs of similar texts within each group; ``members`` are written (group, fp, th, doc_id, bytes).

    A group is cut into blocks. Each block meets the first one; that joins nearly all of
    a group of copies, each text shipped once or, in the first block, once a block. What is left outside the
    group's largest component then meets every block, so no pair of texts of different components goes uncompared.
    """
    sizes = members.groupBy("group").agg(_blocks().alias("n"), F.count("*").alias("__n")).filter("__n > 1")
    dealt = join_hot(members, materialize(sizes, "sizes"), ["group"], F.xxhash64("fp")).filter("n is not null")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    block = lambda *parts: F.xxhash64("group", *parts)
    all_blocks = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: block(i))
    first = F.when(F.col("own") == 0, all_blocks).otherwise(F.array(block(F.col("own"))))
    edges = materialize(_compared(dealt.select("fp", "th", "doc_id", first.alias("blocks")), docs, words, similarity), "first")
    large = dealt.filter("n > 1")
    if large.isEmpty():
        return edges
    roots = components(edges).select(F.col("node").alias("fp"), "root")
    large = materialize(large.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "large")
    counts = large.groupBy("group", "root").count().groupBy("group").agg(F.max(F.struct("count", "root")).alias("most"))
    main = materialize(counts.select("group", F.col("most.root").alias("main"), F.col("most.count").alias("__n")), "main")
    rest = materialize(join_hot(large, main, ["group"], F.xxhash64("fp")).filter("root <> main").select("group", "fp", "th", "doc_id", "bytes", "n"), "rest")
    if rest.isEmpty():
        return edges
    waves = materialize(rest.groupBy("group").agg(_blocks().alias("m"), F.count("*").alias("__n")), "waves")
    own = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    outer = join_hot(rest, waves, ["group"], F.xxhash64("fp"))
    outer = outer.select("fp", "th", "doc_id", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: block(F.lit("rest"), own, j)).alias("blocks"))
    inner = join_hot(large, waves, ["group"], F.xxhash64("fp")).filter("m is not null")
    inner = inner.select("fp", "th", "doc_id", F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: block(F.lit("rest"), i, F.col("own"))).alias("blocks"))
    return edges.unionByName(_compared(outer.unionByName(inner), docs, words, similarity))


def similar_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, th, root, component_id): a row for each row of ``docs``; th is the text's xxhash64.

    Links join texts whose sets of shingles have at least this Jaccard
    similarity; root stands for the component, component_id is its smallest
    doc_id. Texts without words are one another's copies. Texts with a key of two
    softly decoded Golay segments in common, and check bits within CHECK_BITS, are
    candidates; groups of candidates are compared exactly, in pairs of blocks where
    a group is large, so no group is cut. A similarity under LEAST raises ValueError.
    """
    if similarity < LEAST:
        raise ValueError(f"the keys find texts of similarity {LEAST} or more")
    rows = materialize(_sets(docs, words), "sets")
    least, one = F.min("doc_id").alias("least"), F.min(F.struct("th", "doc_id", "bytes")).alias("one")
    nodes = rows.groupBy("fp").agg(least, one, *[F.first(c).alias(c) for c in (*CHECKS, "keys")])
    nodes = materialize(nodes, "nodes")
    groups = components(_verified(nodes.select(F.explode("keys").alias("key"), *CHECKS), CHECK_BITS, BLOCK))
    groups = groups.select(F.col("node").alias("check0"), F.col("root").alias("group"))
    # Sets with the same check bits are one node of the links, so they share a group also where nothing links it.
    members = nodes.select("check0", "fp", "one.*").join(groups, "check0", "left").withColumn("group", F.coalesce("group", "check0"))
    members = materialize(members.select("group", "fp", "th", "doc_id", "bytes"), "members")
    roots = components(_linked_groups(members, docs, words, similarity)).select(F.col("node").alias("fp"), "root")
    nodes = _component_ids(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    return rows.select("doc_id", "th", "fp").join(nodes, "fp").select("doc_id", "th", "root", "component_id")


def _component_ids(nodes: DataFrame) -> DataFrame:
    """(fp, root, component_id) of nodes (fp, least, root); a component that has very many nodes is no single task."""
    nodes = materialize(nodes, "rooted")
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("__n"))
    return join_hot(nodes, materialize(ids, "ids"), ["root"], F.xxhash64("fp")).select("fp", "root", "component_id")


def one_of_each(docs: DataFrame, words: int = 4, max_bits: int = MAX_BITS, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` that stay if each component keeps its smallest doc_id.

    Components are those of :func:`similar_texts` if a ``similarity`` is given, and of :func:`near_duplicates` if not.
    Each row is judged by the component of its own text, also where texts share a doc_id. Rows of one component
    that share this doc_id are one document: one of them stays (the
    smallest by all columns). Rows without a doc_id can't be told apart and stay.
    """
    found = _grouped(docs, words, max_bits) if similarity is None else similar_texts(docs, words, similarity)
    kept = found.filter("doc_id = component_id").groupBy("doc_id", "root", "th").agg(F.count("*").alias("__m"))
    rows_of = kept.groupBy("doc_id", "root").agg(F.sum("__m").alias("__n"))
    kept = kept.join(rows_of, ["doc_id", "root"]).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("root").alias("__root"), "__n")
    rows = docs.withColumn("__h", F.xxhash64("text"))
    rows = rows.join(kept, (F.col("doc_id") == F.col("__id")) & (F.col("__h") == F.col("__th")))
    once = rows.filter("__n = 1").select(*docs.columns)
    whole = F.struct(*[F.col(c) for c in docs.columns])
    again = rows.filter("__n > 1").groupBy("__id", "__root").agg(F.min(whole).alias("__row")).select("__row.*")
    return once.unionByName(again).unionByName(docs.filter(F.col("doc_id").isNull()))
