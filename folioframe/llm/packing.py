"""Best-fit packing by minimum bin slack.

A bin takes the longest piece left and the subset of the others that fills the
rest fullest, found by subset-sum dynamic programming on a bitset over the
available lengths. Only lengths matter for this, and there are at most as many
as the capacity, so the plan is made from the counts of the lengths: each
chosen combination is repeated while the counts allow, which uses up at least
one length. The plan has a bounded size whatever the number of documents;
pieces then find their bins by their rank among the pieces of their length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 2048
#: Id that ends each document.
END_ID = 0
#: Words whose ids a worker remembers at a time.
REMEMBERED = 400_000
#: Groups that the pieces of one length are ranked in.
RANK_GROUPS = 1024

# ---- ids ------------------------------------------------------------------------------

_ENCODERS: dict[str, _Encoder] = {}
_DOUBLE_SPACE = re.compile(r"\s\s")
#: The vocabulary's special token, which has an id of its own after the ranks.
SPECIAL = "<|endoftext|>"


class _Encoder(dict):
    """Ids (little-endian, 4 bytes each) of a text by a byte-level BPE vocabulary.

    Where no two white-space characters meet, a text is cut before every space
    and around every line feed: no token of the vocabulary's pattern crosses
    such a cut, so the ids of the parts are remembered and joined.
    """

    def __init__(self, ranks: str):
        import public_tokenizers
        import tiktoken

        lines = (x.split() for x in open(ranks, "rb"))
        merges = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.encode = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.line_feed = self.ids("\n")
        self.special = np.array([len(merges)], "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = self.ids(" " + word)
        return found

    def text_ids(self, text: str) -> bytes:
        if _DOUBLE_SPACE.search(text):
            return self.ids(text)
        lines = []
        for line in text.split("\n"):
            head, *words = line.split(" ")
            lines.append((self.ids(head) if head else b"") + b"".join([self[w] for w in words]))
        return self.line_feed.join(lines)

    def document_ids(self, text: str) -> bytes:
        """The ids of a text in which the special token is one id, as the tokenizer library gives them."""
        return self.special.join([self.text_ids(part) if part else b"" for part in text.split(SPECIAL)])


def encoder(ranks: str) -> _Encoder:
    if ranks not in _ENCODERS:
        _ENCODERS[ranks] = _Encoder(ranks)
    return _ENCODERS[ranks]


def default_ranks() -> str:
    """The ranks of the vocabulary byte_bpe_50k.json; both give the same ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, ranks: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids, the end id last, in pieces of at most ``capacity``.

    All pieces of a document but its first have ``capacity`` ids. Null texts
    are empty: their one piece is the end id. A null doc_id stays null.
    """
    ranks = ranks or default_ranks()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(ranks).document_ids
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py() or "") + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    to = first if not k else at + capacity
                    part = ids[4 * at : 4 * to]
                    rows.append((doc, k, at, to - at, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


# ---- the plan -------------------------------------------------------------------------


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length fill ``room`` fullest; long ones first.

    ``reach`` has bit s set if some combination has the sum s; a length's count
    goes in as powers of two, so each step is one shift.
    """
    full, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            n = min(take, left)
            more = (reach | reach << n * length) & full
            if more != reach:
                steps.append((length, n, reach))
                reach = more
            left, take = left - n, take * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + n
            at -= n * length
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, pieces of each length in such a bin) until no piece is left."""
    counts, bins = {x: n for x, n in counts.items() if n}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = fullest({x: n for x, n in counts.items() if n}, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in used.items())
        for x, n in used.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        bins.append((times, used))
    return bins


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset: the bin, and the place in it, gapless from 0.

    ``found`` must give the same rows whenever it is read (a written table):
    pieces of a length are ranked by doc_id, start and content. Ties and equal
    rows get bins of their own. No pieces, no bins. Only the counts of the
    lengths, ``capacity`` at most, reach the driver.
    """
    spark = found.sparkSession
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    rows, bin_no = [], 0
    taken: dict[int, int] = {}
    for times, used in plan(counts, capacity):
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            at = taken.get(length, 0)
            rows.append((length, at, at + n * times, n, bin_no, offset))
            taken[length] = at + n * times
            offset += n * length
        bin_no += times
    # A row of the plan serves the ranks from first to last of a length, n in a row to each bin. A length's rows are one array.
    by_length: dict[int, list[tuple]] = {}
    for length, *rest in rows:
        by_length.setdefault(length, []).append(tuple(rest))
    shape = "length long, slots array<struct<first: long, last: long, n: long, bin: long, offset: long>>"
    slots = spark.createDataFrame([(k, v) for k, v in by_length.items()], shape)

    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(RANK_GROUPS)).cast("int")
    dealt = found.withColumn("__group", group)
    sizes = dealt.groupBy("length", "__group").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__group").orderBy("doc_id", "start", "piece", "ids_crc32")
    ranked = dealt.withColumn("__rank", F.row_number().over(inside) - 1).join(starts, ["length", "__group"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before")).join(F.broadcast(slots), "length")
    slot = F.element_at(F.filter("slots", lambda s: (s["first"] <= F.col("__rank")) & (F.col("__rank") < s["last"])), 1)
    ranked = ranked.withColumn("__slot", slot).withColumn("__at", F.col("__rank") - F.col("__slot.first"))
    sequence = F.col("__slot.bin") + F.expr("__at div __slot.n")
    offset = F.col("__slot.offset") + F.col("__at") % F.col("__slot.n") * F.col("length")
    return ranked.select(*found.columns, sequence.alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(docs: DataFrame, ranks: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Cut documents into pieces of ids and pack these into as few sequences of ``capacity`` as minimum bin slack finds."""
    return pack(materialize(pieces(docs, ranks, capacity, with_ids), "pieces"), capacity)
