"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenization takes, at each place of a word, the longest
vocabulary entry that starts there. The automaton is a trie of the vocabulary
with failure links: where a node has no edge for the next byte, the pieces
that are certain by then are popped and the walk goes on from the failure
node. Each node holds how many pieces its link pops, so a word is counted in
one pass over its bytes and no piece is ever built.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a worker remembers at a time.
REMEMBERED = 500_000
#: Bytes of text that are cut into words at a time.
CHUNK = 1 << 20

_COUNTERS: dict[str, _Counter] = {}


class Automaton:
    """Counts greedy longest-match pieces of a byte string; entries are byte strings.

    A byte that no entry starts with counts as a piece of its own.
    """

    def __init__(self, entries: Iterable[bytes]):
        vocabulary = {x for x in entries if x} | {bytes([b]) for b in range(256)}
        edges: list[dict[int, int]] = [{}]
        ends = {0: False}
        for entry in vocabulary:
            at = 0
            for byte in entry:
                to = edges[at].get(byte)
                if to is None:
                    to = edges[at][byte] = len(edges)
                    edges.append({})
                    ends[to] = False
                at = to
            ends[at] = True
        #: Failure node (-1: none) and the pieces that are popped on the way to it.
        fail, popped = [-1] * len(edges), [0] * len(edges)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in edges[parent].items():
                queue.append(node)
                if ends[node]:  # the whole string is one piece
                    fail[node], popped[node] = 0, 1
                    continue
                z, n = fail[parent], popped[parent]
                while z >= 0 and byte not in edges[z]:
                    n += popped[z]
                    z = fail[z]
                if z >= 0:
                    fail[node], popped[node] = edges[z][byte], n
        self.edges, self.fail, self.popped = edges, fail, popped

    def count(self, word: bytes) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        at = n = 0
        for byte in word:
            to = edges[at].get(byte)
            while to is None:
                n += popped[at]
                at = fail[at]
                to = edges[at].get(byte)
            at = to
        while at > 0:
            n += popped[at]
            at = fail[at]
        return n


class _Counter(dict):
    """Pieces of a word by its bytes; a word is counted once while it is remembered."""

    def __init__(self, vocabulary: str):
        self.automaton = Automaton(read_vocabulary(vocabulary))

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = self.automaton.count(b" " + word)
        return found

    def text(self, data: bytes) -> tuple[int, int]:
        words = n = at = 0
        while at < len(data):
            end = at + CHUNK
            while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            run = data[at:end].split()
            words += len(run)
            n += sum(map(self.__getitem__, run))
            at = end
        return words, n


def read_vocabulary(path: str) -> list[bytes]:
    """Entries of a vocabulary of lines: an entry in base64, a space, its rank."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def counter(vocabulary: str) -> _Counter:
    if vocabulary not in _COUNTERS:
        _COUNTERS[vocabulary] = _Counter(vocabulary)
    return _COUNTERS[vocabulary]


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens): a row for each row of ``docs``.

    A word is a run of bytes other than ASCII white space and is matched with
    one space before it, as the vocabulary marks the first piece of a word by
    a leading space; later pieces have none. n_tokens is the number of greedy
    longest-match pieces of all words of the whole text. Null and empty texts
    have none. Single bytes are always entries, so no word is unknown.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(vocabulary).text
        for batch in batches:
            found = np.array([of(t.as_py() or b"") for t in batch.column(1)], np.int64).reshape(-1, 2)
            yield pa.record_batch([batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
