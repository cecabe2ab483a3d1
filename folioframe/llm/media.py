"""Interleaved document sequences with media columns.

An HTML document is parsed to one ordered array of structs: text runs and
media references, each with its position, a reference with its caption. Media
lie in a table of their own under the SHA-256 of the stored bytes; references
find them by an equi-join on that digest, which carries what the bytes hold and
not the bytes; a task describes a payload that it has met before only once, and
positions and captions stay with the reference. Payloads are stored as PNG images of 8-bit RGB samples, 64 pixels
(192 bytes) a row, without loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize

#: Bytes a payload is a multiple of: a row of 64 RGB pixels.
ROW = 192
LEVEL = 1
#: References on a page, and digests that a task remembers.
REFERENCES, REMEMBERED = 4, 100_000
SCHEME = "sha256:"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"

# ---- PNG ------------------------------------------------------------------------------


def padded(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of ROW."""
    return text + b" " * (-len(text) % ROW if text else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """The payload's bytes as the samples of an RGB image, 64 pixels wide, rows without filter."""
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    header = struct.pack(">IIBBBBB", ROW // 3, height, 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples (height, width * 3) of an image that :func:`to_png` wrote; ValueError for other bytes."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, size, body = 8, (0, 0), []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", part)
            if (depth, colour) != (8, 2):
                raise ValueError("not 8-bit RGB")
            size = (height, width * 3)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[0], size[1] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Mean and deviation of each channel and a 16-bin histogram of all samples, as text."""
    pixels = samples.reshape(-1, 3)
    counts = np.bincount(pixels.reshape(-1) >> 4, minlength=16)
    total = pixels.sum(axis=0, dtype=np.int64)
    square = np.array([int((c.astype(np.int64) ** 2).sum()) for c in pixels.T])
    mean = total / len(pixels)
    sd = np.sqrt(np.maximum(square / len(pixels) - mean**2, 0))
    return "mean=" + ",".join(f"{x:.4f}" for x in mean) + ";sd=" + ",".join(f"{x:.4f}" for x in sd) + ";hist=" + ",".join(map(str, counts))


# ---- HTML -------------------------------------------------------------------------------

SEQUENCE = "array<struct<pos: int, kind: string, text: string, ref: string, caption: string>>"
_HIDDEN = {"script", "style", "template", "noscript", "title", "head"}
_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "article", "section", "figure", "figcaption", "blockquote", "pre", "nav", "header", "footer", "hr"}


class _Parser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.out.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        if tag in _BLOCKS:
            self.flush() if self.caption is None else self.caption.append(" ")
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("img", "video", "audio", "source") and not self.hidden:
            known = dict(attrs)
            if known.get("src"):
                self.flush()
                self.out.append({"kind": "media", "text": None, "ref": known["src"], "caption": known.get("alt") or None})
                if self.figure is not None:
                    self.figure.append(self.out[-1])

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            if self.figure and text:
                for ref in self.figure:
                    ref["caption"] = text
            elif text:  # no reference to stand with: it is text
                self.words.append(text)
                self.flush()
        elif tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def parse_html(source: str | None) -> list[dict]:
    """Text runs and media references of an HTML text in their order; a figure's caption goes to its references."""
    parser = _Parser()
    parser.feed(source or "")
    parser.close()
    if parser.caption is not None:
        parser.words.append("".join(parser.caption))
    parser.flush()
    return [{"pos": i, **x} for i, x in enumerate(parser.out)]


def sequences(pages: DataFrame, key: str, column: str = "html") -> DataFrame:
    """(key, seq): the parsed sequence of each row; null and empty HTML has an empty one."""
    kind = pages.schema[key].dataType.simpleString()
    item = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [parse_html(x.as_py()) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(seqs, pa.list_(item))], names=[key, "seq"])

    return pages.select(key, column).mapInArrow(run, f"`{key}` {kind}, seq {SEQUENCE}")


def resolved(seqs: DataFrame, key: str, media: DataFrame) -> DataFrame:
    """A row for each item of each sequence: key, pos, kind, text, ref, caption, and the columns of ``media`` by ref = digest.

    ``media`` has one row a digest. References to nothing keep nulls, so
    positions and captions stay aligned whatever is found. Columns of ``media`` with the names of items' columns are left out.
    """
    items = materialize(seqs.select(key, F.explode("seq").alias("i")).select(key, "i.*"), "items")
    wanted = items.filter("ref is not null").groupBy("ref").agg(F.count("*").alias("__n"))
    about = media.select(F.col("digest").alias("ref"), *[c for c in media.columns if c not in ("digest", *items.columns)])
    # A payload that very many references share would bring them all together: such facts are few and broadcast.
    return join_hot(items, materialize(about.join(wanted, "ref"), "wanted"), ["ref"], spread=F.xxhash64("pos", key))


# ---- documents as media -------------------------------------------------------------


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digest, media): each whole text's bytes, padded, as a stored image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                texts = [t.as_py() or b"" for t in part.column(1)]
                images = [to_png(padded(t)) for t in texts]
                digests = [SCHEME + hashlib.sha256(x).hexdigest() for x in images]
                columns = [part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(digests, pa.string()), pa.array(images, pa.binary())]
                yield pa.record_batch(columns, names=["doc_id", "n_bytes", "digest", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return materialize(rows.mapInArrow(run, "doc_id long, n_bytes long, digest string, media binary"), "media")


FACTS = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(stored: DataFrame) -> DataFrame:
    """One row a digest with what its stored bytes hold, read back and decoded where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()  # what this task has described already; REMEMBERED at most
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest in known:
                    continue
                if len(known) >= REMEMBERED:
                    known.clear()
                known.add(digest)
                data = media.as_py()
                samples = from_png(data)
                payload = samples.tobytes()
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            names = [x.split()[0] for x in FACTS.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    facts = stored.select("digest", "media").mapInArrow(run, FACTS)
    names = [c for c in facts.columns if c != "digest"]
    return facts.groupBy("digest").agg(*[F.min(c).alias(c) for c in names])


def _title(doc: Column) -> Column:
    return F.concat(F.lit("Document "), F.coalesce(doc["doc_id"].cast("string"), F.lit("without id")), F.lit(" of "), doc["n_bytes"].cast("string"), F.lit(" bytes"))


def pages_of(stored: DataFrame) -> DataFrame:
    """(docs, html): pages of REFERENCES stored documents each, in the order in which they are stored.

    A page has a paragraph and a captioned figure for each of its documents, which docs lists in the same order.
    """
    place = stored.select("doc_id", "n_bytes", "digest", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    pages = place.groupBy("file", F.floor(F.col("row") / REFERENCES).alias("page"))
    pages = pages.agg(F.sort_array(F.collect_list(F.struct("row", "doc_id", "n_bytes", "digest"))).alias("docs"))
    figure = lambda d: F.concat(
        F.lit("<p>Text of "), _title(d), F.lit('</p><figure><img src="'), d["digest"], F.lit('"><figcaption>'), _title(d), F.lit("</figcaption></figure>")
    )
    return pages.select("docs", F.concat(F.lit("<article>"), F.array_join(F.transform("docs", figure), ""), F.lit("</article>")).alias("html"))


def documents_as_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pos, caption).

    Each whole text becomes an image in the store; pages refer to several of
    them by digest, between paragraphs. The pages are parsed and the references resolved. Null
    texts are empty and become one row of spaces. Equal texts share a digest
    and all values but pos and caption; equal rows give equal rows but for pos; a null doc_id stays null.
    """
    stored = store_texts(docs)
    seqs = sequences(pages_of(stored).select(F.col("docs").alias("page"), "html"), "page")
    items = resolved(seqs, "page", described(stored)).filter("kind = 'media'")
    doc = F.get("page", F.floor(F.col("pos") / 2).cast("int"))  # paragraphs and references take turns
    facts = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return items.select(doc["doc_id"].alias("doc_id"), doc["n_bytes"].alias("n_bytes"), *facts, "pos", "caption")
