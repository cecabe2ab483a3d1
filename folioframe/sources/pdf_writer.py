"""PDF files written from texts and pixels: a sink for results, and what the reader is held against."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pdf_objects import PADDING, Ref, Security, aes_encrypt, object_key, rc4

#: Size of the letters and distance of the lines in points, lines a page.
SIZE, LEADING, LINES = 10, 14, 50
#: Bytes of files that a batch holds, unless one file has more.
HELD = 4 << 20


@dataclass(frozen=True)
class Locked:
    """Encryption: revision 2 (RC4, 40 bits), 3 (RC4, 128 bits) or 4 (AES, 128 bits)."""

    user: str
    owner: str
    revision: int = 4


class _Writer:
    def __init__(self, packed: bool, locked: Locked | None, file_id: bytes):
        self.packed, self.objects, self.locked, self.file_id, self.key = packed, [], locked, file_id, None
        if locked:
            size, blank = (5 if locked.revision == 2 else 16), Security(locked.revision, 0, b"", b"", -4, file_id)
            owner = blank._replace(size=size).owner_entry(locked.owner.encode("latin-1"), locked.user.encode("latin-1"))
            self.security = Security(locked.revision, size, owner, b"", -4, file_id)
            self.key = self.security.key(locked.user.encode("latin-1"))

    def add(self, about: bytes, stream: bytes | None = None) -> int:
        """The number of a new object; strings in it are written as {text}."""
        self.objects.append((about, stream))
        return len(self.objects)

    def _with_strings(self, about: bytes, number: int | None) -> bytes:
        seal = lambda m: b"<%s>" % (m[1] if number is None else self._sealed(m[1], number)).hex().encode()
        return re.sub(rb"\{([^}]*)\}", seal, about)

    def _sealed(self, data: bytes, number: int) -> bytes:
        if self.key is None:
            return data
        aes = self.locked.revision == 4
        key = object_key(self.key, Ref(number, 0), aes)
        return aes_encrypt(key, data, zlib.crc32(data).to_bytes(4, "big") * 4) if aes else rc4(key, data)

    def _body(self, number: int, about: bytes, stream: bytes | None) -> bytes:
        about = self._with_strings(about, number)
        if stream is None:
            return b"%d 0 obj\n%s\nendobj\n" % (number, about)
        data = self._sealed(stream, number)
        return b"%d 0 obj\n<<%s/Length %d>>\nstream\n%s\nendstream\nendobj\n" % (number, about, len(data), data)

    def _encrypt(self) -> bytes:
        revision = self.locked.revision
        user = self.security.user_entry(self.key)
        user = user if revision == 2 else user + PADDING[:16]
        kind = {2: b"/V 1", 3: b"/V 2/Length 128", 4: b"/V 4/Length 128/CF<</StdCF<</CFM/AESV2/Length 16>>>>/StmF/StdCF/StrF/StdCF"}[revision]
        return b"<</Filter/Standard/R %d%s/O<%s>/U<%s>/P -4>>" % (revision, kind, self.security.owner.hex().encode(), user.hex().encode())

    def file(self, root: int) -> bytes:
        """The file; ``packed``: objects without streams in an object stream, cross references as a stream."""
        out, places, inner = [b"%PDF-1.6\n%\xe2\xe3\xcf\xd3\n"], {}, []
        at = len(out[0])

        def put(number: int, body: bytes) -> None:
            nonlocal at
            places[number] = (1, at, 0)
            out.append(body)
            at += len(body)

        for number, (about, stream) in enumerate(self.objects, 1):
            if self.packed and stream is None:
                inner.append((number, about))
            else:
                put(number, self._body(number, about, stream))
        size = len(self.objects) + 1
        if inner:
            head, body = b"", b""
            for number, about in inner:
                head += b"%d %d " % (number, len(body))
                body += self._with_strings(about, None) + b"\n"
            places |= {number: (2, size, i) for i, (number, _) in enumerate(inner)}
            put(size, self._body(size, b"/Type/ObjStm/N %d/First %d/Filter/FlateDecode" % (len(inner), len(head)), zlib.compress(head + body)))
            size += 1
        more = b"/Root %d 0 R/ID[<%s><%s>]" % (root, self.file_id.hex().encode(), self.file_id.hex().encode())
        if self.locked:
            put(size, b"%d 0 obj\n%s\nendobj\n" % (size, self._encrypt()))
            more += b"/Encrypt %d 0 R" % size
            size += 1
        start = at
        if self.packed:
            places[size] = (1, at, 0)
            rows = b"".join(b"%c%s%s" % (k, p.to_bytes(4, "big"), i.to_bytes(2, "big")) for k, p, i in [(0, 0, 0), *(places[n] for n in range(1, size + 1))])
            lines = np.frombuffer(rows, np.uint8).reshape(-1, 7)
            up = np.c_[np.full(len(lines), 2, np.uint8), lines - np.r_[np.zeros((1, 7), np.uint8), lines[:-1]]]  # the filter that takes the row above away
            data = zlib.compress(up.astype(np.uint8).tobytes())
            about = b"/Type/XRef/Size %d/W[1 4 2]/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 7>>%s/Length %d" % (size + 1, more, len(data))
            out.append(b"%d 0 obj\n<<%s>>\nstream\n%s\nendstream\nendobj\n" % (size, about, data))
        else:
            table = b"".join(b"%010d %05d n \n" % (places[n][1], 0) for n in range(1, size))
            out.append(b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<</Size %d%s>>\n" % (size, table, size, more))
        out.append(b"startxref\n%d\n%%%%EOF\n" % start)
        return b"".join(out)


def _literal(data: bytes) -> bytes:
    return b"(" + data.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def _unicode_map(chars: list[str]) -> bytes:
    lines = [b"<%04X> <%s>" % (i, c.encode("utf-16-be").hex().encode()) for i, c in enumerate(chars, 1)]
    blocks = [b"%d beginbfchar\n%s\nendbfchar" % (len(lines[i : i + 100]), b"\n".join(lines[i : i + 100])) for i in range(0, len(lines), 100)]
    return b"begincmap\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n" + b"\n".join(blocks) + b"\nendcmap"


def text_pdf(text: str, number: int = 0, locked: Locked | None = None, image: np.ndarray | None = None) -> bytes:
    """A file with the lines of ``text``, LINES a page; ``number`` chooses how it is written.

    Odd numbers pack objects; every eighth sets its words with kerns instead of spaces, every sixteenth places each word
    for itself. Texts beyond Windows' Latin letters get a font of two-byte codes. ``image`` (height, width, 3) goes on the first page.
    """
    out = _Writer(number % 2 == 1, locked, number.to_bytes(16, "big", signed=True))
    lines = text.split("\n")
    try:
        text.encode("cp1252")
        code, chars = (lambda s: _literal(s.encode("cp1252"))), []
        font = out.add(b"<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding/WinAnsiEncoding>>")
    except UnicodeEncodeError:
        chars = sorted(set(text) - {"\n"})
        codes = {c: i for i, c in enumerate(chars, 1)}
        code = lambda s: b"<" + b"".join(b"%04X" % codes[c] for c in s) + b">"
        names = out.add(b"/Filter/FlateDecode", zlib.compress(_unicode_map(chars)))
        below = out.add(b"<</Type/Font/Subtype/CIDFontType2/BaseFont/Wide/CIDSystemInfo<</Registry{Adobe}/Ordering{Identity}/Supplement 0>>/DW 600>>")
        font = out.add(b"<</Type/Font/Subtype/Type0/BaseFont/Wide/Encoding/Identity-H/DescendantFonts[%d 0 R]/ToUnicode %d 0 R>>" % (below, names))
    picture = b""
    if image is not None:
        high, wide = image.shape[:2]
        filters = [b"/Filter/FlateDecode", b"/Filter[/ASCII85Decode/FlateDecode]", b"/Filter/FlateDecode/DecodeParms<</Predictor 15/Colors 3/Columns %d>>" % wide][number % 3]
        rows = image.reshape(high, -1)
        if number % 3 == 2:
            left = rows - np.c_[np.zeros((high, 3), np.uint8), rows[:, :-3]]
            rows = np.c_[np.ones(high, np.uint8), left]
        data = zlib.compress(rows.astype(np.uint8).tobytes())
        if number % 3 == 1:
            import base64

            data = base64.a85encode(data) + b"~>"
        picture = b"/XObject<</Im1 %d 0 R>>" % out.add(b"/Type/XObject/Subtype/Image/Width %d/Height %d/ColorSpace/DeviceRGB/BitsPerComponent 8%s" % (wide, high, filters), data)
    kids, tree = [], len(out.objects) + 2 * max(1, -(-len(lines) // LINES)) + 1
    for at in range(0, max(1, len(lines)), LINES):
        ops = [b"BT /F1 %d Tf %d TL 36 %d Td" % (SIZE, LEADING, 792 - 36)]
        for i, line in enumerate(lines[at : at + LINES]):
            words = line.split(" ")
            if number % 8 == 0:
                ops.append(b"[%s] TJ T*" % b" -600 ".join(code(w) for w in words if w))
            elif number % 16 == 1:
                x = 36.0
                for word in words:
                    if word:
                        ops.append(b"1 0 0 1 %.3f %d Tm %s Tj" % (x, 792 - 36 - LEADING * i, code(word)))
                    x += 0.6 * SIZE * (len(word) + 1)
            else:
                ops.append(b"%s Tj T*" % code(line))
        content = out.add(b"/Filter/FlateDecode", zlib.compress(b"\n".join([*ops, b"ET"])))
        kids.append(out.add(b"<</Type/Page/Parent %d 0 R/Contents %d 0 R/Resources<</Font<</F1 %d 0 R>>%s>>>>" % (tree, content, font, picture)))
        picture = b""
    pages = out.add(b"<</Type/Pages/MediaBox[0 0 612 792]/Count %d/Kids[%s]>>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids)))
    return out.file(out.add(b"<</Type/Catalog/Pages %d 0 R>>" % pages))


def image_of_bytes(data: bytes, wide: int = 64) -> np.ndarray:
    """(height, wide, 3): bytes as pixels, filled with zeros."""
    n = max(1, -(-len(data) // (3 * wide)))
    return np.frombuffer(data.ljust(3 * wide * n, b"\0"), np.uint8).reshape(n, wide, 3)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key, to three tasks a core and four an input split at least: a table's few row groups would
    leave most cores without work that takes a millisecond and more a row."""
    return rows.repartition(max(3 * rows.sparkSession.sparkContext.defaultParallelism, 4 * rows.rdd.getNumPartitions()), key)


def text_files(texts: DataFrame, locked: Callable[[int], Locked | None] | None = None, with_image: bool = False) -> DataFrame:
    """(path, content) of (number, text): a PDF for each text; with ``with_image`` its bytes are an image on the first page too.

    ``locked`` gives the passwords by number. Null texts are empty.
    """
    kind = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, held = [], 0
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                plain = text.as_py() or ""
                image = image_of_bytes(plain.encode()) if with_image else None
                done.append({"path": f"{number}.pdf", "content": text_pdf(plain, number, locked(number) if locked else None, image)})
                held += len(done[-1]["content"])
                if held > HELD:
                    yield pa.RecordBatch.from_pylist(done, kind)
                    done, held = [], 0
            yield pa.RecordBatch.from_pylist(done, kind)

    return dealt(texts.select(F.col("number").cast("long").alias("number"), "text"), "number").mapInArrow(run, "path string, content binary")
