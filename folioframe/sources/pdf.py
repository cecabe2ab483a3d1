"""PDF files as tables: pages with their text elements, rows of text, images.

Files come as (path, content), as Spark's ``binaryFile`` source reads them from
any file system it knows, or as a column of any table. A file is one task's
work; what is not asked for is not decoded: a list of pages reaches
the reader, so other pages' streams stay as they are. Files that can't be read are rows with an error. Rows of
text are made of elements by windows over a page.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pixels
from .pdf_objects import Document, Lexer, Name, PdfError, Stream, Word

ELEMENT = "struct<text:string,x:double,y:double,w:double,h:double,font:string>"
PAGE = f"path string, page int, page_w double, page_h double, elements array<{ELEMENT}>, error string"
IMAGE = "path string, page int, name string, width int, height int, channels int, format string, data binary, error string"
# The page size of files that state none.
LETTER = (0, 0, 612, 792)
UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
UPRIGHT = UNIT[:4]
# The width of all characters of the fixed-pitch standard fonts, in thousandths of the size.
COURIER = 600.0
# Encodings that a font may name, as the library calls them; glyph names that are no letters.
ENCODINGS = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}
GLYPHS = {"space": " ", "period": ".", "comma": ",", "hyphen": "-", "colon": ":", "semicolon": ";", "parenleft": "(", "parenright": ")", "quotesingle": "'", "quotedbl": '"', "slash": "/"}
GLYPHS |= {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _times(m: Sequence[float], n: Sequence[float]) -> tuple[float, ...]:
    """The transformation ``m``, then ``n``."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


class Font:
    """Characters and widths of the codes of a string."""

    def __init__(self, doc: Document, about: dict):
        get = lambda name, kind, other: v if isinstance(v := doc.get(about.get(name)), kind) else other
        self.name = str(get("BaseFont", str, ""))
        self.size = 2 if get("Subtype", str, "") == "Type0" else 1
        self.widths: dict[int, float] = {}
        self.other = COURIER if "Courier" in self.name else 500.0
        self.chars: dict[int, str] = {}
        self.codec = ""  # where one encoding says it all
        if self.size == 2:
            below = doc.get((get("DescendantFonts", list, None) or [{}])[0]) or {}
            self.other = float(doc.get(below.get("DW")) or 1000)
            self._wide(doc, doc.get(below.get("W")) or [])
        else:
            encoding = get("Encoding", (str, dict), "")
            base = encoding if isinstance(encoding, str) else doc.get(encoding.get("BaseEncoding")) or ""
            self.codec = ENCODINGS.get(base, "latin-1")
            if isinstance(encoding, dict) or "ToUnicode" in about:
                self.chars = {c: x for c, x in enumerate(bytes(range(256)).decode(self.codec, "replace")) if ord(x) != c}
                self.codec = ""
                self._differences((doc.get(encoding.get("Differences")) if isinstance(encoding, dict) else None) or [])
            first = get("FirstChar", int, 0)
            self.widths = {first + i: float(doc.get(w) or 0) for i, w in enumerate(get("Widths", list, []))}
        if isinstance(unicode := doc.get(about.get("ToUnicode")), Stream):
            self._read_map(doc.decoded(unicode)[0])

    def _wide(self, doc: Document, items: list) -> None:
        at = 0
        while at + 1 < len(items):
            first, second = items[at], doc.get(items[at + 1])
            if isinstance(second, list):
                self.widths |= {first + i: float(w) for i, w in enumerate(second)}
                at += 2
            else:
                self.widths |= dict.fromkeys(range(first, second + 1), float(items[at + 2]))
                at += 3

    def _differences(self, items: list) -> None:
        code = 0
        for item in items:
            if isinstance(item, int):
                code = item
                continue
            if item.startswith("uni") and len(item) == 7:
                self.chars[code] = chr(int(item[3:], 16))
            elif len(item) == 1 or item in GLYPHS:
                self.chars[code] = GLYPHS.get(item, item)
            code += 1

    def _read_map(self, data: bytes) -> None:
        number = lambda b: int.from_bytes(b, "big")
        text = lambda b: b.decode("utf-16-be", "replace")
        lexer, held = Lexer(data), []
        while (v := lexer.value()) is not None:
            if not isinstance(v, Word):
                held.append(v)
                continue
            if v == b"endbfchar":
                self.chars |= {number(a): text(b) for a, b in zip(held[::2], held[1::2], strict=False)}
            elif v == b"endbfrange":
                for low, high, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                    for i, code in enumerate(range(number(low), number(high) + 1)):
                        if isinstance(to, list):
                            self.chars[code] = text(to[i]) if i < len(to) else ""
                        else:
                            self.chars[code] = text(to[:-2]) + chr(number(to[-2:]) + i)
            elif v == b"begincodespacerange":
                held = []
                continue
            elif v == b"endcodespacerange" and held and isinstance(held[0], bytes):
                self.size = len(held[0])
            held = []

    def read(self, codes: bytes) -> tuple[str, float, int, int]:
        """The characters of a string's codes, their width in thousandths, how many they are, and how many are the one-byte space."""
        n = self.size
        numbers = codes if n == 1 else [int.from_bytes(codes[i : i + n], "big") for i in range(0, len(codes), n)]
        if self.codec:
            text = codes.decode(self.codec, "replace")
        elif n == 1:
            text = codes.decode("latin-1").translate(self.chars)
        else:
            text = "".join([self.chars.get(c, "\ufffd") for c in numbers])
        width = sum([self.widths.get(c, self.other) for c in numbers]) if self.widths else self.other * len(numbers)
        return text, width, len(numbers), codes.count(b" ") if n == 1 else 0


class _Page:
    """The text elements of a page: what one operator shows, with its box."""

    def __init__(self, doc: Document, page: dict):
        self.doc, self.elements, self.fonts = doc, [], {}
        contents = doc.get(page.get("Contents"))
        parts = contents if isinstance(contents, list) else [contents]
        data = b"\n".join(doc.decoded(s)[0] for s in map(doc.get, parts) if isinstance(s, Stream))
        self.run(data, doc.get(page.get("Resources")) or {}, UNIT, 0)

    def font(self, resources: dict, name: Name) -> Font:
        ref = (self.doc.get(resources.get("Font")) or {}).get(name)
        key = repr(ref) if ref is not None else name
        if key not in self.fonts:
            found = self.doc.get(ref)
            self.fonts[key] = Font(self.doc, found if isinstance(found, dict) else {})
        return self.fonts[key]

    def run(self, data: bytes, resources: dict, matrix: Sequence[float], depth: int) -> None:
        state: dict[str, Any] = {"m": matrix, "font": None, "size": 0.0, "Tc": 0.0, "Tw": 0.0, "Tz": 100.0, "TL": 0.0, "Ts": 0.0}
        saved, line, at = [], UNIT, UNIT
        lexer, held = Lexer(data, references=False), []

        def show(items: list) -> None:
            nonlocal at
            font, size, stretch = state["font"], state["size"], state["Tz"] / 100
            if font is None:
                return
            text, along = [], 0.0
            for item in items:
                if isinstance(item, (int, float)):
                    gap = -item / 1000 * size
                    if gap > 0.2 * size and text and text[-1][-1:] != " ":
                        text.append(" ")
                    along += gap * stretch
                elif isinstance(item, bytes):
                    part, width, n, spaces = font.read(item)
                    text.append(part)
                    along += (width / 1000 * size + n * state["Tc"] + spaces * state["Tw"]) * stretch
            whole = at if state["m"] == UNIT else _times(at, state["m"])
            scale, high = along, size
            if whole[:4] != UPRIGHT:
                scale, high = along * (whole[0] ** 2 + whole[1] ** 2) ** 0.5, size * (whole[2] ** 2 + whole[3] ** 2) ** 0.5
            if any(text):
                y = whole[5] + state["Ts"] * whole[3]
                self.elements.append({"text": "".join(text), "x": float(whole[4]), "y": float(y), "w": float(scale), "h": abs(high), "font": font.name})
            at = (*at[:4], along * at[0] + at[4], along * at[1] + at[5])

        def next_line(x: float, y: float) -> None:
            nonlocal line, at
            a, b, c, d, e, f = line
            line = at = (a, b, c, d, x * a + y * c + e, x * b + y * d + f)

        while True:
            if not held and (whole := lexer.operation()):
                op, args = whole
            elif (v := lexer.value()) is None:
                break
            elif not isinstance(v, Word):
                held.append(v)
                continue
            else:
                op, held, args = v, [], held
            if op == b"Tj":
                if args:
                    show(args[:1])
            elif op == b"T*":
                next_line(0, -state["TL"])
            elif op == b"BI":  # an inline image
                end = data.find(b"EI", lexer.at)
                while end >= 0 and data[end + 2 : end + 3].strip(b"\x00\t\n\f\r "):
                    end = data.find(b"EI", end + 2)
                lexer.at = len(data) if end < 0 else end + 2
            elif op == b"q":
                saved.append(dict(state))
            elif op == b"Q" and saved:
                state = saved.pop()
            elif op == b"cm" and len(args) == 6:
                state["m"] = _times(args, state["m"])
            elif op == b"BT":
                line = at = UNIT
            elif op == b"Tf" and len(args) == 2:
                state["font"], state["size"] = self.font(resources, args[0]), float(args[1])
            elif op in (b"Tc", b"Tw", b"Tz", b"TL", b"Ts") and args:
                state[op.decode()] = float(args[0])
            elif op in (b"Td", b"TD") and len(args) == 2:
                if op == b"TD":
                    state["TL"] = -args[1]
                next_line(*args)
            elif op == b"Tm" and len(args) == 6:
                line = at = tuple(map(float, args))
            elif op == b"TJ" and args and isinstance(args[0], list):
                show(args[0])
            elif op in (b"'", b'"') and args:
                if op == b'"' and len(args) == 3:
                    state["Tw"], state["Tc"] = map(float, args[:2])
                next_line(0, -state["TL"])
                show(args[-1:])
            elif op == b"Do" and args and depth < 8:
                form = self.doc.get((self.doc.get(resources.get("XObject")) or {}).get(args[0]))
                if isinstance(form, Stream) and form.about.get("Subtype") == "Form":
                    inner = self.doc.get(form.about.get("Resources")) or resources
                    self.run(self.doc.decoded(form)[0], inner, _times(form.about.get("Matrix", UNIT), state["m"]), depth + 1)


def _wanted(doc: Document, wanted: frozenset[int] | None) -> Iterable[tuple[int, dict]]:
    return [(n, page) for n, page in enumerate(doc.pages, 1) if wanted is None or n in wanted]


ERRORS = (PdfError, ValueError, KeyError, TypeError, IndexError, AttributeError, RecursionError)


#: Elements, or bytes of images by the hundred, that a batch of results holds, unless one file has more.
HELD = 1 << 15


def _reader(rows_of_page, kind: pa.Schema, wanted: Sequence[int] | None, size_of=len):
    """For mapInArrow over (path, content, password): rows of the pages, a page or file that can't be read as one row with its error."""
    chosen = None if wanted is None else frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, held = [], 0
            for path, content, password in zip(*(batch.column(i) for i in range(3)), strict=True):
                rows: list[dict] = []
                try:
                    doc = Document(content.as_py() or b"", password.as_py() or "")
                    for n, page in _wanted(doc, chosen):
                        try:
                            rows += rows_of_page(doc, n, page)
                        except ERRORS as error:
                            rows.append({"page": n, "error": str(error) or type(error).__name__})
                except ERRORS as error:
                    rows.append({"error": str(error) or type(error).__name__})
                done += [{"path": path.as_py()} | r for r in rows]
                held += size_of(rows)
                if held > HELD:
                    yield pa.RecordBatch.from_pylist(done, kind)
                    done, held = [], 0
            yield pa.RecordBatch.from_pylist(done, kind)

    return run


def _rows(files: DataFrame, password: Column | str) -> DataFrame:
    secret = F.lit(password) if isinstance(password, str) else password
    return files.select("path", "content", secret.cast("string").alias("password"))


def _size(doc: Document, page: dict) -> tuple[float, float]:
    box = [float(doc.get(v)) for v in doc.get(page.get("MediaBox")) or LETTER]
    return abs(box[2] - box[0]), abs(box[3] - box[1])


def _text_of_page(doc: Document, n: int, page: dict) -> list[dict]:
    width, height = _size(doc, page)
    return [{"page": n, "page_w": width, "page_h": height, "elements": _Page(doc, page).elements}]


def pages(files: DataFrame, wanted: Sequence[int] | None = None, password: Column | str = "") -> DataFrame:
    """(path, page, page_w, page_h, elements, error): a row for each page of each file, or those of ``wanted`` numbers that it has.

    An element is what one text operator shows: text, x, y (of its baseline, from below), w, h (its size) and font. A
    page that can't be read has an error, a file that can't (no PDF, a wrong password, encryption of another kind) is
    one row without a page. ``password`` is the user's or owner's, for all files or a column of ``files``.
    """
    element = pa.struct([(c, pa.string() if c in ("text", "font") else pa.float64()) for c in ("text", "x", "y", "w", "h", "font")])
    kind = pa.schema([("path", pa.string()), ("page", pa.int32()), ("page_w", pa.float64()), ("page_h", pa.float64()), ("elements", pa.list_(element)), ("error", pa.string())])
    return _rows(files, password).mapInArrow(_reader(_text_of_page, kind, wanted, lambda rows: sum(1 + len(r.get("elements", ())) for r in rows)), PAGE)


def _page_rows(found: DataFrame) -> DataFrame:
    """Rows of text with their page's facts; a page without elements has one row without text."""
    about = ("page_w", "page_h", "error")
    each = found.select("path", "page", *about, F.posexplode_outer("elements").alias("elem", "e")).select("path", "page", *about, "elem", "e.*")
    page = Window.partitionBy("path", "page").orderBy(F.col("y").desc(), "x", "elem")
    fresh = F.coalesce(F.lag("y").over(page) - F.col("y") >= F.greatest("h", F.lag("h").over(page)) / 2, F.lit(True))
    each = each.withColumn("fresh", fresh.cast("int")).withColumn("row", F.sum("fresh").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.col("x") + F.col("w")
    lists = each.groupBy("path", "page", "row").agg(
        F.sort_array(F.collect_list(F.struct("x", "elem", "text", end.alias("end"), "h"))).alias("es"),
        F.max("y").alias("y"), F.min("x").alias("x"), (F.max(end) - F.min("x")).alias("w"), F.max("h").alias("h"), *[F.first(c).alias(c) for c in about],
    )
    before = lambda i: F.get("es", i - 1)
    spaced = F.transform("es", lambda e, i: F.concat(F.when(e["x"] - before(i)["end"] > e["h"] / 6, " ").otherwise(""), F.coalesce(e["text"], F.lit(""))))
    text = F.trim(F.regexp_replace(F.array_join(spaced, ""), r"[\x09-\x0D ]+", " "))
    return lists.select("path", "page", "row", "y", "x", "w", "h", text.alias("text"), *about)


def page_rows(found: DataFrame) -> DataFrame:
    """(path, page, row, y, x, w, h, text): the rows of text of :func:`pages`, from above; elements join a row while their
    baselines are less than half a size apart, from left to right, with a space where a gap is a sixth of the size."""
    return _page_rows(found).select("path", "page", "row", "y", "x", "w", "h", "text").filter("text <> ''")


def page_texts(found: DataFrame) -> DataFrame:
    """(path, page, page_w, page_h, text, n_rows, coverage, error): a row for each row of :func:`pages`; rows of text are lines, an empty page has none.

    One shuffle, by page, carries the elements.
    """
    says = F.col("text") != ""
    lists = _page_rows(found).groupBy("path", "page").agg(
        F.sort_array(F.collect_list(F.when(says, F.struct("row", "text")))).alias("lines"),
        F.sum(F.when(says, F.col("w") * F.col("h"))).alias("area"), *[F.first(c).alias(c) for c in ("page_w", "page_h", "error")],
    )
    share = F.least(F.lit(1.0), F.coalesce(F.col("area") / (F.col("page_w") * F.col("page_h")), F.lit(0.0)))
    return lists.select("path", "page", "page_w", "page_h", F.array_join("lines.text", "\n").alias("text"), F.size("lines").alias("n_rows"), share.alias("coverage"), "error")


# ---- images -------------------------------------------------------------------------


def _colours(doc: Document, space: Any) -> tuple[int, np.ndarray | None]:
    """Samples a pixel, and the palette of an indexed space."""
    space = doc.get(space)
    kind = doc.get(space[0]) if isinstance(space, list) and space else space
    if kind in ("Indexed", "I"):
        channels = _colours(doc, space[1])[0]
        table = doc.get(space[3])
        table = doc.decoded(table)[0] if isinstance(table, Stream) else table
        return 1, np.frombuffer(table[: len(table) // channels * channels], np.uint8).reshape(-1, channels)
    if kind == "ICCBased":
        return doc.get(doc.get(space[1]).about["N"]), None
    return {"DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "Lab": 3, "DeviceCMYK": 4, "CMYK": 4}.get(kind, 1), None


def _image(doc: Document, stream: Stream) -> dict:
    about = {k: doc.get(v) for k, v in stream.about.items()}
    width, height = about["Width"], about["Height"]
    data, form = doc.decoded(stream)
    channels, palette = _colours(doc, about.get("ColorSpace"))
    found = {"width": width, "height": height, "channels": channels, "format": form or "raw"}
    if form:
        return found | {"data": data}
    bits = 1 if about.get("ImageMask") else about.get("BitsPerComponent", 8)
    row = -(-width * channels * bits // 8)
    if len(data) < row * height:
        raise PdfError("pixels are missing")
    values = pixels.samples(np.frombuffer(data[: row * height], np.uint8).reshape(height, row), width, bits, channels)
    if palette is not None:
        values = palette[values[:, :, 0]]
    elif bits < 8:
        values = values * np.uint8(255 // ((1 << bits) - 1))
    return found | {"channels": values.shape[2], "data": np.ascontiguousarray(values).tobytes()}


def _images_of_page(doc: Document, n: int, page: dict) -> list[dict]:
    rows, seen, waiting = [], set(), [("", doc.get(page.get("Resources")) or {})]
    while waiting:
        prefix, resources = waiting.pop()
        for name, ref in sorted((doc.get(resources.get("XObject")) or {}).items()):
            stream = doc.get(ref)
            if not isinstance(stream, Stream) or ref in seen:
                continue
            seen.add(ref)
            if stream.about.get("Subtype") == "Form":
                waiting.append((f"{prefix}{name}/", doc.get(stream.about.get("Resources")) or {}))
            elif stream.about.get("Subtype") == "Image":
                row = {"page": n, "name": prefix + name}
                try:
                    rows.append(row | _image(doc, stream))
                except ERRORS as error:
                    rows.append(row | {"error": str(error) or type(error).__name__})
    return rows


def images(files: DataFrame, wanted: Sequence[int] | None = None, password: Column | str = "") -> DataFrame:
    """(path, page, name, width, height, channels, format, data, error): a row for each image of the pages, those inside forms too.

    Format raw: data are 8-bit samples, row by row, palettes turned to colours; jpeg and other image formats: the file as
    it stands in the PDF. Images, pages and files that can't be read have an error; the password is that of :func:`pages`.
    """
    kind = pa.schema([("path", pa.string()), ("page", pa.int32()), ("name", pa.string()), *[(c, pa.int32()) for c in ("width", "height", "channels")], ("format", pa.string()), ("data", pa.binary()), ("error", pa.string())])
    return _rows(files, password).mapInArrow(_reader(_images_of_page, kind, wanted, lambda rows: sum(1 + len(r.get("data") or b"") // 100 for r in rows)), IMAGE)
