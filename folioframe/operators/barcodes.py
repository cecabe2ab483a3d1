"""Line barcodes: bars and spaces of scan lines read as Code 128, Code 39, EAN/UPC and ITF, and drawn.

:func:`read_lines` is a backend of :func:`contours.decode_barcodes`. A scan line
across the image becomes the widths of its bars and spaces; groups of widths
are compared with the symbols' by their nearest pattern, and only codes with
right guards and check digits count. Lines are taken at several heights, along both axes and in
both directions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Widths of bars and spaces of the Code 128 symbols 0 to 105 (103 to 105 start sets A, B and C), and of its end.
CODE128 = """
212222 222122 222221 121223 121322 131222 122213 122312 132212 221213 221312 231212 112232 122132 122231 113222 123122 123221
223211 221132 221231 213212 223112 312131 311222 321122 321221 312212 322112 322211 212123 212321 232121 111323 131123 131321
112313 132113 132311 211313 231113 231311 112133 112331 132131 113123 113321 133121 313121 211331 231131 213113 213311 213131
311123 311321 331121 312113 312311 332111 314111 221411 431111 111224 111422 121124 121421 141122 141221 112214 112412 122114
122411 142112 142211 241211 221114 413111 241112 134111 111242 121142 121241 114212 124112 124211 411212 421112 421211 212141
214121 412121 111143 111341 131141 114113 114311 411113 411311 113141 114131 311141 411131 211412 211214 211232
""".split()
CODE128_END = "2331112"
# Code 39 characters, and their nine elements, 1 where one is wide.
CODE39_CHARS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-. $/+%*"
CODE39 = """
000110100 100100001 001100001 101100000 000110001 100110000 001110000 000100101 100100100 001100100 100001001 001001001
101001000 000011001 100011000 001011000 000001101 100001100 001001100 000011100 100000011 001000011 101000010 000010011
100010010 001010010 000000111 100000110 001000110 000010110 110000001 011000001 111000000 010010001 110010000 011010000
010000101 110000100 011000100 010101000 010100010 010001010 000101010 010010100
""".split()
# EAN digits as widths (first set), which of the left six digits use the second set for each first digit, ITF digits.
EAN = "3211 2221 2122 1411 1132 1231 1114 1312 1213 3112".split()
EAN_SETS = "000000 001011 001101 001110 010011 011001 011100 010101 010110 011010".split()
ITF = "00110 10001 01001 11000 00101 10100 01100 00011 10010 01010".split()

_widths = lambda patterns: np.array([[int(c) for c in p] for p in patterns], float)
_W128, _WEAN = _widths(CODE128), _widths([*EAN, *(p[::-1] for p in EAN)])
_C39 = {p: c for p, c in zip(CODE39, CODE39_CHARS, strict=True)}
_ITF = {p: str(i) for i, p in enumerate(ITF)}
_END = np.array([int(c) for c in CODE128_END], float)
#: How far a group of widths may be from its pattern, in modules over all its elements.
SLACK = 2.0
#: Heights of the scan lines, as shares of the image.
HEIGHTS = (0.5, 0.25, 0.75, 0.4, 0.6, 0.1, 0.9)


def check_digit(digits: str) -> str:
    """The last digit of an EAN or UPC number."""
    return str(-sum(int(c) * (3 if i % 2 == 0 else 1) for i, c in enumerate(reversed(digits))) % 10)


def _nearest(widths: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """The nearest pattern of each row of widths, -1 where none is near."""
    return _nearest_by(widths, patterns)[0]


def _nearest_by(widths: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest patterns, and how far they are; all patterns have the same number of modules."""
    scaled = widths * (patterns[0].sum() / widths.sum(axis=1, keepdims=True))
    far = np.abs(scaled[:, None, :] - patterns[None, :, :]).sum(axis=2)
    best = far.argmin(axis=1)
    by = far[np.arange(len(best)), best]
    return np.where(by <= SLACK, best, -1), by


def _code128(w: np.ndarray, at: int) -> tuple[str, int] | None:
    groups = (len(w) - at - 7) // 6
    if groups < 3:
        return None
    symbols, by = _nearest_by(w[at : at + 6 * groups].reshape(-1, 6), _W128)
    module = w[at : at + 6].sum() / 11
    for n in range(3, groups + 1):  # start, data, check, end
        end = w[at + 6 * n : at + 6 * n + 7]
        far = np.abs(end / module - _END).sum()
        if far > SLACK or (n < groups and by[n] <= far):
            if n < groups and symbols[n] < 0:
                return None
            continue
        found = symbols[:n].tolist()
        if min(found) < 0 or (found[0] + sum(i * s for i, s in enumerate(found[:-1]))) % 103 != found[-1]:
            return None
        text = _text128(found[:-1])
        return None if text is None else (text, at + 6 * n + 7)
    return None


def _text128(symbols: list[int]) -> str | None:
    chosen, once, out = "ABC"[symbols[0] - 103], None, []
    for s in symbols[1:]:
        now, once = once or chosen, None
        if s >= 103:
            return None
        if now == "C" and s < 100:
            out.append(f"{s:02d}")
        elif now != "C" and s < 96:
            out.append(chr(s + 32) if now == "B" or s < 64 else chr(s - 64))
        elif s == 98 and now != "C":
            once = "B" if now == "A" else "A"
        elif s in (99, 100, 101) and "CBA"[s - 99] != now:
            chosen = "CBA"[s - 99]
        # what is left are function symbols, which stand for no character
    return "".join(out)


def _wide(w: np.ndarray) -> str:
    """Which of the elements are wide: those over the middle of the least and the largest."""
    low, high = w.min(), w.max()
    return "".join("1" if x > (low + high) / 2 else "0" for x in w) if high >= 1.7 * low else ""


def _code39(w: np.ndarray, at: int) -> tuple[str, int] | None:
    out = []
    while at + 9 <= len(w):
        c = _C39.get(_wide(w[at : at + 9]))
        if c is None or (not out and c != "*"):
            return None
        at += 10
        if c == "*" and out:
            return ("".join(out[1:]), at - 1) if len(out) > 1 else None
        out.append(c)
    return None


def _ean(w: np.ndarray, at: int) -> tuple[str, int, str] | None:
    for n, kind in ((6, "EAN13"), (4, "EAN8")):
        total = 3 + 4 * n + 5 + 4 * n + 3
        if at + total > len(w):
            continue
        module = w[at : at + total].sum() / (14 * n + 11)
        middle = at + 3 + 4 * n
        guards = np.r_[w[at : at + 3], w[middle : middle + 5], w[at + total - 3 : at + total]]
        if np.abs(guards / module - 1).max() > 0.6:
            continue
        digits = _nearest(np.r_[w[at + 3 : middle], w[middle + 5 : at + total - 3]].reshape(-1, 4), _WEAN)
        if digits.min() < 0 or digits[n:].max() > 9:
            continue
        sets = "".join("1" if d > 9 else "0" for d in digits[:n])
        if n == 6 and sets not in EAN_SETS or n == 4 and sets != "0000":
            continue
        text = (str(EAN_SETS.index(sets)) if n == 6 else "") + "".join(str(d % 10) for d in digits)
        if check_digit(text[:-1]) == text[-1]:
            return (text[1:], at + total, "UPCA") if n == 6 and text[0] == "0" else (text, at + total, kind)
    return None


def _itf(w: np.ndarray, at: int) -> tuple[str, int] | None:
    if at + 4 > len(w) or w[at : at + 4].max() > 1.6 * w[at : at + 4].min():
        return None
    narrow, at, out = w[at : at + 4].mean(), at + 4, []
    while at + 10 <= len(w):
        pair = [_ITF.get("".join("1" if x > 1.75 * narrow else "0" for x in w[at + i : at + 10 : 2])) for i in (0, 1)]
        if None in pair:
            break
        out += pair
        at += 10
    if len(out) < 4 or at + 3 > len(w) or not w[at] > 1.75 * narrow or max(w[at + 1], w[at + 2]) > 1.6 * narrow:
        return None
    return "".join(out), at + 3


def _line(values: np.ndarray) -> tuple[str, str, int, int] | None:
    """(type, value, first and last place) of a code on a scan line."""
    low, high = int(values.min()), int(values.max())
    if high - low < 32:
        return None
    dark = values < (low + high) / 2
    edges = np.flatnonzero(np.diff(dark)) + 1
    places = np.r_[0, edges, len(dark)]
    w = np.diff(places).astype(float)
    for at in range(0 if dark[0] else 1, len(w) - 20, 2):
        module = w[at : at + 6].sum() / 11
        if at and w[at - 1] < 4 * module:  # a quiet zone comes first
            continue
        for kind, read in (("Code128", _code128), ("Code39", _code39), ("EAN13", _ean), ("ITF", _itf)):
            if kind == "Code128" and int(_nearest(w[at : at + 6][None, :], _W128)[0]) < 103:
                continue
            found = read(w, at)
            # an ITF start is four narrow elements, so eleven modules are no measure: a wide space inside a code would be quiet enough
            quiet = 4 * (w[at : at + 4].mean() if kind == "ITF" else module)
            if found and (not at or w[at - 1] >= quiet) and (found[1] >= len(w) or w[found[1]] >= quiet):
                return (found[2] if len(found) > 2 else kind), found[0], int(places[at]), int(places[found[1]]) - 1
    return None


def read_lines(pixels: np.ndarray) -> list[tuple[str, str, list[tuple[int, int]]]]:
    """(type, value, two points) of the line code in an image (height, width, channels), upright or turned by quarters; at most one."""
    grey = pixels[:, :, 0] if pixels.shape[2] < 3 else pixels[:, :, :3].astype(np.uint16).sum(axis=2) // 3
    for across, image in ((True, grey), (False, grey.T)):
        for share in HEIGHTS:
            y = int(share * len(image))
            for back in (False, True):
                line = image[y][::-1] if back else image[y]
                if found := _line(line):
                    a, b = ((len(line) - 1 - p) if back else p for p in found[2:])
                    return [(found[0], found[1], [(a, y), (b, y)] if across else [(y, a), (y, b)])]
    return []


# ---- drawing ------------------------------------------------------------------------


def bars(kind: str, value: str) -> str:
    """The widths of bars and spaces of a value, the first a bar; ValueError for what the code can't hold."""
    if kind == "Code128":
        if any(not 32 <= ord(c) < 127 for c in value):
            raise ValueError("Code 128 is written in set B")
        symbols = [104, *(ord(c) - 32 for c in value)]
        symbols.append((104 + sum(i * s for i, s in enumerate(symbols))) % 103)
        return "".join(CODE128[s] for s in symbols) + CODE128_END
    if kind == "Code39":
        signs = [CODE39[CODE39_CHARS.index(c)] for c in f"*{value}*"]
        return "1".join(p.replace("1", "3").replace("0", "1") for p in signs)
    if kind in ("EAN13", "EAN8", "UPCA"):
        digits = value.zfill(13) if kind != "EAN8" else value
        if check_digit(digits[:-1]) != digits[-1] or len(digits) not in (8, 13):
            raise ValueError("wrong check digit")
        sets, digits = (EAN_SETS[int(digits[0])], digits[1:]) if len(digits) == 13 else ("0000", digits)
        n = len(digits) // 2
        left = "".join(EAN[int(d)][:: -1 if s == "1" else 1] for d, s in zip(digits[:n], sets, strict=True))
        return "111" + left + "11111" + "".join(EAN[int(d)] for d in digits[n:]) + "111"
    if kind == "ITF" and len(value) % 2 == 0:
        pairs = [zip(ITF[int(value[i])], ITF[int(value[i + 1])], strict=True) for i in range(0, len(value), 2)]
        return "1111" + "".join("13"[int(x)] for pair in pairs for both in pair for x in both) + "311"
    raise ValueError(f"{kind} can't hold {value}")


def drawn(kind: str, value: str, module: int = 2, height: int = 24, turns: int = 0) -> np.ndarray:
    """(height, width, 1): the code with its quiet zones, turned by quarters."""
    widths = [10, *map(int, bars(kind, value)), 10]
    line = np.repeat(np.arange(len(widths)) % 2 == 0, np.array(widths) * module).astype(np.uint8) * np.uint8(255)
    return np.ascontiguousarray(np.rot90(np.tile(line, (height, 1)), turns))[:, :, None]


def drawn_codes(rows: DataFrame) -> DataFrame:
    """(image_id, width, height, channels, data) of (image_id, type, value, turns): a picture of each code."""
    kind = rows.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [drawn(k, v, turns=t) for k, v, t in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            sizes = [pa.array([im.shape[i] for im in images], pa.int32()) for i in (1, 0, 2)]
            yield pa.record_batch([batch.column(0), *sizes, pa.array([im.tobytes() for im in images], pa.binary())], names=["image_id", "width", "height", "channels", "data"])

    return rows.select("image_id", "type", "value", "turns").mapInArrow(run, f"image_id {kind}, width int, height int, channels int, data binary")
