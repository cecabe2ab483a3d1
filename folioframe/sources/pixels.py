"""Pixels of PNG and BMP files in memory; row filters by whole rows."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# The start of a PNG file; samples a pixel by colour type; start and step of the seven passes of an interlaced image.
PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _paeth(line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros(len(line) + step, np.int64)
    up = np.r_[np.zeros(step, np.int64), above]
    for i in range(0, len(line), step):
        a, b, c = out[i : i + step], up[i + step : i + 2 * step], up[i : i + step]
        p = a + b - c
        pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
        near = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        out[i + step : i + 2 * step] = line[i : i + step] + near[: len(line[i : i + step])] & 255
    return out[step:]


def unfiltered(data: bytes, row: int, step: int) -> np.ndarray:
    """Rows of ``row`` bytes from rows that begin with one of the five PNG filters; a pixel has ``step`` bytes."""
    lines = np.frombuffer(data[: len(data) // (row + 1) * (row + 1)], np.uint8).reshape(-1, row + 1)
    out, above = np.empty((len(lines), row), np.uint8), np.zeros(row, np.int64)
    for i, (kind, line) in enumerate(zip(lines[:, 0], lines[:, 1:].astype(np.int64), strict=True)):
        if kind == 1:  # each byte adds to the pixel before
            padded = np.r_[line, np.zeros(-row % step, np.int64)].reshape(-1, step)
            line = np.cumsum(padded, axis=0).ravel()[:row] & 255
        elif kind == 2:
            line = line + above & 255
        elif kind == 3:
            found = np.zeros(row + step, np.int64)
            for at in range(0, row, step):
                n = min(step, row - at)
                found[at + step : at + step + n] = line[at : at + n] + (found[at : at + n] + above[at : at + n] >> 1) & 255
            line = found[step:]
        elif kind == 4:
            line = _paeth(line, above, step)
        elif kind:
            raise ValueError(f"row filter {kind}")
        out[i], above = line, line
    return out


def samples(rows: np.ndarray, width: int, bits: int, channels: int = 1) -> np.ndarray:
    """(height, width, channels) of packed rows: 1, 2, 4, 8 bits, or the high byte of 16."""
    if bits == 16:
        return rows[:, ::2][:, : width * channels].reshape(len(rows), width, channels)
    if bits < 8:
        each = np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits)
        rows = each @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)
    return rows[:, : width * channels].reshape(len(rows), width, channels)


def png(data: bytes, most_pixels: int) -> np.ndarray:
    """(height, width, channels) as 8-bit samples: grey, grey and alpha, RGB or RGBA; palettes become colours."""
    at, body, palette, alpha, head = 8, [], None, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if len(part) < n:
            raise ValueError("a chunk is cut off")
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"wrong checksum of {kind.decode('latin-1')}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = part
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None:
        raise ValueError("no header")
    width, height, bits, colour, _, _, interlaced = head
    channels = CHANNELS[colour]
    if width * height > most_pixels:
        raise ValueError(f"{width} x {height} pixels are too many")
    # No more than the pixels and a filter byte a row, of each pass, can need.
    raw = zlib.decompressobj().decompress(b"".join(body), 2 * height * (width * channels * bits // 8 + 16) + 64)
    out, at = np.zeros((height, width, channels), np.uint8), 0
    for x, y, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w <= 0 or h <= 0:
            continue
        row = -(-w * channels * bits // 8)
        part = raw[at : at + h * (row + 1)]
        if len(part) < h * (row + 1):
            raise ValueError("pixels are missing")
        at += len(part)
        out[y::dy, x::dx] = samples(unfiltered(part, row, max(1, channels * bits // 8)), w, bits, channels)
    if colour == 3:
        if palette is None or int(out.max(initial=0)) >= len(palette):
            raise ValueError("no such colour in the palette")
        colours = palette
        if alpha:
            opaque = np.full((len(palette), 1), 255, np.uint8)
            opaque[: len(alpha), 0] = np.frombuffer(alpha, np.uint8)[: len(palette)]
            colours = np.concatenate([palette, opaque], axis=1)
        return colours[out[:, :, 0]]
    return out * np.uint8(255 // ((1 << bits) - 1)) if bits < 8 else out


def bmp(data: bytes, most_pixels: int) -> np.ndarray:
    """(height, width, 3) of an uncompressed bitmap of 1, 4, 8, 24 or 32 bits."""
    start, size, width, height, _, bits, packed = struct.unpack("<4xI", data[6:14])[0], *struct.unpack("<IiiHHI", data[14:34])
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError(f"bitmap of {bits} bits, compression {packed}")
    row, n = -(-width * bits // 32) * 4, abs(height)
    if width <= 0 or width * n > most_pixels:
        raise ValueError(f"{width} x {n} pixels")
    body = data[start : start + row * n]
    if len(body) < row * n:
        raise ValueError("pixels are missing")
    rows = np.frombuffer(body, np.uint8).reshape(n, row)
    rows = rows[::-1] if height > 0 else rows
    if bits >= 24:
        return rows[:, : width * bits // 8].reshape(n, width, bits // 8)[:, :, 2::-1]
    palette = np.frombuffer(data[14 + size : start], np.uint8).reshape(-1, 4)
    index = samples(rows, width, bits)[:, :, 0]
    if int(index.max(initial=0)) >= len(palette):
        raise ValueError("no such colour in the palette")
    return palette[index][:, :, 2::-1]


def decoded(data: bytes, most_pixels: int = 1 << 28) -> np.ndarray:
    """Pixels of a PNG or BMP file, known by its first bytes; others raise ValueError."""
    try:
        if data[:8] == PNG:
            return png(data, most_pixels)
        if data[:2] == b"BM":
            return bmp(data, most_pixels)
    except (zlib.error, struct.error, KeyError, IndexError) as error:
        raise ValueError(f"broken image: {error}") from None
    raise ValueError("neither PNG nor BMP")
