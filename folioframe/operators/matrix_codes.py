"""QR codes: found by their finder patterns, sampled through a homography, corrected over GF(256), and drawn.

:func:`read_matrix` is a backend of :func:`contours.decode_barcodes`, :func:`read_codes` one for line codes too. Finder
patterns are places where the widths 1:1:3:1:1 lie across and down; three of
them at a right angle give the grid, the alignment pattern its fourth point.
Versions 1 to 20; numeric, alphanumeric, byte (UTF-8, else Latin-1) and kanji
segments; turned by any angle, seen aslant, mirrored, or light on dark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .barcodes import read_lines
from .geometry import homography

# Check codewords a block, and blocks, of versions 1 to 20 by level.
CHECK_WORDS = {
    "L": (7, 10, 15, 20, 26, 18, 20, 24, 30, 18, 20, 24, 26, 30, 22, 24, 28, 30, 28, 28),
    "M": (10, 16, 26, 18, 24, 16, 18, 22, 22, 26, 30, 22, 22, 24, 24, 28, 28, 26, 26, 26),
    "Q": (13, 22, 18, 26, 18, 24, 18, 22, 20, 24, 28, 26, 24, 20, 30, 24, 28, 28, 26, 30),
    "H": (17, 28, 22, 16, 22, 28, 26, 26, 24, 28, 24, 28, 22, 24, 24, 30, 28, 28, 26, 28),
}
BLOCKS = {
    "L": (1, 1, 1, 1, 1, 2, 2, 2, 2, 4, 4, 4, 4, 4, 6, 6, 6, 6, 7, 8),
    "M": (1, 1, 1, 2, 2, 4, 4, 4, 5, 5, 5, 8, 9, 9, 10, 10, 11, 13, 14, 16),
    "Q": (1, 1, 2, 2, 4, 4, 6, 6, 8, 8, 8, 10, 12, 16, 12, 17, 16, 18, 21, 20),
    "H": (1, 1, 2, 4, 4, 4, 5, 6, 8, 8, 11, 11, 16, 16, 18, 16, 19, 21, 25, 25),
}
# The levels' two bits, the letters of alphanumeric segments, polynomials of field, format and version, the format's mask.
LEVELS = {1: "L", 0: "M", 3: "Q", 2: "H"}
LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ $%*+-./:"
FIELD, FORMAT, VERSION, FORMAT_MASK = 0x11D, 0x537, 0x1F25, 0x5412
LARGEST = 20
# Bits of a segment's length for versions to 9 and from 10, by mode.
LENGTH_BITS = {1: (10, 12), 2: (9, 11), 4: (8, 16), 8: (8, 10)}
# Which modules a mask turns over.
MASKS = (
    lambda r, c: (r + c) % 2 == 0,
    lambda r, c: r % 2 + 0 * c == 0,
    lambda r, c: c % 3 + 0 * r == 0,
    lambda r, c: (r + c) % 3 == 0,
    lambda r, c: (r // 2 + c // 3) % 2 == 0,
    lambda r, c: r * c % 2 + r * c % 3 == 0,
    lambda r, c: (r * c % 2 + r * c % 3) % 2 == 0,
    lambda r, c: ((r + c) % 2 + r * c % 3) % 2 == 0,
)

# ---- GF(256) -----------------------------------------------------------------------------


def _powers() -> np.ndarray:
    out, x = np.zeros(510, np.int64), 1
    for i in range(255):
        out[i] = out[i + 255] = x
        x = x << 1 ^ (FIELD if x & 128 else 0)
    return out


EXP = _powers()
LOG = np.zeros(256, np.int64)
LOG[EXP[:255]] = np.arange(255)


def _mul(a: int, b: int) -> int:
    return int(EXP[LOG[a] + LOG[b]]) if a and b else 0


@lru_cache(maxsize=64)
def _generator(n: int) -> tuple[int, ...]:
    out = [1]
    for i in range(n):
        out = [a ^ _mul(b, int(EXP[i])) for a, b in zip([*out, 0], [0, *out], strict=True)]
    return tuple(out)


def check_words(data: list[int], n: int) -> list[int]:
    """The n check codewords of a block."""
    rest, g = list(data) + [0] * n, _generator(n)
    for i in range(len(data)):
        if lead := rest[i]:
            for j in range(1, n + 1):
                rest[i + j] ^= _mul(g[j], lead)
    return rest[len(data) :]


def corrected(block: np.ndarray, n: int) -> np.ndarray | None:
    """A block with up to n / 2 wrong codewords put right; None if there are more."""
    size = len(block)
    places = np.arange(size - 1, -1, -1)
    terms = np.where(block > 0, EXP[(LOG[block] + np.arange(n)[:, None] * places) % 255], 0)
    syndromes = [int(s) for s in np.bitwise_xor.reduce(terms, axis=1)]
    if not any(syndromes):
        return block
    now, before, length, gap, last = [1], [1], 0, 1, 1  # the shortest recurrence of the syndromes: the error locator
    for i in range(n):
        off = syndromes[i]
        for j in range(1, min(length, len(now) - 1) + 1):
            off ^= _mul(now[j], syndromes[i - j])
        if not off:
            gap += 1
            continue
        factor = int(EXP[(LOG[off] - LOG[last]) % 255])
        shifted = [0] * gap + [_mul(factor, b) for b in before]
        wide = max(len(now), len(shifted))
        changed = [(now[k] if k < len(now) else 0) ^ (shifted[k] if k < len(shifted) else 0) for k in range(wide)]
        if 2 * length <= i:
            before, length, last, gap = now, i + 1 - length, off, 1
        else:
            gap += 1
        now = changed
    if 2 * length > n:
        return None
    locator = np.array(now[: length + 1])
    at = lambda poly, logs: np.bitwise_xor.reduce(np.where(poly[:, None] > 0, EXP[(LOG[poly][:, None] + np.arange(len(poly))[:, None] * logs) % 255], 0), axis=0)
    wrong = np.flatnonzero(at(locator, -places % 255) == 0)
    if len(wrong) != length:
        return None
    evaluator = np.zeros(n, np.int64)
    for i, a in enumerate(locator):
        for j in range(n - i):
            evaluator[i + j] ^= _mul(int(a), syndromes[j])
    inverse = -places[wrong] % 255
    top = at(evaluator, inverse)
    slope = at(np.where(np.arange(len(locator)) % 2 == 1, locator, 0)[1:], inverse)
    if (slope == 0).any():
        return None
    out = block.copy()
    out[wrong] ^= np.where(top > 0, EXP[(LOG[top] - LOG[slope] + places[wrong]) % 255], 0)
    return out


# ---- the grid ----------------------------------------------------------------------------


def _remainder(value: int, bits: int, poly: int) -> int:
    rest = value << bits
    for i in range(rest.bit_length() - 1, bits - 1, -1):
        if rest >> i & 1:
            rest ^= poly << (i - bits)
    return value << bits | rest


FORMATS = np.array([_remainder(f, 10, FORMAT) ^ FORMAT_MASK for f in range(32)])


def alignments(version: int) -> list[int]:
    """Rows and columns of the alignment patterns' centres."""
    if version == 1:
        return []
    n = version // 7 + 2
    step = (4 * version + 2 * n + 1) // (2 * n - 2) * 2
    return [6, *(4 * version + 10 - step * i for i in range(n - 2, -1, -1))]


def _format_places(size: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(row, column) of the format's bits from the lowest, in both copies."""
    first = [(r, 8) for r in (0, 1, 2, 3, 4, 5, 7, 8)] + [(8, c) for c in (7, 5, 4, 3, 2, 1, 0)]
    return first, [(8, size - 1 - i) for i in range(8)] + [(size - 15 + i, 8) for i in range(8, 15)]


@lru_cache(maxsize=LARGEST)
def layout(version: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grid of the fixed modules, rows, columns of the data modules in reading order)."""
    size = 17 + 4 * version
    grid, taken = np.zeros((size, size), bool), np.zeros((size, size), bool)
    rings = lambda n: np.maximum(*np.abs(np.mgrid[-n : n + 1, -n : n + 1]))
    grid[6, ::2] = grid[::2, 6] = True
    taken[6] = taken[:, 6] = True
    centres = alignments(version)
    for r in centres:
        for c in centres:
            if (r, c) not in ((6, 6), (6, centres[-1]), (centres[-1], 6)):
                grid[r - 2 : r + 3, c - 2 : c + 3], taken[r - 2 : r + 3, c - 2 : c + 3] = rings(2) != 1, True
    eye = (rings(4) != 2) & (rings(4) != 4)
    for rows, cols in ((slice(0, 8), slice(0, 8)), (slice(0, 8), slice(size - 8, size)), (slice(size - 8, size), slice(0, 8))):
        part = lambda s: slice(1, 9) if s.start == 0 else slice(0, 8)
        grid[rows, cols], taken[rows, cols] = eye[part(rows), part(cols)], True
    for places in _format_places(size):
        for r, c in places:
            taken[r, c] = True
    grid[size - 8, 8] = taken[size - 8, 8] = True
    if version >= 7:
        bits = _remainder(version, 12, VERSION)
        for i in range(18):
            r, c = i // 3, size - 11 + i % 3
            grid[r, c] = grid[c, r] = bool(bits >> i & 1)
            taken[r, c] = taken[c, r] = True
    pairs = [c for c in range(size - 1, 6, -2)] + [5, 3, 1]
    walk = [(r, c - side) for k, c in enumerate(pairs) for r in (range(size) if k % 2 else range(size - 1, -1, -1)) for side in (0, 1)]
    rows, cols = np.array([p for p in walk if not taken[p]]).T
    return grid, rows, cols


@lru_cache(maxsize=4 * LARGEST)
def blocks(version: int, level: str) -> tuple[list[np.ndarray], int]:
    """(the places of each block's codewords in the stream, check codewords a block)."""
    total, check, n = len(layout(version)[1]) // 8, CHECK_WORDS[level][version - 1], BLOCKS[level][version - 1]
    sizes = [total // n + (b >= n - total % n) - check for b in range(n)]
    owner = [b for i in range(max(sizes)) for b in range(n) if i < sizes[b]] + [b for _ in range(check) for b in range(n)]
    return [np.flatnonzero(np.array(owner) == b) for b in range(n)], check


# ---- reading the grid -----------------------------------------------------------------------


def _text(data: bytes, version: int) -> str | None:
    bits, left, out, raw = int.from_bytes(data, "big"), 8 * len(data), [], b""

    def take(n: int) -> int:
        nonlocal left
        if n > left:
            raise EOFError
        left -= n
        return bits >> left & (1 << n) - 1

    def flush() -> None:
        nonlocal raw
        if raw:
            try:
                out.append(raw.decode())
            except UnicodeDecodeError:
                out.append(raw.decode("latin-1"))
        raw = b""

    try:
        while left >= 4 and (mode := take(4)):
            if mode == 7:  # another character set: its number has as many bytes as leading ones say
                first = take(8)
                take(0 if first < 128 else 8 if first < 192 else 16)
                continue
            if mode not in LENGTH_BITS:
                return None
            n = take(LENGTH_BITS[mode][version >= 10])
            if mode == 4:
                raw += bytes(take(8) for _ in range(n))
                continue
            flush()
            if mode == 1:
                groups = [3] * (n // 3) + ([n % 3] if n % 3 else [])
                out += [f"{take((0, 4, 7, 10)[g]):0{g}d}" for g in groups]
            elif mode == 2:
                for _ in range(n // 2):
                    high, low = divmod(take(11), 45)
                    out.append(LETTERS[high] + LETTERS[low])
                out += [LETTERS[take(6)]] if n % 2 else []
            else:
                for _ in range(n):
                    high, low = divmod(take(13), 0xC0)
                    code = (high << 8 | low) + (0x8140 if (high << 8 | low) < 0x1F00 else 0xC140)
                    out.append(code.to_bytes(2, "big").decode("shift_jis"))
    except (EOFError, IndexError, UnicodeDecodeError):
        return None
    flush()
    return "".join(out)


def read_grid(grid: np.ndarray) -> str | None:
    """The text of a square of modules, dark ones True; None if it is no code or can't be put right."""
    size = len(grid)
    version = (size - 17) // 4
    if not 1 <= version <= LARGEST or size != 17 + 4 * version:
        return None
    copies = [sum(int(grid[p]) << i for i, p in enumerate(places)) for places in _format_places(size)]
    off = np.array([[int(f ^ c).bit_count() for c in copies] for f in FORMATS])
    best = int(off.min(axis=1).argmin())
    if off[best].min() > 3:
        return None
    _, rows, cols = layout(version)
    bits = grid[rows, cols] ^ MASKS[best & 7](rows, cols)
    words = np.packbits(bits[: len(bits) // 8 * 8]).astype(np.int64)
    places, check = blocks(version, LEVELS[best >> 3])
    data = []
    for at in places:
        block = corrected(words[at], check)
        if block is None:
            return None
        data.append(block[:-check])
    return _text(np.concatenate(data).astype(np.uint8).tobytes(), version)


# ---- finding the grid -----------------------------------------------------------------------


def _crossings(dark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place along the line, line, module) where runs of a line are as 1:1:3:1:1, dark first."""
    wide = dark.shape[1] + 1
    flat = np.zeros(len(dark) * wide + 1, bool)
    flat[1:].reshape(len(dark), wide)[:, :-1] = dark
    edges = np.flatnonzero(flat[1:] != flat[:-1])
    if len(edges) < 6:
        return (np.empty(0),) * 3
    edges = edges[: len(edges) // 2 * 2]
    runs = np.lib.stride_tricks.sliding_window_view(np.diff(edges), 5)[::2]
    module = runs.sum(axis=1) / 7
    near = (np.abs(runs - module[:, None] * np.array([1, 1, 3, 1, 1])) <= module[:, None] * np.array([0.5, 0.5, 1.0, 0.5, 0.5]) + 0.3).all(axis=1)
    first = edges[2 : 2 + 2 * len(runs) : 2][near]
    return first % wide + runs[near, 2] / 2, first // wide, module[near]


def finders(dark: np.ndarray) -> list[tuple[float, float, float]]:
    """(x, y, module) of the finder patterns' centres, those that most rays from the centre bear out first."""
    hx, hy, hm = _crossings(dark)
    vy, vx, vm = _crossings(dark.T)
    by_column: dict[int, list[int]] = {}
    for k, x in enumerate(vx):
        by_column.setdefault(int(x), []).append(k)
    found: list[list[float]] = []
    for x, y, m in zip(hx, hy, hm, strict=True):
        for k in by_column.get(int(x), ()):
            if abs(vy[k] - y - 0.5) > max(1.0, m / 2) or not 0.5 < vm[k] / m < 2:
                continue
            for f in found:
                if abs(f[0] / f[3] - x) < m and abs(f[1] / f[3] - vy[k]) < m:
                    break
            else:
                found.append(f := [0.0, 0.0, 0.0, 0.0])
            f[0], f[1], f[2], f[3] = f[0] + x, f[1] + vy[k], f[2] + (m + vm[k]) / 2, f[3] + 1
    if not found:
        return []
    marks = np.array(found)
    marks = marks[:, :3] / marks[:, 3:]
    rays = _rays(dark, marks)
    return [tuple(map(float, marks[i])) for i in np.lexsort([-marks[:, 2], -rays]) if rays[i] >= 11]


def _rays(dark: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """On how many of sixteen rays from each centre dark, light and dark follow as 1.5:1:1, as on any line through a finder pattern."""
    turn = np.arange(16) * np.pi / 8 + 0.05
    reach = np.arange(0, 36) / 6
    r = marks[:, 2, None, None] * reach
    x, y = (np.floor(marks[:, i, None, None] + r * f(turn)[:, None]).astype(int) for i, f in ((0, np.cos), (1, np.sin)))
    inside = (x >= 0) & (y >= 0) & (x < dark.shape[1]) & (y < dark.shape[0])
    seen = dark[np.where(inside, y, 0), np.where(inside, x, 0)] & inside
    light = np.argmax(~seen, axis=2)
    after = np.arange(len(reach))
    again = np.argmax(seen & (after > light[..., None]), axis=2)
    end = np.argmax(~seen & (after > again[..., None]), axis=2)
    step, slack = light / 1.5, 2.5 + 6 / marks[:, 2, None]
    good = seen[..., 0] & (light > 0) & (again > light) & (end > again)
    return (good & (np.abs(again - light - step) <= slack) & (np.abs(end - again - step) <= slack)).sum(axis=1)


def _corners(three: tuple) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float] | None:
    """(how far from a right angle with equal sides, corner, right end, lower end, module) of three finder patterns."""
    p, m = np.array([f[:2] for f in three]), [f[2] for f in three]
    sides = [np.hypot(*(p[(i + 1) % 3] - p[(i + 2) % 3])) for i in range(3)]
    c = int(np.argmax(sides))
    a, b = p[(c + 1) % 3] - p[c], p[(c + 2) % 3] - p[c]
    if a[0] * b[1] - a[1] * b[0] < 0:
        a, b = b, a
    la, lb = np.hypot(*a), np.hypot(*b)
    if min(la, lb) < 8 * min(m):
        return None
    off = abs(la - lb) / max(la, lb) + abs(a @ b) / (la * lb) + max(m) / min(m) - 1
    slant = max(abs(a[0]), abs(a[1])) / la
    return (off, p[c], p[c] + a, p[c] + b, float(np.mean(m)) * slant) if off < 1.2 else None


def _sampled(dark: np.ndarray, h: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = h[6] * x + h[7] * y + h[8]
    u, v = (np.floor((h[i] * x + h[i + 1] * y + h[i + 2]) / d).astype(int) for i in (0, 3))
    return dark[np.clip(v, 0, dark.shape[0] - 1), np.clip(u, 0, dark.shape[1] - 1)]


_BULLSEYE = np.maximum(*np.abs(np.mgrid[-2:3, -2:3])) != 1


def _grids(dark: np.ndarray, c: np.ndarray, right: np.ndarray, low: np.ndarray, module: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(modules, homography) as three finder patterns may mean them, the likeliest versions first."""
    guess = ((np.hypot(*(right - c)) + np.hypot(*(low - c))) / 2 / module + 7 - 17) / 4
    tries = []
    for version in range(max(1, round(guess) - 2), min(LARGEST, round(guess) + 2) + 1):
        size = 17 + 4 * version
        frame = np.array([(3.5, 3.5), (size - 3.5, 3.5), (3.5, size - 3.5), (size - 3.5, size - 3.5)])
        h = homography(frame, np.array([c, right, low, right + low - c]))
        if h is not None:
            line = np.arange(8, size - 8)
            timing = [_sampled(dark, h, *xy) for xy in ((line + 0.5, line * 0 + 6.5), (line * 0 + 6.5, line + 0.5))]
            share = np.mean([t == (line % 2 == 0) for t in timing])
            if share >= 0.7:
                tries.append((-share, abs(version - guess), version, frame, h))
    for _, _, version, frame, h in sorted(tries, key=lambda t: t[:3]):
        size = 17 + 4 * version
        ys, xs = np.mgrid[0:size, 0:size] + 0.5
        if version > 1:
            steps = np.arange(-4, 4.01, 0.25)
            dy, dx = (g.ravel()[:, None] for g in np.meshgrid(steps, steps, indexing="ij"))
            oy, ox = (g.ravel()[None, :] for g in np.mgrid[-2:3, -2:3])
            seen = (_sampled(dark, h, size - 6.5 + dx + ox, size - 6.5 + dy + oy) == _BULLSEYE.ravel()).sum(axis=1)
            best = seen == seen.max()
            if seen.max() >= 22:
                far = np.hypot(dx, dy)[:, 0]
                best &= far <= far[best].min() + 1
                x, y = size - 6.5 + dx[best].mean(), size - 6.5 + dy[best].mean()
                d = h[6] * x + h[7] * y + h[8]
                mark = np.array([(h[0] * x + h[1] * y + h[2]) / d, (h[3] * x + h[4] * y + h[5]) / d])
                better = homography(np.r_[frame[:3], [[size - 6.5, size - 6.5]]], np.array([c, right, low, mark]))
                if better is not None:
                    yield _sampled(dark, better, xs, ys), better
        yield _sampled(dark, h, xs, ys), h


def _darks(grey: np.ndarray) -> Iterator[np.ndarray]:
    """Which pixels are dark: under the middle of the range, then under the mean around them; then the other way round."""
    low, high = int(grey.min()), int(grey.max())
    if high - low < 32:
        return
    middle = grey < (low + high) / 2
    yield middle
    half = max(4, max(grey.shape) // 16)
    sums = np.pad(np.pad(grey.astype(np.int64), half, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * half + 1
    around = (sums[n:, n:] - sums[:-n, n:] - sums[n:, :-n] + sums[:-n, :-n])[: grey.shape[0], : grey.shape[1]] / (n * n)
    yield grey < around - 4
    yield ~middle


def read_matrix(pixels: np.ndarray) -> list[tuple[str, str, list[tuple[float, float]]]]:
    """(QR, value, corners) of the QR codes in an image (height, width, channels)."""
    grey = pixels[:, :, 0] if pixels.shape[2] < 3 else (pixels[:, :, :3].astype(np.uint16).sum(axis=2) // 3)
    for dark in _darks(grey):
        found, used = [], set()
        marks = finders(dark)[:12]
        threes = [(t, k) for k in combinations(range(len(marks)), 3) if (t := _corners(tuple(marks[i] for i in k))) is not None]
        for (_, c, right, low, module), k in sorted(threes, key=lambda t: t[0][0]):
            if used & set(k):
                continue
            for grid, h in _grids(dark, c, right, low, module):
                text = read_grid(grid)
                if text is None:
                    text = read_grid(grid.T)
                if text is not None:
                    n = len(grid)
                    corner = lambda x, y: tuple((h[i] * x + h[i + 1] * y + h[i + 2]) / (h[6] * x + h[7] * y + h[8]) for i in (0, 3))  # noqa: B023, E731
                    found.append(("QR", text, [corner(0, 0), corner(n, 0), corner(n, n), corner(0, n)]))
                    used |= set(k)
                    break
        if found:
            return found
    return []


def read_codes(pixels: np.ndarray) -> list:
    """QR codes, or where there are none the line code of an image."""
    return read_matrix(pixels) or read_lines(pixels)


# ---- drawing ------------------------------------------------------------------------------


def _segment(text: str) -> tuple[int, int, str]:
    """(mode, length, bits) of a text as one segment."""
    if text and all(c in LETTERS[:10] for c in text):
        return 1, len(text), "".join(f"{int(text[i : i + 3]):0{(4, 7, 10)[len(text[i : i + 3]) - 1]}b}" for i in range(0, len(text), 3))
    if text and all(c in LETTERS for c in text):
        pairs = [text[i : i + 2] for i in range(0, len(text), 2)]
        return 2, len(text), "".join(f"{LETTERS.index(p[0]) * 45 + LETTERS.index(p[1]):011b}" if len(p) == 2 else f"{LETTERS.index(p):06b}" for p in pairs)
    raw = text.encode()
    return 4, len(raw), "".join(f"{b:08b}" for b in raw)


def codewords(text: str, level: str = "M") -> tuple[int, np.ndarray]:
    """(version, stream of codewords) of a text at a level; ValueError for what version 20 can't hold."""
    mode, length, bits = _segment(text)
    for version in range(1, LARGEST + 1):
        places, check = blocks(version, level)
        room, head = sum(len(p) - check for p in places), LENGTH_BITS[mode][version >= 10]
        if length < 1 << head and 4 + head + len(bits) <= 8 * room:
            break
    else:
        raise ValueError("too long for a code of version 20")
    whole = f"{mode:04b}{length:0{head}b}{bits}"
    whole += "0" * min(4, 8 * room - len(whole))
    whole += "0" * (-len(whole) % 8)
    data = [int(whole[i : i + 8], 2) for i in range(0, len(whole), 8)]
    data += [(236, 17)[i % 2] for i in range(room - len(data))]
    stream, start = np.zeros(sum(map(len, places)), np.int64), 0
    for at in places:
        own = data[start : start + len(at) - check]
        stream[at], start = own + check_words(own, check), start + len(own)
    return version, stream


def grid_of(text: str, level: str = "M", mask: int | None = None, damage: int = 0, mendable: bool = False) -> np.ndarray:
    """The modules of a text, the first ``damage`` codewords of every block turned over, with ``mendable`` no more than it can mend; without a mask the one with the fewest squares of one colour."""
    version, stream = codewords(text, level)
    places, check = blocks(version, level)
    for at in places:
        stream[at[: min(damage, check // 2) if mendable else damage]] ^= 255
    fixed, rows, cols = layout(version)
    bits = np.zeros(len(rows), bool)
    bits[: 8 * len(stream)] = np.unpackbits(stream.astype(np.uint8)).astype(bool)
    drawn = []
    for m in range(8) if mask is None else [mask]:
        grid = fixed.copy()
        grid[rows, cols] = bits ^ MASKS[m](rows, cols)
        word = FORMATS[next(b for b, name in LEVELS.items() if name == level) << 3 | m]
        for places in _format_places(len(grid)):
            for i, p in enumerate(places):
                grid[p] = bool(word >> i & 1)
        same = (grid[1:] == grid[:-1])[:, 1:] & (grid[:, 1:] == grid[:, :-1])[1:] & (grid[1:, :-1] == grid[:-1, :-1])
        drawn.append((int(same.sum()), m, grid))
    return min(drawn, key=lambda d: d[:2])[2]


def drawn(text: str, level: str = "M", module: int = 3, turns: int = 0, mask: int | None = None, damage: int = 0) -> np.ndarray:
    """(height, width, 1): the code with a quiet zone of four modules, turned by quarters; of a block no more codewords are turned over than it can mend."""
    grid = np.pad(grid_of(text, level, mask, damage, mendable=True), 4)
    image = np.where(np.kron(grid, np.ones((module, module), bool)), 0, 255).astype(np.uint8)
    return np.ascontiguousarray(np.rot90(image, turns))[:, :, None]


def drawn_codes(rows: DataFrame) -> DataFrame:
    """(image_id, width, height, channels, data) of (image_id, value, level, turns, damage): a picture of each code, batches of at most 256."""
    kind = rows.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                columns = [batch.column(i).to_pylist() for i in range(1, 5)]
                images = [drawn(v, level, turns=t, mask=i % 8, damage=n) for i, (v, level, t, n) in enumerate(zip(*columns, strict=True))]
                sizes = [pa.array([im.shape[i] for im in images], pa.int32()) for i in (1, 0, 2)]
                yield pa.record_batch([batch.column(0), *sizes, pa.array([im.tobytes() for im in images], pa.binary())], names=["image_id", "width", "height", "channels", "data"])

    return rows.select("image_id", "value", "level", "turns", "damage").mapInArrow(run, f"image_id {kind}, width int, height int, channels int, data binary")
