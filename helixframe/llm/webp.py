"""Media column: lossless WebP (VP8L), written for text payloads and read in full.

`decode` reads any lossless still image: prefix codes and their groups,
back-references, the colour cache, and the predictor, cross-colour,
subtract-green and palette transforms. All are inverted for the whole image at
once, but for predictors other than the left or the upper pixel.

`encode` stores bytes as 8-bit samples, 64 a row, in the form that is expected
to take the least bits: grey samples after subtract-green, whose red and blue
cost nothing, under a prefix code for text or, where that saves a fifth, under
one made for the file; residuals of the left or the upper sample (predictor and
subtract-green); packed indices of at most 16 sample values (palette); or four
samples a pixel with a colour cache. Cross-colour is read, but never written:
on grey samples it does what subtract-green does. Repeated blocks become
back-references. A payload beyond `MOST_SAMPLES` is one file with several frames, an
animation, so that no image is larger than a task can hold. Equal payloads give
equal files.

Defined results of `media`: a null text counts as empty, and an empty text is
one row of zeros; equal rows have equal files; an empty table gives an empty
result; other columns are not read. Images have a bounded size, so that a long
text takes little more memory than it has bytes; a file ends at the format's 4 GB,
beyond which encode raises.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import mixed, small, table, utf8

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: (columns, rows) back of the distance codes 1 to 120.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
TRANSFORMS = ("predictor", "cross-colour", "subtract-green", "palette")
CACHE_HASH = 0x1E35A7BD
OPAQUE_BLACK = 0xFF000000


@lru_cache(maxsize=64)
def codes_of(lengths: tuple[int, ...]) -> list[int]:
    """The canonical code of each symbol, its first bit lowest; one symbol alone takes no bits."""
    out, code, last = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[s] = int(f"{code:0{n}b}"[::-1], 2)
        code, last = code + 1, n
    return out


@lru_cache(maxsize=256)
def lookup(lengths: tuple[int, ...]) -> tuple[int, list[int]]:
    """(mask, table): table[next bits & mask] is symbol << 4 | bits taken."""
    used = [s for s, x in enumerate(lengths) if x]
    if len(used) <= 1:
        return 0, [(used[0] if used else 0) << 4]
    bits = max(lengths)
    found = np.zeros(1 << bits, np.int64)
    codes = codes_of(lengths)
    for s in used:
        found[codes[s] :: 1 << lengths[s]] = s << 4 | lengths[s]
    return (1 << bits) - 1, found.tolist()


@lru_cache(maxsize=16)
def literal_runs(lengths: tuple[int, ...], bits: int = 14) -> tuple[list[bytes], list[int]]:
    """For each value of the next bits the literals that they hold whole, and the bits these take."""
    mask, found = lookup(lengths)
    runs, taken = [], []
    for w in range(1 << bits):
        run, at = [], 0
        while True:
            e = found[w >> at & mask]
            if at + (e & 15) > bits or e >> 4 > 255:
                break
            run.append(e >> 4)
            at += e & 15
        runs.append(bytes(run))
        taken.append(at)
    return runs, taken


class Bits:
    """A stream of bits, lowest first."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data + bytes(16), np.uint8)
        self.windows = np.lib.stride_tricks.sliding_window_view(raw, 8).copy().view("<u8").ravel().tolist()
        self.at = 0

    def read(self, n: int) -> int:
        out = self.windows[self.at >> 3] >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return out

    def symbol(self, code: tuple[int, list[int]]) -> int:
        e = code[1][self.windows[self.at >> 3] >> (self.at & 7) & code[0]]
        self.at += e & 15
        return e >> 4


def read_lengths(bits: Bits, n: int) -> tuple[int, ...]:
    """The code lengths of an alphabet of n symbols."""
    out = [0] * n
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        out[bits.read(8 if wide else 1)] = 1
        if two:
            out[bits.read(8)] = 1
        return tuple(out)
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[LENGTH_ORDER[k]] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else n
    code, at, last = lookup(tuple(own)), 0, 8
    while at < n and left:
        left -= 1
        s = bits.symbol(code)
        if s < 16:
            out[at] = s
            at, last = at + 1, s or last
            continue
        times = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
        if s == 16:
            out[at : at + times] = [last] * times
        at += times
    if len(out) != n:
        raise ValueError("code lengths go beyond their alphabet")
    return tuple(out)


_groups: dict[tuple[int, int], tuple[int, int, list]] = {}  # of the last header at a place: many files share theirs


def read_group(bits: Bits, cache_size: int) -> list[tuple[int, ...]]:
    """The five codes' lengths: green with lengths and cache, red, blue, alpha, distance."""
    key = bits.at, cache_size
    peek = lambda a, b: [bits.windows[x] for x in range(a >> 3, b + 7 >> 3, 8)]
    if (old := _groups.get(key)) and (old[1] >> 3) < len(bits.windows) and peek(bits.at, old[1])[:-1] == old[2][0][:-1]:
        end = old[1]
        tail = len(old[2][0]) - 1
        keep = (1 << (end - ((key[0] >> 3) + 8 * tail) * 8)) - 1
        if peek(bits.at, end)[-1] & keep == old[2][0][-1] & keep:
            bits.at = end
            return old[2][1]
    out = [read_lengths(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)]
    if len(_groups) < 64:
        _groups[key] = (key[0], bits.at, [peek(key[0], bits.at), out])
    return out


def value_of(prefix: int, bits: Bits) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def distance_of(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB values of an entropy-coded image; only the main one can have several groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    shift, cache = 32 - cache_bits, [0] * (1 << cache_bits if cache_bits else 0)
    block, which = 0, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width // (1 << block))
        which = (read_pixels(bits, across, -(-height // (1 << block)), False) >> 8 & 0xFFFF).tolist()
    lengths = [read_group(bits, len(cache)) for _ in range(1 + max(which or [0]))]
    groups = [[lookup(x) for x in g] for g in lengths]
    n = width * height
    if which is None and not cache and not any(m for m, _ in groups[0][1:4]):
        green = _read_green(bits, lengths[0], groups[0], n, width)
        rest = [t[0] >> 4 for _, t in groups[0][1:4]]
        return green << 8 | np.uint32(rest[2] << 24 | rest[0] << 16 | rest[1])
    out: list[int] = []
    windows, symbol = bits.windows, bits.symbol
    group, filled = groups[0], 0
    while (i := len(out)) < n:
        if which is not None:
            y, x = divmod(i, width)
            group = groups[which[(y >> block) * across + (x >> block)]]
        s = symbol(group[0])
        if s < 256:
            red = symbol(group[1])
            blue = symbol(group[2])
            out.append(symbol(group[3]) << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            size = value_of(s - 256, bits)
            back = distance_of(value_of(symbol(group[4]), bits), width)
            if back > i:
                raise ValueError("a back-reference before the first pixel")
            for k in range(i - back, i - back + min(size, n - i)):
                out.append(out[k])
        else:
            for v in out[filled:]:
                cache[(CACHE_HASH * v & 0xFFFFFFFF) >> shift] = v
            filled = len(out)
            out.append(cache[s - 280])
        if bits.at > 8 * len(windows):
            raise ValueError("the data end within the image")
    return np.array(out, np.uint32)


_seen: dict[tuple[int, ...], int] = {}  # how many images had a code: a table of runs pays off for codes that many share
RUNS_FROM = 8


def _read_green(bits: Bits, lengths: list, group: list, n: int, width: int) -> np.ndarray:
    """The green samples where the other channels are constant; for codes met often, several literals for each look at the stream."""
    mask, symbols = group[0]
    if mask == 0:
        return np.full(n, symbols[0] >> 4, np.uint32)
    if len(_seen) > 4096:
        _seen.clear()
    _seen[lengths[0]] = _seen.get(lengths[0], 0) + 1
    often = _seen[lengths[0]] >= RUNS_FROM
    runs, taken = literal_runs(lengths[0]) if often else ((), ())
    windows, at, out = bits.windows, bits.at, bytearray()
    end = 8 * len(windows)
    while len(out) < n:
        w = windows[at >> 3] >> (at & 7)
        if often and (run := runs[w & 0x3FFF]):
            out += run
            at += taken[w & 0x3FFF]
            continue
        e = symbols[w & mask]
        if e < 4096:  # a literal, and then two more from what was looked at
            out.append(e >> 4)
            at += e & 15
            w >>= e & 15
            e = symbols[w & mask]
            if e < 4096:
                out.append(e >> 4)
                at += e & 15
                e = symbols[w >> (e & 15) & mask]
                if e < 4096:
                    out.append(e >> 4)
                    at += e & 15
            if at > end:
                break
            continue
        bits.at = at + (e & 15)
        size = value_of((e >> 4) - 256, bits)
        back = distance_of(value_of(bits.symbol(group[4]), bits), width)
        if back > len(out):
            raise ValueError("a back-reference before the first pixel")
        from_ = len(out) - back
        out += (bytes(out[from_:]) * (size // back + 1))[:size] if back < size else out[from_ : from_ + size]
        at = bits.at
        if at > end:
            break
    if len(out) < n:
        raise ValueError("the data end within the image")
    bits.at = at
    return np.frombuffer(bytes(out[:n]), np.uint8).astype(np.uint32)


def _bytes_of(pixels: np.ndarray) -> np.ndarray:
    """Blue, green, red, alpha of each pixel, as the last axis."""
    return np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(*pixels.shape, 4)


def _pixels_of(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels.astype(np.uint8)).view("<u4")[..., 0]


def invert_predictor(rest: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    """Add to each pixel of `rest` (height, width) what its block's mode foretells from those before it."""
    height, width = rest.shape
    kinds = modes >> 8 & 15
    if (kinds == kinds[0, 0]).all() and kinds[0, 0] in (1, 2):  # running sums: along the first row and down, or down the first column and along
        own = _bytes_of(rest).astype(np.int64)
        own[0, 0, 3] += 255
        if kinds[0, 0] == 1:
            own[:, 0] = np.cumsum(own[:, 0], axis=0)
            return _pixels_of(np.cumsum(own, axis=1) & 255)
        own[0] = np.cumsum(own[0], axis=0)
        return _pixels_of(np.cumsum(own, axis=0) & 255)
    rows = _bytes_of(rest).astype(int).tolist()
    kinds = kinds.tolist()

    def half(a: list[int], b: list[int]) -> list[int]:
        return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]

    def clamp(x: int) -> int:
        return min(255, max(0, x))

    black = [0, 0, 0, 255]
    for y in range(height):
        row, above = rows[y], rows[y - 1] if y else None
        for x in range(width):
            mode = 1 if y == 0 else 2 if x == 0 else kinds[y >> size_bits][x >> size_bits]
            if x == y == 0:
                mode = 0
            left = row[x - 1] if x else None
            top, corner = (above[x], above[x - 1]) if y else (None, None)
            right = (above[x + 1] if x + 1 < width else row[0]) if y else None
            if mode in (0, 14, 15):
                p = black
            elif mode == 1:
                p = left
            elif mode == 2:
                p = top
            elif mode == 3:
                p = right
            elif mode == 4:
                p = corner
            elif mode == 5:
                p = half(half(left, right), top)
            elif mode == 6:
                p = half(left, corner)
            elif mode == 7:
                p = half(left, top)
            elif mode == 8:
                p = half(corner, top)
            elif mode == 9:
                p = half(top, right)
            elif mode == 10:
                p = half(half(left, corner), half(top, right))
            elif mode == 11:
                # The neighbour that is nearer to left + top - corner: |estimate - left| is |top - corner|.
                to_left = sum(abs(a - b) for a, b in zip(top, corner, strict=True))
                to_top = sum(abs(a - b) for a, b in zip(left, corner, strict=True))
                p = left if to_left < to_top else top
            elif mode == 12:
                p = [clamp(a + b - c) for a, b, c in zip(left, top, corner, strict=True)]
            else:
                p = [clamp(a + int((a - c) / 2)) for a, c in zip(half(left, top), corner, strict=True)]
            row[x] = [(a + b) & 255 for a, b in zip(row[x], p, strict=True)]
    return _pixels_of(np.array(rows))


def invert_cross_colour(rest: np.ndarray, blocks: np.ndarray, size_bits: int) -> np.ndarray:
    height, width = rest.shape
    y, x = np.arange(height) >> size_bits, np.arange(width) >> size_bits
    factor = _bytes_of(blocks)[y[:, None], x[None, :]].view(np.int8).astype(int)
    c = _bytes_of(rest).astype(int)
    signed = lambda v: (v & 255) - ((v & 128) << 1)
    green = signed(c[..., 1])
    red = (c[..., 2] + (factor[..., 0] * green >> 5)) & 255
    blue = (c[..., 0] + (factor[..., 1] * green >> 5) + (factor[..., 2] * signed(red) >> 5)) & 255
    return _pixels_of(np.stack([blue, c[..., 1], red, c[..., 3]], -1))


def invert_subtract_green(rest: np.ndarray) -> np.ndarray:
    green = rest >> np.uint32(8) & np.uint32(255)
    both = (rest & np.uint32(0x00FF00FF)) + (green << np.uint32(16) | green)
    return rest & np.uint32(0xFF00FF00) | both & np.uint32(0x00FF00FF)


def invert_palette(index: np.ndarray, colours: np.ndarray, pack_bits: int, width: int) -> np.ndarray:
    green = index >> 8 & 255
    if pack_bits:
        per, bits = 1 << pack_bits, 8 >> pack_bits
        green = (green[..., None] >> (np.arange(per) * bits) & ((1 << bits) - 1)).reshape(len(index), -1)[:, :width]
    return np.concatenate([colours, np.zeros(256, np.uint32)])[green.astype(np.int64)]


def frames_of(data: bytes) -> Iterator[bytes]:
    """The stills of a file, each as a file of its own: itself, or the frames of an animation."""
    if data[12:16] != b"VP8X":
        yield data
        return
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"ANMF":
            yield _riff(data[at + 24 : at + 8 + size])  # behind the frame's place, size and duration
        at += 8 + size + size % 2


def _riff(chunks: bytes) -> bytes:
    return b"RIFF" + (4 + len(chunks)).to_bytes(4, "little") + b"WEBP" + chunks


def _animation(stills: list[bytes]) -> bytes:
    """One file whose frames are the stills, one after the other at the same place."""
    said = [int.from_bytes(x[21:25], "little") for x in stills]
    sizes = [(x & 0x3FFF, x >> 14 & 0x3FFF) for x in said]  # columns and rows, less one
    three = lambda *numbers: b"".join(x.to_bytes(3, "little") for x in numbers)
    chunk = lambda kind, body: kind + len(body).to_bytes(4, "little") + body + bytes(len(body) % 2)
    head = chunk(b"VP8X", bytes([0x12, 0, 0, 0]) + three(max(w for w, _ in sizes), max(h for _, h in sizes)))  # has frames, and alpha
    frames = [chunk(b"ANMF", three(0, 0, w, h, 1000) + b"\x02" + x[12:]) for (w, h), x in zip(sizes, stills, strict=True)]
    return _riff(head + chunk(b"ANIM", bytes(6)) + b"".join(frames))


def decode(data: bytes, used: list[str] | None = None) -> np.ndarray:
    """The pixels (height, width) of a lossless WebP file as ARGB; `used` gets the names of the transforms."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image in the file")
        at += 8 + (int.from_bytes(data[at + 4 : at + 8], "little") + 1 & ~1)
    bits = Bits(data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")])
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    used = [] if used is None else used
    undo, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        used.append(TRANSFORMS[kind])
        if kind in (PREDICTOR, CROSS_COLOUR):
            size_bits = bits.read(3) + 2
            w, h = -(-across // (1 << size_bits)), -(-height // (1 << size_bits))
            blocks = read_pixels(bits, w, h, False).reshape(h, w)
            undo.append((invert_predictor if kind == PREDICTOR else invert_cross_colour, (blocks, size_bits)))
        elif kind == SUBTRACT_GREEN:
            undo.append((invert_subtract_green, ()))
        else:
            n = bits.read(8) + 1
            steps = _bytes_of(read_pixels(bits, n, 1, False))
            colours = _pixels_of(np.cumsum(steps, axis=0, dtype=np.int64) & 255)
            pack_bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((invert_palette, (colours, pack_bits, across)))
            across = -(-across // (1 << pack_bits))
    if bits.windows[bits.at >> 3] >> (bits.at & 7) & 1:
        used.append("colour-cache")
    pixels = read_pixels(bits, across, height, True).reshape(height, across)
    for invert, how in reversed(undo):
        pixels = invert(pixels, *how)
    return pixels if alpha else pixels | np.uint32(OPAQUE_BLACK)


# --- writing -----------------------------------------------------------------

#: Fixed value: letters of running text, most frequent first.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
BLOCK = 16  # bytes; where a block repeats an earlier one, a back-reference is tried
MOST = 4096  # pixels that one back-reference can copy


def _weights() -> list[float]:
    """How often each green symbol is expected: a rule for text in Latin letters, and for the 24 length symbols."""
    out = [0.3] * 128 + [1.5] * 64 + [0.3] * 64 + [0.4] * 24
    for k, c in enumerate(LETTERS):
        out[ord(c)] = 120 * 0.87**k
        out[ord(c.upper())] = 2 + 5 * 0.9**k
    for c, x in ((" ", 190), (",", 12), (".", 14), ("\n", 4), ("\xc3", 10), *((d, 3) for d in "0123456789")):
        out[ord(c)] = x
    return out


def _huffman(weights: list[float], most: int = 15) -> tuple[int, ...]:
    """Code lengths of at most `most` bits; weights are flattened until they fit. Symbols of weight 0 have no code."""
    used = [(w, k) for k, w in enumerate(weights) if w]
    while True:
        heap = [(w, k, (k,)) for w, k in used]
        heapq.heapify(heap)
        depth = [0] * len(weights)
        tie = len(weights)
        while len(heap) > 1:
            (a, _, one), (b, _, other) = heapq.heappop(heap), heapq.heappop(heap)
            for s in one + other:
                depth[s] += 1
            heapq.heappush(heap, (a + b, tie, one + other))
            tie += 1
        if max(depth) <= most:
            return tuple(depth) if len(used) > 1 else tuple(int(k == used[0][1]) if used else 0 for k in range(len(weights)))
        used = [(w / 2 + 1, k) for w, k in used]


class Writer:
    """Bits, lowest first, as a list of (value, count)."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, int]] = []

    def put(self, value: int, n: int) -> None:
        self.parts.append((value, n))

    def value(self) -> tuple[int, int]:
        out = at = 0
        for v, n in self.parts:
            out |= v << at
            at += n
        return out, at

    def lengths(self, lengths: tuple[int, ...]) -> None:
        """The code lengths of an alphabet."""
        self.put(*_said(lengths))

    def _say(self, lengths: tuple[int, ...]) -> None:
        """A simple code for one or two symbols, else one with runs of zeros and repeats."""
        used = [s for s, x in enumerate(lengths) if x]
        if len(used) <= 2 and max(used, default=0) < 256:
            self.put(1, 1)
            self.put(len(used) > 1, 1)
            self.put(1, 1)
            for s in used or [0]:
                self.put(s, 8)
            return
        tokens, at, last = [], 0, 8
        while at < len(lengths):
            x, end = lengths[at], at + 1
            while end < len(lengths) and lengths[end] == x:
                end += 1
            run = end - at
            if x == 0 and run >= 3:
                run = min(run, 138)
                tokens.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
            elif x and x == last and run >= 3:
                run = min(run, 6)
                tokens.append((16, run - 3, 2))
            else:
                run = 1
                tokens.append((x, 0, 0))
                last = x or last
            at += run
        kinds = sorted({t[0] for t in tokens})
        own = [0] * 19
        if len(kinds) == 1:
            kinds.append(next(s for s in range(19) if s != kinds[0]))
        for s, x in zip(kinds, _huffman([sum(t[0] == s for t in tokens) + 1 for s in kinds], 7), strict=True):
            own[s] = x
        code = codes_of(tuple(own))
        self.put(0, 1)
        self.put(15, 4)
        for s in LENGTH_ORDER:
            self.put(own[s], 3)
        self.put(0, 1)
        for s, extra, n in tokens:
            self.put(code[s], own[s])
            self.put(extra, n)


@lru_cache(maxsize=64)
def _said(lengths: tuple[int, ...]) -> tuple[int, int]:
    w = Writer()
    w._say(lengths)
    return w.value()


MOST_SAMPLES = 64 * 16384  # of one image: as many rows as the format has; reading it back takes some 50 bytes for each of its bytes
FARTHEST = (1 << 20) - 120  # back-reference
OWN_CODE_SAVES = 0.2  # of the bits: reading under a code of its own takes longer
OWN_BITS = 11  # of the longest code in it
CACHE_BITS = 8
FAR = (5,) * 24 + (6,) * 16  # lengths of the distance code
WHOLE_BITS = 9  # of the blocks of a transform that treats all alike


@lru_cache(maxsize=1)
def _shared() -> tuple[int, ...]:
    """Lengths of the code for text."""
    return _huffman(_weights())


@lru_cache(maxsize=8)
def _alone(symbol: int) -> tuple[int, ...]:
    return tuple(int(s == symbol) for s in range(256))


def _entropy(counts: np.ndarray) -> float:
    """Bits of all samples under the best code, and a guess at what writing the code takes."""
    c = counts[counts > 0].astype(np.float64)
    return float((c * np.log2(c.sum() / c)).sum()) + 6.0 * len(c)


def _put_small(w: Writer, pixels: list[int]) -> None:
    """An image of a transform: literals without a cache, each channel under a code of its own."""
    w.put(0, 1)
    channels = [[p >> shift & 255 for p in pixels] for shift in (8, 16, 0, 24)]
    lengths = [_huffman(np.bincount(c, minlength=280 if k == 0 else 256).tolist()) for k, c in enumerate(channels)]
    for x in lengths:
        w.lengths(x)
    w.lengths(_alone(0)[:40])
    codes = [codes_of(x) for x in lengths]
    single = [sum(map(bool, x)) == 1 for x in lengths]
    for row in zip(*channels, strict=True):
        for v, code, x, one in zip(row, codes, lengths, single, strict=True):
            if not one:
                w.put(code[v], x[v])


def _prefix_of(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits' value, their count) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    n = (value - 1).bit_length() - 2
    high = (value - 1) >> n
    return 2 * n + high, (value - 1) & ((1 << n) - 1), n


def _repeats(raw: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of copies of earlier bytes, found at block starts, in order and apart."""
    words = raw[: len(raw) // BLOCK * BLOCK].view("<u8").reshape(-1, 2)
    key = mixed(words[:, 0]) ^ mixed(words[:, 1] + np.uint64(1))
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order][1:] == key[order][:-1])
    out, end = [], 0
    for to, source in sorted(zip(order[again + 1].tolist(), order[again].tolist(), strict=True)):
        at, back = to * BLOCK, (to - source) * BLOCK
        if at < end or back > FARTHEST:
            continue
        span = min(MOST, len(raw) - at)
        differ = raw[at : at + span] != raw[at - back : at - back + span]
        size = int(differ.argmax()) if differ.any() else span
        if size >= BLOCK:
            out.append((at, size, back))
            end = at + size
    return out


def _file(width: int, height: int, w: Writer, value: np.ndarray, count: np.ndarray, alpha: int = 0) -> bytes:
    """The file of an image whose header bits are in w, followed by the values of so many bits each."""
    head, head_bits = w.value()
    start = 40 + head_bits
    at = np.cumsum(count) - count + start % 32
    # Bits of one 32-bit word never overlap, so that sums below 2**53 put them together.
    words = np.bincount(at >> 5, weights=(value << (at & 31)).astype(np.float64), minlength=(int(at[-1] + count[-1]) >> 5) + 2).astype(np.int64)
    words[1:] += words[:-1] >> 32
    body = (words & 0xFFFFFFFF).astype("<u4").tobytes()
    lead = 0x2F | (width - 1) << 8 | (height - 1) << 22 | alpha << 36 | head << 40
    whole = start // 32 * 4
    tail = int.from_bytes(body[:4], "little") | lead >> (whole * 8)
    size = (start + int(count.sum()) + 7) // 8
    data = ((lead & ((1 << whole * 8) - 1)).to_bytes(whole, "little") + tail.to_bytes(4, "little") + body[4:])[:size]
    chunk = b"VP8L" + size.to_bytes(4, "little") + data + bytes(size % 2)
    return _riff(chunk)


def _green(w: Writer, raw: np.ndarray, alpha: int, shared: bool) -> tuple[np.ndarray, np.ndarray]:
    """Samples of the green channel, the others constant: codes into w, then values and bit counts of literals and back-references."""
    refs = [(at, size, *_prefix_of(size), *_prefix_of(back + 120)) for at, size, back in _repeats(raw)]
    if shared:
        length = np.array(_shared())
    else:
        free = np.ones(len(raw), bool)
        for at, size, *_ in refs:
            free[at : at + size] = False
        counts = np.concatenate([np.bincount(raw[free], minlength=256), np.bincount([r[2] for r in refs], minlength=24)])
        length = np.array(_huffman(counts.tolist(), OWN_BITS))
    w.put(0, 2)  # no colour cache, one group
    w.lengths(tuple(length.tolist()))
    for x in (_alone(0), _alone(0), _alone(alpha), FAR):
        w.lengths(x)
    code, far_code = np.array(codes_of(tuple(length.tolist()))), codes_of(FAR)
    if (length > 0).sum() == 1:
        length = np.zeros_like(length)  # one symbol alone takes no bits
    values, bits, done = [], [], 0
    for at, size, s, extra, n, d, far, m in refs:
        values += [code[raw[done:at]], np.array([code[256 + s], extra, far_code[d], far])]
        bits += [length[raw[done:at]], np.array([length[256 + s], n, FAR[d], m])]
        done = at + size
    return np.concatenate([*values, code[raw[done:]]]), np.concatenate([*bits, length[raw[done:]]])


def _cached(w: Writer, pixels: np.ndarray, hit: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of four samples with a colour cache: a hit is one symbol, any other pixel four."""
    channels = _bytes_of(pixels)[:, [1, 2, 0, 3]].astype(np.int64)
    channels[hit, 0] = 280 + slot[hit]
    sizes = (280 + (1 << CACHE_BITS), 256, 256, 256)
    lengths = [_huffman(np.bincount(channels[:, k] if k == 0 else channels[~hit, k], minlength=n).tolist(), OWN_BITS) for k, n in enumerate(sizes)]
    w.put(1, 1)
    w.put(CACHE_BITS, 4)
    w.put(0, 1)
    for x in [*lengths, _alone(0)[:40]]:
        w.lengths(x)
    codes = [np.array(codes_of(x)) for x in lengths]
    bits = [np.array(x) if sum(map(bool, x)) > 1 else np.zeros(len(x), np.int64) for x in lengths]
    value, count = (np.stack([x[k][channels[:, k]] if k == 0 else np.where(hit, 0, x[k][channels[:, k]]) for k in range(4)], 1) for x in (codes, bits))
    return value.ravel(), count.ravel()


def _cache_hits(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pixels the cache holds when they come, and the slot of each."""
    slot = ((pixels.astype(np.uint64) * np.uint64(CACHE_HASH) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(pixels), bool)
    hit[order[1:]] = (slot[order][1:] == slot[order][:-1]) & (pixels[order][1:] == pixels[order][:-1])
    return hit, slot


def encode(payload: bytes) -> bytes:
    """Lossless WebP whose samples are the payload; in several frames where it is longer than MOST_SAMPLES."""
    if not payload or len(payload) % 64:
        raise ValueError("a payload needs a positive multiple of 64 bytes")
    stills = [_encoded(payload[k : k + MOST_SAMPLES]) for k in range(0, len(payload), MOST_SAMPLES)]
    return stills[0] if len(stills) == 1 else _animation(stills)


def _encoded(payload: bytes) -> bytes:
    width, height = 64, len(payload) // 64
    raw = np.frombuffer(payload, np.uint8)
    image = raw.reshape(height, width)
    w = Writer()
    counts = np.bincount(raw, minlength=256)
    values = np.flatnonzero(counts)
    if 1 < len(values) <= 16:
        pack = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
        w.put(1 | PALETTE << 1, 3)
        w.put(len(values) - 1, 8)
        steps = np.diff(values, prepend=0).tolist()
        _put_small(w, [(255 if k == 0 else 0) << 24 | x << 16 | x << 8 | x for k, x in enumerate(steps)])
        w.put(0, 1)
        index = np.searchsorted(values, image).reshape(height, width >> pack, 1 << pack)
        packed = (index << (np.arange(1 << pack) * (8 >> pack))).sum(-1).astype(np.uint8)
        return _file(width, height, w, *_green(w, packed.ravel(), 255, False))
    left, up = np.diff(image, axis=1, prepend=np.uint8(0)), np.diff(image, axis=0, prepend=np.uint8(0))
    left[1:, 0], up[0, 1:] = np.diff(image[:, 0]), np.diff(image[0])
    bits = {"shared": float(counts[values] @ np.array(_shared())[values]), "own": _entropy(counts) / (1 - OWN_CODE_SAVES)}
    bits |= {k: _entropy(np.bincount(x.ravel(), minlength=256)) / (1 - OWN_CODE_SAVES) for k, x in (("left", left), ("up", up))}
    pixels = raw.view("<u4")
    if 2 * len(np.unique(pixels)) < len(pixels):
        hit, slot = _cache_hits(pixels)
        missed = _bytes_of(pixels[~hit])
        bits["cache"] = (sum(_entropy(np.bincount(missed[:, k], minlength=256)) for k in range(4)) + _entropy(np.bincount(slot[hit])) + len(pixels) * 0.9) / (1 - OWN_CODE_SAVES)
    form = min(bits, key=bits.get)
    if form == "cache":
        w.put(0, 1)
        return _file(16, height, w, *_cached(w, pixels, hit, slot), 1)
    if form in ("left", "up"):
        across, down = -(-width >> WHOLE_BITS), -(-height >> WHOLE_BITS)
        w.put(1 | PREDICTOR << 1, 3)
        w.put(WHOLE_BITS - 2, 3)
        _put_small(w, [0xFF000000 | (1 if form == "left" else 2) << 8] * (across * down))
    w.put(1 | SUBTRACT_GREEN << 1, 3)
    w.put(0, 1)
    samples_ = {"left": left, "up": up}.get(form, image).ravel()
    return _file(width, height, w, *_green(w, samples_, 0 if form in ("left", "up") else 255, form == "shared"))


def payload_of(text: bytes | None) -> bytes:
    raw = text or b""
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def samples(data: bytes, used: list[str] | None = None) -> np.ndarray:
    """The samples of a stored file, row by row: of green, or of all four channels in images of 16 columns; `used` gets the transforms of the first image."""
    out = []
    for still in frames_of(data):
        image = decode(still, [] if out else used)
        out.append(_bytes_of(image).ravel() if image.shape[1] == 16 else (image.ravel() >> 8 & 255).astype(np.uint8))
    return out[0] if len(out) == 1 else np.concatenate(out)


def feature(grey: np.ndarray) -> str:
    """Mean, deviation and the shares of four bands of sample values."""
    bands = np.bincount(grey >> 6, minlength=4) / len(grey)
    return f"{grey.mean():.4f},{grey.std():.4f}," + ",".join(f"{x:.4f}" for x in bands)


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the stored form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch):
                texts = utf8(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([encode(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def measured(stored: DataFrame) -> DataFrame:
    """What the stored files hold, read back: payload_bytes, payload_sha256, tail_crc32, feature; and which transforms they use."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "transforms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, data in zip(batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
                size, used = max(64, n + -n % 64), []
                grey = samples(data, used)[:size]
                payload = grey.tobytes()
                rows.append((size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(grey), ",".join(used)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, transforms string")


def op7_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(media(table(spark, sf_dir, "documents")))
