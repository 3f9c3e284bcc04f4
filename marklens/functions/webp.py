"""Pixels of lossless WebP files: prefix codes, copies of earlier pixels, a cache of colours, and four transforms undone.

Copies may reach back to the first pixel, so a picture is held whole (four bytes a pixel). Lossy and animated files are told apart, not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import binary
from .jpeg import Unread, Unreadable

# Fixed values of the format: the order of the lengths of lengths' codes, what is copied by code, kinds of transforms.
LENGTHS_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
COPIES, DISTANCES, CACHE_FACTOR = 24, 40, 0x1E35A7BD
PREDICT, COLOUR, GREEN, PALETTE = 0, 1, 2, 3
#: Near pixels by code: by their distance, then across, right before left.
NEAR = sorted(((x, y) for x in range(-7, 9) for y in range(8) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class Bits:
    """Bits from the lowest of each byte on."""

    def __init__(self, content: bytes):
        self.content, self.at, self.end = content + bytes(8), 0, 8 * len(content)

    def take(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise Unreadable("the picture's data end early")
        return int.from_bytes(self.content[at >> 3 : (at >> 3) + 5], "little") >> (at & 7) & (1 << n) - 1

    def symbol(self, code: tuple[int, list[int]]) -> int:
        """The next symbol of a prefix code."""
        most, table = code
        at = self.at
        found = table[int.from_bytes(self.content[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & (1 << most) - 1]
        if found < 0:
            raise Unreadable("no such code")
        self.at = at + (found & 15)
        return found >> 4


def coded(lengths: list[int]) -> tuple[int, list[int]]:
    """By the next bits of the longest code: symbol << 4 | its length. A lone symbol takes no bits."""
    used = [i for i, n in enumerate(lengths) if n]
    if len(used) == 1:
        return 0, [used[0] << 4]
    most = max(lengths, default=0)
    if not most or sum(1 << most - n for n in lengths if n) != 1 << most:
        raise Unreadable("codes that don't add up")
    table, code = [-1] * (1 << most), 0
    for n in range(1, most + 1):
        for i in used:
            if lengths[i] == n:
                first = int(f"{code:0{n}b}"[::-1], 2)
                table[first :: 1 << n] = [i << 4 | n] * (1 << most - n)
                code += 1
        code <<= 1
    return most, table


def prefix_code(bits: Bits, size: int) -> tuple[int, list[int]]:
    lengths = [0] * size
    if bits.take(1):
        two, wide = bits.take(1), bits.take(1)
        for symbol in [bits.take(8 if wide else 1)] + [bits.take(8) for _ in range(two)]:
            if symbol >= size:
                raise Unreadable("no such symbol")
            lengths[symbol] = 1
        return coded(lengths)
    of_lengths = [0] * 19
    for i in LENGTHS_ORDER[: 4 + bits.take(4)]:
        of_lengths[i] = bits.take(3)
    code = coded(of_lengths)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        n = bits.symbol(code)
        if n < 16:
            lengths[at] = n
            at, last = at + 1, n or last
            continue
        times = 3 + bits.take(2) if n == 16 else 3 + bits.take(3) if n == 17 else 11 + bits.take(7)
        if at + times > size:
            raise Unreadable("too many lengths")
        lengths[at : at + times] = [last if n == 16 else 0] * times
        at += times
    return coded(lengths)


def value(bits: Bits, code: int) -> int:
    """A length or distance by its code and more bits."""
    if code < 4:
        return code + 1
    more = code - 2 >> 1
    return (2 + (code & 1) << more) + bits.take(more) + 1


def image(bits: Bits, width: int, height: int, outer: bool) -> np.ndarray:
    """height x width numbers, alpha, red, green and blue from the top; outer: of the picture itself, whose codes may differ by place."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise Unreadable("no such cache")
    cache, step, places = [0] * (1 << cache_bits if cache_bits else 0), 0, None
    if outer and bits.take(1):
        step = bits.take(3) + 2
        across = -(-width // (1 << step))
        places = (image(bits, across, -(-height // (1 << step)), False) >> 8 & 0xFFFF).ravel().tolist()
    groups = [[prefix_code(bits, n) for n in (256 + COPIES + len(cache), 256, 256, 256, DISTANCES)] for _ in range(max(places) + 1 if places else 1)]
    total, out, at, filled = width * height, np.zeros(width * height, np.uint32), 0, 0
    shift, group = 32 - cache_bits, groups[0]
    while at < total:
        if places:
            group = groups[places[(at // width >> step) * across + (at % width >> step)]]
        green = bits.symbol(group[0])
        if green < 256:
            red, blue, alpha = bits.symbol(group[1]), bits.symbol(group[2]), bits.symbol(group[3])
            out[at] = alpha << 24 | red << 16 | green << 8 | blue
            at += 1
        elif green < 256 + COPIES:
            length, back = value(bits, green - 256), value(bits, bits.symbol(group[4]))
            if back > len(NEAR):
                back -= len(NEAR)
            else:
                x, y = NEAR[back - 1]
                back = max(1, x + y * width)
            if back > at or at + length > total:
                raise Unreadable("a copy of pixels that are not there")
            if back >= length:
                out[at : at + length] = out[at - back : at - back + length]
            else:
                out[at : at + length] = np.resize(out[at - back : at], length)
            at += length
        else:
            if cache:  # what has come since goes in first
                for colour in out[filled:at].tolist():
                    cache[(CACHE_FACTOR * colour & 0xFFFFFFFF) >> shift] = colour
                filled = at
            out[at] = cache[green - 256 - COPIES]
            at += 1
    if bits.at > bits.end:
        raise Unreadable("the picture's data end early")
    return out.reshape(height, width)


def parts(pixels: np.ndarray) -> np.ndarray:
    """Alpha, red, green, blue by pixel."""
    return np.stack([pixels >> s & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def joined(made: np.ndarray) -> np.ndarray:
    made = (made & 0xFF).astype(np.uint32)
    return made[..., 0] << 24 | made[..., 1] << 16 | made[..., 2] << 8 | made[..., 3]


def spread(blocks: np.ndarray, step: int, width: int, height: int) -> np.ndarray:
    return np.repeat(np.repeat(blocks, 1 << step, axis=0)[:height], 1 << step, axis=1)[:, :width]


def predicted(pixels: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """Differences to what neighbours predict, undone. A pixel needs its left one and three above it: all x + 2 y = d are done at once."""
    height, width = pixels.shape
    rest, out = parts(pixels), np.zeros((height, width + 1, 4), np.int64)
    out[0, 0] = (rest[0, 0] + [255, 0, 0, 0]) & 255
    rest[0, 1:] = (np.cumsum(rest[0, 1:], axis=0) + out[0, 0]) & 255
    out[0, 1:width] = rest[0, 1:]
    half = lambda a, b: a + b >> 1
    for d in range(2, width - 1 + 2 * (height - 1) + 1):
        y = np.arange(max(1, -(-(d - width + 1) // 2)), min(height - 1, d // 2) + 1)
        x = d - 2 * y
        top, left, corner = out[y - 1, x], out[y, x - 1], out[y - 1, x - 1]
        right = np.where((x == width - 1)[:, None], out[y, 0], out[y - 1, np.minimum(x + 1, width - 1)])
        mode = np.where(x == 0, 2, modes[y, x])[:, None]
        near_left = np.abs(top - corner).sum(1, keepdims=True) < np.abs(left - corner).sum(1, keepdims=True)
        mean = half(left, top)
        off = mean - corner
        guess = np.select(
            [mode == m for m in range(1, 14)],
            [
                left, top, right, corner, half(half(left, right), top), half(left, corner), mean, half(corner, top), half(top, right), half(half(left, corner), half(top, right)),
                np.where(near_left, left, top), np.clip(left + top - corner, 0, 255), np.clip(mean + np.sign(off) * (np.abs(off) // 2), 0, 255),
            ],
            np.array([255, 0, 0, 0]),
        )
        out[y, x] = (rest[y, x] + guess) & 255
    return joined(out[:, :width])


def recoloured(pixels: np.ndarray, factors: np.ndarray) -> np.ndarray:
    made = parts(pixels)
    signed = lambda a: (a & 0xFF) - ((a & 0x80) << 1)
    to_red, green_to_blue, red_to_blue = (signed(factors.astype(np.int64) >> s) for s in (0, 8, 16))
    green = signed(made[..., 2])
    made[..., 1] += to_red * green >> 5
    made[..., 3] += (green_to_blue * green >> 5) + (red_to_blue * signed(made[..., 1]) >> 5)
    return joined(made)


def unpacked(pixels: np.ndarray, palette: np.ndarray, bits: int, width: int) -> np.ndarray:
    index = pixels >> 8 & 0xFF
    if bits:
        each = 8 >> bits
        index = np.stack([index >> each * i & (1 << each) - 1 for i in range(1 << bits)], axis=-1).reshape(len(pixels), -1)[:, :width]
    return np.append(palette, np.zeros(256, np.uint32))[index]


def lossless(content: bytes) -> np.ndarray:
    """height x width numbers of a lossless chunk's body."""
    bits = Bits(content)
    if bits.take(8) != 0x2F:
        raise Unreadable("no lossless picture")
    width, height, _ = bits.take(14) + 1, bits.take(14) + 1, bits.take(1)
    if bits.take(3):
        raise Unread("another version")
    undo, seen, now = [], set(), width
    while bits.take(1):
        kind = bits.take(2)
        if kind in seen:
            raise Unreadable("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICT, COLOUR):
            step = bits.take(3) + 2
            blocks = spread(image(bits, -(-now // (1 << step)), -(-height // (1 << step)), False), step, now, height)
            undo.append(lambda p, b=blocks, k=kind: predicted(p, (b >> 8 & 0xF).astype(np.int64)) if k == PREDICT else recoloured(p, b))
        elif kind == GREEN:
            undo.append(lambda p: joined(parts(p) + (parts(p)[..., 2:3] * [0, 1, 0, 1])))
        else:
            n = bits.take(8) + 1
            palette = joined(np.cumsum(parts(image(bits, n, 1, False)[0]), axis=0))
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(lambda p, c=palette, b=packed, w=now: unpacked(p, c, b, w))
            now = -(-now // (1 << packed))
    made = image(bits, now, height, True)
    for step_ in reversed(undo):
        made = step_(made)
    return made


def bands(content: bytes) -> tuple[int, int, Iterator[np.ndarray]]:
    """Height, width, and the picture (lines x width x 3 or 4 bytes: red, green, blue and, if the file has it, alpha) in one band."""
    elements, complete = binary.riff(content)
    found = {e.kind: e for e in elements}
    if not complete or not {"VP8 ", "VP8L", "VP8X", "ANIM"} & set(found):
        raise Unreadable("no whole WebP")
    if "VP8L" not in found or "ANIM" in found:
        raise Unread("lossy or animated")
    e = found["VP8L"]
    body = content[e.body : e.start + e.total]
    if len(body) < 5:
        raise Unreadable("the picture's data end early")
    head = int.from_bytes(body[1:5], "little")
    width, height = (head & 0x3FFF) + 1, (head >> 14 & 0x3FFF) + 1

    def made() -> Iterator[np.ndarray]:
        argb = parts(lossless(body)).astype(np.uint8)
        yield argb[..., [1, 2, 3, 0]] if head >> 28 & 1 else argb[..., 1:]

    return height, width, made()
