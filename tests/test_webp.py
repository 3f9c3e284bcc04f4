"""Lossless WebP: files written here bit by bit, with every transform, code and copy, against plain pixel-by-pixel Python."""

import random

import numpy as np
import pytest
from test_containers import riff

from marklens.functions import samples, webp

MASK = 0xFFFFFFFF


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, v, n):
        self.value |= v << self.n
        self.n += n

    def bytes(self):
        return self.value.to_bytes((self.n + 7) // 8, "little")


def put_code(w, rng, used, size):
    """A prefix code for these symbols; returns symbol -> (bits from the lowest, length)."""
    used = sorted(used) or [0]
    if len(used) <= 2 and max(used) < 256 and rng.random() < 0.7:
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(int(used[0] > 1), 1)
        w.put(used[0], 8 if used[0] > 1 else 1)
        for s in used[1:]:
            w.put(s, 8)
        lengths = dict.fromkeys(used, 1)
    else:
        lengths, depth = {}, max(1, (len(used) - 1).bit_length())
        short = (1 << depth) - len(used)
        for i, s in enumerate(used):
            lengths[s] = depth - 1 if i < short and depth > 1 else depth
        if len(used) == 1:
            lengths = {used[0]: 1}
        w.put(0, 1)
        w.put(15, 4)
        for _ in range(19):
            w.put(0, 0)
        order = webp.LENGTHS_ORDER
        kinds = sorted({0, 17, 18, *lengths.values()})
        own = {k: 3 if len(kinds) > 4 else 2 for k in kinds}
        while sum(2.0 ** -n for n in own.values()) < 1:
            k = max((k for k in kinds if own[k] > 1 and sum(2.0 ** -n for n in own.values()) + 2.0 ** -own[k] <= 1), default=None)
            if k is None:
                break
            own[k] -= 1
        for k in order:
            w.put(own.get(k, 0), 3)
        codes = canonical(own)
        w.put(0, 1)
        at = 0
        while at < size:
            run = 0
            while at + run < size and at + run not in lengths:
                run += 1
            if run >= 11:
                n = min(run, 138)
                w.put(*codes[18])
                w.put(n - 11, 7)
            elif run >= 3:
                n = min(run, 10)
                w.put(*codes[17])
                w.put(n - 3, 3)
            else:
                n = 1
                w.put(*codes[lengths.get(at, 0)])
            at += n
    return {used[0]: (0, 0)} if len(used) == 1 else canonical(lengths)


def canonical(lengths):
    out, code = {}, 0
    for n in range(1, 16):
        for s in sorted(lengths):
            if lengths[s] == n:
                out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
                code += 1
        code <<= 1
    return out


def coded_value(v):
    """Code, more bits, how many."""
    if v <= 4:
        return v - 1, 0, 0
    v -= 1
    n = v.bit_length() - 2
    return 2 * n + 2 + (v >> n & 1), v & (1 << n) - 1, n


def put_image(w, rng, pixels, outer, cache_bits=0, step=None):
    height, width = len(pixels), len(pixels[0])
    flat = [p for line in pixels for p in line]
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    across, groups = 1, [0]
    if outer:
        w.put(int(step is not None), 1)
        if step is not None:
            w.put(step - 2, 3)
            across, down = -(-width // (1 << step)), -(-height // (1 << step))
            groups = [rng.randrange(3) for _ in range(across * down)]
            put_image(w, rng, [[g << 8 for g in groups[y * across : (y + 1) * across]] for y in range(down)], False)
    of = lambda at: groups[(at // width >> step) * across + (at % width >> step)] if outer and step is not None else 0
    cache, items, at = {}, [], 0
    near = {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(webp.NEAR)))}
    while at < len(flat):
        best = max(((n, b) for b in {1, width, width + 1, 2, max(1, width - 1), 200} if b <= at for n in [next((i for i in range(min(70, len(flat) - at)) if flat[at + i] != flat[at + i - b]), min(70, len(flat) - at))]), default=(0, 0))
        slot = (0x1E35A7BD * flat[at] & MASK) >> 32 - cache_bits if cache_bits else None
        if best[0] >= 3:
            items.append((at, "copy", best[0], near.get(best[1], best[1] + 120)))
            n = best[0]
        elif slot is not None and cache.get(slot) == flat[at]:
            items.append((at, "cache", slot, 0))
            n = 1
        else:
            items.append((at, "pixel", flat[at], 0))
            n = 1
        if cache_bits:
            for p in flat[at : at + n]:
                cache[(0x1E35A7BD * p & MASK) >> 32 - cache_bits] = p
        at += n
    sizes = [280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    used = [[set() for _ in sizes] for _ in range(max(groups) + 1)]

    def symbols(item):
        at, kind, a, b = item
        if kind == "pixel":
            return [(0, a >> 8 & 255, 0, 0), (1, a >> 16 & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0)]
        if kind == "cache":
            return [(0, 280 + a, 0, 0)]
        (c1, v1, n1), (c2, v2, n2) = coded_value(a), coded_value(b)
        return [(0, 256 + c1, v1, n1), (4, c2, v2, n2)]

    for item in items:
        for which, s, *_ in symbols(item):
            used[of(item[0])][which].add(s)
    codes = [[put_code(w, rng, u, n) for u, n in zip(group, sizes)] for group in used]
    for item in items:
        for which, s, v, n in symbols(item):
            w.put(*codes[of(item[0])][which][s])
            w.put(v, n)


def split(p):
    return [p >> s & 255 for s in (24, 16, 8, 0)]


def join(c):
    return sum((v & 255) << s for v, s in zip(c, (24, 16, 8, 0)))


def guess(pixels, x, y, mode):
    at = lambda i, j: split(pixels[j][i])
    if x == y == 0:
        return [255, 0, 0, 0]
    if y == 0:
        return at(x - 1, 0)
    if x == 0:
        return at(0, y - 1)
    width = len(pixels[0])
    left, top, corner = at(x - 1, y), at(x, y - 1), at(x - 1, y - 1)
    right = at(x + 1, y - 1) if x + 1 < width else at(0, y)
    half = lambda a, b: [(i + j) // 2 for i, j in zip(a, b)]
    clamp = lambda v: min(255, max(0, v))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner))
        return left if to_left < sum(abs(v - c) for v, c in zip(left, corner)) else top
    if mode == 12:
        return [clamp(v + t - c) for v, t, c in zip(left, top, corner)]
    if mode == 13:
        return [clamp(a + int((a - c) / 2)) for a, c in zip(half(left, top), corner)]
    return [
        [255, 0, 0, 0], left, top, right, corner, half(half(left, right), top), half(left, corner), half(left, top), half(corner, top), half(top, right), half(half(left, corner), half(top, right))
    ][mode]


def written(pixels, rng, transforms=(), cache_bits=0, step=None, alpha=True):
    """A lossless WebP of lines of numbers."""
    height, width = len(pixels), len(pixels[0])
    w, now = Writer(), [list(line) for line in pixels]
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int(alpha), 1), (0, 3)):
        w.put(v, n)
    signed = lambda v: v - 256 if v > 127 else v
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        wide = len(now[0])
        if kind in (0, 1):
            bits = rng.choice([2, 3])
            w.put(bits - 2, 3)
            across, down = -(-wide // (1 << bits)), -(-height // (1 << bits))
            blocks = [[rng.randrange(14) << 8 if kind == 0 else rng.randrange(1 << 24) for _ in range(across)] for _ in range(down)]
            put_image(w, rng, blocks, False)
            made = [list(line) for line in now]
            for y in range(height):
                for x in range(wide):
                    b, p = blocks[y >> bits][x >> bits], split(now[y][x])
                    if kind == 0:
                        made[y][x] = join([a - g for a, g in zip(p, guess(now, x, y, b >> 8))])
                    else:
                        g2r, g2b, r2b = signed(b & 255), signed(b >> 8 & 255), signed(b >> 16 & 255)
                        made[y][x] = join([p[0], p[1] - (g2r * signed(p[2]) >> 5), p[2], p[3] - (g2b * signed(p[2]) >> 5) - (r2b * signed(p[1]) >> 5)])
            now = made
        elif kind == 2:
            now = [[join([a, r - g, g, b - g]) for a, r, g, b in map(split, line)] for line in now]
        else:
            palette = sorted({p for line in now for p in line})
            w.put(len(palette) - 1, 8)
            steps = [palette[0], *(join([a - b for a, b in zip(split(p), split(q))]) for p, q in zip(palette[1:], palette))]
            put_image(w, rng, [steps], False)
            bits = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
            each, n = 8 >> bits, 1 << bits
            index = [[palette.index(p) for p in line] + [0] * (-len(line) % n) for line in now]
            now = [[0xFF000000 | sum(line[i + k] << each * k for k in range(n)) << 8 for i in range(0, len(line), n)] for line in index]
    w.put(0, 1)
    put_image(w, rng, now, True, cache_bits, step)
    return riff(b"WEBP", (b"VP8L", w.bytes()))


def decoded(content):
    height, width, bands = webp.bands(content)
    whole = np.concatenate(list(bands))
    assert whole.shape[:2] == (height, width)
    return whole


def expected(pixels, alpha=True):
    made = np.array([[[p >> 16 & 255, p >> 8 & 255, p & 255, p >> 24] for p in line] for line in pixels], np.uint8)
    return made if alpha else made[..., :3]


def test_near_pixels():
    assert len(webp.NEAR) == 120 and webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)]


@pytest.mark.parametrize("transforms", [(), (2,), (0,), (1,), (3,), (2, 0), (0, 1, 2), (3, 0), (3, 2)])
@pytest.mark.parametrize("cache_bits,step", [(0, None), (4, 2)])
def test_pixels(transforms, cache_bits, step):
    rng = random.Random(str((transforms, cache_bits)))
    for width, height, colours in ((1, 1, 1), (19, 13, 300), (9, 21, 2), (16, 5, 4), (23, 6, 13), (300, 2, 40)):
        if 3 in transforms:
            colours = min(colours, 30)
        some = [rng.randrange(1 << 32) for _ in range(colours)]
        pixels = [[rng.choice(some) if rng.random() < 0.5 else some[(x // 4 + y // 3) % colours] for x in range(width)] for y in range(height)]
        content = written(pixels, rng, transforms, cache_bits, step)
        assert (decoded(content) == expected(pixels)).all(), (width, height)
        assert (decoded(written(pixels, rng, (), alpha=False)) == expected(pixels, False)).all()


def test_damage_and_other_forms():
    rng = random.Random(3)
    pixels = [[rng.randrange(1 << 32) for _ in range(12)] for _ in range(9)]
    content = written(pixels, rng, (2, 0))
    for i in range(20, len(content), 7):
        body = bytes([content[i] ^ 0x21])
        try:
            decoded(content[:i] + body + content[i + 1 :])
        except (webp.Unreadable, webp.Unread):
            pass
    with pytest.raises(webp.Unreadable):
        decoded(riff(b"WEBP", (b"VP8L", content[20:60])))
    for other in (riff(b"WEBP", (b"VP8 ", b"x" * 20)), riff(b"WEBP", (b"VP8X", bytes(10)), (b"ANIM", bytes(6)))):
        with pytest.raises(webp.Unread):
            decoded(other)
    assert samples.PICTURES["webp"] is webp.bands
