"""Sound of FLAC files: frames of predicted samples and coded differences, checked by their sums and by the digest of all."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from operator import mul
from typing import NamedTuple

import numpy as np

from . import binary
from .jpeg import Unread, Unreadable

# Rates, sample sizes and block sizes by code; polynomials of the two sums; factors of the fixed predictors.
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
BLOCKS = {1: 192, **{c: 576 << c - 2 for c in range(2, 6)}, **{c: 256 << c - 8 for c in range(8, 16)}}
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10
SYNC, CRC_8, CRC_16 = 0x3FFE, 0x07, 0x8005
#: No sample of a sound file is that large; damaged ones may lead there.
LARGEST = 1 << 40


class Info(NamedTuple):
    rate: int
    channels: int
    depth: int
    total: int  # samples of a channel; 0: not said
    digest: bytes


def _table(polynomial: int, width: int) -> list[int]:
    made = []
    for byte in range(256):
        value = byte << width - 8
        for _ in range(8):
            value = (value << 1) ^ (polynomial if value >> width - 1 else 0)
            value &= (1 << width) - 1
        made.append(value)
    return made


_SUM_8, _SUM_16 = _table(CRC_8, 8), _table(CRC_16, 16)


def sum_8(content: bytes) -> int:
    value = 0
    for b in content:
        value = _SUM_8[value ^ b]
    return value


def sum_16(content: bytes) -> int:
    value = 0
    for b in content:
        value = _SUM_16[value >> 8 ^ b] ^ value << 8 & 0xFFFF
    return value


class Bits:
    def __init__(self, content: bytes, at: int):
        self.content, self.at = content, 8 * at  # in bits

    def take(self, n: int) -> int:
        first, upto = self.at >> 3, self.at + n + 7 >> 3
        if upto > len(self.content):
            raise Unreadable("the sound's data end early")
        self.at += n
        return int.from_bytes(self.content[first:upto], "big") >> 8 * upto - self.at & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> n - 1 else v

    def zeros(self) -> int:
        """How many zeros come before the next one, which is taken too."""
        begin = self.at
        while not (word := int.from_bytes(self.content[self.at >> 3 : (self.at >> 3) + 8].ljust(8, b"\0"), "big") & (1 << 64 - (self.at & 7)) - 1):
            self.at = (self.at >> 3) + 8 << 3
            if self.at >= 8 * len(self.content):
                raise Unreadable("the sound's data end early")
        self.at = (self.at >> 3 << 3) + 64 - word.bit_length() + 1
        return self.at - begin - 1

    def rice(self, n: int, k: int) -> list[int]:
        """n numbers: a quotient in ones' distances, k bits of rest; odd ones are negative."""
        content, at, out = self.content, self.at, []
        limit, rest = 8 * len(content), (1 << k) - 1
        for _ in range(n):
            word = int.from_bytes(content[at >> 3 : (at >> 3) + 8], "big") & (1 << 64 - (at & 7)) - 1
            used = 64 - word.bit_length() + 1  # from the byte's start to behind the one
            if word and used + k <= 64 and (at >> 3) + 8 <= len(content):
                value = used - 1 - (at & 7) << k | word >> 64 - used - k & rest
                at = (at >> 3 << 3) + used + k
            else:
                self.at = at
                value = self.zeros() << k
                value |= self.take(k)
                at = self.at
            out.append(value >> 1 ^ -(value & 1))
        if at > limit:
            raise Unreadable("the sound's data end early")
        self.at = at
        return out


def residual(bits: Bits, order: int, size: int) -> list[int]:
    method, parts = bits.take(2), 1 << bits.take(4)
    if method > 1 or size % parts or size // parts < order:
        raise Unreadable("no such coding of differences")
    width, out = 4 + method, []
    for i in range(parts):
        n, k = size // parts - (order if i == 0 else 0), bits.take(width)
        if k == (1 << width) - 1:  # as they are
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(n)]
        else:
            out += bits.rice(n, k)
    return out


def subframe(bits: Bits, depth: int, size: int) -> np.ndarray:
    head = bits.take(8)
    if head >> 7:
        raise Unreadable("no subframe")
    kind, wasted = head >> 1 & 63, 0
    if head & 1:
        wasted = bits.zeros() + 1
        depth -= wasted
    if depth < 1:
        raise Unreadable("no bits are left of a sample")
    if kind == 0:
        made = np.full(size, bits.signed(depth), np.int64)
    elif kind == 1:
        made = np.array([bits.signed(depth) for _ in range(size)], np.int64)
    elif 8 <= kind <= 12 and kind - 8 <= size:
        order = kind - 8
        first = [bits.signed(depth) for _ in range(order)]
        made = np.array(first + residual(bits, order, size), np.int64)
        # differences of differences: each sum begins with what the first samples say of it
        starts = [np.diff(np.array(first, np.int64), n=o)[:1] for o in range(order)]
        run = made[order:]
        for o in reversed(range(order)):
            run = np.cumsum(np.concatenate([starts[o], run]))
        made = run if order else made
    elif kind >= 32 and kind - 31 <= size:
        order = kind - 31
        done = [bits.signed(depth) for _ in range(order)]
        precision, shift = bits.take(4) + 1, bits.signed(5)
        if precision == 16 or shift < 0:
            raise Unreadable("no such predictor")
        factors = [bits.signed(precision) for _ in range(order)][::-1]
        for difference in residual(bits, order, size):
            done.append((sum(map(mul, factors, done[-order:])) >> shift) + difference)
            if not -LARGEST < done[-1] < LARGEST:
                raise Unreadable("a sample is too large")
        made = np.array(done, np.int64)
    else:
        raise Unreadable("no such subframe")
    return made << wasted


def info_of(content: bytes) -> tuple[Info, int]:
    """What the file says of itself, and where its frames start."""
    found, complete = binary.flac(content)
    if content[:4] != b"fLaC" or not complete or found[0].kind != "0" or found[0].total != 38:
        raise Unreadable("no whole FLAC")
    packed, digest = struct.unpack_from(">10xQ16s", content, found[0].body)
    info = Info(packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, digest)
    if not info.rate or info.depth < 4:
        raise Unreadable("no rate or no depth")
    return info, found[-1].start + found[-1].total


def frames(content: bytes, info: Info, at: int) -> Iterator[np.ndarray]:
    """Samples x channels, a frame at a time."""
    done = 0
    while at < len(content) and not (info.total and done >= info.total):
        bits = Bits(content, at)
        if bits.take(14) != SYNC or bits.take(1):
            raise Unreadable("no frame where one should be")
        bits.take(1)
        block, rate, layout, depth = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        if bits.take(1) or layout > MID_SIDE or not block or rate == 15 or depth == 3:
            raise Unreadable("no such frame")
        lead = bits.take(8)
        ones = 8 - (~lead & 0xFF).bit_length()
        if ones == 1 or ones == 8:
            raise Unreadable("no such frame number")
        bits.take(8 * max(0, ones - 1))
        size = bits.take(8) + 1 if block == 6 else bits.take(16) + 1 if block == 7 else BLOCKS[block]
        bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
        if bits.take(8) != sum_8(content[at : (bits.at >> 3) - 1]):
            raise Unreadable("a frame's head is damaged")
        wide = DEPTHS.get(depth, info.depth)
        channels = layout + 1 if layout < LEFT_SIDE else 2
        if wide != info.depth or channels != info.channels:
            raise Unread("frames of several kinds")
        wider = [layout == SIDE_RIGHT, layout in (LEFT_SIDE, MID_SIDE)] if layout >= LEFT_SIDE else [False] * channels
        one = [subframe(bits, wide + w, size) for w in wider]
        if layout == LEFT_SIDE:
            one[1] = one[0] - one[1]
        elif layout == SIDE_RIGHT:
            one[0] = one[0] + one[1]
        elif layout == MID_SIDE:
            twice = one[0] * 2 + (one[1] & 1)
            one = [twice + one[1] >> 1, twice - one[1] >> 1]
        end = bits.at + 7 >> 3
        bits.at = 8 * end
        if bits.take(16) != sum_16(content[at:end]):
            raise Unreadable("a frame is damaged")
        at, done = end + 2, done + size
        yield np.stack(one, axis=1)
    if info.total and done != info.total:
        raise Unreadable("the sound's data end early")


def numbers(content: bytes) -> tuple[Info, np.ndarray]:
    """The file's facts, and its samples x channels as whole numbers. Raises Unreadable where sums or the digest don't match."""
    info, at = info_of(content)
    whole = np.concatenate([np.empty((0, info.channels), np.int64), *frames(content, info, at)])
    size = (info.depth + 7) // 8
    if any(info.digest):
        plain = whole.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :size].tobytes()
        if hashlib.md5(plain).digest() != info.digest:
            raise Unreadable("the digest does not match")
    return info, whole
