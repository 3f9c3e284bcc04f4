"""Pixels of JPEG files in bands of lines: Huffman codes to coefficients, then dequantisation, inverse cosine transform,
upsampling and colours over arrays of blocks.

Sequential pictures whose one scan holds all components are decoded some rows of units at a time, so memory follows their
width, and their codes are read at many places at once, those of several files together (``huffman``). Progressive ones, and those
of several scans, are read code by code and need all coefficients (two bytes each) before their first line.
"""

from __future__ import annotations

import functools
import itertools
import struct
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

from . import huffman
from .huffman import ZIGZAG, Unread, Unreadable

#: Blocks of a component that are made pixels of at once, or one line of them; codes of files that are read together. No effect on results.
AT_ONCE, TOGETHER = 4096, 32
# Fixed values of the format: markers.
SOF0, SOF1, SOF2, DHT, EOI, SOS, DQT, DRI, APP14 = 0xC0, 0xC1, 0xC2, 0xC4, 0xD9, 0xDA, 0xDB, 0xDD, 0xEE
OTHER_FRAMES = {0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)}
#: What a value on the edge of rounding is lifted by, so that the order of sums doesn't decide it.
LIFT = 1e-6
_C = np.array([[(0.125**0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_BOTH = np.kron(_C, _C)  # all of a block's samples by all of its coefficients
_NONE = (bytes(16), b"")  # no codes
# What of_coefficients writes: zeros * 16 + bits of a value, the end, sixteen zeros; codes of up to three times these; bits of a number.
_SIZES = bytes([16 * zeros + n for zeros in range(16) for n in range(1, 11)] + [0, huffman.ZEROS])
_SKIPS = np.array([0, 161, 161 << 8 | 161, 161 << 16 | 161 << 8 | 161])
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int64)
_ZIGZAG = np.array(ZIGZAG)


@dataclass
class Component:
    number: int
    across: int  # sampling factors
    down: int
    table: int
    width: int = 0  # in samples
    height: int = 0
    blocks: int = 0  # in a line of blocks, whole units
    lines: int = 0  # of blocks, whole units
    quantum: np.ndarray | None = None
    kept: array | None = None  # coefficients of all blocks


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    progressive: bool = False
    components: list[Component] = field(default_factory=list)
    colours: int | None = None  # what the writer says of them
    restart: int = 0
    quanta: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[int, huffman.Codes] = field(default_factory=dict)

    @property
    def unit(self) -> tuple[int, int]:
        """Samples of the finest component in a unit, across and down."""
        return 8 * max(c.across for c in self.components), 8 * max(c.down for c in self.components)

    @property
    def units(self) -> tuple[int, int]:
        return -(-self.width // self.unit[0]), -(-self.height // self.unit[1])


@functools.lru_cache(16)
def lookup(codes: huffman.Codes) -> list[int]:
    """By the next 16 bits: the code's length << 8 | its value; 0 where no code begins so."""
    return huffman.lookup(*codes).tolist()


class Reader:
    """The coded data of a scan, an interval between restarts at a time."""

    def __init__(self, intervals: list[bytes]):
        self.intervals, self.number = intervals, -1
        self.restart()

    def restart(self) -> None:
        self.number += 1
        if self.number >= len(self.intervals):
            raise Unreadable("the picture's data end early")
        self.data = self.intervals[self.number]
        self.base, self.at, self.window = 0, 0, array("I")

    def ready(self, blocks: int) -> None:
        """32 bits from every byte that so many blocks may take; self.at counts bits from the window's start."""
        self.checked()
        self.base, self.at = self.base + (self.at >> 3), self.at & 7
        part = np.frombuffer(self.data, np.uint8)[self.base : self.base + blocks * 260 + 8].astype(np.uint32)
        part = np.concatenate([part, np.zeros(8, np.uint32)])
        self.window = array("I", (part[:-3] << 24 | part[1:-2] << 16 | part[2:-1] << 8 | part[3:]).tobytes())

    def checked(self) -> None:
        if 8 * self.base + self.at > 8 * len(self.data):
            raise Unreadable("the picture's data end early")

    def bits(self, n: int) -> int:
        at = self.at
        self.at = at + n
        return self.window[at >> 3] >> 32 - (at & 7) - n & (1 << n) - 1

    def value(self, codes: list[int]) -> int:
        at = self.at
        found = codes[self.window[at >> 3] >> 16 - (at & 7) & 0xFFFF]
        if not found:
            raise Unreadable("no such code")
        self.at = at + (found >> 8)
        return found & 255

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.bits(n)
        return v if v >> n - 1 else v - (1 << n) + 1


def sequential(reader: Reader, out: array, at: int, dc: list[int], ac: list[int]) -> int:
    """One block's coefficients; returns the difference of its first one."""
    size = reader.value(dc)
    if size > 15:
        raise Unreadable("no such size")
    first = reader.signed(size)
    window, place, k = reader.window, reader.at, 1
    while k < 64:  # the loop that all time goes to: nothing is called in it
        found = ac[window[place >> 3] >> 16 - (place & 7) & 0xFFFF]
        if not found:
            raise Unreadable("no such code")
        place += found >> 8
        n = found & 15
        if not n:
            if found & 255 != 0xF0:
                break
            k += 16
            continue
        k += found >> 4 & 15
        if k > 63:
            raise Unreadable("a block has too many coefficients")
        v = window[place >> 3] >> 32 - (place & 7) - n & (1 << n) - 1
        place += n
        out[at + ZIGZAG[k]] = v if v >> n - 1 else v - (1 << n) + 1
        k += 1
    reader.at = place
    return first


class Progressive:
    """Blocks of one progressive scan; ``run``: blocks that have no more coefficients in it."""

    def __init__(self, start: int, end: int, high: int, low: int):
        self.start, self.end, self.high, self.low, self.run = start, end, high, low, 0

    def ac_first(self, reader: Reader, out: array, at: int, ac: list[int]) -> None:
        if self.run:
            self.run -= 1
            return
        k = self.start
        while k <= self.end:
            value = reader.value(ac)
            zeros, n = value >> 4, value & 15
            if n:
                k += zeros
                if k > 63:
                    raise Unreadable("a block has too many coefficients")
                out[at + ZIGZAG[k]] = reader.signed(n) << self.low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                self.run = (1 << zeros) + reader.bits(zeros) - 1
                return

    def ac_more(self, reader: Reader, out: array, at: int, ac: list[int]) -> None:
        """One more bit of each coefficient that is there, and new ones between them."""
        one, k = 1 << self.low, self.start

        def refine(place: int) -> None:
            if reader.bits(1) and not abs(out[place]) & one:
                out[place] += one if out[place] > 0 else -one

        while k <= self.end and not self.run:
            value = reader.value(ac)
            zeros, n = value >> 4, value & 15
            new = 0
            if n:
                new = one if reader.bits(1) else -one
            elif zeros < 15:
                self.run = (1 << zeros) + reader.bits(zeros)
                break
            while k <= self.end:
                place = at + ZIGZAG[k]
                k += 1
                if out[place]:
                    refine(place)
                elif zeros:
                    zeros -= 1
                else:
                    out[place] = new
                    break
        if self.run:
            for i in range(k, self.end + 1):
                if out[at + ZIGZAG[i]]:
                    refine(at + ZIGZAG[i])
            self.run -= 1


def intervals(content: bytes, at: int) -> tuple[list[bytes], int]:
    """The coded data from here on, stuffed bytes taken out, by restarts; and where the next marker is."""
    found, start = [], at
    while True:
        at = content.find(b"\xff", at)
        if at < 0 or at + 1 >= len(content):
            at = len(content)
        elif content[at + 1] == 0:
            at += 2
            continue
        elif content[at + 1] == 0xFF:  # fill
            at += 1
            continue
        found.append(content[start:at].replace(b"\xff\x00", b"\xff"))
        if at < len(content) and 0xD0 <= content[at + 1] <= 0xD7:
            at += 2
            start = at
            continue
        return found, at


def frame(picture: Picture, marker: int, body: bytes) -> None:
    if picture.components:
        raise Unreadable("two frames")
    if len(body) < 6:
        raise Unreadable("the frame is cut short")
    depth, picture.height, picture.width, n = struct.unpack_from(">BHHB", body)
    picture.progressive = marker == SOF2
    if depth != 8 or n not in (1, 3):
        raise Unread("neither grey nor three colours of 8 bits")
    if len(body) < 6 + 3 * n or not picture.width or not picture.height:
        raise Unreadable("no such frame")
    for i in range(n):
        number, factors, table = body[6 + 3 * i : 9 + 3 * i]
        c = Component(number, factors >> 4, factors & 15, table)
        if not 1 <= c.across <= 4 or not 1 <= c.down <= 4:
            raise Unreadable("no such sampling factor")
        if n == 1:
            c.across = c.down = 1
        picture.components.append(c)
    wide, high = picture.unit
    for c in picture.components:
        if wide // 8 % c.across or high // 8 % c.down:
            raise Unread("sampling factors that don't divide")
        c.width, c.height = -(-picture.width * 8 * c.across // wide), -(-picture.height * 8 * c.down // high)
        c.blocks, c.lines = picture.units[0] * c.across, picture.units[1] * c.down


def tables(picture: Picture, marker: int, body: bytes) -> None:
    at = 0
    while at < len(body):
        kind, number = body[at] >> 4, body[at] & 15
        at += 1
        if marker == DQT:
            size = 128 if kind else 64
            if len(body) < at + size:
                raise Unreadable("a table is cut short")
            table = np.zeros(64, np.int64)
            table[ZIGZAG] = np.frombuffer(body, ">u2" if kind else np.uint8, 64, at)
            picture.quanta[number] = table
            at += size
        else:
            counts = body[at : at + 16]
            size = sum(counts)
            if len(body) < at + 16 + size or kind > 1:
                raise Unreadable("a table is cut short")
            picture.codes[kind << 4 | number] = counts, body[at + 16 : at + 16 + size]
            huffman.lookup(*picture.codes[kind << 4 | number])
            at += 16 + size


def chosen_of(picture: Picture, body: bytes) -> list[tuple[Component, int, int]]:
    """A scan's components, each with the numbers of its codes."""
    n = body[0] if body else 0
    if len(body) < 4 + 2 * n or not n:
        raise Unreadable("the scan is cut short")
    by_number = {c.number: c for c in picture.components}
    chosen = []
    for i in range(n):
        number, which = body[1 + 2 * i : 3 + 2 * i]
        if number not in by_number:
            raise Unreadable("a scan of no component")
        chosen.append((by_number[number], which >> 4, 16 | which & 15))
    for c, *_ in chosen:
        if c.quantum is None:
            if c.table not in picture.quanta:
                raise Unreadable("a table is missing")
            c.quantum = picture.quanta[c.table]
    return chosen


def scan_lines(picture: Picture, body: bytes, reader: Reader) -> Iterator[None]:
    """Decodes a scan code by code into the components' kept coefficients, line of units by line."""
    chosen = chosen_of(picture, body)
    n = len(chosen)
    start, end, steps = body[1 + 2 * n : 4 + 2 * n]
    high, low = steps >> 4, steps & 15
    if not picture.progressive:
        start, end, high, low = 0, 63, 0, 0
    elif start > end or end > 63 or low > 13 or (start == 0) != (end == 0) or start and n > 1:
        raise Unreadable("no such scan")
    first, more = start == 0, end > 0
    code = lambda which: lookup(picture.codes.get(which, _NONE))
    if n == 1:  # a unit is one block, and there are only blocks with samples
        c = chosen[0][0]
        across, down = -(-c.width // 8), -(-c.height // 8)
        shape = [(c, 0, 0, chosen[0][1], chosen[0][2])]
    else:
        across, down = picture.units
        shape = [(c, x, y, dc, ac) for c, dc, ac in chosen for y in range(c.down) for x in range(c.across)]
    step = lambda c: (1, 1) if n == 1 else (c.across, c.down)
    steps_ = [(*step(c), x, y, c.blocks, i, code(dc) if first and not high else None, code(ac) if more else None) for c, x, y, dc, ac in shape for i in [[d.number for d, *_ in chosen].index(c.number)]]
    before, left = [0] * n, picture.restart
    scan = Progressive(start, end, high, low)
    ac_block = scan.ac_more if high else scan.ac_first
    for line in range(down):
        outs = [c.kept for c, *_ in chosen]
        reader.ready(across * len(shape))
        try:
            for unit in range(across):
                if picture.restart and not left:
                    reader.checked()
                    reader.restart()
                    reader.ready((across - unit) * len(shape))
                    before, left, scan.run = [0] * n, picture.restart, 0
                left -= 1
                for wide, tall, x, y, blocks, i, dc, ac in steps_:
                    at = 64 * ((line * tall + y) * blocks + unit * wide + x)
                    out = outs[i]
                    if not picture.progressive:
                        before[i] += sequential(reader, out, at, dc, ac)
                        out[at] = before[i]
                    elif more:
                        ac_block(reader, out, at, ac)
                    elif high:
                        out[at] |= reader.bits(1) << low
                    else:
                        before[i] += reader.signed(min(reader.value(dc), 16))
                        out[at] = before[i] << low
        except (IndexError, OverflowError) as e:  # beyond the data, or beyond 16 bits
            raise Unreadable("the picture's data are broken") from e
        reader.checked()
        yield


def samples_of(c: Component, coefficients: array | np.ndarray, lines: int) -> np.ndarray:
    """Lines of blocks as samples, 0 to 255, with no more columns than the component has."""
    blocks = np.frombuffer(coefficients, np.int16).reshape(-1, 64)
    used = np.flatnonzero(blocks.any(axis=0))
    made = blocks[:, used].astype(np.float64) @ (c.quantum[used, None] * _BOTH[used])
    made += 128.5 + LIFT
    made = np.minimum(np.maximum(made, 0, out=made), 255, out=made).astype(np.uint8)  # cut, so rounded down
    return made.reshape(lines, -1, 8, 8).swapaxes(1, 2).reshape(8 * lines, -1)[:, : c.width]


def between(a: np.ndarray, width: int) -> np.ndarray:
    """Twice the columns: each sample three parts, its neighbour one; a holds sums of four parts already if it is wide."""
    a = a.astype(np.int32)
    out = np.empty((len(a), 2 * a.shape[1]), np.int32)
    left, right = np.concatenate([a[:, :1], a[:, :-1]], axis=1), np.concatenate([a[:, 1:], a[:, -1:]], axis=1)
    out[:, ::2], out[:, 1::2] = 3 * a + left, 3 * a + right
    return out[:, :width]


def upsampled(part: np.ndarray, above: np.ndarray, below: np.ndarray, across: int, down: int, width: int) -> np.ndarray:
    """Samples for all pixels. By two in either direction: three parts of the nearer sample and one of the next; by more,
    repeated. above, below: the neighbouring lines."""
    if across <= 2 and down <= 2:
        parts, wide = 1, part.astype(np.int32)
        if down == 2:
            upper, lower = np.concatenate([above, part[:-1]]).astype(np.int32), np.concatenate([part[1:], below]).astype(np.int32)
            wide = np.stack([3 * wide + upper, 3 * wide + lower], axis=1).reshape(-1, part.shape[1])
            parts = 4
        if across == 2:
            wide, parts = between(wide, width), parts * 4
        return ((wide + parts // 2) // parts).astype(np.uint8) if parts > 1 else part
    return np.repeat(np.repeat(part, down, axis=0), across, axis=1)[:, :width]


def coloured(planes: list[np.ndarray], picture: Picture) -> np.ndarray:
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, axis=2)
    if picture.colours == 0 or picture.colours is None and [c.number for c in picture.components] == [*b"RGB"]:
        return np.stack(planes, axis=2)
    y, cb, cr = planes[0].astype(np.float64), planes[1] - 128.0, planes[2] - 128.0
    made = np.stack([y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.floor(made + (0.5 + LIFT)), 0, 255).astype(np.uint8)


def scans(content: bytes, picture: Picture) -> Iterator[tuple[bytes, list[bytes]]]:
    """Each scan's header and coded data; the picture's header is filled on the way."""
    at, some = 2, False
    while True:
        while content[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(content) or content[at] != 0xFF:
            if some and at >= len(content):
                return  # no end marker: what is missing shows later
            raise Unreadable("no marker where one should be")
        marker = content[at + 1]
        if marker == EOI:
            return
        if 0xD0 <= marker <= 0xD7 or marker == 1:
            at += 2
            continue
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        body = content[at + 4 : at + 2 + size]
        if size < 2 or at + 2 + size > len(content):
            raise Unreadable("a segment is cut short")
        at += 2 + size
        if marker in (SOF0, SOF1, SOF2):
            frame(picture, marker, body)
        elif marker in OTHER_FRAMES:
            raise Unread("arithmetic, lossless or differential coding")
        elif marker in (DQT, DHT):
            tables(picture, marker, body)
        elif marker == DRI and len(body) >= 2:
            picture.restart = int.from_bytes(body[:2], "big")
        elif marker == APP14 and body[:5] == b"Adobe" and len(body) >= 12:
            picture.colours = body[11]
        elif marker == SOS:
            if not picture.components:
                raise Unreadable("a scan before the frame")
            parts, at = intervals(content, at)
            yield body, parts
            some = True


def kept_strips(picture: Picture, rest: Iterator[tuple[bytes, list[bytes]]]) -> Iterator[list[np.ndarray]]:
    """The samples of each component, a line of units at a time, of a picture whose scans are all read first."""
    done = set()
    for body, parts in rest:
        for c in picture.components:
            c.kept = c.kept or array("h", bytes(2 * 64 * c.blocks * c.lines))
        for _ in scan_lines(picture, body, Reader(parts)):
            pass
        done |= {*body[1 : 1 + 2 * body[0] : 2]}
    if not picture.components or done != {c.number for c in picture.components}:
        raise Unreadable("a component has no scan")
    for line in range(picture.units[1]):
        yield [samples_of(c, c.kept[64 * c.blocks * c.down * line : 64 * c.blocks * c.down * (line + 1)], c.down) for c in picture.components]


def parts_of(picture: Picture, body: bytes, data: list[bytes]) -> list[huffman.Part]:
    """What is to be read of a scan of all components."""
    chosen = chosen_of(picture, body)
    if {c.number for c, *_ in chosen} != {c.number for c in picture.components}:
        raise Unreadable("a component has no scan")
    codes = tuple((picture.codes.get(dc, _NONE), picture.codes.get(ac, _NONE)) for c, dc, ac in chosen for _ in range(c.across * c.down))
    blocks = len(codes)
    codes = next(codes[:n] for n in range(1, blocks + 1) if codes == codes[:n] * (blocks // n))  # blocks of equal codes need not be told apart
    units = picture.units[0] * picture.units[1]
    each = picture.restart or units
    if len(data) < -(-units // each):
        raise Unreadable("the picture's data end early")
    return [huffman.Part(part, codes, min(each, units - first) * blocks) for part, first in zip(data, range(0, units, each))]


class Blocks:
    """Blocks of several pictures in their order."""

    def __init__(self, parts: list[huffman.Part]):
        self.made, self.first, self.held = huffman.decoded(parts), 0, np.zeros((0, 64), np.int16)

    def take(self, first: int, count: int) -> np.ndarray:
        """So many from the first one on; what is before them is gone."""
        found, n = [], 0
        while n < count:
            if self.first + len(self.held) <= first + n:
                self.first, self.held = next(self.made, (1 << 62, np.zeros((1, 64), np.int16)))
            elif self.first > first + n:
                raise Unreadable("the picture's data are broken")
            else:
                at = first + n - self.first
                found.append(self.held[at : at + count - n])
                n += len(found[-1])
        return found[0] if len(found) == 1 else np.concatenate(found)


def differences_undone(d: np.ndarray, before: int, first: int, restart: int) -> np.ndarray:
    """units x blocks of differences, from unit first on, as running sums that begin anew at restarts."""
    made = d.astype(np.int64).cumsum().reshape(d.shape)
    anew = np.arange(-first % restart, len(d), restart) if restart else np.zeros(0, np.int64)
    base = np.append(-before, made[anew, 0] - d[anew, 0])
    made -= base[np.searchsorted(anew, np.arange(len(d)), side="right"), None]
    if made.min() < -1 << 15 or made.max() >= 1 << 15:
        raise Unreadable("the picture's data are broken")
    return made


def strips(picture: Picture, body: bytes, blocks: Blocks, number: int) -> Iterator[list[np.ndarray]]:
    """The samples of each component, some lines of units at a time, of a picture in one scan; number: its first block's."""
    order = [c for c, *_ in chosen_of(picture, body)]
    unit = sum(c.across * c.down for c in order)
    across, down = picture.units
    before = [0] * len(order)
    lines = max(1, AT_ONCE // (across * max(c.across * c.down for c in order)))
    for line in range(0, down, lines):
        n = min(lines, down - line)
        some = blocks.take(number + line * across * unit, n * across * unit).reshape(n * across, unit, 64)
        made, at = {}, 0
        for i, c in enumerate(order):
            mine = some[:, at : at + c.across * c.down].copy()
            at += c.across * c.down
            mine[..., 0] = sums = differences_undone(mine[..., 0], before[i], line * across, picture.restart)
            before[i] = int(sums[-1, -1])
            mine = mine.reshape(n, across, c.down, c.across, 64).swapaxes(1, 2)
            made[c.number] = samples_of(c, np.ascontiguousarray(mine), n * c.down)
        yield [made[c.number] for c in picture.components]


def header(content: bytes) -> Picture:
    """The frame alone: size, components and their sampling factors."""
    picture, at = Picture(), 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if marker == 0xFF or 0xD0 <= marker <= 0xD7 or marker == 1:
            at += 1 if marker == 0xFF else 2
            continue
        if marker in (SOF0, SOF1, SOF2):
            frame(picture, marker, content[at + 4 : at + 2 + size])
            return picture
        if marker in OTHER_FRAMES:
            raise Unread("arithmetic, lossless or differential coding")
        if marker in (SOS, EOI):
            break
        at += 2 + size
    raise Unreadable("no frame")


Bands = tuple[int, int, Iterator[np.ndarray]]


def bands(content: bytes) -> Bands:
    """Height, width, and the picture's lines (lines x width x 3 bytes) in bands, top to bottom."""
    return next(several([content]))()


def several(contents: Sequence[bytes]) -> Iterator[Callable[[], Bands]]:
    """What gives each picture's bands, or raises Unread or Unreadable, in this order; one is looked at before the next is taken.
    The codes of several pictures are read together."""
    waiting: list[tuple] = []
    parts: list[huffman.Part] = []
    codes: set = set()
    number = 0

    def opened() -> Iterator[Callable[[], Bands]]:
        blocks = Blocks(parts)
        for made, first in waiting:
            yield functools.partial(made, blocks, first)

    for content in contents:
        made, mine = prepared(content)
        new = {c for p in mine[:1] for pair in p.units for c in enumerate(pair)}
        if codes and len(codes | new) > TOGETHER:
            yield from opened()
            waiting, parts, codes, number = [], [], set(), 0
        waiting.append((made, number))
        parts += mine
        codes |= new
        number += sum(p.blocks for p in mine)
    yield from opened()


def prepared(content: bytes) -> tuple[Callable[[Blocks, int], Bands], list[huffman.Part]]:
    """What gives a picture's bands by the blocks of several pictures and the number of its first one; and what is to be read for them."""
    try:
        head, picture = header(content), Picture()
        rest = scans(content, picture)
        scan = next(rest, None)
        if scan and not picture.progressive and scan[0][:1] == bytes([len(picture.components)]):
            parts = parts_of(picture, *scan)
            return lambda blocks, number: (head.height, head.width, _bands(picture, strips(picture, scan[0], blocks, number))), parts
        return lambda *_: (head.height, head.width, _bands(picture, kept_strips(picture, itertools.chain([scan] if scan else [], rest)))), []
    except (Unread, Unreadable) as e:
        error = e

    def refused(*_) -> Bands:
        raise error

    return refused, []


def _bands(picture: Picture, parts: Iterator[list[np.ndarray]]) -> Iterator[np.ndarray]:
    first = 0
    held: list = []  # the strip before, this one
    last_lines: list[np.ndarray] = []

    def made(now: list[np.ndarray], following: list[np.ndarray] | None) -> np.ndarray:
        wide, high = picture.unit
        planes = []
        for i, c in enumerate(picture.components):
            seen = c.height - first // high * 8 * c.down  # lines of samples that are left from here on
            part = now[i][:seen]
            below = following[i][:1] if following is not None and seen > len(part) else part[-1:]
            above = last_lines[i] if last_lines else part[:1]
            planes.append(upsampled(part, above, below, wide // (8 * c.across), high // (8 * c.down), picture.width)[: picture.height - first])
        last_lines[:] = [n[-1:] for n in now]
        return coloured(planes, picture)

    for strip in parts:
        if held:
            yield made(held[0], strip)
            first += len(held[0][0]) // (8 * picture.components[0].down) * picture.unit[1]
        held = [strip]
    if held:
        yield made(held[0], None)


def subsampled(content: bytes) -> bool | None:
    """Whether a component's sampling factors differ from the first one's; None without a frame that is read here."""
    try:
        parts = header(content).components
    except (Unreadable, Unread):
        return None
    return any((c.across, c.down) != (parts[0].across, parts[0].down) for c in parts)


def packed(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Values of so many bits each (at most 48) one behind the other, whole bytes in all."""
    upto = np.cumsum(sizes)
    word, over = (upto - 1) >> 6, upto & 63
    over = np.where(over, over, 64)  # bits of the word that a value's last one lies in
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))  # no value is as long as a word, so one ends in each but perhaps the last
    values = values.astype(np.uint64)
    made = np.zeros(int(word[-1]) + 1, np.uint64)
    made[word[starts]] = np.bitwise_or.reduceat(values << (64 - over).astype(np.uint64), starts)
    split = np.flatnonzero(over < sizes)
    made[word[split] - 1] |= values[split] >> over[split].astype(np.uint64)
    return made.astype(">u8").tobytes()[: int(upto[-1]) >> 3]


def of_coefficients(width: int, height: int, planes: list[np.ndarray], factors: list[tuple[int, int]], quantum: np.ndarray | None = None, restart: int = 0) -> bytes:
    """A sequential JPEG of given coefficients. planes: per component lines x blocks x 64, whole units, in natural order.
    All codes have one length; restart: units between restart markers."""
    quantum = np.ones(64, np.uint8) if quantum is None else quantum
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, 2 + len(body)) + body
    head = segment(DQT, b"\0" + bytes(np.asarray(quantum)[_ZIGZAG].tolist()))
    head += segment(SOF0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, a << 4 | d, 0]) for i, (a, d) in enumerate(factors)))
    head += segment(DHT, bytes([0, 0, 0, 0, 12, *[0] * 12, *range(12)]) + bytes([16, *[0] * 7, len(_SIZES), *[0] * 8]) + _SIZES)
    head += segment(DRI, struct.pack(">H", restart)) if restart else b""
    head += segment(SOS, bytes([len(planes), *(x for i in range(len(planes)) for x in (i + 1, 0)), 0, 63, 0]))
    across, down = planes[0].shape[1] // factors[0][0], planes[0].shape[0] // factors[0][1]
    units = across * down
    each, differences = [], []
    for plane, (a, d) in zip(planes, factors):
        mine = plane.reshape(down, d, across, a, 64).swapaxes(1, 2).reshape(units, d * a, 64)
        before = np.roll(mine[..., 0].astype(np.int64).ravel(), 1).reshape(units, d * a)
        before[:: restart or units, 0] = 0
        each.append(mine)
        differences.append(mine[..., 0] - before)
    blocks = np.concatenate(each, axis=1).reshape(-1, 64)[:, _ZIGZAG]
    first = np.concatenate(differences, axis=1).ravel()
    blocks[:, 0] = 0
    there = np.flatnonzero(blocks.reshape(-1) != 0)
    block, k, v = there >> 6, there & 63, blocks.reshape(-1)[there].astype(np.int64)
    zeros = k - 1
    zeros[1:] -= (block[1:] == block[:-1]) * k[:-1]
    n, size = _BITS[np.abs(v)], _BITS[np.abs(first)]
    if n.max(initial=0) > 10:
        raise ValueError("a coefficient that has no code")
    spelt = lambda v, n: v + (v < 0) * ((1 << n) - 1)
    # what is written, in order: per block its first coefficient, the others, perhaps an end, and behind the last block of an interval ones up to a whole byte
    many = np.bincount(block, minlength=len(blocks))
    short = np.ones(len(blocks), bool)
    short[block[k == 63]] = False
    closing = np.zeros(len(blocks), bool)
    closing[(restart or units) * (len(blocks) // units) - 1 :: (restart or units) * (len(blocks) // units)] = closing[-1] = True
    total = 1 + many + short + closing
    upto = np.cumsum(total)
    at = upto - total
    values, lengths = np.zeros((2, int(upto[-1])), np.int64)
    values[at], lengths[at] = size << size | spelt(first, size), 4 + size
    to = at[block] + 1 + np.arange(len(block)) - (np.cumsum(many) - many)[block]
    skips = zeros >> 4
    values[to], lengths[to] = (_SKIPS[skips] << 8 | (zeros & 15) * 10 + n - 1) << n | spelt(v, n), 8 * skips + 8 + n
    to = (upto - closing - 1)[short]
    values[to], lengths[to] = len(_SIZES) - 2, 8
    ends = upto[closing] - 1
    bits = np.cumsum(lengths)[ends]
    lengths[ends] = -np.diff(bits, prepend=0) % 8
    values[ends] = (1 << lengths[ends]) - 1
    data, upto = packed(values, lengths), np.cumsum(np.diff(bits, prepend=0) + 7 >> 3).tolist()
    parts = [data[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip([0, *upto], upto)]
    coded = b"".join(part + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(parts) else b"") for i, part in enumerate(parts))
    return b"\xff\xd8" + head + coded + b"\xff\xd9"
