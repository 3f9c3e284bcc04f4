"""Samples of single files: pixels of PNG and JPEG, sound of WAV and FLAC, and how far two of a kind differ. One file's bytes in,
arrays or sums out.

Pictures come in bands of lines, so memory follows their width and not their size. A file that breaks its format raises
Unreadable; one whose form is not read here raises Unread.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np

from . import binary, flac, jpeg, webp
from .jpeg import Unread, Unreadable

#: Bytes of a band of lines, about; and of compressed data that are taken in at once.
BAND_BYTES, TAKEN_IN = 2**22, 2**16
# Channels by PNG colour type; the seven passes of interlaced pictures (first column and row, steps); luma
# weights; window edge and constants of structural similarity; frame, hop, floor and least frames of log spectra.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
LUMA = np.array([0.299, 0.587, 0.114])
WINDOW, C1, C2 = 8, (0.01 * 255) ** 2, (0.03 * 255) ** 2
FRAME, HOP, FLOOR, LEAST_FRAMES = 2048, 1024, 1e-10, 4
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int, above: np.ndarray | None = None) -> np.ndarray:
    """Lines of bytes with their filters undone; above: the line before the first one. Only bytes left of and above a byte count for
    it, so all bytes of an anti-diagonal (of groups of step bytes) are done at once: as many steps as lines and columns, not as bytes."""
    height, width = len(rows), rows.shape[1] // step
    if kinds.max() <= 2:  # each line is a running sum, or the line above and a difference
        made = np.zeros((height + 1, width, step), np.uint8)
        if above is not None:
            made[0] = above.reshape(width, step)
        for y, line in enumerate(rows.reshape(height, width, step)):
            made[y + 1] = line if kinds[y] == 0 else np.cumsum(line, axis=0, dtype=np.uint8) if kinds[y] == 1 else line + made[y]
        return made[1:].reshape(height, -1)
    raw = rows.reshape(height, width, step).astype(np.int16)
    out = np.zeros((height + 1, width + 1, step), np.int16)
    if above is not None:
        out[0, 1:] = above.reshape(width, step)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        kind = kinds[y, None]
        out[y + 1, x + 1] = (raw[y, x] + np.select([kind == 1, kind == 2, kind == 3, kind == 4], [a, b, (a + b) >> 1, nearest], 0)) & 255
    return out[1:, 1:].reshape(height, -1).astype(np.uint8)


class Inflated:
    """Bytes of a compressed stream, a few at a time."""

    def __init__(self, parts: list[memoryview]):
        self.source = (p[at : at + TAKEN_IN] for p in parts for at in range(0, len(p), TAKEN_IN))
        self.stream, self.waiting = zlib.decompressobj(), b""

    def read(self, n: int) -> bytes:
        found = []
        try:
            while n:
                if not self.waiting and (more := next(self.source, None)) is not None:
                    self.waiting = more
                made = self.stream.decompress(self.waiting, n)
                if not made and not self.waiting:
                    raise Unreadable("the picture's data end early")
                self.waiting = self.stream.unconsumed_tail
                found.append(made)
                n -= len(made)
        except zlib.error as e:
            raise Unreadable("the picture's data are broken") from e
        return b"".join(found)


class Lines:
    """The lines of a PNG, or of one pass of it."""

    def __init__(self, parts: list[memoryview], skip: int, width: int, depth: int, channels: int):
        self.stream, self.width, self.depth, self.channels, self.above = Inflated(parts), width, depth, channels, None
        self.per_line = (width * depth * channels + 7) // 8
        while skip:
            skip -= len(self.stream.read(min(skip, TAKEN_IN)))

    def next(self, n: int) -> np.ndarray:
        """n x width x channels numbers of depth bits."""
        rows = np.frombuffer(self.stream.read(n * (self.per_line + 1)), np.uint8).reshape(n, self.per_line + 1)
        if (kinds := rows[:, 0]).max() > 4:
            raise Unreadable("no such filter")
        data = unfiltered(kinds, rows[:, 1:], max(1, self.depth * self.channels // 8), self.above)
        self.above = data[-1]
        if self.depth == 16:
            data = np.ascontiguousarray(data).view(">u2")
        elif self.depth < 8:
            bits = np.unpackbits(data, axis=1).reshape(n, -1, self.depth)
            data = bits @ (1 << np.arange(self.depth)[::-1])
        return data[:, : self.width * self.channels].reshape(n, self.width, self.channels).astype(np.uint16)


def png_bands(content: bytes) -> tuple[int, int, Iterator[np.ndarray]]:
    """Height, width, and lines (lines x width x 3 or 4 bytes) in bands: palettes and transparent colours resolved, grey as three
    equal channels, of 16 bits the upper 8. Content after the picture's data is not looked at. An interlaced picture's passes
    are read side by side."""
    elements, complete = binary.png(content)
    view = memoryview(content)
    part = lambda kind: [view[e.body : e.start + e.total - 4] for e in elements if e.kind == kind]
    if not complete or not (head := part("IHDR")) or len(head[0]) < 13:
        raise Unreadable("no whole PNG")
    width, height, depth, colour, method, filters, interlaced = struct.unpack_from(">IIBBBBB", head[0])
    depths = {0: (1, 2, 4, 8, 16), 3: (1, 2, 4, 8)}.get(colour, (8, 16))
    if not width or not height or colour not in CHANNELS or depth not in depths or method or filters or interlaced > 1:
        raise Unreadable("no such PNG header")
    channels = CHANNELS[colour]
    passes = [p for p in PASSES if p[0] < width and p[1] < height] if interlaced else [(0, 0, 1, 1)]
    sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in passes]
    lengths = [h * ((w * depth * channels + 7) // 8 + 1) for w, h in sizes]
    clear, palette = part("tRNS"), part("PLTE")

    def bands() -> Iterator[np.ndarray]:
        read = [Lines(part("IDAT"), sum(lengths[:i]), w, depth, channels) for i, (w, _) in enumerate(sizes)]
        most = max(8, BAND_BYTES // (2 * channels * width) // 8 * 8)
        for top in range(0, height, most):
            here = min(most, height - top)
            made = np.zeros((here, width, channels), np.uint16)
            for lines, (x, y, dx, dy) in zip(read, passes):  # top is a multiple of 8, so each pass has whole lines in a band
                if y < here:
                    made[y::dy, x::dx] = lines.next(-(-(here - y) // dy))
            yield as_bytes(made, colour, depth, palette, clear)

    return height, width, bands()


def as_bytes(made: np.ndarray, colour: int, depth: int, palette: list, clear: list) -> np.ndarray:
    channels = CHANNELS[colour]
    if colour == 3:
        return resolved(made[..., 0], palette, clear)
    if clear and colour in (0, 2) and len(clear[0]) >= 2 * channels:
        key = np.frombuffer(clear[0], ">u2", channels)
        opaque = (made != key).any(-1, keepdims=True) * (2**depth - 1)
        made = np.concatenate([made, opaque.astype(np.uint16)], axis=-1)
    made = made >> 8 if depth == 16 else made * (255 // (2**depth - 1))
    if made.shape[-1] < 3:
        made = made[..., [0, 0, 0, 1][: 2 + made.shape[-1]]]
    return made.astype(np.uint8)


#: Readers of pictures by format.
PICTURES = {"png": png_bands, "jpeg": jpeg.bands, "webp": webp.bands}
Bands = jpeg.Bands


def pictures(forms: Sequence[str | None], contents: Sequence[bytes | None]) -> Iterator[Callable[[], Bands] | None]:
    """What gives each file's bands, or raises Unread or Unreadable; None for what is no picture or has no content. One is looked at
    before the next is taken: JPEG are read together."""
    together = jpeg.several([c for f, c in zip(forms, contents) if f == "jpeg" and c is not None])
    for f, c in zip(forms, contents):
        yield None if c is None or f not in PICTURES else next(together) if f == "jpeg" else functools.partial(PICTURES[f], c)


def in_windows(bands: Iterator[np.ndarray], lines: int = 8) -> Iterator[np.ndarray]:
    """The same lines in bands of a multiple of so many lines, but for the last one."""
    held: list[np.ndarray] = []
    for band in bands:
        held.append(band)
        n = sum(map(len, held))
        if whole := n // lines * lines:
            both = np.concatenate(held) if len(held) > 1 else band
            yield both[:whole]
            held = [both[whole:]] if whole < n else []
    if held:
        yield np.concatenate(held)


def side_by_side(a: Iterator[np.ndarray], b: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Two pictures of one size in bands of equal lines, whole windows but at the end."""
    one, two = np.empty((0, 0)), np.empty((0, 0))
    a, b = in_windows(a), in_windows(b)
    while True:
        one, two = (one if len(one) else next(a, one)), (two if len(two) else next(b, two))
        n = min(len(one), len(two))
        if not n:
            return
        yield one[:n], two[:n]
        one, two = one[n:], two[n:]


def png_pixels(content: bytes) -> np.ndarray:
    """A whole PNG's pixels."""
    return np.concatenate(list(png_bands(content)[2]))


def resolved(index: np.ndarray, palette: list, clear: list) -> np.ndarray:
    colours = np.frombuffer(palette[0][: len(palette[0]) // 3 * 3] if palette else b"", np.uint8).reshape(-1, 3)
    if index.max() >= len(colours):
        raise Unreadable("a colour is not in the palette")
    if clear:
        opaque = np.full(len(colours), 255, np.uint8)
        opaque[: len(clear[0])] = np.frombuffer(clear[0], np.uint8)[: len(colours)]
        colours = np.column_stack([colours, opaque])
    return colours[index]


def png_of(pixels: np.ndarray) -> bytes:
    """A PNG of height x width x 3 or 4 bytes."""
    height, width, channels = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {3: 2, 4: 6}[channels], 0, 0, 0)
    data = np.zeros((height, 1 + width * channels), np.uint8)
    data[:, 1:] = pixels.reshape(height, -1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(data.tobytes())) + chunk(b"IEND", b"")


class Sound(NamedTuple):
    rate: int
    bits: int
    is_float: bool
    samples: np.ndarray  # frames x channels; whole numbers from -1 to 1


def wav_sound(content: bytes) -> Sound:
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise Unreadable("no WAVE file")
    form = data = None
    at = 12
    while at + 8 <= len(content):  # a last chunk that is cut short counts as far as it goes
        kind, size = struct.unpack_from("<4sI", content, at)
        if kind == b"fmt ":
            form = content[at + 8 : at + 8 + size]
        elif kind == b"data":
            data = memoryview(content)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or data is None or len(form) < 16:
        raise Unreadable("no format or no data")
    tag, channels, rate, bits = struct.unpack_from("<HHI6xH", form)
    if tag == EXTENSIBLE:
        if len(form) < 26:
            raise Unreadable("the format is cut short")
        tag = struct.unpack_from("<H", form, 24)[0]
    if not channels or not rate:
        raise Unreadable("no channels or no rate")
    if (tag, bits) not in {(FLOAT, 32), (PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32)}:
        raise Unread("neither whole numbers nor floats of 32 bits")
    size = bits // 8
    data = data[: len(data) // (size * channels) * size * channels]
    if tag == FLOAT:
        samples = np.frombuffer(data, "<f4").astype(np.float64)
    elif bits == 8:
        samples = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif bits == 24:
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        samples = wide.view("<i4")[:, 0] / 2.0**31
    else:
        samples = np.frombuffer(data, f"<i{size}") / 2.0 ** (bits - 1)
    return Sound(rate, bits, tag == FLOAT, samples.reshape(-1, channels))


def flac_sound(content: bytes) -> Sound:
    info, whole = flac.numbers(content)
    return Sound(info.rate, info.depth, False, whole / 2.0 ** (info.depth - 1))


#: Readers of sounds by format.
SOUNDS = {"riff-wav": wav_sound, "flac": flac_sound}


def wav_of(sound: Sound) -> bytes:
    """A WAV of 8, 16 or 24 bits, or of floats; halves round away from zero."""
    if sound.is_float:
        data = sound.samples.astype("<f4").tobytes()
    else:
        full = 2.0 ** (sound.bits - 1)
        value = sound.samples * full
        value = np.clip(np.sign(value) * np.floor(np.abs(value) + 0.5), -full, full - 1).astype("<i4")
        data = (value + 128).astype(np.uint8).tobytes() if sound.bits == 8 else value.reshape(-1, 1).view(np.uint8)[:, : sound.bits // 8].tobytes()
    channels, size = sound.samples.shape[1], (32 if sound.is_float else sound.bits) // 8
    form = struct.pack("<HHIIHH", FLOAT if sound.is_float else PCM, channels, sound.rate, sound.rate * channels * size, channels * size, 8 * size)
    body = b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def picture_sums(a: Iterator[np.ndarray], b: Iterator[np.ndarray]) -> tuple[int, int, int, float]:
    """Samples, squared differences, windows and the sum of their similarities of two pictures of one size, in bands. An opaque
    channel stands in for one that only the other has."""
    samples, squares, windows, similar = 0, 0, 0, 0.0
    for one, two in side_by_side(a, b):
        if one.shape != two.shape:
            one, two = (p if p.shape[2] == 4 else np.concatenate([p, np.full((*p.shape[:2], 1), 255, np.uint8)], axis=2) for p in (one, two))
        samples += one.size
        for y in range(0, len(one), WINDOW):  # a line of windows at a time
            x1, x2 = one[y : y + WINDOW], two[y : y + WINDOW]
            squares += int(((x1.astype(np.int64) - x2) ** 2).sum())
            across = one.shape[1] // WINDOW
            if len(x1) == WINDOW and across:
                l1, l2 = ((p[:, : across * WINDOW, :3] @ LUMA).reshape(WINDOW, across, WINDOW) for p in (x1, x2))
                m1, m2 = l1.mean((0, 2)), l2.mean((0, 2))
                d1, d2 = l1 - m1[:, None], l2 - m2[:, None]
                top = (2 * m1 * m2 + C1) * (2 * (d1 * d2).mean((0, 2)) + C2)
                similar += float((top / ((m1**2 + m2**2 + C1) * ((d1**2).mean((0, 2)) + (d2**2).mean((0, 2)) + C2))).sum())
                windows += across
    return samples, squares, windows, similar


def spectral_sums(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """Frames that both sounds (frames x channels, mixed down) have, and the sum of their log-spectral distances in dB."""
    frames = max(0, (min(len(a), len(b)) - FRAME) // HOP + 1)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)
    total = 0.0
    for first in range(0, frames, 256):
        starts = np.arange(first, min(frames, first + 256)) * HOP
        level = []
        for sound in (a, b):
            part = sound[starts[0] : starts[-1] + FRAME].mean(1)
            x = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * hann
            level.append(10 * np.log10(np.maximum(np.abs(np.fft.rfft(x)) ** 2 / FRAME**2, FLOOR)))
        total += float(np.sqrt(((level[0] - level[1]) ** 2).mean(1)).sum())
    return frames, total
