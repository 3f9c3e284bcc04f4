"""MPEG layer III files: tags at both ends, frames, the information frame, and bytes that no frame's main data uses."""

from __future__ import annotations

from itertools import takewhile
from typing import NamedTuple

import numpy as np

# kbit/s by index, Hz by index, and names that encoders leave.
KBITS_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0)
KBITS_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0)
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
ENCODERS = (b"LAME", b"Lavc", b"Lavf", b"GOGO", b"Xing")
TAG_FRAMES = (b"PRIV", b"GEOB", b"TSSE", b"TENC", b"TXXX")
#: The information frame's extension: its length, the encoder's name, delay and padding.
EXTENSION, NAME, TIMES = 36, slice(0, 9), slice(21, 24)


class Frame(NamedTuple):
    at: int
    size: int
    data_at: int  # main data's place in the frame, after header, checksum and side information
    side_at: int
    first: bool  # MPEG-1
    mono: bool


class Mark(NamedTuple):
    kind: str
    start: int
    total: int
    detail: str
    notes: list[str]
    broken: bool = False  # there, but not to be read


def id3v2(content: bytes, at: int) -> int:
    """The length of the tag that starts here, 0 if none does."""
    head = content[at : at + 10]
    if len(head) < 10 or head[:3] != b"ID3" or any(b > 127 for b in head[6:]):
        return 0
    body = head[6] << 21 | head[7] << 14 | head[8] << 7 | head[9]
    return 10 + body + (10 if head[5] & 16 else 0)


def ape(content: bytes, at: int) -> tuple[int, int] | None:
    """Start and end of the tag whose header or footer is here."""
    block = content[at : at + 32] if at >= 0 else b""
    if len(block) < 32 or block[:8] != b"APETAGEX":
        return None
    size, flags = int.from_bytes(block[12:16], "little"), int.from_bytes(block[20:24], "little")
    if size < 32:
        return None
    if flags >> 29 & 1:
        found = at, at + 32 + size
    else:
        found = at + 32 - size - (32 if flags >> 31 else 0), at + 32
    return found if 0 <= found[0] and found[1] <= len(content) else None


def frame(content: bytes, at: int, end: int) -> Frame | None:
    if at + 4 > end:
        return None
    a, b, c, d = content[at : at + 4]
    version = b >> 3 & 3
    if a != 255 or b >> 5 != 7 or version == 1 or b >> 1 & 3 != 1 or c >> 2 & 3 == 3:
        return None
    first, mono = version == 3, d >> 6 == 3
    kbits = (KBITS_1 if first else KBITS_2)[c >> 4]
    if not kbits:
        return None
    size = (144_000 if first else 72_000) * kbits // RATES[version][c >> 2 & 3] + (c >> 1 & 1)
    side_at = 4 if b & 1 else 6
    return Frame(at, size, side_at + ((17 if mono else 32) if first else 9 if mono else 17), side_at, first, mono)


def bits(content: bytes, at: int, n: int) -> int:
    whole = int.from_bytes(content, "big")
    return whole >> (8 * len(content) - at - n) & (1 << n) - 1


def used(content: bytes, f: Frame) -> tuple[int, int] | None:
    """How far before its own region a frame's main data starts, and how many bytes it has."""
    side = content[f.at + f.side_at : f.at + f.data_at]
    if f.at + f.data_at > f.at + f.size or len(side) < f.data_at - f.side_at:
        return None
    channels = 1 if f.mono else 2
    begin, width, granules = (9, 59, 2) if f.first else (8, 63, 1)
    skipped = begin + ((5 if f.mono else 3) + 4 * channels if f.first else channels)
    total = sum(bits(side, skipped + i * width, 12) for i in range(granules * channels))
    return bits(side, 0, begin), -(-total // 8)


def unused(content: bytes, frames: list[Frame], info_at: int | None) -> list[tuple[int, int]] | None:
    """Stretches (start, end) of main-data regions that no frame's main data covers; None if one can't be placed."""
    sizes = [f.size - f.data_at for f in frames]
    if min(sizes, default=0) < 0:
        return None
    covered, at = np.zeros(sum(sizes), bool), 0
    for f, size in zip(frames, sizes):
        if f.at == info_at:
            covered[at : at + size] = True  # not looked at
        else:
            extent = used(content, f)
            if extent is None or extent[0] > at or at - extent[0] + extent[1] > at + size:
                return None
            covered[at - extent[0] : at - extent[0] + extent[1]] = True
        at += size
    found, at = [], 0
    for f, size in zip(frames, sizes):
        free = np.concatenate([[False], ~covered[at : at + size], [False]])
        edges = np.flatnonzero(free[1:] != free[:-1])
        found += [(f.at + f.data_at + int(a), f.at + f.data_at + int(z)) for a, z in edges.reshape(-1, 2)]
        at += size
    return found


def information(content: bytes, f: Frame) -> Mark | None:
    """The information frame, if it tells of its encoder more than delay and padding. A frame without is no mark
    but kept out of the search for unused bytes: kind is then empty."""
    body = content[f.at : f.at + f.size]
    kind = body[f.data_at : f.data_at + 4].decode("latin-1")
    if kind not in ("Xing", "Info"):
        return Mark("", f.at, f.size, "VBRI", []) if body[36:40] == b"VBRI" else None
    flags = int.from_bytes(body[f.data_at + 4 : f.data_at + 8], "big")
    at = f.data_at + 8 + 4 * (flags & 1) + 2 * (flags & 2) + 25 * (flags & 4) + (flags & 8) // 2
    more = body[at : at + EXTENSION]
    notes, encoder = [], ""
    if len(more) == EXTENSION:
        encoder = "".join(map(chr, takewhile(lambda c: 32 <= c < 127, more[NAME]))).rstrip()
        if any(more):
            times = int.from_bytes(more[TIMES], "big")
            notes.append(f"delay {times >> 12}, padding {times & 4095}")
    if flags & 4:
        notes.append("toc")
    tells = any(more[: TIMES.start]) or any(more[TIMES.stop :]) if len(more) == EXTENSION else False
    return Mark("info" if tells else "", f.at, f.size, f"{kind} tag, encoder {encoder}" if encoder else f"{kind} tag", notes)


class Layout(NamedTuple):
    leading: list[Mark]
    frames: list[Frame]
    trailing: list[Mark]  # in the file's order
    start: int  # of the frames
    end: int
    complete: bool  # tags and frames fill the file


def layout(content: bytes) -> Layout:
    leading, start = [], 0
    while True:
        if size := id3v2(content, start):
            if start + size > len(content):
                break
            body = content[start + 10 : start + size]
            leading.append(Mark("ID3v2", start, size, "leading tag", [f"{n.decode()} frame" for n in TAG_FRAMES if n in body]))
            start += size
        elif (tag := ape(content, start)) and tag[0] == start:
            leading.append(Mark("APE", start, tag[1] - start, "leading tag", []))
            start = tag[1]
        else:
            break
    trailing, end = [], len(content)
    while True:
        if end - 128 >= start and content[end - 128 : end - 125] == b"TAG" and not any(m.kind == "ID3v1" for m in trailing):
            trailing.append(Mark("ID3v1", end - 128, 128, "trailing tag", []))
        elif end - 32 >= start and (tag := ape(content, end - 32)) and tag[0] >= start and tag[1] == end:
            trailing.append(Mark("APE", tag[0], tag[1] - tag[0], "trailing tag", []))
        else:
            break
        end = trailing[-1].start
    frames, at = [], start
    while (f := frame(content, at, end)) and at + f.size <= end:
        frames.append(f)
        at += f.size
    return Layout(leading, frames, trailing[::-1], start, end, bool(frames) and at == end)


def walk(content: bytes) -> tuple[list[Mark], bool]:
    """The file's marks in order, and whether tags and frames fill all of it."""
    lay = layout(content)
    inner = []
    info = information(content, lay.frames[0]) if lay.frames else None
    if info and info.kind:
        inner.append(info._replace(broken=not lay.complete))
    if lay.complete:
        stretches = unused(content, lay.frames, info.start if info else None)
        if stretches is None:
            inner.append(Mark("ancillary", lay.start, lay.end - lay.start, "main data can't be placed", [], True))
        else:
            parts = [content[a:z] for a, z in stretches]
            filled = sum(len(p) - p.count(0) for p in parts)
            if filled:
                hits = {n: sum(n in p for p in parts) for n in ENCODERS}
                notes = [f"{n.decode()} in {hits[n]} frames" for n in ENCODERS if hits[n]]
                inner.append(Mark("ancillary", stretches[0][0], sum(map(len, parts)), f"{filled} nonzero bytes across {len(parts)} runs", notes))
    return [*lay.leading, *inner, *lay.trailing], lay.complete


#: Bytes of a VBRI tag's head, before its table and what its encoder adds.
VBRI_AT, VBRI_HEAD = 36, 26
#: Tags by the class they go with.
TAG_CLASSES = {"ID3v2": "id3", "ID3v1": "id3", "APE": "ape"}


def minimal(body: bytes, f: Frame) -> bytes:
    """An information frame of the same size with counts, table of contents, delay and padding, and zeros for the rest."""
    if body[f.data_at : f.data_at + 4] not in (b"Xing", b"Info"):
        return body[: VBRI_AT + VBRI_HEAD].ljust(len(body), b"\0")
    flags = int.from_bytes(body[f.data_at + 4 : f.data_at + 8], "big")
    counts = f.data_at + 8 + 4 * (flags & 1) + 2 * (flags & 2) + 25 * (flags & 4)
    more = counts + (flags & 8) // 2
    made = bytearray(body[:counts].ljust(len(body), b"\0"))
    if more + EXTENSION <= len(body):
        made[more + TIMES.start : more + TIMES.stop] = body[more + TIMES.start : more + TIMES.stop]
    return bytes(made)


def without(content: bytes, drop: set[str]) -> tuple[bytes, list[str]]:
    """The file without tags of these classes, its information frame made minimal, unused bytes of main data set to zero; and the
    kinds of what changed. No byte that a frame's main data covers changes. Raises ValueError for a broken file."""
    lay = layout(content)
    if not lay.complete:
        raise ValueError("tags and frames don't fill the file")
    info = information(content, lay.frames[0])
    middle, changed = bytearray(content[lay.start : lay.end]), []
    if "mp3_info" in drop and info:
        body = bytes(middle[: info.total])
        middle[: info.total] = minimal(body, lay.frames[0])
        changed += ["info"] * (middle[: info.total] != body)
    if "mp3_ancillary" in drop:
        stretches = unused(content, lay.frames, info.start if info else None)
        if stretches is None:
            raise ValueError("main data can't be placed")
        changed += ["ancillary"] * any(content.count(0, a, z) < z - a for a, z in stretches)
        for a, z in stretches:
            middle[a - lay.start : z - lay.start] = bytes(z - a)
    kept = [[m for m in tags if TAG_CLASSES[m.kind] not in drop] for tags in (lay.leading, lay.trailing)]
    gone = [[m.kind for m in tags if TAG_CLASSES[m.kind] in drop] for tags in (lay.leading, lay.trailing)]
    if not changed and not gone[0] + gone[1]:
        return content, []
    parts = [b"".join(content[m.start : m.start + m.total] for m in tags) for tags in kept]
    return parts[0] + bytes(middle) + parts[1], [*gone[0], *changed, *gone[1]]
