"""Readers of single media files: element walks, EXIF facts and manifest carriage. One file's bytes in, plain values out."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

# Box kinds that hold boxes, TIFF tags, and how a payload starts.
CONTAINERS = {"moov", "udta", "trak", "mdia", "minf", "stbl", "meta"}
EXIF_START, XMP_START, IPTC_START = b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0", b"Photoshop 3.0\0"
TEXT_TAGS = {0x010F: "make", 0x0110: "model", 0x0131: "software"}
FLAG_TAGS = {0x829A: "exposure", 0x829D: "aperture", 0x8827: "iso", 0x920A: "lens", 0xA434: "lens"}
SUB_DIRECTORY, DEEPEST = 0x8769, 8
#: Elements whose payload is small metadata that later steps read; of the others as many first bytes as tell a list's kind.
CARRIED = {"png": {"tEXt", "zTXt", "iTXt"}, "jpeg": {"E1", "ED"}, "webp": {"XMP "}, "riff-wav": {"XMP "}, "riff-avi": {"XMP "}}
HEAD = 4


class Element(NamedTuple):
    kind: str
    start: int
    total: int
    body: int  # where the payload starts


def name(four: bytes) -> str:
    return four.decode("latin-1")


def png(content: bytes) -> tuple[list[Element], bool]:
    found, at = [], 8
    while at + 12 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        if at + 8 + size > len(content):
            return found, False
        found.append(Element(name(kind), at, 12 + size, at + 8))
        if kind == b"IEND":
            return found, True
        at += 12 + size
    return found, False


def riff(content: bytes) -> tuple[list[Element], bool]:
    """Complete where the chunks reach the declared end and at most a padding byte follows it."""
    if len(content) < 12:
        return [], False
    upto = min(struct.unpack_from("<I", content, 4)[0] + 8, len(content))
    found, at = [], 12
    while at < upto and at + 8 <= len(content):
        kind, size = struct.unpack_from("<4sI", content, at)
        if at + 8 + size > len(content):
            break
        found.append(Element(name(kind), at, 8 + size + size % 2, at + 8))
        at += 8 + size + size % 2
    return found, at >= upto and len(content) <= upto + 1


def flac(content: bytes) -> tuple[list[Element], bool]:
    found, at = [], 4
    while at + 4 <= len(content):
        head = struct.unpack_from(">I", content, at)[0]
        total = 4 + (head & 0xFFFFFF)
        if at + total > len(content):
            break
        found.append(Element(str(head >> 24 & 0x7F), at, total, at + 4))
        if head >> 31:
            return found, True
        at += total
    return found, False


def jpeg(content: bytes) -> tuple[list[Element], bool]:
    found, at = [], 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        marker, size = struct.unpack_from(">xBH", content, at)
        if marker in (0xD9, 0xDA):
            return found, True
        if 0xD0 <= marker <= 0xD7 or marker == 1:  # these stand alone
            at += 2
            continue
        if size < 2 or at + 2 + size > len(content):
            break
        found.append(Element(f"{marker:02X}", at, 2 + size, at + 4))
        at += 2 + size
    return found, False


def isobmff(content: bytes) -> tuple[list[Element], bool]:
    """Boxes of all levels, outer ones first; complete where the outermost level fills the file."""
    found, complete, open_ = [], True, [(0, len(content), 0)]
    while open_:
        at, upto, depth = open_.pop()
        inner = []
        while at + 8 <= upto:
            size, kind = struct.unpack_from(">I4s", content, at)
            body = at + 8
            if size == 1 and at + 16 <= len(content):
                size, body = struct.unpack_from(">Q", content, at + 8)[0], at + 16
            elif size == 0:
                size = upto - at
            if size < 8 or at + size > upto:
                complete &= depth > 0
                break
            found.append(Element(name(kind), at, size, body))
            if name(kind) in CONTAINERS and depth < DEEPEST:
                inner.append((min(body + 4 * (kind == b"meta"), at + size), at + size, depth + 1))
            at += size
        open_ += reversed(inner)
    return found, complete


WALKS = {"png": png, "jpeg": jpeg, "webp": riff, "riff-wav": riff, "riff-avi": riff, "flac": flac, "isobmff": isobmff}


def walk(content: bytes, form: str) -> tuple[list[Element], bool]:
    """A file's elements, and whether the walk covered all of it."""
    return WALKS[form](content)


ANY_CASE = re.compile(rb"(?i)c2pa")


def carries_manifest(content: bytes, start: int, end: int) -> bool:
    """Looks in place: an element may be most of the file."""
    return content.find(b"jumb", start, end) >= 0 or ANY_CASE.search(content, start, end) is not None


def directory(tiff: bytes, at: int, order: str) -> Iterator[tuple[int, int, int, int]]:
    """Tag, type, count and place of the value of each whole entry."""
    if at + 2 > len(tiff):
        return
    for i in range(struct.unpack_from(order + "H", tiff, at)[0]):
        entry = at + 2 + 12 * i
        if entry + 12 > len(tiff):
            return
        yield *struct.unpack_from(order + "HHI", tiff, entry), entry + 8


def tiff_text(tiff: bytes, kind: int, count: int, place: int, order: str) -> str | None:
    if kind != 2:
        return None
    if count > 4:
        place = struct.unpack_from(order + "I", tiff, place)[0]
    if place + count > len(tiff):
        return None
    value = tiff[place : place + count].split(b"\0")[0]
    return "".join(chr(c) for c in value if 32 <= c < 127).strip() or None


def exif(payload: bytes) -> dict[str, object] | None:
    """make, model, software, and whether exposure, aperture, iso and lens are given; None if this is no TIFF block."""
    tiff = payload.removeprefix(EXIF_START)
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(tiff[:4])
    if order is None or len(tiff) < 8:
        return None
    facts: dict[str, object] = dict.fromkeys(TEXT_TAGS.values()) | dict.fromkeys(FLAG_TAGS.values(), False)
    below = None
    for tag, kind, count, place in directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order):
        if tag in TEXT_TAGS:
            facts[TEXT_TAGS[tag]] = tiff_text(tiff, kind, count, place, order)
        elif tag in FLAG_TAGS:
            facts[FLAG_TAGS[tag]] = True
        elif tag == SUB_DIRECTORY:
            below = struct.unpack_from(order + "I", tiff, place)[0]
    for tag, *_ in directory(tiff, below, order) if below is not None else ():
        if tag in FLAG_TAGS:
            facts[FLAG_TAGS[tag]] = True
    return facts
