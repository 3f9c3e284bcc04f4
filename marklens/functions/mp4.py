"""MP4 and its kin: the tree of boxes, chunk offsets, and the file without its tag lists.

Leaving a box out makes all boxes around it shorter and moves what lies behind it. Sizes are carried up the tree; each
offset into the file falls by the bytes that went before it, found by binary search over prefix sums of the removed ranges.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from . import binary

# Boxes that hold boxes (all that may lead to a tag list or an offset); tables of chunk offsets and the size of their entries.
HOLDERS = binary.CONTAINERS | {"moof", "traf"}
TABLES = {"stco": ">u4", "co64": ">u8"}
TAGS, FRAGMENT, BASE_GIVEN = "ilst", "tfhd", 1


class Box(NamedTuple):
    kind: str
    start: int
    total: int
    body: int
    around: tuple[int, ...]  # where the boxes around it start, outermost first


def boxes(content: bytes) -> tuple[list[Box], bool]:
    """All boxes, outer ones before inner ones, and whether the outermost ones fill the file."""
    found, complete, open_ = [], True, [(0, len(content), ())]
    while open_:
        at, upto, around = open_.pop()
        while at + 8 <= upto:
            size, kind = struct.unpack_from(">I4s", content, at)
            body = at + 8
            if size == 1 and at + 16 <= upto:
                size, body = struct.unpack_from(">Q", content, at + 8)[0], at + 16
            elif size == 0:
                size = upto - at
            if size < body - at or at + size > upto:
                complete &= bool(around)
                break
            found.append(Box(binary.name(kind), at, size, body, around))
            if binary.name(kind) in HOLDERS and len(around) < binary.DEEPEST:
                open_.append((min(body + 4 * (kind == b"meta"), at + size), at + size, (*around, at)))
            at += size
    return found, complete


def offsets(content: bytes, found: list[Box]) -> Iterator[tuple[int, np.ndarray]]:
    """Of each table of offsets into the file where its entries are, and the entries; one that is cut short counts as far as it goes."""
    for b in found:
        if b.kind in TABLES and b.total >= b.body - b.start + 8:
            entry = np.dtype(TABLES[b.kind])
            room = (b.start + b.total - b.body - 8) // entry.itemsize
            yield b.body + 8, np.frombuffer(content, entry, min(struct.unpack_from(">I", content, b.body + 4)[0], room), b.body + 8)
        elif b.kind == FRAGMENT and b.total >= b.body - b.start + 16 and content[b.body + 3] & BASE_GIVEN:
            yield b.body + 8, np.frombuffer(content, ">u8", 1, b.body + 8)


def chunk_offsets(content: bytes) -> list[int]:
    """Where the media's chunks start, table by table."""
    tables = sorted(offsets(content, boxes(content)[0]), key=lambda t: t[0])
    return [int(v) for _, values in tables for v in values]


def without_tags(content: bytes) -> tuple[bytes, list[str]]:
    """The file without its tag lists, and what went. Raises ValueError where the boxes don't fill the file."""
    found, complete = boxes(content)
    if not complete or not found:
        raise ValueError("the walk does not reach the file's end")
    gone = sorted((b for b in found if b.kind == TAGS), key=lambda b: b.start)
    if not gone:
        return content, []
    made = bytearray(content)
    starts = np.array([b.start for b in gone], np.uint64)
    before = np.concatenate([[0], np.cumsum([b.total for b in gone])]).astype(np.uint64)
    for at, values in offsets(content, found):
        moved = values.astype(np.uint64) - before[np.searchsorted(starts, values.astype(np.uint64), side="left")]
        made[at : at + values.nbytes] = moved.astype(values.dtype).tobytes()
    for b in gone:
        for holder in b.around:
            size = struct.unpack_from(">I", made, holder)[0]
            if size == 1:
                struct.pack_into(">Q", made, holder + 8, struct.unpack_from(">Q", made, holder + 8)[0] - b.total)
            elif size:
                struct.pack_into(">I", made, holder, size - b.total)
    edges = [0, *(x for b in gone for x in (b.start, b.start + b.total)), len(content)]
    return b"".join(made[a:z] for a, z in zip(edges[::2], edges[1::2])), [TAGS] * len(gone)
