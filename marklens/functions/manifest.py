"""Readers of provenance manifests: boxes, CBOR, certificates' names. They only read, and verify no signature.

Each reader takes bytes and gives plain values, or None where the bytes are not exactly what they should be.
"""

from __future__ import annotations

import math
import struct
from typing import NamedTuple

from . import binary

#: Levels of CBOR and of DER that are followed.
DEEPEST_CBOR, DEEPEST_DER = 64, 32
#: Object identifiers of common name and organization; the header label of a certificate chain.
NAME_OIDS, CHAIN = (b"\x55\x04\x03", b"\x55\x04\x0a"), 33
STRINGS = {0x0C: "utf-8", 0x13: "ascii", 0x14: "latin-1", 0x16: "ascii"}


class Box(NamedTuple):
    kind: bytes
    body: bytes


def boxes(content: bytes) -> list[Box] | None:
    """The boxes that fill content exactly."""
    found, at = [], 0
    while at < len(content):
        if at + 8 > len(content):
            return None
        size, kind = struct.unpack_from(">I4s", content, at)
        head = 8
        if size == 1:
            if at + 16 > len(content):
                return None
            size, head = struct.unpack_from(">Q", content, at + 8)[0], 16
        elif size == 0:
            size = len(content) - at
        if size < head or at + size > len(content):
            return None
        found.append(Box(kind, content[at + head : at + size]))
        at += size
    return found


class Super(NamedTuple):
    kind: bytes
    label: str | None
    inner: list[Box]

    def children(self) -> list[Super] | None:
        made = [superbox(b) for b in self.inner if b.kind == b"jumb"]
        return None if None in made else made

    def content(self, kind: bytes) -> bytes | None:
        return next((b.body for b in self.inner if b.kind == kind), None)


def superbox(box: Box) -> Super | None:
    """A box that holds a description (kind, toggles, perhaps a label) and other boxes."""
    inner = boxes(box.body) if box.kind == b"jumb" else None
    if not inner or inner[0].kind != b"jumd" or len(inner[0].body) < 17:
        return None
    body, label = inner[0].body, None
    if body[16] & 2:
        end = body.find(b"\0", 17)
        if end < 0:
            return None
        try:
            label = body[17:end].decode()
        except UnicodeDecodeError:
            return None
    return Super(body[:4], label, inner[1:])


class Malformed(ValueError):
    pass


BREAK = object()


class Tagged(NamedTuple):
    tag: int
    value: object


def cbor(content: bytes):
    """The one item that fills content: int, float, bytes, str, list, list of pairs in a dict's place, Tagged, or a constant. None if malformed."""
    try:
        value, at = item(content, 0, 0)
    except (Malformed, IndexError, struct.error, UnicodeDecodeError):
        return None
    return value if at == len(content) and value is not BREAK else None


def item(content: bytes, at: int, depth: int) -> tuple[object, int]:
    if depth > DEEPEST_CBOR:
        raise Malformed
    major, low = content[at] >> 5, content[at] & 31
    at += 1
    if low < 24:
        n = low
    elif low < 28:
        width = 1 << low - 24
        if at + width > len(content):
            raise Malformed
        n, at = int.from_bytes(content[at : at + width], "big"), at + width
    elif low == 31:
        n = None
    else:
        raise Malformed
    if n is None and (major in (0, 1, 6) or major == 7 and depth == 0):
        raise Malformed
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        if n is None:
            parts = []
            while content[at] != 0xFF:
                if content[at] >> 5 != major or content[at] & 31 == 31:
                    raise Malformed
                part, at = item(content, at, depth + 1)
                parts.append(part)
            return (b"" if major == 2 else "").join(parts), at + 1
        if at + n > len(content):
            raise Malformed
        body = content[at : at + n]
        return (body if major == 2 else body.decode()), at + n
    if major in (4, 5):
        values, left = [], None if n is None else n * (major - 3)
        while left is None or left:
            value, at = item(content, at, depth + 1)
            if value is BREAK:
                if left is not None or major == 5 and len(values) % 2:
                    raise Malformed
                break
            values.append(value)
            left = None if left is None else left - 1
        return (values if major == 4 else Pairs(zip(values[::2], values[1::2]))), at
    if major == 6:
        value, at = item(content, at, depth + 1)
        if value is BREAK:
            raise Malformed
        return Tagged(n, value), at
    if n is None:
        return BREAK, at
    if low == 25:
        return half(n), at
    if low == 26:
        return struct.unpack(">f", n.to_bytes(4, "big"))[0], at
    if low == 27:
        return struct.unpack(">d", n.to_bytes(8, "big"))[0], at
    return {20: False, 21: True}.get(n, Simple(n)), at


class Simple(NamedTuple):
    value: int


class Pairs(list):
    """A map: keys may be anything, so it is kept as pairs."""

    def get(self, key):
        return next((v for k, v in self if type(k) is type(key) and k == key), None)


def half(n: int) -> float:
    exponent, part = n >> 10 & 31, n & 1023
    value = math.ldexp(part, -24) if exponent == 0 else math.ldexp(part + 1024, exponent - 25) if exponent < 31 else math.nan if part else math.inf
    return -value if n >> 15 else value


def der(content: bytes, depth: int = 0) -> list[str]:
    """Common names and organizations of a certificate, in order."""
    names, at, named = [], 0, False
    while at + 2 <= len(content) and depth <= DEEPEST_DER:
        tag, size, at = content[at], content[at + 1], at + 2
        if size > 127:
            width = size & 127
            if not 1 <= width <= 4 or at + width > len(content):
                break
            size, at = int.from_bytes(content[at : at + width], "big"), at + width
        body = content[at : at + size]
        if len(body) < size:
            break
        if tag & 32:
            names += der(body, depth + 1)
        elif named and tag in STRINGS:
            names.append(body.decode(STRINGS[tag], "replace"))
        named = tag == 6 and body in NAME_OIDS
        at += size
    return names


def signers(signature) -> list[str]:
    """Names in the certificate chains of a signature's two headers."""
    while isinstance(signature, Tagged):
        signature = signature.value
    if not isinstance(signature, list) or isinstance(signature, Pairs):
        return []
    protected = cbor(signature[0]) if signature and isinstance(signature[0], bytes) else None
    chains = [h.get(CHAIN) for h in (signature[1] if len(signature) > 1 else None, protected) if isinstance(h, Pairs)]
    certificates = [c for chain in chains for c in ([chain] if isinstance(chain, bytes) else chain if isinstance(chain, list) else []) if isinstance(c, bytes)]
    return [n for c in certificates for n in der(c)]


def text_of(value) -> str | None:
    return value if isinstance(value, str) else None


def manifest(box: Super) -> tuple[str, list[tuple], list[str]] | None:
    """Label, actions (action, source type, agent) and signers' names."""
    children = box.children()
    if box.label is None or children is None:
        return None
    part = lambda kind, label: next((c for c in children if c.kind == kind and c.label == label), None)
    assertions, claim, signature = part(b"c2as", "c2pa.assertions"), part(b"c2cl", "c2pa.claim"), part(b"c2cs", "c2pa.signature")
    if not (assertions and claim and signature):
        return None
    said = cbor(claim.content(b"cbor") or b"")
    if not isinstance(said, Pairs) or text_of(said.get("signature")) is None:
        return None
    lists = [said.get(k) for k in ("assertions", "created_assertions", "gathered_assertions")]
    lists = [x for x in lists if x is not None]
    if not lists or not all(isinstance(x, list) and not isinstance(x, Pairs) and all(isinstance(e, Pairs) and text_of(e.get("url")) is not None for e in x) for x in lists):
        return None
    urls = tuple(e.get("url") for x in lists for e in x)
    actions, inner = [], assertions.children()
    if inner is None or any(a.label is None for a in inner):
        return None
    for a in inner:
        if not a.label.startswith("c2pa.actions"):
            continue
        body = cbor(a.content(b"cbor") or b"")
        listed = body.get("actions") if isinstance(body, Pairs) else None
        if not any(u.endswith(f"c2pa.assertions/{a.label}") for u in urls) or not isinstance(listed, list):
            return None
        for act in listed:
            if not isinstance(act, Pairs) or text_of(act.get("action")) is None:
                return None
            agent = act.get("softwareAgent")
            actions.append((act.get("action"), text_of(act.get("digitalSourceType")), text_of(agent.get("name") if isinstance(agent, Pairs) else agent)))
    return box.label, actions, signers(cbor(signature.content(b"cbor") or b""))


def manifests(content: bytes) -> list[tuple[str, list[tuple], list[str]]] | None:
    """The manifests of a whole, well-formed store."""
    top = boxes(content)
    store = superbox(top[0]) if top and len(top) == 1 else None
    if not store or store.kind != b"c2pa" or store.label != "c2pa":
        return None
    children = store.children()
    if not children or any(c.kind not in (b"c2ma", b"c2um") for c in children):
        return None
    made = [manifest(c) for c in children]
    return None if None in made else made


def carried(content: bytes, form: str, found: list[binary.Element]) -> list[bytes]:
    """What may be a store, of a file's elements: packets of one instance are put together, wrappers taken off."""
    out, packets = [], {}
    for e in found:
        body = content[e.body : e.start + e.total]
        if form == "jpeg" and e.kind == "EB" and body[:2] == b"JP" and len(body) >= 8:
            same = packets.setdefault(body[2:4], [])
            same.append(body[16:] if same else body[8:])  # a further packet repeats the box's head
        elif form == "png" and e.kind == "caBX":
            out.append(body[:-4])
        elif form == "isobmff" and e.kind == "uuid":
            purpose, _, store = body[20:].partition(b"\0")
            out.append(store if purpose == b"manifest" else body[16:])
        elif form in ("webp", "riff-wav") and e.kind == "C2PA":
            out.append(content[e.body : e.body + struct.unpack_from("<I", content, e.start + 4)[0]])
    out += [b"".join(p) for p in packets.values()]
    begins = [(c, 4 if c[4:8] == b"jumb" else c.find(b"jumb")) for c in out]
    return [c[at - 4 :] for c, at in begins if at >= 4]


def store_of(content: bytes, form: str) -> list[tuple[str, list[tuple], list[str]]] | None:
    """The first well-formed store of a media file."""
    if form not in binary.WALKS:
        return None
    return next((m for c in carried(content, form, binary.walk(content, form)[0]) if (m := manifests(c))), None)


def decoded_run(run: str) -> bytes:
    """The bytes that a run of variation selectors stands for."""
    return bytes(ord(c) - 0xFE00 if ord(c) <= 0xFE0F else ord(c) - 0xE0100 + 16 for c in run)
