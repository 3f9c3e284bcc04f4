"""Element walks, EXIF facts and mark states of small media files built here."""

import struct

from pyspark.sql import functions as F

from marklens.functions import binary
from marklens.operators import containers


def png(*chunks):
    made = b"".join(struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0" for kind, body in ((b"IHDR", b"\0" * 13), *chunks, (b"IEND", b"")))
    return b"\x89PNG\r\n\x1a\n" + made


def riff(form, *chunks):
    made = form + b"".join(kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2) for kind, body in chunks)
    return b"RIFF" + struct.pack("<I", len(made)) + made


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def jpeg(*segments):
    return b"\xff\xd8" + b"".join(b"\xff" + m + struct.pack(">H", 2 + len(body)) + body for m, body in segments) + b"\xff\xda\0\0"


XMP = b'<x xmp:CreatorTool="Tool 1"/> c2pa'
FILES = {
    1: png((b"tEXt", b"parameters\0steps"), (b"iTXt", b"XML:com.adobe.xmp\0" + XMP)),
    2: png((b"caBX", b"jumb"))[:-10],  # the end is cut off
    3: jpeg((b"\xe1", b"http://ns.adobe.com/xap/1.0/\0" + XMP), (b"\xeb", b"JP..jumb"), (b"\xed", b"Photoshop 3.0\0x")),
    4: riff(b"WAVE", (b"fmt ", b"\0" * 16), (b"LIST", b"INFOISFT"), (b"id3 ", b"ID3"), (b"data", b"C2PA jumb")),
    5: riff(b"WEBP", (b"VP8L", b"abc"), (b"C2PA", b"x")),
    6: b"fLaC" + b"\0\0\0\2ab" + b"\x84\0\0\1c",
    7: box(b"ftyp", b"M4A 0000") + box(b"moov", box(b"udta", box(b"meta", b"\0" * 4 + box(b"ilst", b"")))) + box(b"uuid", b"..jumb"),
    8: png(),
    9: riff(b"AVI ", (b"LIST", b"movi")),
    10: b"plain text",
    11: b"\x89PNG\r\n\x1a\n",
    13: png((b"caBX", b"jumb"))[:-20],  # the mark itself is cut
}


def frame(spark):
    rows = [(i, bytearray(c)) for i, c in FILES.items()] + [(12, None)]
    return spark.createDataFrame(rows, "asset_id long, content binary")


def test_states(spark):
    got = {(r["asset_id"], r["class"]): r["state"] for r in containers.states(frame(spark)).where("honesty = 'confirmable'").collect()}
    present = {k for k, v in got.items() if v == "confirmed_present"}
    assert present == {(1, "png_text"), (1, "xmp"), (2, "c2pa"), (3, "xmp"), (3, "c2pa"), (3, "iptc"), (4, "riff_ancillary"), (4, "id3"), (5, "c2pa"), (6, "vorbis"), (7, "ilst"), (7, "c2pa")}
    assert got[2, "exif"] == got[11, "c2pa"] == got[13, "c2pa"] == "malformed"
    assert got[8, "c2pa"] == got[4, "c2pa"] == "confirmed_absent"
    assert got[9, "id3"] == "unsupported_format"
    assert not {i for i, _ in got} & {10, 12}
    blind = containers.states(frame(spark)).where("honesty <> 'confirmable'").select("state").distinct().collect()
    assert [r[0] for r in blind] == ["not_attempted"]


def test_evidence(spark):
    got = {(r["asset_id"], r["class"]): r["evidence"] for r in containers.marks(frame(spark)).collect()}
    assert got[1, "png_text"] == ["parameters"]
    assert got[1, "xmp"] == got[3, "xmp"] == ["Tool 1", "references a C2PA manifest"]
    assert got[7, "ilst"] == []


def test_exif_facts(spark):
    order = struct.Struct("<HHII")
    first = b"II*\0" + struct.pack("<IH", 8, 3) + order.pack(0x010F, 2, 6, 104) + order.pack(0x0131, 2, 4, 0x00636261) + order.pack(0x8769, 4, 1, 52)
    made = first.ljust(52, b"\0") + struct.pack("<H", 4) + b"".join(order.pack(t, 5, 1, 0) for t in (0x829A, 0x829D, 0x8827, 0x920A))
    made = made.ljust(104, b"\0") + b"Canon\0"
    facts = binary.exif(b"Exif\0\0" + made)
    assert facts == {"make": "Canon", "model": None, "software": "abc", "exposure": True, "aperture": True, "iso": True, "lens": True}
    assert binary.exif(b"nonsense") is None and binary.exif(b"II*\0\xff\xff\xff\xff")["make"] is None
    rows = spark.createDataFrame([(1, bytearray(png((b"eXIf", made))))], "asset_id long, content binary")
    assert containers.marks(rows).first()["evidence"] == ["Software: abc", "Make: Canon"]
    hinted = containers.elements(rows).where("kind = 'eXIf'").select(containers.camera_hint(["canon"]), containers.camera_hint(["nikon"]))
    assert tuple(hinted.first()) == (True, False)


def test_walks_survive_any_cut():
    for content in FILES.values():
        for form in binary.WALKS:
            for cut in range(len(content)):
                found, _ = binary.walk(content[:cut], form)
                assert all(e.start < cut for e in found)


def test_no_files(spark):
    assert containers.states(frame(spark).where(F.lit(False))).count() == 0


def test_elements():
    content = png((b"tEXt", b"a\0b"))
    assert [e[:3] for e in binary.walk(content, "png")[0]] == [("IHDR", 8, 25), ("tEXt", 33, 15), ("IEND", 48, 12)]
    assert binary.walk(content, "png")[1] and not binary.walk(content[:40], "png")[1]
    wav = riff(b"WAVE", (b"data", b"abc"))
    assert [e[:3] for e in binary.walk(wav, "riff-wav")[0]] == [("data", 12, 12)] and binary.walk(wav, "riff-wav")[1]
    assert not binary.walk(wav + b"more", "riff-wav")[1]
