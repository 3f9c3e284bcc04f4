"""MP4, MP3 and JPEG files without their tags: chunks point at the same bytes, decoders read the same ones."""

import random
import struct

import numpy as np
import pytest
from test_capture import mpeg
from test_containers import box, jpeg

from marklens.functions import mp3, mp4
from marklens.operators import containers, rewrite


def tags(n):
    return box(b"meta", bytes(4) + box(b"hdlr", b"h") + box(b"ilst", b"t" * n))


def film(rng, wide, large=False):
    """Tag lists of odd sizes before, between and behind the media; tables of 32 or 64 bits. Made twice: offsets depend on sizes."""
    media = [rng.randbytes(rng.randint(5, 60)) for _ in range(3)]
    lists = [rng.randint(0, 30) for _ in range(4)]

    def made(offsets):
        table = box(b"co64" if wide else b"stco", struct.pack(">II", 0, len(offsets)) + b"".join(struct.pack(">Q" if wide else ">I", o) for o in offsets))
        track = box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", table))) + box(b"udta", tags(lists[0])))
        body = track + box(b"udta", tags(lists[1]))
        moov = struct.pack(">I4sQ", 1, b"moov", 16 + len(body)) + body if large else box(b"moov", body)
        part = box(b"moof", box(b"traf", box(b"tfhd", struct.pack(">IIQ", 1, 1, offsets[-1] if offsets else 0))))
        uuid = box(b"uuid", b"..jumb")
        return [box(b"ftyp", b"M4A 0000"), uuid, moov, box(b"mdat", media[0]), tags(lists[2]), box(b"mdat", media[1]), part, tags(lists[3]), struct.pack(">I4s", 0, b"mdat") + media[2]]

    parts = made([0] * 6)
    ends = np.cumsum([len(p) for p in parts])
    starts = [int(ends[i] - len(parts[i])) + 8 for i in (3, 5, 8)]
    offsets = [s + rng.randrange(len(m)) for s, m in zip(starts, media) for _ in range(2)]
    return b"".join(made(offsets)), offsets


@pytest.mark.parametrize("wide,large", [(False, False), (True, True)])
def test_chunks_point_at_the_same_bytes(wide, large):
    rng = random.Random(wide)
    for _ in range(60):
        content, offsets = film(rng, wide, large)
        assert mp4.chunk_offsets(content) == [*offsets, offsets[-1]]
        made, gone = mp4.without_tags(content)
        moved = mp4.chunk_offsets(made)
        assert gone == ["ilst"] * 4 and len(moved) == 7
        assert [made[o : o + 4] for o in moved] == [content[o : o + 4] for o in [*offsets, offsets[-1]]]
        before, after = mp4.boxes(content), mp4.boxes(made)
        assert before[1] and after[1] and [b.kind for b in after[0]] == [b.kind for b in before[0] if b.kind != "ilst"]
        assert b"..jumb" in made and mp4.without_tags(made) == (made, [])
        for cut in range(1, len(content), 17):  # never more than a refusal
            try:
                mp4.without_tags(content[:cut])
            except ValueError:
                pass


def test_mp3_without_tags():
    plain = mpeg(b"\1" * 100) * 3
    filled = mpeg(b"\1" * 100)[:200] + b"LAME3.1" + bytes(len(mpeg()) - 207)
    id3, last = b"ID3\4\0\0\0\0\0\6TSSE..", b"TAG" + bytes(125)
    ape = bytes(10) + b"APETAGEX" + struct.pack("<IIII", 2000, 42, 1, 0) + bytes(8)
    extension = b"LAME3.99r".ljust(21, b"\1") + bytes([0x24, 0x05, 0x76]) + bytes(12)
    head = mpeg()[:21] + b"Xing" + struct.pack(">I", 13) + struct.pack(">I", 9) + bytes(range(100))
    info = (head + b"qual" + extension).ljust(len(mpeg()), b"\0")
    bare = (head + bytes(4) + bytes(21) + bytes([0x24, 0x05, 0x76])).ljust(len(mpeg()), b"\0")
    whole = id3 + info + plain + filled + ape + last
    everything = {"id3", "ape", "mp3_info", "mp3_ancillary"}
    made, changed = mp3.without(whole, everything)
    assert changed == ["ID3v2", "info", "ancillary", "APE", "ID3v1"]
    assert made == bare + plain + filled.replace(b"LAME3.1", bytes(7)) and mp3.walk(made) == ([], True)
    assert mp3.without(made, everything) == (made, [])
    assert mp3.without(whole, {"ape"}) == (id3 + info + plain + filled + last, ["APE"]) and mp3.without(whole, set()) == (whole, [])
    assert mp3.without(whole, {"mp3_info"})[0] == id3 + bare + plain + filled + ape + last
    table = bytearray(mpeg())
    table[36:90] = b"VBRI" + bytes(range(50))
    kept = bytes(table[:62]).ljust(len(table), b"\0")
    assert mp3.without(bytes(table) + plain, {"mp3_info", "mp3_ancillary"}) == (kept + plain, ["info"])
    astray = bytearray(plain)
    astray[4] = 0xFF
    assert mp3.without(bytes(astray), {"id3"}) == (bytes(astray), [])
    for broken in (bytes(astray), plain[:-1], b""):
        with pytest.raises(ValueError):
            mp3.without(broken, {"mp3_ancillary"})


def test_encoder_names_end_at_the_first_odd_byte():
    extension = (b"LAME\1xyz".ljust(9, b"\0")).ljust(36, b"\0")
    info = (mpeg()[:21] + b"Info" + bytes(4) + extension).ljust(len(mpeg()), b"\0")
    assert mp3.walk(info + mpeg(b"\1"))[0][0].detail == "Info tag, encoder LAME"


def test_reservoir_is_left_alone():
    """Main data of a later frame in an earlier frame's region is no waste."""
    first = bytearray(mpeg(b"\1" * 10))
    first[21 + 350 : 21 + 396] = b"\7" * 46  # the last 46 of 396 bytes
    second = bytearray(mpeg(b"\2" * 50))
    side = 46 << 136 - 9 | (8 * 96) << 136 - 30  # starts 46 bytes before its region
    second[4:21] = side.to_bytes(17, "big")
    content = bytes(first + second)
    made, changed = mp3.without(content, {"mp3_ancillary"})
    assert (made, changed) == (content, [])
    first[200] = 9
    assert mp3.without(bytes(first + second), {"mp3_ancillary"}) == (content, ["ancillary"])


SEGMENTS = {
    "exif": (b"\xe1", b"Exif\0\0II*\0"), "xmp": (b"\xe1", b"http://ns.adobe.com/xap/1.0/\0<x/>"), "iptc": (b"\xed", b"Photoshop 3.0\0x"), "manifest": (b"\xeb", b"JP..jumb"),
    "jfif": (b"\xe0", b"JFIF\0"), "colour": (b"\xe2", b"ICC_PROFILE\0x"), "adobe": (b"\xee", b"Adobe"), "table": (b"\xdb", b"q"), "note": (b"\xfe", b"made by"), "other": (b"\xe5", b"o"), "two": (b"\xe2", b"MPF\0"), "one": (b"\xe1", b"x"),
}


def test_files_of_three_formats(spark):
    every = lambda *names: jpeg(*(SEGMENTS[n] for n in names))
    scan = b"\xff\x00scan\xff\xd9"
    content, _ = film(random.Random(3), False)
    sound = b"ID3\4\0\0\0\0\0\0" + mpeg(b"\1" * 9) * 2
    cases = [
        (every(*SEGMENTS) + scan, ["exif", "xmp"], every(*(n for n in SEGMENTS if n not in ("exif", "xmp"))) + scan, 0),
        (every(*SEGMENTS) + scan, rewrite.CLASSES, every("manifest", "jfif", "colour", "adobe", "table") + scan, 0),
        (every(*SEGMENTS) + scan, ["iptc"], every(*(n for n in SEGMENTS if n != "iptc")) + scan, 0),
        (every("jfif") + scan, rewrite.CLASSES, every("jfif") + scan, 0),
        (b"\xff\xd8\xff\xe1\xff\xff", rewrite.CLASSES, None, 30),
        (content, ["ilst"], mp4.without_tags(content)[0], 0),
        (content, ["exif"], content, 0),
        (content + b"\0\0\0\xff", rewrite.CLASSES, None, 30),
        (sound, ["id3"], mpeg(b"\1" * 9) * 2, 0),
        (sound + b"x", ["id3"], None, 30),
    ]
    cases[7] = (box(b"ftyp", b"M4A 0000") + b"\0\0\0\xffmdat", rewrite.CLASSES, None, 30)
    frame = spark.createDataFrame([(i, bytearray(c), d) for i, (c, d, *_) in enumerate(cases)], "asset_id long, content binary, drop array<string>")
    made = rewrite.rewritten(frame, frame["drop"])
    got = {r["asset_id"]: r for r in made.collect()}
    for i, (_, _, wanted, code) in enumerate(cases):
        assert (None if wanted is None else wanted, code) == (got[i]["content"] and bytes(got[i]["content"]), got[i]["exit_code"]), i
    left = {(r["asset_id"], r["class"]) for r in containers.marks(made.where("asset_id IN (1, 5, 8)")).collect()}
    assert left == {(1, "c2pa"), (5, "c2pa")}
    assert rewrite.dropped_by(["MC01", "MC02", "MC14", "PX01"]) == ["iptc", "mp3_info", "xmp"]
    where = [tuple(r) for r in rewrite.chunk_offsets(made.where("asset_id < 9")).orderBy("asset_id", "chunk").collect()]
    assert [w[:2] for w in where] == [(i, k) for i in (5, 6) for k in range(7)]
    assert [w[2] for w in where[7:]] == mp4.chunk_offsets(content)
