"""Plain tags left out of small files built here: what stays is what would have been written without them."""

import pytest
from test_containers import jpeg, png, riff

from marklens.operators import containers, rewrite

TEXT, ICON, PACKET, ODD, BOX = (b"tEXt", b"a\0b"), (b"iCCP", b"p"), (b"iTXt", b"XML:com.adobe.xmp\0x"), (b"prVt", b"?"), (b"caBX", b"jumb")
HEAD, SOUND, INFO, FILM = (b"fmt ", b"\0" * 16), (b"data", b"abc"), (b"LIST", b"INFOISFT"), (b"LIST", b"movi")
WEBP = lambda flags: (b"VP8X", bytes([flags]) + b"\0" * 9)
ALL = rewrite.CLASSES
CASES = [
    (png(TEXT, ICON, PACKET, ODD), ["png_text"], png(ICON, PACKET, ODD), ["tEXt"]),
    (png(TEXT, ICON, PACKET, ODD), ["xmp", "unlisted"], png(TEXT, ICON), ["iTXt", "prVt"]),
    (png(BOX, ICON, (b"eXIf", b"II"), (b"prVt", b"c2pa"), ODD), ALL, png(BOX, ICON, (b"prVt", b"c2pa")), ["eXIf", "prVt"]),  # manifests stay
    (png(ICON), ALL, png(ICON), []),
    (jpeg(), ALL, jpeg(), []),
    (png(TEXT) + b"tail", ["xmp"], png(TEXT) + b"tail", []),
    (riff(b"WAVE", HEAD, INFO, (b"bext", b"x"), SOUND, (b"id3 ", b"ID3")), ["riff_ancillary", "id3"], riff(b"WAVE", HEAD, (b"bext", b"x"), SOUND), ["LIST", "id3 "]),
    (riff(b"WAVE", HEAD, (b"bext", b"x"), FILM, (b"C2PA", b"x"), (b"junk", b""), SOUND), ALL, riff(b"WAVE", HEAD, FILM, (b"C2PA", b"x"), SOUND), ["bext", "junk"]),
    (riff(b"WEBP", WEBP(0x2E), (b"VP8L", b"p"), (b"EXIF", b"e"), (b"XMP ", b"m"), (b"ICCP", b"i")), ["exif"], riff(b"WEBP", WEBP(0x26), (b"VP8L", b"p"), (b"XMP ", b"m"), (b"ICCP", b"i")), ["EXIF"]),
    (b"fLaC\0\0\0\2ab\4\0\0\1v\x82\0\0\1pSOUND", ["vorbis"], b"fLaC\0\0\0\2ab\x82\0\0\1pSOUND", ["4"]),
    (b"fLaC\0\0\0\2ab\4\0\0\1v\x82\0\0\1pSOUND", ALL, b"fLaC\x80\0\0\2abSOUND", ["4", "2"]),
]


def test_rewritten(spark):
    broken = [(png(TEXT)[:-3], 30), (riff(b"WAVE", INFO)[:-2], 30), (b"fLaC\0\0\0\2a", 30), (b"OggS....", 40), (b"text", 40), (None, 40), (b"", 40)]
    rows = [(i, bytearray(c), d) for i, (c, d, _, _) in enumerate(CASES)] + [(100 + i, None if c is None else bytearray(c), ALL) for i, (c, _) in enumerate(broken)]
    rows += [(200, bytearray(png(TEXT)), None), (201, bytearray(png(BOX)), ["c2pa"])]
    frame = spark.createDataFrame(rows, "asset_id long, content binary, drop array<string>")
    made = rewrite.rewritten(frame, frame["drop"])
    got = {r["asset_id"]: r for r in made.collect()}
    for i, (_, _, wanted, removed) in enumerate(CASES):
        assert (bytes(got[i]["content"]), got[i]["removed"], got[i]["exit_code"]) == (wanted, removed, 0), i
    assert [(got[100 + i]["content"], got[100 + i]["exit_code"]) for i in range(len(broken))] == [(None, code) for _, code in broken]
    assert bytes(got[200]["content"]) == png(TEXT) and bytes(got[201]["content"]) == png(BOX)
    left = {(r["asset_id"], r["class"]) for r in containers.marks(made.where("asset_id < 10 AND exit_code = 0")).collect()}
    assert left == {(0, "xmp"), (1, "png_text"), (2, "c2pa"), (5, "png_text"), (7, "c2pa"), (8, "xmp")}
    again = rewrite.rewritten(made.where("exit_code = 0 AND asset_id IN (2, 7, 10)"), ALL).collect()
    assert [(bytes(r["content"]), r["removed"]) for r in again] == [(CASES[r["asset_id"]][2], []) for r in again]


def test_manifests_are_not_asked_for(spark):
    frame = spark.createDataFrame([], "asset_id long, content binary")
    assert rewrite.rewritten(frame, ["xmp"]).count() == 0
    with pytest.raises(ValueError):
        rewrite.rewritten(frame, ["c2pa"])
