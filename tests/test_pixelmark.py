"""The pixel mark, read from pictures drawn here, against plain Python."""

import math

import numpy as np

from marklens.functions import jpeg, samples
from marklens.operators import pixelmark


def plain(picture, payload):
    """Blocks, and the payload's agreement, by loops."""
    high, wide = len(picture) // 4 * 4, len(picture[0]) // 4 * 4
    u = {}
    for y in range(high):
        for x in range(wide):
            r, g, b = (int(v) for v in picture[y][x][:3])
            luma = (r * 4899 + g * 9617 + b * 1868 + 8192) >> 14
            u[y, x] = min(255, max(0, ((b - luma) * 8061 + (128 << 14) + 8192) >> 14))
    s = math.sqrt(0.5)
    low = lambda y, x: (u[2 * y + 1, 2 * x + 1] * s + u[2 * y, 2 * x + 1] * s) * s + (u[2 * y + 1, 2 * x] * s + u[2 * y, 2 * x] * s) * s
    bits = [max(low(y + i // 4, x + i % 4) for i in range(1, 16)) % 36 > 18 for y in range(0, high // 2 - 3, 4) for x in range(0, wide // 2 - 3, 4)]
    same = 0
    for k, wanted in enumerate(payload):
        mine = bits[k :: len(payload)]
        same += (bool(mine) and sum(mine) * 255 / len(mine) > 127) == (wanted == "1")
    return len(bits), math.floor(same / len(payload) * 1000 + 0.5) / 1000


def drawn(payload, down, across, wrong=()):
    """A grey picture; in each block one patch is a little bluer, by the payload's bit."""
    picture = np.full((8 * down, 8 * across, 3), 128, np.uint8)
    for i in range(down * across):
        bit = (payload[i % len(payload)] == "1") != (i % len(payload) in wrong)
        y, x = 8 * (i // across), 8 * (i % across)
        picture[y : y + 2, x + 2 : x + 4, 2] = 156 if bit else 166
    return picture


def test_decisions(spark):
    one, two = pixelmark.PAYLOADS.values()
    some = np.random.default_rng(3)
    pictures = {
        1: drawn(one, 9, 7), 2: drawn(two, 12, 12), 3: drawn(one, 8, 8, wrong=range(9)), 4: drawn(one, 8, 8, wrong=range(10)), 5: drawn(one, 6, 7),
        6: some.integers(0, 256, (83, 91, 3)).astype(np.uint8), 7: some.integers(0, 256, (70, 150, 4)).astype(np.uint8), 8: np.zeros((3, 3, 3), np.uint8),
    }
    files = {i: samples.png_of(p) for i, p in pictures.items()} | {9: b"\x89PNG\r\n\x1a\n", 10: None, 11: b"", 12: b"text"}
    rows = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in files.items()], "asset_id long, content binary")
    got = {r["asset_id"]: r for r in pixelmark.decisions(rows).collect()}
    assert len(got) == 12
    for i, p in pictures.items():
        for name, payload in pixelmark.PAYLOADS.items():
            assert (got[i]["blocks"], got[i]["agreements"][name]) == plain(p, payload), (i, name)
    assert {i for i, r in got.items() if r["state"] == "confirmed_present"} == {1, 2, 3}  # 4: too many wrong; 5: too few blocks
    assert [got[i]["state"] for i in (9, 10, 11, 12)] == ["malformed"] + ["unsupported_format"] * 3
    assert got[3]["evidence"][0] == "payload sdxl-48 matches 0.813 of its bits in 64 blocks, 0.80 are needed: found" and got[9]["evidence"] == []
    assert pixelmark.decisions(rows.limit(0)).count() == 0


def as_jpeg(picture, factors):
    """Coefficients by the transform of a picture's own blue difference and luma, unrounded colours left out."""
    lum = picture.astype(float) @ [0.299, 0.587, 0.114] - 128
    blue = (picture[..., 2] - picture.astype(float) @ [0.299, 0.587, 0.114]) / 1.772
    wave = np.array([[(0.125**0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    most = max(a for a, _ in factors)
    planes = []
    for plane, (a, _) in zip((lum, blue, blue * 0), factors):
        r = most // a
        plane = plane.reshape(plane.shape[0] // r, r, plane.shape[1] // r, r).mean((1, 3))
        blocks = plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
        planes.append(np.rint(wave @ blocks @ wave.T).astype(int).reshape(*blocks.shape[:2], 64))
    return jpeg.of_coefficients(picture.shape[1], picture.shape[0], planes, factors)


def test_jpeg_decisions(spark):
    """Whole colours show the mark; halved ones that show none are not called free of it."""
    one = pixelmark.PAYLOADS["sdxl-48"]
    marked, plain_ = drawn(one, 8, 8), np.full((64, 64, 3), 120, np.uint8)
    whole, half = [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)]
    files = {1: as_jpeg(marked, whole), 2: as_jpeg(plain_, whole), 3: as_jpeg(plain_, half), 4: as_jpeg(plain_, whole)[:90], 5: as_jpeg(plain_, whole).replace(b"\xff\xc0", b"\xff\xc9")}
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in files.items()], "asset_id long, content binary")
    got = {r["asset_id"]: r for r in pixelmark.decisions(rows).collect()}
    assert [got[i]["state"] for i in range(1, 6)] == ["confirmed_present", "confirmed_absent", "unsupported_format", "malformed", "unsupported_format"]
    pixels = np.concatenate(list(jpeg.bands(files[1])[2]))
    assert (got[1]["blocks"], got[1]["agreements"]["sdxl-48"]) == plain(pixels, one)


def test_votes_in_bands(monkeypatch):
    picture = np.random.default_rng(4).integers(0, 256, (77, 41, 3)).astype(np.uint8)
    whole = pixelmark.voted(iter([picture]))
    assert pixelmark.voted(iter([picture[:3], picture[3:30], picture[30:]])) == whole == pixelmark.voted(samples.png_bands(samples.png_of(picture))[2])
