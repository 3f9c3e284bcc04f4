"""PNG and WAV samples and fidelity measures against plain Python."""

import math
import random
import struct
import zlib

import numpy as np
import pytest

from marklens.functions import jpeg, samples
from marklens.operators import fidelity


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(line, above, step, kind):
    """One line of bytes as a writer would filter it."""
    out = []
    for i, v in enumerate(line):
        a, b, c = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
        p = a + b - c
        nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out.append((v - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
    return bytes([kind, *out])


def written(width, height, depth, colour, passes, pixel, extra=()):
    """A PNG from pixel(x, y) -> numbers per channel, with all filters in turn."""
    made, n = b"", samples.CHANNELS[colour]
    for x0, y0, dx, dy in passes:
        xs, ys = range(x0, width, dx), range(y0, height, dy)
        above = None
        for i, y in enumerate(ys if xs else ()):
            bits = "".join(f"{v:0{depth}b}" for x in xs for v in pixel(x, y))
            bits += "0" * (-len(bits) % 8)
            line = bytes(int(bits[j : j + 8], 2) for j in range(0, len(bits), 8))
            made += filtered(line, above or bytes(len(line)), max(1, depth * n // 8), i % 5)
            above = line
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, len(passes) > 1)
    data = zlib.compress(made)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + b"".join(chunk(*e) for e in extra) + chunk(b"IDAT", data[:9]) + chunk(b"IDAT", data[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("passes", [[(0, 0, 1, 1)], samples.PASSES])
@pytest.mark.parametrize("colour,depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_png(colour, depth, passes):
    n, some = samples.CHANNELS[colour], random.Random(depth * 10 + colour)
    for width, height in ((11, 13), (1, 1), (3, 20)):
        grid = {(x, y): [some.randrange(2**depth) for _ in range(n)] for x in range(width) for y in range(height)}
        got = samples.png_pixels(written(width, height, depth, colour, passes, lambda x, y: grid[x, y]))
        eight = lambda v: v >> 8 if depth == 16 else v * 255 // (2**depth - 1)
        for (x, y), values in grid.items():
            values = [eight(v) for v in values]
            assert got[y, x].tolist() == ([values[0]] * 3 + values[1:] if n < 3 else values)


def test_png_palette_and_clear_colours():
    palette, clear = (b"PLTE", bytes(range(12))), (b"tRNS", b"\x07\x08")
    one = samples.png_pixels(written(4, 1, 2, 3, [(0, 0, 1, 1)], lambda x, y: [x], [palette, clear]))
    assert one.tolist() == [[[0, 1, 2, 7], [3, 4, 5, 8], [6, 7, 8, 255], [9, 10, 11, 255]]]
    two = samples.png_pixels(written(2, 1, 8, 0, [(0, 0, 1, 1)], lambda x, y: [x], [(b"tRNS", b"\0\1")]))
    assert two.tolist() == [[[0, 0, 0, 255], [1, 1, 1, 0]]]
    with pytest.raises(samples.Unreadable):
        samples.png_pixels(written(4, 1, 2, 3, [(0, 0, 1, 1)], lambda x, y: [x], [(b"PLTE", bytes(6))]))


def test_no_cut_or_flipped_byte_crashes():
    picture = written(9, 9, 8, 2, samples.PASSES, lambda x, y: [x, y, x * y])
    sound = samples.wav_of(samples.Sound(8000, 16, False, np.zeros((9, 2))))
    for read, content in ((samples.png_pixels, picture), (samples.wav_sound, sound)):
        for i in range(len(content)):
            for broken in (content[:i], content[:i] + bytes([content[i] ^ 255]) + content[i + 1 :]):
                try:
                    read(broken)
                except (samples.Unreadable, samples.Unread):
                    pass


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_wav(bits):
    some = np.random.default_rng(bits)
    value = some.integers(-(2 ** (min(bits, 24) - 1)), 2 ** (min(bits, 24) - 1), (50, 2)) / 2 ** (min(bits, 24) - 1)
    back = samples.wav_sound(samples.wav_of(samples.Sound(8000, bits, bits == 32, value)))
    assert back[:3] == (8000, bits, bits == 32) and np.abs(back.samples - value).max() <= (1e-7 if bits == 32 else 0)


def test_wav_forms():
    form = struct.pack("<HHIIHH", 0xFFFE, 1, 8000, 16000, 2, 16) + struct.pack("<HHIH", 22, 16, 0, 1) + bytes(14)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", 900) + struct.pack("<hhh", 0, 16384, -32768)[:5]
    assert samples.wav_sound(b"RIFF\0\0\0\0" + body).samples.tolist() == [[0], [0.5]]  # cut short: whole frames count
    with pytest.raises(samples.Unread):
        samples.wav_sound(b"RIFF\0\0\0\0" + body.replace(struct.pack("<HIH", 16, 0, 1), struct.pack("<HIH", 16, 0, 2)))


def plain_measures(a, b):
    """PSNR and SSIM by loops."""
    diff = [(int(x) - int(y)) ** 2 for x, y in zip(a.ravel(), b.ravel())]
    psnr = 10 * math.log10(65025 / (sum(diff) / len(diff))) if any(diff) else 120.0
    luma = lambda p: [[0.299 * r + 0.587 * g + 0.114 * u for r, g, u in row[:, :3].tolist()] for row in p]
    l1, l2, scores = luma(a), luma(b), []
    for y in range(0, len(l1) - 7, 8):
        for x in range(0, len(l1[0]) - 7, 8):
            u, v = ([q[y + i][x + j] for i in range(8) for j in range(8)] for q in (l1, l2))
            mu, mv = sum(u) / 64, sum(v) / 64
            vu, vv, both = sum((p - mu) ** 2 for p in u) / 64, sum((p - mv) ** 2 for p in v) / 64, sum((p - mu) * (q - mv) for p, q in zip(u, v)) / 64
            c1, c2 = 2.55**2, 7.65**2
            scores.append((2 * mu * mv + c1) * (2 * both + c2) / ((mu**2 + mv**2 + c1) * (vu + vv + c2)))
    return psnr, sum(scores) / len(scores) if scores else None


def plain_distance(a, b):
    """Log-spectral distance by sums over every sample and bin."""
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * i / 2048) for i in range(2048)]
    wave = np.exp(-2j * np.pi * np.outer(np.arange(1025), np.arange(2048)) / 2048)
    scores = []
    for at in range(0, min(len(a), len(b)) - 2047, 1024):
        p, q = (10 * np.log10(np.maximum(np.abs(wave @ (s[at : at + 2048] * hann) / 2048) ** 2, 1e-10)) for s in (a, b))
        scores.append(math.sqrt(((p - q) ** 2).mean()))
    return sum(scores) / len(scores)


def test_measures(spark):
    some = np.random.default_rng(5)
    base = some.integers(0, 256, (21, 19, 3)).astype(np.uint8)
    near = (base & 0xFC).astype(np.uint8)
    far = some.integers(0, 256, base.shape).astype(np.uint8)
    clear = np.concatenate([base, np.full((21, 19, 1), 255, np.uint8)], axis=2)
    tone = np.sin(np.arange(9000) / 9)[:, None] * [0.5, 0.25]
    quiet = np.round(tone * 50) / 64
    sound = lambda s, rate=8000: samples.wav_of(samples.Sound(rate, 32, True, s))
    png = samples.png_of
    pairs = {
        1: (png(base), png(near)), 2: (png(base), png(far)), 3: (png(base), png(base)), 4: (png(base), png(clear)), 5: (png(base), png(base[:20])),
        6: (png(base[:7]), png(base[:7])), 7: (png(base), b"\x89PNG\r\n\x1a\n"), 8: (png(base), sound(tone)), 9: (png(base), None), 10: (b"", b""),
        11: (sound(tone), sound(quiet)), 12: (sound(tone[:5119]), sound(tone)), 13: (sound(tone), sound(tone, 9000)), 14: (sound(tone[:5120]), sound(tone)),
    }
    rows = [(i, *(None if c is None else bytearray(c) for c in p)) for i, p in pairs.items()] + [(1, *map(bytearray, pairs[1]))]
    made = fidelity.measures(spark.createDataFrame(rows, "asset_id long, before binary, after binary")).collect()
    assert len(made) == 15
    got = {r["asset_id"]: r for r in made}
    for i, after in ((1, near), (2, far), (3, base)):
        assert (got[i]["psnr_db"], got[i]["ssim"]) == pytest.approx(plain_measures(base, after))
    assert got[4]["psnr_db"] == 120 and got[4]["ssim"] == pytest.approx(1)
    assert {i: r["exit_code"] for i, r in got.items()} == {1: 0, 2: 50, 3: 0, 4: 0, 5: 30, 6: 40, 7: 30, 8: 40, 9: 40, 10: 40, 11: 0, 12: 30, 13: 30, 14: 0}
    assert all(r["passed"] == (r["exit_code"] == 0) == (r["refusal"] is None) for r in made)
    assert got[11]["lsd_db"] == pytest.approx(plain_distance(tone.mean(1), quiet.mean(1)), rel=1e-4)
    assert got[14]["lsd_db"] == 0 and got[12]["lsd_db"] is None


@pytest.mark.parametrize("colour,depth", [(0, 1), (2, 16), (3, 4), (6, 8)])
@pytest.mark.parametrize("passes", [[(0, 0, 1, 1)], samples.PASSES])
def test_pictures_in_bands(monkeypatch, colour, depth, passes):
    """Bands of eight lines, and little data taken in at once, give the same pixels."""
    some = random.Random(depth)
    grid = {(x, y): [some.randrange(2**depth) for _ in range(samples.CHANNELS[colour])] for x in range(21) for y in range(45)}
    content = written(21, 45, depth, colour, passes, lambda x, y: grid[x, y], [(b"PLTE", bytes(range(48)))] if colour == 3 else [])
    whole = samples.png_pixels(content)
    monkeypatch.setattr(samples, "BAND_BYTES", 1)
    monkeypatch.setattr(samples, "TAKEN_IN", 5)
    height, width, bands = samples.png_bands(content)
    bands = list(bands)
    assert (height, width) == (45, 21) and [len(b) for b in bands] == [8, 8, 8, 8, 8, 5]
    assert (np.concatenate(bands) == whole).all()


def test_large_pictures_are_read(spark):
    """A picture of 36 million pixels takes a band's memory, whatever its size."""
    line = zlib.compress(bytes(6000 * (1 + 6000 * 3)), 1)
    head = struct.pack(">IIBBBBB", 6000, 6000, 8, 2, 0, 0, 0)
    content = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", line) + chunk(b"IEND", b"")
    assert max(len(b) for b in samples.png_bands(content)[2]) * 6000 * 3 <= samples.BAND_BYTES
    rows = spark.createDataFrame([(1, bytearray(content), bytearray(content))], "asset_id long, before binary, after binary")
    made = fidelity.measures(rows).first()
    assert (made["psnr_db"], made["exit_code"]) == (120.0, 0)


def test_jpeg_pairs(spark):
    rng = np.random.default_rng(8)
    plane = np.zeros((3, 4, 64), int)
    plane[..., :3] = rng.integers(-90, 90, (3, 4, 3))
    other = plane.copy()
    other[..., 0] += 4
    one, two, far, odd = (jpeg.of_coefficients(w, 24, [p[:, : -(-w // 8)]], [(1, 1)]) for w, p in ((32, plane), (32, other), (32, -plane), (24, plane)))
    cmyk = one.replace(b"\xff\xc0\x00\x0b\x08\x00\x18\x00\x20\x01", b"\xff\xc0\x00\x0b\x08\x00\x18\x00\x20\x04")
    pairs = {1: (one, two), 2: (one, far), 3: (one, odd), 4: (one, one[:60]), 5: (one, cmyk), 6: (one, samples.png_of(np.zeros((24, 32, 3), np.uint8)))}
    rows = spark.createDataFrame([(i, *map(bytearray, p)) for i, p in pairs.items()], "asset_id long, before binary, after binary")
    got = {r["asset_id"]: r for r in fidelity.measures(rows).collect()}
    assert {i: r["exit_code"] for i, r in got.items()} == {1: 0, 2: 50, 3: 30, 4: 30, 5: 40, 6: 40}
    pixels = [np.concatenate(list(jpeg.bands(c)[2])) for c in (one, two)]
    assert (got[1]["psnr_db"], got[1]["ssim"]) == pytest.approx(plain_measures(*pixels))


def test_no_pairs(spark):
    assert fidelity.measures(spark.createDataFrame([], "asset_id long, before binary, after binary")).count() == 0
