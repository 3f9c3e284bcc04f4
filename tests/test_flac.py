"""FLAC against its own digest: files written here with every kind of subframe, coding and stereo layout."""

import hashlib
import random
import struct

import numpy as np
import pytest
from test_fidelity import plain_distance

from marklens.functions import flac, samples
from marklens.operators import fidelity


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits.append(f"{value & (1 << n) - 1:0{n}b}" if n else "")

    def bytes(self):
        text = "".join(self.bits)
        text += "0" * (-len(text) % 8)
        return int("1" + text, 2).to_bytes(len(text) // 8 + 1, "big")[1:]


def put_differences(w, rng, values, order, size, method):
    parts = rng.choice([p for p in range(4) if size % (1 << p) == 0 and size >> p >= order])
    w.put(method, 2)
    w.put(parts, 4)
    at = 0
    for i in range(1 << parts):
        n = (size >> parts) - (order if i == 0 else 0)
        mine, width = values[at : at + n], 4 + method
        at += n
        k = max(0, max([(2 * abs(v)).bit_length() for v in mine], default=0) - rng.randint(1, 4))
        if rng.random() < 0.2 or k >= (1 << width) - 1:
            raw = max([abs(v).bit_length() + 1 for v in mine], default=0)
            w.put(-1, width)
            w.put(raw, 5)
            for v in mine:
                w.put(v, raw)
            continue
        w.put(k, width)
        for v in mine:
            u = 2 * v if v >= 0 else -2 * v - 1
            w.bits.append("0" * (u >> k) + "1")
            w.put(u, k)


def put_subframe(w, rng, x, depth, kind):
    wasted = 0
    while kind != "constant" and any(x) and not any(v & ((2 << wasted) - 1) for v in x):
        wasted += 1
    x, depth = [v >> wasted for v in x], depth - wasted
    order = {"constant": 0, "plain": 0}.get(kind, int(kind[1:]) if kind[0] in "fl" else 0)
    code = {"constant": 0, "plain": 1}.get(kind, 8 + order if kind[0] == "f" else 31 + order)
    w.put(code << 1 | (wasted > 0), 8)
    if wasted:
        w.bits.append("0" * (wasted - 1) + "1")
    for v in x[:1] if kind == "constant" else x if kind == "plain" else x[:order]:
        w.put(v, depth)
    if kind[0] == "f":
        put_differences(w, rng, np.diff(np.array(x, object), n=order).tolist() if order else x, order, len(x), rng.randint(0, 1))
    elif kind[0] == "l":
        factors = [rng.randint(-60, 60) for _ in range(order)]
        w.put(8 - 1, 4)
        w.put(5, 5)
        for f in factors:
            w.put(f, 8)
        put_differences(w, rng, [x[i] - (sum(f * x[i - 1 - j] for j, f in enumerate(factors)) >> 5) for i in range(order, len(x))], order, len(x), rng.randint(0, 1))


def number_of(i):
    return bytes([i]) if i < 128 else bytes([0xC0 | i >> 6, 0x80 | i & 63])


def written(sound, depth, rng, rate=8000, kinds=("constant", "plain", *(f"f{o}" for o in range(5)), "l1", "l3", "l12"), digest=True, more=b""):
    """samples x channels as a file of frames of 64 or 100 samples."""
    out, at, n, channels = [], 0, 0, sound.shape[1]
    while at < len(sound):
        size = min(rng.choice([64, 100]), len(sound) - at)
        part = sound[at : at + size]
        layout = rng.choice([1, 8, 9, 10]) if channels == 2 else channels - 1
        one = [part[:, c].tolist() for c in range(channels)]
        depths = [depth] * channels
        if layout >= 8:
            side = [a - b for a, b in zip(*one)]
            one = {8: [one[0], side], 9: [side, one[1]], 10: [[a + b >> 1 for a, b in zip(*one)], side]}[layout]
            depths = {8: [depth, depth + 1], 9: [depth + 1, depth], 10: [depth, depth + 1]}[layout]
        w = Writer()
        for v, n_bits in ((0x3FFE, 14), (0, 2), (6, 4), (4, 4), (layout, 4), ({8: 1, 12: 2, 16: 4, 20: 5, 24: 6}[depth], 3), (0, 1)):
            w.put(v, n_bits)
        head = w.bytes() + number_of(n) + bytes([size - 1])
        w = Writer()
        for x, d in zip(one, depths):
            fit = [k for k in kinds if (k != "constant" or len(set(x)) == 1) and (k[0] not in "fl" or int(k[1:]) <= size)]
            put_subframe(w, rng, x, d, rng.choice(fit))
        body = head + bytes([flac.sum_8(head)]) + w.bytes()
        out.append(body + struct.pack(">H", flac.sum_16(body)))
        at, n = at + size, n + 1
    plain = sound.astype("<i8").reshape(-1, 1).view(np.uint8)[:, : (depth + 7) // 8].tobytes()
    packed = rate << 44 | channels - 1 << 41 | depth - 1 << 36 | len(sound)
    info = bytes(10) + struct.pack(">Q", packed) + (hashlib.md5(plain).digest() if digest else bytes(16))
    return b"fLaC" + struct.pack(">I", 34 | 0x80 << 24) + info + b"".join(out) + more


def test_sums():
    assert flac.sum_8(b"123456789") == 0xF4 and flac.sum_16(b"123456789") == 0xFEE8


@pytest.mark.parametrize("depth", [8, 12, 16, 24])
@pytest.mark.parametrize("channels", [1, 2, 3])
def test_numbers(depth, channels):
    rng, some = random.Random(depth + channels), np.random.default_rng(depth)
    full = 1 << depth - 1
    wave = (np.sin(np.arange(330)[:, None] / [7, 9, 11][:channels]) * full * 0.4).astype(np.int64)
    for sound in (wave, some.integers(-full, full, (300, channels)), np.full((200, channels), -full), wave[:150] << 2 if depth > 8 else wave, wave[:1], np.empty((0, channels), np.int64)):
        sound = np.clip(sound, -full, full - 1)
        info, got = flac.numbers(written(sound, depth, rng))
        assert (info.rate, info.channels, info.depth) == (8000, channels, depth) and (got == sound).all() and got.shape == sound.shape


def test_damage():
    rng = random.Random(1)
    sound = (np.sin(np.arange(200)[:, None] / [5, 6]) * 9000).astype(np.int64)
    content = written(sound, 16, rng)
    assert (flac.numbers(content + b"TAG" + bytes(125))[1] == sound).all()  # what follows the last frame is not looked at
    for i in range(0, len(content), 61):
        for cut in (content[:i], content[:i] + bytes([content[i] ^ 0x41]) + content[i + 1 :]):
            try:
                assert (flac.numbers(cut)[1] == sound).all()
            except (flac.Unreadable, flac.Unread):
                pass
    with pytest.raises(flac.Unreadable, match="digest"):
        broken = bytearray(content)
        broken[26 + 2] ^= 1
        flac.numbers(bytes(broken))


def test_distance_of_sounds(spark):
    rng = random.Random(2)
    tone = (np.sin(np.arange(9000)[:, None] / [9, 13]) * 9000).astype(np.int64)
    coarse = tone // 512 * 512
    files = {1: (tone, coarse), 2: (tone, tone), 3: (tone[:5119], tone)}
    rows = [(i, *(bytearray(written(s, 16, rng, kinds=("f2", "f1"))) for s in pair)) for i, pair in files.items()]
    rows.append((4, rows[0][1], rows[0][1][:-9]))
    rows.append((5, rows[0][1], bytearray(samples.wav_of(samples.Sound(8000, 16, False, tone / 2.0**15)))))
    got = {r["asset_id"]: r for r in fidelity.measures(spark.createDataFrame(rows, "asset_id long, before binary, after binary")).collect()}
    assert {i: r["exit_code"] for i, r in got.items()} == {1: 0, 2: 0, 3: 30, 4: 30, 5: 40}
    assert got[1]["lsd_db"] == pytest.approx(plain_distance(tone.mean(1) / 2.0**15, coarse.mean(1) / 2.0**15), rel=1e-4) and got[2]["lsd_db"] == 0
