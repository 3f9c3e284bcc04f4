"""JPEG pixels against a plain slow decoder of coefficients and against the JVM's own reader and writer."""

import math
import random

import numpy as np
import pytest

from marklens.functions import jpeg


def slow_samples(block, quantum):
    """One block by the definition of the inverse transform."""
    out = np.zeros((8, 8), int)
    half = lambda u: math.sqrt(0.5) if u == 0 else 1.0
    for y in range(8):
        for x in range(8):
            total = sum(
                half(u) * half(v) / 4 * int(block[8 * v + u]) * int(quantum[8 * v + u]) * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16)
                for v in range(8) for u in range(8) if block[8 * v + u]
            )
            out[y, x] = min(255, max(0, math.floor(total + 128.5 + jpeg.LIFT)))
    return out


def slow_pixels(width, height, planes, factors, quantum):
    """Pixel by pixel: the nearer sample counts three parts and the next one, each way in which a component is halved."""
    most = max(a for a, _ in factors), max(d for _, d in factors)
    made = []
    for plane, (across, down) in zip(planes, factors):
        grid = np.block([[slow_samples(b, quantum) for b in line] for line in plane])
        ratio_x, ratio_y = most[0] // across, most[1] // down
        grid = grid[: math.ceil(height / ratio_y), : math.ceil(width / ratio_x)]
        at = lambda y, x, g=grid: int(g[min(max(y, 0), len(g) - 1), min(max(x, 0), g.shape[1] - 1)])

        def sample(y, x, at=at, ratio_x=ratio_x, ratio_y=ratio_y):
            if ratio_x > 2 or ratio_y > 2:
                return at(y // ratio_y, x // ratio_x)
            ways_y = [(y, 1)] if ratio_y == 1 else [(y // 2, 3), (y // 2 + (1 if y % 2 else -1), 1)]
            ways_x = [(x, 1)] if ratio_x == 1 else [(x // 2, 3), (x // 2 + (1 if x % 2 else -1), 1)]
            parts = sum(b for _, b in ways_y) * sum(b for _, b in ways_x)
            return (sum(at(i, j) * b * d for i, b in ways_y for j, d in ways_x) + parts // 2) // parts

        made.append(sample)
    out = np.zeros((height, width, 3), int)
    for y in range(height):
        for x in range(width):
            if len(made) == 1:
                out[y, x] = made[0](y, x)
            else:
                lum, cb, cr = (s(y, x) for s in made)
                for i, v in enumerate((lum + 1.402 * (cr - 128), lum - 0.344136286 * (cb - 128) - 0.714136286 * (cr - 128), lum + 1.772 * (cb - 128))):
                    out[y, x, i] = min(255, max(0, math.floor(v + 0.5 + jpeg.LIFT)))
    return out


def random_planes(rng, width, height, factors, most=40):
    wide, high = 8 * max(a for a, _ in factors), 8 * max(d for _, d in factors)
    planes = []
    for across, down in factors:
        plane = np.zeros((-(-height // high) * down, -(-width // wide) * across, 64), int)
        plane[..., 0] = rng.integers(-most * 12, most * 12, plane.shape[:2])
        for k in rng.choice(64, 5, replace=False):
            plane[..., k] = rng.integers(-most, most, plane.shape[:2])
        planes.append(plane)
    return planes


def pixels(content):
    height, width, bands = jpeg.bands(content)
    whole = np.concatenate(list(bands))
    assert whole.shape == (height, width, 3) and whole.dtype == np.uint8
    return whole


SAMPLINGS = [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)], [(4, 1), (1, 1), (1, 1)], [(2, 2), (2, 1), (1, 2)]]


@pytest.mark.parametrize("factors", SAMPLINGS)
@pytest.mark.parametrize("restart", [0, 1, 3])
def test_equal_slow_decoder(factors, restart):
    rng = np.random.default_rng(len(factors) * 10 + restart)
    quantum = rng.integers(1, 4, 64)
    for width, height in ((1, 1), (17, 35), (33, 16)):
        planes = random_planes(rng, width, height, factors)
        got = pixels(jpeg.of_coefficients(width, height, planes, factors, quantum, restart))
        assert (got == slow_pixels(width, height, planes, factors, quantum)).all()


def test_broken_tails_and_other_forms():
    rng = np.random.default_rng(5)
    planes = random_planes(rng, 40, 40, [(1, 1)] * 3)
    whole = jpeg.of_coefficients(40, 40, planes, [(1, 1)] * 3, restart=4)
    assert (pixels(whole[:-2]) == pixels(whole)).all()  # no end marker
    for cut in (len(whole) // 2, len(whole) - 40, 30, 3):
        with pytest.raises(jpeg.Unreadable):
            pixels(whole[:cut])
    for marker, error in ((0xC3, jpeg.Unread), (0xC9, jpeg.Unread)):
        with pytest.raises(error):
            pixels(whole.replace(b"\xff\xc0", bytes([0xFF, marker])))
    deep = whole.replace(b"\xff\xc0\x00\x11\x08", b"\xff\xc0\x00\x11\x0c")
    with pytest.raises(jpeg.Unread):
        pixels(deep)
    for i in range(0, len(whole), 7):  # a damaged byte gives pixels or one of the two errors
        try:
            pixels(whole[:i] + bytes([whole[i] ^ 0x55]) + whole[i + 1 :])
        except (jpeg.Unreadable, jpeg.Unread):
            pass
    assert jpeg.subsampled(whole) is False and jpeg.subsampled(b"\xff\xd8\xff\xd9") is None
    assert jpeg.subsampled(jpeg.of_coefficients(8, 8, random_planes(rng, 8, 8, SAMPLINGS[2]), SAMPLINGS[2])) is True


def jvm_written(spark, picture, quality, progressive, subsampling=None):
    """The JVM's own JPEG writer."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    height, width, _ = picture.shape
    image = jvm.java.awt.image.BufferedImage(width, height, 1)
    rgb = (picture[..., 0].astype(int) << 16 | picture[..., 1].astype(int) << 8 | picture[..., 2]).ravel().tolist()
    numbers = gateway.new_array(jvm.int, len(rgb))
    for i, v in enumerate(rgb):
        numbers[i] = v
    image.setRGB(0, 0, width, height, numbers, 0, width)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setCompressionMode(2)
    how.setCompressionQuality(quality)
    how.setProgressiveMode(1 if progressive else 0)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    stream.close()
    return bytes(out.toByteArray())


def jvm_read(spark, content):
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(content))
    width, height = image.getWidth(), image.getHeight()
    rgb = np.array(list(image.getRGB(0, 0, width, height, None, 0, width)), np.int64) & 0xFFFFFF
    return np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255], axis=-1).reshape(height, width, 3)


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("quality", [0.3, 0.95])
def test_files_of_another_writer(spark, progressive, quality):
    """Subsampled, with codes of all lengths; progressive ones come in ten scans with refinements."""
    y, x = np.mgrid[:45, :61]
    noise = np.random.default_rng(1).integers(0, 40, (45, 61, 3))
    picture = np.clip(np.stack([x * 4, y * 5, (x + y) * 2], axis=-1) + noise, 0, 255).astype(np.uint8)
    content = jvm_written(spark, picture, quality, progressive)
    assert (b"\xff\xc2" in content) == progressive
    off = np.abs(pixels(content).astype(int) - jvm_read(spark, content))
    assert off.max() <= 4 and off.mean() < 0.4  # the transforms and upsamplings of two decoders round differently
