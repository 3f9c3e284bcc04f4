"""Codes read at many places at once against the same codes read one by one."""

import itertools
import sys

import numpy as np
import pyarrow as pa
import pytest
from test_jpeg import SAMPLINGS, random_planes

from marklens.functions import huffman, jpeg
from marklens.operators import fidelity
from marklens.plans import media_queries


def one_by_one(content):
    picture = jpeg.Picture()
    return np.concatenate(list(jpeg._bands(picture, jpeg.kept_strips(picture, jpeg.scans(content, picture)))))


def pictures(rng, n, full=True):
    for i in range(n):
        factors = SAMPLINGS[i % len(SAMPLINGS)]
        width, height = (int(x) for x in rng.integers(1, 90, 2))
        planes = random_planes(rng, width, height, factors)
        if full and i % 3 == 0:  # full blocks, which no code ends
            planes = [rng.integers(-1000, 1000, p.shape) * (rng.random(p.shape) < 0.3 ** (i % 4)) for p in planes]
        yield jpeg.of_coefficients(width, height, planes, factors, rng.integers(1, 4, 64), int(rng.integers(0, 6)))


@pytest.mark.parametrize("stretch, lead, stretches, rounds, few, blocks", [(2048, 1024, 4096, 12, 64, 2**16), (64, 0, 7, 0, 64, 5), (64, 32, 50, 2, 0, 1), (256, 128, 1000, 30, 0, 40)])
def test_several_equal_one_by_one(monkeypatch, stretch, lead, stretches, rounds, few, blocks):
    for name, value in (("STRETCH", stretch), ("LEAD", lead), ("STRETCHES", stretches), ("ROUNDS", rounds), ("FEW", few), ("BLOCKS", blocks)):
        monkeypatch.setattr(huffman, name, value)
    monkeypatch.setattr(jpeg, "AT_ONCE", 16)
    contents = list(pictures(np.random.default_rng(stretch), 28))
    for content, opened in zip(contents, jpeg.several(contents), strict=True):
        height, width, bands = opened()
        want = one_by_one(content)
        assert want.shape == (height, width, 3) and (np.concatenate(list(bands)) == want).all()


def test_broken_ones_among_others():
    """Cut, damaged or unread files give what they give alone, and those beside them all their pixels."""
    rng = np.random.default_rng(3)
    contents = list(pictures(rng, 40))
    for i in range(0, 40, 4):
        at = int(rng.integers(200, max(201, len(contents[i]))))
        contents[i] = [contents[i][:at], contents[i][:at] + bytes(3) + contents[i][at + 3 :], contents[i].replace(b"\xff\xc0", b"\xff\xc9"), b"\xff\xd8\xff"][i // 4 % 4]
    contents[2] = contents[2].replace(b"\xff\xc0\x00\x11\x08" + contents[2][contents[2].index(b"\xff\xc0") + 5 :][:2], b"\xff\xc0\x00\x11\x08\xff\xff")  # far more lines than there are
    wrong = 0
    for content, opened in zip(contents, jpeg.several(contents), strict=True):
        try:
            want = one_by_one(content) if len(content) and content is not contents[2] else None
        except (jpeg.Unread, jpeg.Unreadable) as e:
            want = type(e)
        if isinstance(want, np.ndarray):
            assert (np.concatenate(list(opened()[2])) == want).all()
        else:
            wrong += 1
            with pytest.raises(want or jpeg.Unreadable):
                list(opened()[2])
    assert 5 < wrong < 15


def test_more_codes_than_are_read_together(monkeypatch):
    monkeypatch.setattr(jpeg, "TOGETHER", 2)
    contents = list(pictures(np.random.default_rng(8), 6, full=False))
    other = [c.replace(bytes([0, 0, 0, 0, 12, *[0] * 12]), bytes([0, 0, 0, 0, 11, 0, 1, *[0] * 10])) for c in contents]  # a longer code for the largest size
    for content, opened in zip(itertools.chain(*zip(contents, other)), jpeg.several(list(itertools.chain(*zip(contents, other))))):
        assert (np.concatenate(list(opened()[2])) == one_by_one(content)).all()


def test_components_of_the_same_codes_come_into_step(monkeypatch):
    """Which of a unit's blocks is read can't be told from the data if all have the same codes, and isn't asked."""
    walked = []
    walk = huffman.Tables.walk
    monkeypatch.setattr(huffman.Tables, "walk", lambda self, *args: walked.append(1) or walk(self, *args))
    planes = random_planes(np.random.default_rng(4), 700, 500, SAMPLINGS[2])
    content = jpeg.of_coefficients(700, 500, planes, SAMPLINGS[2])
    assert (np.concatenate(list(jpeg.bands(content)[2])) == one_by_one(content)).all()
    assert len(walked) < len(content) * 8 / huffman.STRETCH / 2


def test_no_function_is_called_by_block_or_code(monkeypatch):
    """Drawing and totals of jpeg_pixels: their steps follow the files and the lengths of stretches, not the blocks."""
    monkeypatch.setattr(media_queries.arrow, "by_slices", lambda each, kind, files=False: lambda *c: each)
    each = fidelity.totals(None, None)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(32, 127, 40_000).tolist()) for _ in range(5)]
    blocks = sum(-(-len(t) // 128) * 16 for t in texts)
    calls = 0

    def count(frame, event, _arg):
        nonlocal calls
        calls += event == "call" and "marklens" in frame.f_code.co_filename

    sys.setprofile(count)
    try:
        files = media_queries.drawn(pa.array(texts, pa.binary()))
        made = each(pa.array(["jpeg"] * len(texts)), files).to_pylist()
    finally:
        sys.setprofile(None)
    assert calls < blocks / 10
    for text, got in zip(texts[:2], made):
        want = one_by_one(files[texts.index(text)].as_py()).astype(int)
        assert got == {"width": 128, "height": len(want), "total": want.sum(), "squares": (want**2).sum(), "problem": None}
