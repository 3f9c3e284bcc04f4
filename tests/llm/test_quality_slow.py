"""Features, scores and probabilities of the quality classifier against plain Python, text by text."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from marklens.llm import quality

TEXTS = [None, "", " ", "Plain words, words again.\nPlain words, words again.\n", "ÀÉÎ ñandú 中文\t123 !!", "x" * 3000, "A1b2 C3\r\n\r\nd", "one\n\none\n", "𝄞 " * 9, "Zz-zz zZ"]


def slow(text, model):
    content = (text or "").encode()
    words = [w.encode() if isinstance(w, str) else w for w in re.findall(rb"[a-z\x80-\xff]+", content.lower())]
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    n, lines = max(1, len(content)), content.split(b"\n")
    count = lambda when: sum(map(when, content))
    letters, spaces, digits, ends = count(letter), count(lambda b: b in b"\t\v\f\r "), count(lambda b: 48 <= b <= 57), content.count(b"\n")
    measures = [
        math.log(1 + len(content)), count(lambda b: 65 <= b <= 90) / max(1, letters), digits / n, (n - letters - spaces - digits - ends) / n, spaces / n, ends / n,
        count(lambda b: b >= 128) / n, sum(len(w) for w in words) / max(1, len(words)) / 10, len(set(words)) / max(1, len(words)) ** 0.9, 1 - len(set(lines)) / len(lines),
    ]
    ids = {xxhash.xxh3_64_intdigest(w) % 2**quality.BITS for w in set(words)}
    score = sum(float(model.weights[i]) for i in ids) + sum(d * (x - m) / s for d, x, m, s in zip(model.dense, measures, model.mean, model.spread))
    below = [0.0, *(1 / (1 + math.exp(score - t)) for t in model.thresholds), 1.0]
    return len(ids), score, [b - a for a, b in zip(below, below[1:])]


def test_equal_plain_python():
    some = np.random.default_rng(1)
    k = len(quality.SHAPE)
    model = quality.Model(some.normal(0, 0.2, 2**quality.BITS).astype(np.float32), some.normal(0, 0.3, k), some.normal(0, 1, k), some.uniform(0.5, 2, k), np.array([-0.4, 0.7]))
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abcXYZ 0!\n\té中") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    n, scores, p = quality.probabilities(pa.array(texts, pa.string()), model, {})
    for i, text in enumerate(texts):
        want = slow(text, model)
        assert n[i] == want[0] and scores[i] == pytest.approx(want[1], abs=1e-6) and p[i].tolist() == pytest.approx(want[2], abs=1e-6)
        assert model.keeps(p[i : i + 1], 0.5)[0] == (want[2][-1] >= 0.5)


def test_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.trained(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = quality.op3_quality(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n, score, p = slow(texts[r["doc_id"]], model)
        assert r["n_features"] == n and r["score"] == pytest.approx(score, abs=1e-6) and r["p_tail"] == pytest.approx(p[-1], abs=1e-6) and r["p_toxic"] == pytest.approx(p[0], abs=1e-6)
        assert r["expected_grade"] == pytest.approx(p[1] + 2 * p[2], abs=1e-6) and r["grade"] == max(range(3), key=p.__getitem__) and r["kept"] == (p[-1] >= 0.5)
