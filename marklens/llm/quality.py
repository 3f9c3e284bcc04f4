"""Quality classifier: ordinal cumulative-link (proportional odds) regression on graded ratings.

Grades: 0 toxic, 1 poor, 2 good (from ``labels``: toxic, else quality). One weight vector over hashed
words and text-shape measures is shared by all grades; ordered thresholds cut its score s:

    P(grade <= k) = 1 / (1 + exp(s - threshold_k))

so a document gets an expected grade and the tail probability P(grade >= 2), by which it is selected.

Fitting takes a bounded sample: of the labels that name a document present, the ``fit_rows`` with the
smallest hash of their id. Executors make the sample's features; the driver gets these alone and fits by proximal Adam with
an L1 penalty, so words that say nothing weigh nothing. Scoring reads every whole text, in Arrow
batches, with the weights (``2 ** bits`` floats, whatever the corpus) sent along.

Defined cases: null or empty text has no words and is scored by its shape alone; rows with null labels
don't take part in fitting; a document labelled twice takes part twice, of documents that repeat an id one does; rows
repeated, tied or with a null id are scored like others; columns of any names pass through selected(); an empty table
gives no rows; without a row to fit on (no labels,
or none that names a document present), every grade is equally likely and nothing is rejected; very long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD = re.compile(rb"[a-z\x80-\xff]+")
#: Rows to fit on at most; hashed features are 2 ** BITS; documents that a word must occur in; grades.
FIT_ROWS, BITS, LEAST_DOCS, GRADES = 8000, 20, 6, 3
#: Tail probability P(grade >= 2) below which a document is rejected.
LEAST_TAIL = 0.5
SHAPE = ["log_bytes", "upper", "digits", "symbols", "spaces", "newlines", "wide", "word_length", "distinct_words", "repeated_lines"]
REMEMBERED = 500_000
SCHEMA = "doc_id long, n_features long, score double, expected_grade double, p_toxic double, p_tail double, grade int, kept boolean"


def shape(content: bytes, words: list[bytes], distinct: set[bytes]) -> list[float]:
    """The measures named in SHAPE, over the whole text."""
    n = max(1, len(content))
    count = np.bincount(np.frombuffer(content, np.uint8), minlength=256)
    letters = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    spaces, digits = count[[9, 11, 12, 13, 32]].sum(), count[48:58].sum()
    lines = content.split(b"\n")
    return [
        float(np.log1p(len(content))), count[65:91].sum() / max(1, letters), digits / n, (n - letters - spaces - digits - count[10]) / n, spaces / n, count[10] / n,
        count[128:].sum() / n, sum(map(len, words)) / max(1, len(words)) / 10, len(distinct) / max(1, len(words)) ** 0.9, 1 - len(set(lines)) / len(lines),
    ]


def features(text: str | None, known: dict[bytes, int]) -> tuple[np.ndarray, list[float]]:
    """Ids of the distinct hashed words, sorted, and the shape."""
    import xxhash

    content = (text or "").encode("utf-8", "surrogatepass")
    words = WORD.findall(content.lower())
    distinct = set(words)
    if len(known) > REMEMBERED:
        known.clear()
    ids = []
    for w in distinct:
        i = known.get(w)
        if i is None:
            i = known[w] = xxhash.xxh3_64_intdigest(w) & (2**BITS - 1)
        ids.append(i)
    return np.unique(np.array(ids, dtype=np.int32)), shape(content, words, distinct)


@dataclass
class Model:
    weights: np.ndarray  # float32, by hashed word
    dense: np.ndarray  # by shape measure, standardised
    mean: np.ndarray
    spread: np.ndarray
    thresholds: np.ndarray  # ascending, GRADES - 1
    fitted: bool = True  # else there were no rows to fit on

    def score(self, ids: np.ndarray, measures: list[float]) -> float:
        return float(self.weights[ids].sum(dtype=np.float64) + self.dense @ ((np.array(measures) - self.mean) / self.spread))

    def keeps(self, p: np.ndarray, least_tail: float) -> np.ndarray:
        """By rows of probabilities per grade; a model that has seen nothing rejects nothing."""
        return (p[:, -1] >= least_tail) | (not self.fitted)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[np.ndarray, list[float], int]], rounds: int = 300, l1: float = 3e-4, rate: float = 0.03) -> Model:
    """Maximum likelihood of the ordinal model by full-batch proximal Adam; deterministic."""
    size = 2**BITS
    dense_of = np.array([r[1] for r in rows], dtype=float).reshape(len(rows), len(SHAPE))
    if not rows:
        return Model(np.zeros(size, np.float32), np.zeros(len(SHAPE)), np.zeros(len(SHAPE)), np.ones(len(SHAPE)), np.log([1 / 2, 2.0]), fitted=False)
    grade = np.array([r[2] for r in rows])
    mean, spread = dense_of.mean(0), np.maximum(dense_of.std(0), 1e-6)
    dense_of = (dense_of - mean) / spread
    lengths = np.array([len(r[0]) for r in rows])
    ids = np.concatenate([r[0] for r in rows]).astype(np.int64)
    row_of = np.repeat(np.arange(len(rows)), lengths)
    docs_with = np.bincount(ids, minlength=size)
    used = np.flatnonzero(docs_with >= LEAST_DOCS)
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    seen = place[ids] >= 0
    ids, row_of = place[ids[seen]], row_of[seen]
    n, k = len(rows), len(used)
    share = np.array([(np.sum(grade <= g) + 1) / (n + 2) for g in range(GRADES - 1)])
    first = np.log(share / (1 - share))
    # parameters: words, shape, first threshold, logs of the gaps between thresholds
    x = np.concatenate([np.zeros(k + len(SHAPE)), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        cut = np.concatenate([x[k + len(SHAPE) : k + len(SHAPE) + 1], np.exp(x[k + len(SHAPE) + 1 :])]).cumsum()
        s = np.bincount(row_of, x[:k][ids], n) + dense_of @ x[k : k + len(SHAPE)]
        below = np.column_stack([np.zeros(n), sigmoid(cut[None, :] - s[:, None]), np.ones(n)])
        hi, lo = below[np.arange(n), grade + 1], below[np.arange(n), grade]
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p  # d log p by the upper and lower cut
        by_s = (d_hi - d_lo) / n  # of -log p
        by_cut = np.array([(d_lo[grade == g + 1].sum() - d_hi[grade == g].sum()) / n for g in range(GRADES - 1)])
        by_gap = np.exp(x[k + len(SHAPE) + 1 :]) * by_cut[::-1].cumsum()[::-1][1:]
        g = np.concatenate([np.bincount(ids, by_s[row_of], k), dense_of.T @ by_s, [by_cut.sum()], by_gap])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
        x -= step * m / (1 - 0.9**t)
        x[:k] = np.sign(x[:k]) * np.maximum(np.abs(x[:k]) - step[:k] * l1, 0)
    weights = np.zeros(size, np.float32)
    weights[used] = x[:k]
    cut = np.concatenate([x[k + len(SHAPE) : k + len(SHAPE) + 1], np.exp(x[k + len(SHAPE) + 1 :])]).cumsum()
    return Model(weights, x[k : k + len(SHAPE)], mean, spread, cut)


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, grade of the labelled documents."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    graded = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", grade.alias("grade"))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(graded, "doc_id")


def trained(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fits on the fit_rows labels of documents present with the smallest hash of their id."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in it:
            made = [features(t.as_py(), known) for t in b.column(1)]
            columns = [b.column(0), b.column(2), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "grade", "ids", "measures"])

    # the labels are cut to the sample first, by the documents' ids alone, so that only its documents' texts are looked at
    graded = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    present = graded.join(docs.select("doc_id"), "doc_id", "left_semi")
    sample = present.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "quality").limit(fit_rows)
    # documents that repeat an id would take part once for each: the one with the least text does, so fit_rows is a bound
    named = docs.join(sample.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("text").cast("string").alias("text"))
    once = named.groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = common.in_batches(rated(once, sample), batches, "doc_id long, grade int, ids array<int>, measures array<double>").toArrow().to_pydict()
    order = sorted(range(len(rows["doc_id"])), key=lambda i: (rows["doc_id"][i], rows["grade"][i], rows["measures"][i]))
    return fit([(np.array(rows["ids"][i], dtype=np.int64), rows["measures"][i], rows["grade"][i]) for i in order])


def probabilities(texts: pa.Array, model: Model, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features per text, scores, and a column of probabilities per grade."""
    made = [features(t.as_py(), known) for t in texts]
    s = np.array([model.score(*m) for m in made])
    below = sigmoid(model.thresholds[None, :] - s[:, None]).reshape(len(made), GRADES - 1)
    p = np.diff(np.column_stack([np.zeros(len(made)), below, np.ones(len(made))]), axis=1)
    return np.array([len(m[0]) for m in made], np.int64), s, p


def graded(docs: DataFrame, model: Model, least_tail: float = LEAST_TAIL) -> DataFrame:
    """One row per input row, see SCHEMA; kept where p_tail reaches least_tail, or everywhere if the model has no fitted rows."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in it:
            n, s, p = probabilities(b.column(1), model, known)
            columns = [n, s, p @ np.arange(GRADES), p[:, 0], p[:, -1], p.argmax(1).astype(np.int32), model.keeps(p, least_tail)]
            names = ["doc_id", "n_features", "score", "expected_grade", "p_toxic", "p_tail", "grade", "kept"]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns)], names)

    return common.in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), batches, SCHEMA)


def selected(docs: DataFrame, model: Model, least_tail: float = LEAST_TAIL) -> DataFrame:
    """The rows of docs, all columns, that the model keeps."""
    at = docs.columns.index("text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in it:
            yield b.filter(pa.array(model.keeps(probabilities(b.column(at), model, known)[2], least_tail)))

    return common.in_batches(docs, batches, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return graded(docs, trained(docs, common.table(spark, sf_dir, "labels")))
