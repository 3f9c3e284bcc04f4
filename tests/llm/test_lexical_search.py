"""Ranked search against a full scoring, on the tables and on odd ones."""

import math
import random
import re
import string
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marklens.llm import lexical_search, queries

COLUMNS = ["item_id", "rank", "doc_id", "score"]
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def full_scoring(docs, items, k):
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in held:
            m = 100 - 50 + (50 * c.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equal_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    want = con.sql(lexical_search.ORACLE)
    got = queries.QUERIES["op13_lexical_search"](spark, f"/root/testdata/{sf}")
    assert got.columns == COLUMNS == want.columns
    assert rows_of(got) == sorted(want.fetchall(), key=str) != []


@pytest.mark.parametrize("k, shard, block", [(5, 2_000_000, 500_000), (5, 40, 500_000), (1, 1, 3), (50, 40, 9)])
def test_equal_full_scoring(spark, monkeypatch, k, shard, block):
    """Frequent and rare words, many ties; one or many shards and blocks."""
    rng = random.Random(k + shard)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(300 + i, "w1 w2 w7") for i in range(60)]
    items = [(i, "!".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(25)]
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k)
    assert rows_of(got) == sorted(full_scoring(docs, items, k), key=str) != []


def test_non_essential_lists_are_only_probed():
    """A frequent word of little weight brings no candidates once the rare one has filled the top."""
    ids = np.arange(1000)
    terms = np.concatenate([np.array([[0, 1]] * 10).ravel(), np.zeros(990, int)])
    shard = lexical_search.Shard(ids, np.full(1000, 2), np.array([2] * 10 + [1] * 990), terms, np.ones(len(terms), int), np.array([3, 9000]), 1000, 2000)
    place, scores = shard.best([0, 1], 5, 0)
    assert place.tolist() == list(range(10)) and len(set(scores.tolist())) == 1
    assert not len(shard.best([0], 5, 10**12)[0])


def test_odd_tables(spark, monkeypatch):
    texts = ["", None, " .,!", "Alpha beta", "ALPHA, beta", "alpha" * 3, "Ünïcode 𝄞 alpha1", "x " * 9000 + "beta", "alpha\u0000beta", "É é"]
    docs = [*enumerate(texts), (None, "alpha beta"), (None, "beta"), (3, "Alpha beta"), (3, "gamma")]
    items = [(1, "Alpha"), (1, "beta beta"), (2, None), (3, ""), (4, "unknown"), (None, "ünïcode é"), (5, "É \u0000 alpha")]
    monkeypatch.setattr(lexical_search, "PIECE", 10)
    clash = lambda df: df.withColumn("term", F.lit(1)).withColumn("n", F.lit("x")).withColumn("rank", F.lit(0))
    d, i = clash(spark.createDataFrame(docs, "doc_id long, text string")), clash(spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(lexical_search.search(d, i)) == sorted(full_scoring(docs, items, 50), key=str)
    for a, b in ((d.where("false"), i), (d, i.where("false"))):
        out = lexical_search.search(a, b)
        assert out.columns == COLUMNS and out.count() == 0


def test_lengths_beyond_64_bits():
    n = np.array([10**9, 7])
    assert lexical_search.lengths(n, 10**12, 10**15).tolist() == [50 + 50 * i * 10**12 // 10**15 for i in (10**9, 7)]
