"""SentencePiece encoding and decoding against the library, on every text of small and odd tables."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marklens.llm import queries, sentence_pieces

SF = "/root/testdata/sf0.001"
ALPHABETS = ["abcdefgh", "aab ", "th e in", " ▁\n\tab", "éñ中文😀​", "01.,-", "theingonrat "]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentence_pieces.MODEL))


@pytest.fixture(scope="module")
def model():
    return sentence_pieces.read_model(public_tokenizers.path(sentence_pieces.MODEL))


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randint(0, 300))) for _ in range(n)]


@pytest.mark.parametrize("long_word", [3, 40, 10**9])
def test_equal_library(model, library, long_word, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "LONG_WORD", long_word)
    encoder, decoder = sentence_pieces.Encoder(model), sentence_pieces.Decoder(model)
    texts = [None, "", " ", "   x ", "▁x ▁▁ y", "<s> </s> <0x41> \0", "aaaa" * 99, "the" * 99, "中文字符" * 50, " " * 70, *random_texts(600, long_word)]
    for text, ids in zip(texts, encoder.encode_all(texts)):
        assert ids.tolist() == library.encode(text or "")
        assert decoder.decode(np.append(ids, model.end_id)) == library.decode([*ids.tolist(), model.end_id])


def test_random_pieces_joined(model, library):
    rng, pieces = random.Random(3), [text for text, _, kind in model.pieces if kind == sentence_pieces.NORMAL]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    assert [i.tolist() for i in sentence_pieces.Encoder(model).encode_all(texts)] == library.encode(texts, num_threads=1)


def test_any_ids_decode_as_the_library_does(model, library):
    rng, decoder = random.Random(4), sentence_pieces.Decoder(model)
    for _ in range(8000):
        ids = [rng.choice([rng.randrange(259), rng.randrange(len(model.pieces))]) for _ in range(rng.randint(0, 9))]
        assert decoder.decode(np.array(ids, np.int32)) == library.decode(ids), ids


def test_long_texts_in_segments(model, library, monkeypatch):
    encoder = sentence_pieces.Encoder(model)
    monkeypatch.setattr(sentence_pieces, "LONG_TEXT", 20)
    monkeypatch.setattr(sentence_pieces, "BLOCK_WORDS", 3)
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 50)
    for text in random_texts(200, 9):
        assert encoder.encode(text).tolist() == library.encode(text)
        encoder.forget()


def test_models_that_are_refused(tmp_path):
    content = open(public_tokenizers.path(sentence_pieces.MODEL), "rb").read()
    other = tmp_path / "unigram.model"
    other.write_bytes(content.replace(b"\x18\x02\x20\x80\xfa\x01", b"\x18\x01\x20\x80\xfa\x01"))  # type 2 (merges) to 1
    with pytest.raises(ValueError, match="merges"):
        sentence_pieces.read_model(str(other))


def test_query_equals_library_on_whole_table(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op12_sentencepiece"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = [*library.encode(docs[r["doc_id"]]), 2]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_tables_and_round_trip(spark, model):
    rows = [(i, t) for i, t in enumerate(["", None, " ", "a  b", "x" * 5000, "Ünïcode 𝄞\n", "same", "same"])] + [(None, "no id"), (3, "a  b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(-1))
    out = sentence_pieces.round_trip(docs, model, with_ids=True)
    back = sentence_pieces.decoded(out, model).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in back))) == sorted(map(str, ((i, t or "") for i, t in rows)))
    assert all(r["ids"][-1] == 2 and r["n_tokens"] == len(r["ids"]) for r in back)
    empty = sentence_pieces.round_trip(docs.where("false"), model, with_ids=False)
    assert empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and empty.count() == 0
    nulls = spark.createDataFrame([(None,)], "ids array<int>")
    assert [r["text"] for r in sentence_pieces.decoded(nulls, model).collect()] == [""]
