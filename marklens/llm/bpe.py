"""Byte-level BPE over Arrow batches with the tokenizers library.

Encoding cuts each text into the matches of a pattern, hands the matches not seen lately to the
tokenizers library (a BPE model built from ranks, over the byte-to-character table) and joins their
ids. A match's ids don't depend on its surroundings, so equal matches are encoded once. ``starts``
and ``ends`` are the character (code point) span of each token; a token that holds a part of a
character has the whole character's span.

Decoding reverses the byte table and joins the bytes. Tokens may end inside a character:
``n_split`` counts them, and ``text`` puts such characters together again from their parts. Bytes
that are not UTF-8 in the end become U+FFFD in ``text``; ``bytes`` always holds them as they are.

Defined cases: null or empty text has no ids and decodes to empty; null ids decode to empty; an
unknown id fails the job; a text is never cut: very long ones are taken in segments of matches;
repeated rows give repeated results; an empty table gives no rows; columns other than the id and the
text are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RANKS = "byte_bpe_50k.tiktoken"
#: Characters from which a text is taken in segments; matches in such a
#: segment; matches remembered, and the longest remembered. They bound memory and change no result.
LONG_TEXT, BLOCK_MATCHES, REMEMBERED, LONGEST = 1_000_000, 200_000, 200_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def byte_table() -> list[str]:
    """A printable character for every byte: itself if printable in Latin-1, else U+0100 and on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """A BPE model for the tokenizers library. The merge that makes a token is the one that is left
    when lower ranks have merged all they can."""
    table = byte_table()
    show = lambda token: "".join(table[b] for b in token)
    none = len(ranks)
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], none))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        merges.append([show(p) for p in parts])
    model = {"type": "BPE", "vocab": {show(t): r for t, r in ranks.items()}, "merges": merges, "ignore_merges": True}
    split = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps({"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": split, "post_processor": None, "decoder": None, "model": model})


def token_bytes(tokenizer) -> list[bytes]:
    """Each id's bytes, by the byte table reversed."""
    back = {c: b for b, c in enumerate(byte_table())}
    vocabulary = tokenizer.get_vocab()
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(map(back.__getitem__, token))
    return out


def tokenizer_of(model: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_str(model)


class Encoder:
    def __init__(self, model: str, pattern: str):
        import regex

        self.tokenizer = tokenizer_of(model)
        self.pattern = regex.compile(pattern)
        self.table = token_bytes(self.tokenizer)
        self.size = np.array([len(t) for t in self.table], dtype=np.int64)
        self.known: dict[str, bytes] = {}  # a match and its ids

    def segments(self, text: str) -> Iterator[list[str]]:
        """The text's matches; a very long text comes in several segments."""
        if len(text) <= LONG_TEXT:
            yield self.pattern.findall(text)
            return
        matches = self.pattern.finditer(text)
        while segment := [m[0] for m in islice(matches, BLOCK_MATCHES)]:
            yield segment

    def ids_of(self, matches: list[str]) -> np.ndarray:
        new = set(matches).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set(matches)
        if new:
            # one call for all: the matches go in as words, and the lengths of the ids' bytes tell where each one ends
            ids = np.array(self.tokenizer.encode_batch_fast([list(new)], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
            ends = np.cumsum([len(m.encode("utf-8", "surrogatepass")) for m in new])
            upto = (4 * (np.searchsorted(np.cumsum(self.size[ids]), ends) + 1)).tolist()
            content = ids.tobytes()
            self.known.update(zip(new, (content[a:z] for a, z in zip([0, *upto], upto))))
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, matches)), dtype=np.int32)
        for m in new:
            if len(m) > LONGEST:
                del self.known[m]
        return ids

    def spans(self, ids: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where each id's characters start and end in the text."""
        ends = np.cumsum(self.size[ids])  # in bytes
        starts = ends - self.size[ids]
        content = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if len(content) == len(text):
            return starts, ends
        # byte to character: how many characters have begun up to this byte
        character = np.cumsum((content & 0xC0) != 0x80, dtype=np.int64) - 1
        return character[starts], character[ends - 1] + 1

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, starts and ends."""
        parts, done = [(np.empty(0, np.int32),) * 3], 0
        for matches in self.segments(text or ""):
            segment = "".join(matches)
            ids = self.ids_of(matches)
            starts, ends = self.spans(ids, segment)
            parts.append((ids, (starts + done).astype(np.int32), (ends + done).astype(np.int32)))
            done += len(segment)
        return parts[-1] if len(parts) < 3 else tuple(map(np.concatenate, zip(*parts)))

    def decode(self, ids: np.ndarray) -> tuple[bytes, int]:
        return joined(self.table, self.size, ids)


def joined(table: list[bytes], size: np.ndarray, ids: np.ndarray) -> tuple[bytes, int]:
    """The bytes of ids, and how many ids end inside a character."""
    content = b"".join(map(table.__getitem__, ids.tolist()))
    ends = np.cumsum(size[ids])[:-1]
    return content, int(((np.frombuffer(content, np.uint8)[ends] & 0xC0) == 0x80).sum()) if len(ends) and not content.isascii() else 0


def lists(values: list[np.ndarray]) -> pa.ListArray:
    limits = np.concatenate([[0], np.cumsum([len(v) for v in values], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(limits), pa.array(np.concatenate([np.empty(0, np.int32), *values])))


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids, starts, ends: one row per input row."""
    model = tokenizer_json(ranks)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, pattern)
        for b in it:
            rows = [encoder.encode(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(lists([r[i] for r in rows]) for i in range(3))], ["doc_id", "ids", "starts", "ends"])

    return common.in_batches(texts_of(docs, text_col, id_col), batches, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decoded(tokens: DataFrame, ranks: dict[bytes, int], with_text: bool = True) -> DataFrame:
    """The input's columns (ids among them), and bytes, n_split and, if wanted, text."""
    model = tokenizer_json(ranks)
    inputs = tokens.columns

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(tokenizer_of(model))
        size = np.array([len(t) for t in table], dtype=np.int64)
        for b in it:
            rows = [joined(table, size, i.values.to_numpy() if i.is_valid else np.empty(0, np.int32)) for i in b.column(inputs.index("ids"))]
            more = [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())]
            if with_text:
                more.append(pa.array([r[0].decode("utf-8", "replace") for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*inputs, "bytes", "n_split", "text"][: len(inputs) + len(more)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema) + ", bytes binary, n_split long" + ", text string" * with_text
    return common.in_batches(tokens, batches, schema)


def texts_of(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids (if wanted), ids_sha256, decoded_sha256, n_chars (where the last span ends),
    n_split: one row per input row. Encodes and decodes in one pass: a worker holds the vocabulary once,
    and neither spans nor decoded bytes leave it."""
    model = tokenizer_json(ranks)
    names = ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "n_chars", "n_split"]
    kinds = ["long", "long", "array<int>", "string", "string", "long", "long"]
    wanted = [n for n in names if with_ids or n != "ids"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, pattern)
        decimal = [str(i) for i in range(len(encoder.table))]

        def row(text: str | None) -> tuple:
            ids, _, ends = encoder.encode(text)
            content, n_split = encoder.decode(ids)
            shown = " ".join(map(decimal.__getitem__, ids.tolist())).encode()
            return len(ids), ids, hashlib.sha256(shown).hexdigest(), hashlib.sha256(content).hexdigest(), int(ends[-1]) if len(ends) else 0, n_split

        for b in it:
            n, ids, *rest = zip(*(row(t.as_py()) for t in b.column(1)))
            made = dict(zip(names, [b.column(0), pa.array(n, pa.int64()), lists(list(ids)), *map(pa.array, rest)]))
            yield pa.RecordBatch.from_arrays([made[c] for c in wanted], wanted)

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds) if n in wanted)
    return common.in_batches(texts_of(docs, text_col, id_col), batches, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path(RANKS))
    return round_trip(common.table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)
