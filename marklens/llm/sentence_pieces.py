"""SentencePiece encoding and decoding: byte-pair merges of many words at once, in rounds over flat arrays.

A text, spaces shown as U+2581 and one put in front, falls into words (a run of U+2581 and what follows); no piece
reaches over a word's start, so a word's ids don't depend on its surroundings and equal words are encoded once. All words
that a batch brings anew are encoded together: their symbols stand in one flat array, each pair of neighbours has a rank
by the score of the piece it would make, and each round

1. takes the smallest rank of every word (a segmented minimum),
2. merges its places in all words at once, from the left, without overlap,
3. puts words without a pair aside and closes the gaps.

Merging one place after the other, as the definition has it, gives the same pieces but where a merge makes a pair that
ranks before (or beside) itself, as "the" may make U+2581 + "the". Of such ranks a round merges the leftmost place of
each word only. Words of more than ``LONG_WORD`` characters would need many rounds; they go by a queue of pairs.

Characters that no piece holds become the pieces of their UTF-8 bytes. Decoding joins the pieces' bytes, spaces put
back and the one in front taken away; bytes that are not UTF-8 become U+FFFD.

Defined cases: null or empty text has the end id alone (if one is asked for) and decodes to empty; null ids decode to
empty; an unknown id fails the job; equal ranks go from left to right; a text is never cut: very long ones are taken in
segments of words; repeated rows give repeated results; an empty table gives no rows; columns other than the id and the
text are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import common
from .bpe import lists, texts_of

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Characters from which a text is taken in segments; words in such a segment; words remembered, and the longest
#: remembered; characters of a word from which pairs are queued. They bound memory and time and change no result.
LONG_TEXT, BLOCK_WORDS, REMEMBERED, LONGEST, LONG_WORD = 1_000_000, 200_000, 200_000, 64, 256
#: A word: its first space, and what follows up to the next word.
WORD = re.compile(f"{SPACE}({SPACE}*[^{SPACE}]*)")
#: No pair; and what spreads keys over a table's slots.
NONE, MIX, SHIFT = 1 << 62, 0x9E3779B97F4A7C1 | 1, 24
#: Fixed values of the model file's format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_MODEL = 2


def wire_fields(content: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = content[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(content):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, content[at : at + size]
        at += size


@dataclass
class Model:
    """pieces: (text, score, kind) by id."""

    pieces: list[tuple[str, float, int]]

    @property
    def end_id(self) -> int:
        return next(i for i, (text, _, kind) in enumerate(self.pieces) if text == "</s>" and kind == CONTROL)


def read_model(path: str) -> Model:
    """A model of merges with bytes as a last resort and texts taken as they are; others are refused."""
    with open(path, "rb") as f:
        fields = list(wire_fields(f.read()))
    pieces = []
    for number, value in fields:
        if number == 1:
            piece = dict(wire_fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
    trainer = dict(wire_fields(next(v for n, v in fields if n == 2)))
    normaliser = dict(wire_fields(next(v for n, v in fields if n == 3)))
    kinds = {kind for _, _, kind in pieces}
    if trainer.get(3, 1) != BPE_MODEL or BYTE not in kinds or kinds & {USER_DEFINED, UNUSED}:
        raise ValueError("the model must be of merges, with byte pieces and without user-defined or unused ones")
    if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1) or trainer.get(24):
        raise ValueError("the model must take texts as they are, spaces shown as U+2581, one more in front, none at words' ends")
    return Model(pieces)


class Encoder:
    def __init__(self, model: Model):
        self.model = model
        normal = {text: i for i, (text, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        if any(SPACE in text.lstrip(SPACE) for text in normal):
            raise ValueError("a piece reaches over a word's start")
        # symbols: the ids, characters that are part of pieces but none themselves, and one for all other characters
        apart = sorted(set("".join(normal)).difference(normal))
        symbols = normal | {c: len(model.pieces) + i for i, c in enumerate(apart)}
        self.other = len(model.pieces) + len(apart)
        self.apart_codes = np.array([*map(ord, apart), 0], np.int32)
        chars = sorted(c for c in symbols if len(c) == 1)
        self.char_codes = np.array([*map(ord, chars), 1 << 31], np.uint32)
        self.char_symbols = np.array([*(symbols[c] for c in chars), 0], np.int32)
        # ranks: scores downwards, equal scores share one; hasty: ranks whose pieces may make a pair of no later rank
        rank_of = {score: r for r, score in enumerate(sorted({model.pieces[i][1] for i in normal.values()}, reverse=True))}
        ranks = {text: rank_of[model.pieces[i][1]] for text, i in normal.items()}
        keys, values, self.hasty = [], [], np.zeros(len(rank_of), bool)
        for text, i in normal.items():
            for at in range(1, len(text)):
                left, right = text[:at], text[at:]
                if left in symbols and right in symbols:
                    keys.append(symbols[left] * (self.other + 1) + symbols[right])
                    values.append(ranks[text] << 32 | i)
                    self.hasty[[ranks[part] for part in (left, right) if len(part) > 1 and ranks[part] >= ranks[text]]] = True
        self.table_pairs(np.array(keys, np.int64), np.array(values, np.int64))
        self.byte_ids = np.zeros(256, np.int32)
        for i, (text, _, kind) in enumerate(model.pieces):
            if kind == BYTE:
                self.byte_ids[int(text[1:-1], 16)] = i
        self.known: dict[str, bytes] = {}  # a word and its ids

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair of symbols rank << 32 | the piece it makes, or NONE."""
        keys = np.minimum(left, self.other).astype(np.int64) * (self.other + 1) + np.minimum(right, self.other)
        slots = (keys * MIX >> SHIFT) & (len(self.slot_keys) - 1)
        out = np.where(self.slot_keys[slots] == keys, self.slot_values[slots], NONE)
        again = np.flatnonzero((self.slot_keys[slots] != keys) & (self.slot_keys[slots] >= 0))
        while len(again):  # taken by other pairs: on to the next slot
            slots[again] = (slots[again] + 1) & (len(self.slot_keys) - 1)
            here = self.slot_keys[slots[again]]
            found = again[here == keys[again]]
            out[found] = self.slot_values[slots[found]]
            again = again[(here != keys[again]) & (here >= 0)]
        return out

    def table_pairs(self, keys: np.ndarray, values: np.ndarray) -> None:
        """A table of slots, a quarter taken at most."""
        size = 1 << int(4 * len(keys)).bit_length()
        self.slot_keys, self.slot_values = np.full(size, -1, np.int64), np.full(size, NONE, np.int64)
        slots = (keys * MIX >> SHIFT) & (size - 1)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.slot_keys[slots[left]] < 0]
            self.slot_keys[slots[free]] = keys[free]
            won = free[self.slot_keys[slots[free]] == keys[free]]
            self.slot_values[slots[won]] = values[won]
            left = left[self.slot_keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & (size - 1)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """The symbols of characters; of those in no piece, self.other + 1 + their code."""
        at = np.searchsorted(self.char_codes, codes)
        return np.where(self.char_codes[at] == codes, self.char_symbols[at], codes.astype(np.int32) + self.other + 1)

    def rounds(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """symbols: of all words, one after the other; sizes: how many each word has. The same two for the pieces in the end."""
        number, ended = np.arange(len(sizes)), []
        ends = np.cumsum(sizes)
        pair = np.full(len(symbols), NONE)
        if len(symbols) > 1:
            pair[:-1] = self.pairs(symbols[:-1], symbols[1:])
        pair[ends - 1] = NONE
        while len(number):
            heads = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(pair, heads) >> 32
            over = least == NONE >> 32
            if over.any():
                gone = np.repeat(over, sizes)
                ended.append((number[over], sizes[over], symbols[gone]))
                stay = ~gone
                symbols, pair, number, sizes = symbols[stay], pair[stay], number[~over], sizes[~over]
                if not len(number):
                    break
                heads, least = np.cumsum(sizes) - sizes, least[~over]
            at = np.flatnonzero(pair >> 32 == np.repeat(least, sizes))
            # overlapping places: every second of a run, from its left
            place = np.arange(len(at))
            run = np.concatenate([[True], at[1:] - at[:-1] != 1])
            at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) & 1 == 0]
            word = np.searchsorted(heads, at, side="right") - 1
            wanted = np.concatenate([[True], word[1:] != word[:-1]]) | ~self.hasty[pair[at] >> 32]
            at, word = at[wanted], word[wanted]
            symbols[at] = pair[at] & 0xFFFFFFFF
            pair[at] = np.where(at + 2 < np.append(heads, len(symbols))[word + 1], 0, NONE)  # 0: to be looked up, unless it is the word's last
            before = at[at > heads[word]] - 1
            pair[before] = 0
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, pair = symbols[stay], pair[stay]
            sizes = sizes - np.bincount(word, minlength=len(sizes))
            open_ = np.flatnonzero(pair == 0)
            pair[open_] = self.pairs(symbols[open_], symbols[open_ + 1])
        number, sizes, symbols = (np.concatenate(a) if ended else np.empty(0, np.int32) for a in (zip(*ended) if ended else [()] * 3))
        order = np.argsort(number, kind="stable")
        starts = np.cumsum(sizes) - sizes
        sizes = sizes[order]
        return symbols[np.repeat(starts[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(symbols))], sizes

    def queued(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one long word, pair by pair."""
        held, after, before = symbols.tolist(), [*range(1, len(symbols)), -1], [-1, *range(len(symbols) - 1)]
        queue = [(pair >> 32, i, a, b, pair & 0xFFFFFFFF) for i, (pair, a, b) in enumerate(zip(self.pairs(symbols[:-1], symbols[1:]).tolist(), held, held[1:])) if pair != NONE]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i]
            if held[i] != a or j < 0 or held[j] != b:
                continue
            held[i], held[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (pair := self.pair_of.get((held[x], held[y]))) is not None:
                    heapq.heappush(queue, (pair >> 32, x, held[x], held[y], pair & 0xFFFFFFFF))
        return np.array([s for s in held if s >= 0], np.int32)

    @functools.cached_property
    def pair_of(self) -> dict[tuple[int, int], int]:
        taken = self.slot_keys >= 0
        lefts, rights = np.divmod(self.slot_keys[taken], self.other + 1)
        return dict(zip(zip(lefts.tolist(), rights.tolist()), self.slot_values[taken].tolist()))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, which is given without the space in front of it."""
        if not words:
            return []
        symbols = self.symbols(np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        long = np.flatnonzero(sizes > LONG_WORD)
        if len(long):
            ends = np.cumsum(sizes)
            apart = {w: self.queued(symbols[ends[w] - sizes[w] : ends[w]]) for w in long.tolist()}
            short = sizes <= LONG_WORD
            made, counts = self.rounds(symbols[np.repeat(short, sizes)], sizes[short])
            made = iter(np.split(made, np.cumsum(counts)[:-1]) if len(counts) else [])
            parts = [apart[w] if w in apart else next(made) for w in range(len(words))]
            symbols, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        else:
            symbols, sizes = self.rounds(symbols, sizes)
        unknown = np.flatnonzero(symbols >= len(self.model.pieces))
        if len(unknown):
            codes = symbols[unknown]
            codes = np.where(codes > self.other, codes - self.other - 1, self.apart_codes[np.minimum(codes, self.other) - len(self.model.pieces)])
            spelt = [chr(c).encode("utf-8", "surrogatepass") for c in codes.tolist()]
            counts = np.ones(len(symbols), np.int64)
            counts[unknown] = [len(s) for s in spelt]
            sizes = np.add.reduceat(counts, np.cumsum(sizes) - sizes)
            symbols = np.repeat(symbols, counts)
            symbols[symbols >= len(self.model.pieces)] = self.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
        upto = (4 * np.cumsum(sizes)).tolist()
        content = symbols.astype(np.int32).tobytes()
        return [content[a:z] for a, z in zip([0, *upto], upto)]

    def segments(self, text: str) -> Iterator[list[str]]:
        """The words of a text, each without the first space of its own; a very long text comes in several segments."""
        if not text:
            return
        shown = text.replace(" ", SPACE)
        if len(shown) <= LONG_TEXT and SPACE * 2 not in shown and shown[0] != SPACE and shown[-1] != SPACE:
            yield shown.split(SPACE)
            return
        words = WORD.finditer(SPACE + shown)
        while segment := [m[1] for m in islice(words, BLOCK_WORDS)]:
            yield segment

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(words)
        self.known.update(zip(new, self.encode_words(new)))

    def forget(self) -> None:
        for w in [w for w in self.known if len(w) > LONGEST] if len(self.known) > REMEMBERED else ():
            del self.known[w]

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; what short ones bring anew is encoded together."""
        short = [list(self.segments(t))[0] if t and len(t) < LONG_TEXT else None for t in texts]
        self.learn(set().union(*filter(None, short)))
        kept = self.known  # learn() of a long text may start a new one
        for text, words in zip(texts, short):
            if words is not None:
                yield np.frombuffer(b"".join(map(kept.__getitem__, words)), np.int32)
            elif not text:
                yield np.empty(0, np.int32)
            else:
                parts = []
                for segment in self.segments(text):
                    new = set(segment).difference(kept)
                    here = dict(zip(new, self.encode_words(list(new))))
                    parts.append(b"".join([kept.get(w) or here[w] for w in segment]))
                yield np.frombuffer(b"".join(parts), np.int32)

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))


class Decoder:
    def __init__(self, model: Model):
        shown = {UNKNOWN: lambda text: " ⁇ ".encode(), CONTROL: lambda text: b"", BYTE: lambda text: bytes([int(text[1:-1], 16)])}
        spelt = lambda text: text.replace(SPACE, " ").encode()
        self.table = [shown.get(kind, spelt)(text) for text, _, kind in model.pieces]
        self.kind = np.array([kind for _, _, kind in model.pieces])

    def decode(self, ids: np.ndarray) -> str:
        shows = self.kind[ids] != CONTROL
        begin = ids[shows][:1]
        content = b"".join(map(self.table.__getitem__, ids.tolist()))
        if len(begin) and self.kind[begin[0]] == NORMAL and content.startswith(b" "):
            content = content[1:]
        inside = np.flatnonzero(~shows[1:-1]) + 1 if len(ids) > 2 else ()
        if len(inside) and (self.kind[ids[inside + 1]] == BYTE).any():  # bytes on both sides of a control piece make no character
            ends = np.cumsum([len(self.table[i]) for i in ids.tolist()])
            cuts = [0, *(ends[inside] - (ends[-1] - len(content))).tolist(), len(content)]
            return "".join(self.mended(content[max(a, 0) : max(z, 0)]) for a, z in zip(cuts, cuts[1:]))
        try:
            return content.decode()
        except UnicodeDecodeError:
            return self.mended(content)

    @staticmethod
    def mended(content: bytes) -> str:
        """Every byte that is no part of a whole character becomes U+FFFD, by itself."""
        out, at = [], 0
        while at < len(content):
            try:
                out.append(content[at:].decode())
                break
            except UnicodeDecodeError as e:
                out.append(content[at : at + e.start].decode())
                out.append("�")
                at += e.start + 1
        return "".join(out)


def round_trip(docs: DataFrame, model: Model, with_ids: bool, end: bool = True, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids (if wanted), ids_sha256, decoded_sha256: one row per input row. Encodes and decodes in one pass."""
    names = ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    kinds = ["long", "long", "array<int>", "string", "string"]
    wanted = [n for n in names if with_ids or n != "ids"]
    tail = np.array([model.end_id] if end else [], np.int32)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(model), Decoder(model)
        decimal = [str(i) for i in range(len(model.pieces))]

        def row(ids: np.ndarray) -> tuple:
            ids = np.concatenate([ids, tail])
            shown = " ".join(map(decimal.__getitem__, ids.tolist())).encode()
            return len(ids), ids if with_ids else None, hashlib.sha256(shown).hexdigest(), hashlib.sha256(decoder.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()

        for b in it:
            n, ids, *rest = zip(*map(row, encoder.encode_all(b.column(1).to_pylist())))
            encoder.forget()
            made = dict(zip(names, [b.column(0), pa.array(n, pa.int64()), lists(list(ids)) if with_ids else None, *map(pa.array, rest)]))
            yield pa.RecordBatch.from_arrays([made[c] for c in wanted], wanted)

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds) if n in wanted)
    return common.in_batches(texts_of(docs, text_col, id_col), batches, schema)


def decoded(tokens: DataFrame, model: Model) -> DataFrame:
    """The input's columns (ids among them), and text."""
    inputs = tokens.columns

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for b in it:
            texts = [decoder.decode(i.values.to_numpy() if i.is_valid else np.empty(0, np.int32)) for i in b.column(inputs.index("ids"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*inputs, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema) + ", text string"
    return common.in_batches(tokens, batches, schema)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = read_model(public_tokenizers.path(MODEL))
    return round_trip(common.table(spark, sf_dir, "documents"), model, with_ids=False)
