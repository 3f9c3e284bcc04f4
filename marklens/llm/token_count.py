"""Word-piece token counts by a longest-match automaton, without building the pieces.

A word (a run without ASCII white space, in UTF-8 bytes) is cut greedily: the longest piece that may
start a word, then the longest pieces that may continue it. The trie of all pieces has, per node,
a failure link to the node that holds what is left once the longest matches at the front are popped,
and the number of pieces popped on the way. So one pass over a word's bytes, each byte entered once,
gives the count (linear time); the pieces are never made.

The vocabulary comes from a ranks file: its tokens with a leading space start words (the space left
out), the others continue words; every single byte may do both, so each word has pieces.

Defined cases: null or empty text has 0 words and 0 tokens; very long words and texts are counted
whole (linear time); repeated rows give repeated counts; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

#: Words remembered per task, and the longest remembered. They bound memory and change no result.
REMEMBERED, LONGEST = 500_000, 64
BYTES = [bytes([b]) for b in range(256)]
SCHEMA = "doc_id long, n_words long, n_tokens long, max_word_tokens long"


def pieces_of(ranks: Iterable[bytes]) -> tuple[set[bytes], set[bytes]]:
    """Pieces that may start a word, and that may continue one."""
    tokens = [t for t in ranks if not t.strip(b" ").split() or len(t.split()) == 1]
    starts = {t[1:] for t in tokens if t[:1] == b" " and t[1:] and not t[1:].isspace() and t[1:].split() == [t[1:]]}
    continues = {t for t in tokens if t.split() == [t]}
    return starts | set(BYTES), continues | set(BYTES)


class Automaton:
    """go: (node * 256 + byte) -> node; fail and popped by node. Node 0 starts a word, node 1 continues one."""

    def __init__(self, starts: set[bytes], continues: set[bytes]):
        self.go: dict[int, int] = {}
        parent, ends = [(-1, 0), (-1, 0)], [False, False]
        for root, pieces in ((0, starts), (1, continues)):
            for piece in sorted(pieces):
                node = root
                for b in piece:
                    following = self.go.get(node * 256 + b)
                    if following is None:
                        following = self.go[node * 256 + b] = len(parent)
                        parent.append((node, b))
                        ends.append(False)
                    node = following
                ends[node] = True
        depth = [0, 0]
        for p, _ in parent[2:]:
            depth.append(depth[p] + 1)
        self.fail, self.popped = [-1] * len(parent), [0] * len(parent)
        for node in sorted(range(2, len(parent)), key=depth.__getitem__):
            if ends[node]:
                self.fail[node], self.popped[node] = 1, 1
                continue
            above, b = parent[node]
            count, link = self.popped[above], self.fail[above]
            while link >= 0 and link * 256 + b not in self.go:
                count, link = count + self.popped[link], self.fail[link]
            if link >= 0:
                self.fail[node], self.popped[node] = self.go[link * 256 + b], count

    def count(self, word: bytes) -> int:
        go, fail, popped = self.go, self.fail, self.popped
        node = total = 0
        for b in word:
            following = go.get(node * 256 + b)
            while following is None:
                total += popped[node]
                node = fail[node]
                following = go.get(node * 256 + b)
            node = following
        while node > 1:
            total += popped[node]
            node = fail[node]
        return total


def token_counts(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, see SCHEMA."""
    starts, continues = pieces_of(ranks)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = Automaton(starts, continues), {}
        for b in it:
            rows = []
            for text in b.column(1):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes.split(): ASCII white space
                if len(known) > REMEMBERED:
                    known.clear()
                counts = []
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = automaton.count(w)
                        if len(w) <= LONGEST:
                            known[w] = n
                    counts.append(n)
                rows.append((len(words), sum(counts), max(counts, default=0)))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_tokens", "max_word_tokens"])

    return common.in_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), batches, SCHEMA)


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"), bpe.read_ranks(public_tokenizers.path(bpe.RANKS)))
