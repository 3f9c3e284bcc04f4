"""License scans: Aho-Corasick finds notice phrases and identifier tags; a shunting-yard parser
evaluates the licence expressions that follow the tags.

Every text is lower-cased (A-Z) and cut into words; the automaton runs once over the words joined
by single spaces, so a hit on " cc by " is a place where these words stand consecutively.

An identifier tag ("SPDX-License-Identifier: ...") is followed by an expression over licence ids
with ``or``, ``and``, ``with`` and parentheses. Its value is how far the licence restricts use, from
0 (free) to 1: ``or`` lets the user choose (minimum), ``and`` binds to both (maximum), ``with`` a known
exception halves. A line's expression is the longest one that its start makes: what follows it (the end of a comment,
code, a full stop) is no part of it. ``score`` is the largest value of a document's notices and expressions, 0 if it
has none.

Defined cases: null or empty text has no words, no labels, score 0; a tag whose line starts with no whole
expression gives the label ``malformed`` with value 1 (nothing is granted for sure); overlapping phrases
all count; very long texts are read whole; repeated rows give repeated results; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases whose places count as base, each with its label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The method's own phrases.
NOTICES = {
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0 1 0": "cc0", "creative commons zero": "cc0",
    "apache license": "apache", "mit license": "mit", "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd", "bsd license": "bsd", "mozilla public license": "mpl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "public domain": "public-domain",
    "proprietary and confidential": "proprietary",
}
#: How far a licence family restricts use.
RESTRICTION = {
    "cc0": 0.0, "public-domain": 0.0, "unlicense": 0.0, "0bsd": 0.0, "wtfpl": 0.0, "mit": 0.1, "bsd": 0.1, "isc": 0.1, "zlib": 0.1, "bsl": 0.1, "psf": 0.1, "python": 0.1, "ncsa": 0.1,
    "postgresql": 0.1, "x11": 0.1, "curl": 0.1, "apache": 0.15, "ms-pl": 0.2, "afl": 0.2, "artistic": 0.2, "cc-by": 0.2, "ofl": 0.25, "mpl": 0.35, "cddl": 0.35, "epl": 0.4, "lgpl": 0.45,
    "ms-rl": 0.45, "cc-by-sa": 0.5, "eupl": 0.55, "cecill": 0.55, "osl": 0.6, "gpl": 0.6, "agpl": 0.7, "sspl": 0.8, "busl": 0.8, "cc-by-nd": 0.8, "cc-by-nc": 0.8,
    "cc-by-nc-sa": 0.85, "cc-by-nc-nd": 0.9, "reserved": 1.0, "proprietary": 1.0, "malformed": 1.0,
}
#: Exceptions that relax a licence; others change nothing.
EXCEPTIONS = ("classpath-exception", "gcc-exception", "linux-syscall-note", "llvm-exception", "autoconf-exception", "bison-exception", "font-exception", "openjdk-assembly-exception", "libtool-exception", "universal-foss-exception")
UNKNOWN = 0.5
TAG_WORDS = "spdx license identifier"
TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)")
TOKEN = re.compile(r"\s*(\(|\)|[a-z0-9.+:-]+)")
BINDS = {"or": 1, "and": 2, "with": 3}
FAMILIES = sorted(RESTRICTION, key=len, reverse=True)

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double, expressions array<string>"
)


def family(identifier: str) -> str:
    """apache-2.0 -> apache; an unknown identifier stands for itself."""
    return next((f for f in FAMILIES if identifier == f or identifier.startswith((f"{f}-", f"{f}+"))), identifier)


def leading_tokens(line: str) -> list[str]:
    """The tokens that a line starts with, up to the first thing that is none; a full stop ends a sentence, not an identifier."""
    out, at = [], 0
    while m := TOKEN.match(line, at):
        out.append(m[1].rstrip(".:") if len(m[1]) > 1 else m[1])
        at = m.end()
        if not out[-1] or out[-1] != m[1]:
            break
    return [t for t in out if t]


def steps(tokens: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The shunting-yard method: for each number of tokens that make a whole expression, that expression in postfix
    order. Ends at the first token that can't stand where it does."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for n, t in enumerate(tokens, 1):
        if operand_next != (t == "(" or t not in BINDS and t != ")"):
            return
        if t == "(":
            held.append(t)
        elif t == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return
            held.pop()
        elif t in BINDS:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[t]:
                out.append(held.pop())
            held.append(t)
            operand_next = True
        else:
            out.append(t)
            operand_next = False
        if not operand_next and "(" not in held:
            yield n, out + held[::-1]


def postfix(expression: str) -> list[str] | None:
    """The longest expression at the start of a line, in postfix order; None if there is none."""
    order = None
    for _, order in steps(leading_tokens(expression)):
        pass
    return order


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels and restriction of a lower-case licence expression."""
    order = postfix(expression)
    if order is None:
        return {"malformed"}, RESTRICTION["malformed"]
    stack: list[tuple[set[str], float]] = []
    for t in order:
        if t not in BINDS:
            stack.append(({family(t)}, RESTRICTION.get(family(t), UNKNOWN)))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        stack.append((left, a / 2 if next(iter(right)).startswith(EXCEPTIONS) else a) if t == "with" else (left | right, min(a, b) if t == "or" else max(a, b)))
    return stack[0]


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG_WORDS]:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(text: str | None, a) -> tuple:
    low = common.lowered(text)
    words = WORD.findall(low)
    line = f" {' '.join(words)} "
    n_base, first, last, at, seen = 0, None, None, 0, 0
    base: set[str] = set()
    labels: dict[str, float] = {}
    expressions: list[str] = []
    places = []
    tagged = False
    for end, phrase in a.iter(line):
        if phrase == TAG_WORDS:
            tagged = True
            continue
        label = BASE.get(phrase) or NOTICES[phrase]
        labels[label] = RESTRICTION[label]
        if phrase in BASE:
            base.add(label)
            places.append(end - len(phrase) - 1)
    for p in sorted(places):  # words before a place: spaces before it, counted once along the line
        seen += line.count(" ", at, p)
        at = p
        n_base, first, last = n_base + 1, seen if first is None else first, seen
    if tagged:
        for m in TAG.finditer(low):
            found, value = evaluate(m[1])
            expressions.append(m[1].strip())
            for label in found:
                labels[label] = max(value, labels.get(label, 0.0))
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), float(max(labels.values(), default=0.0)), expressions


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, see SCHEMA; labels are distinct, sorted and comma-joined."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions"]
        for b in it:
            found = [scan(t.as_py(), a) for t in b.column(1)]
            columns = list(zip(*found)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return common.in_batches(docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"CAST(`{text_col}` AS STRING) AS text"), batches, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(common.table(spark, sf_dir, "documents"))
