"""Marks in text, as column expressions: invisible characters, variation-selector runs, generator headers.

Every expression takes time in proportion to the text, whatever it holds: nothing is searched for behind the
last place where it may end. LF is the only line end.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrow

# Code point sets, the encoded forms of two words, and element patterns.
SELECTORS = r"\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"
HYGIENE_SET = r"\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{AD}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{1680}"
HYGIENE = f"[{HYGIENE_SET}]"
WRAPPER = (
    r"\x{E015A}\x{E0165}\x{E015D}\x{E0152}"
    r"|[\x{E0153}\x{E0133}]\x{E0122}[\x{E0160}\x{E0140}][\x{E0151}\x{E0131}]"
)
MALFORMED_RUN = 8
RUN_OR_TEXT = f"([{SELECTORS}]+|[^{SELECTORS}]+)"
SPANS = "array<struct<kind: string, offset: long, length: long>>"
TAG_OR_TEXT = r"((?i:<meta)[^>]*+>|<|[^<]+)"
ELEMENT_OR_TEXT = r"(?s)((?i:<meta)[^>]*+>|<!--.*?-->|<|[^<]+)"
GENERATOR_META = r"""(?is)^<meta[^>]*[ \t\n\r\f]name\s*=\s*(?:"\s*generator\s*"|'\s*generator\s*'|generator[\s>/])"""
GENERATOR_COMMENT = r"(?is)^<!--.*(?:generator|created with)"
BANNER = r"(?dim)^[ \t\r\f\x0B]*+(?:(?:#|//|;|--|%|rem |')[^\n]*generator:|generator:|x-generator:)[^\n]*+(?:\n|\z)"
OPEN, CLOSE = "<metadata", "</metadata>"
#: A cut element is ESCAPE + GONE. Either character of the text itself gets another one behind ESCAPE, so no text is taken for a cut.
ESCAPE, GONE = "\ue000", "\ue002"
ESCAPED = {"\ue000": "\ue000\ue001", "\ue002": "\ue000\ue003"}
CUT_LINE = r"(?dm)^[ \t\r\f\x0B]*+\x{E000}\x{E002}[ \t\r\f\x0B\x{E000}\x{E002}]*+(?:\n|\z)"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often use names it: a plan would else hold (and run) a copy for each."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column) -> Column:
    """Runs of variation selectors and the text between them, in order."""
    return F.regexp_extract_all(text, F.lit(RUN_OR_TEXT), F.lit(1))


def token_kind(token: Column) -> Column:
    """T text, W wrapper, M malformed run, H lone selectors."""
    return (
        F.when(~token.rlike(f"^[{SELECTORS}]"), "T").when(token.rlike(WRAPPER), "W").when(F.length(token) >= MALFORMED_RUN, "M").otherwise("H")
    )


def counted(text: Column) -> Column:
    """struct<hygiene, malformed, wrapper>: how many marks of each kind, in one pass over the runs of selectors."""

    def totals(text: Column) -> Column:
        kinds = F.transform(F.regexp_extract_all(text, F.lit(f"([{SELECTORS}]+)"), F.lit(1)), token_kind)
        how_many = lambda kinds, k: F.size(F.filter(kinds, lambda x: x == k)).cast("long")
        single = F.regexp_count(text, F.lit(HYGIENE)).cast("long")
        return bound(kinds, lambda ks: F.struct((how_many(ks, "H") + single).alias("hygiene"), how_many(ks, "M").alias("malformed"), how_many(ks, "W").alias("wrapper")))

    zero = F.lit(0).cast("long")
    none = F.struct(zero.alias("hygiene"), zero.alias("malformed"), zero.alias("wrapper"))
    # most texts have no mark: one look spares them the rest
    return bound(text, lambda t: F.when(t.rlike(f"[{SELECTORS}{HYGIENE_SET}]"), totals(t)).otherwise(none))


def spans(text: Column) -> Column:
    """SPANS, in bytes and in their order: W wrappers, M malformed runs, H lone selectors, S single hygiene characters. Only texts
    with a mark go to Python, where running sums take one pass; null for the others."""

    def all_of(texts: pa.Array) -> pa.Array:
        spelt = lambda pattern: re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), pattern)
        mark, wrapper = re.compile(spelt(f"[{SELECTORS}]+|([{HYGIENE_SET}])")), re.compile(spelt(WRAPPER))

        def one(text: str | None) -> list[dict] | None:
            if text is None:
                return None
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            ends = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])
            found = []
            for m in mark.finditer(text):
                kind = "S" if m[1] else "W" if wrapper.search(m[0]) else "M" if len(m[0]) >= MALFORMED_RUN else "H"
                at, upto = int(ends[m.start()]), int(ends[m.end()])
                found.append({"kind": kind, "offset": at, "length": upto - at})
            return found

        return pa.array([one(t.as_py()) for t in texts], pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))

    return arrow.by_slices(all_of, SPANS)(bound(text, lambda t: F.when(t.rlike(f"[{SELECTORS}{HYGIENE_SET}]"), t)))


def without_invisibles(text: Column) -> Column:
    """Drops lone selectors and hygiene characters; malformed runs and wrappers stay."""
    kept = F.filter(tokens(text), lambda t: token_kind(t) != "H")
    return F.when(text.rlike(f"[{SELECTORS}{HYGIENE_SET}]"), F.regexp_replace(F.array_join(kept, ""), HYGIENE, "")).otherwise(text)


def without_metadata(text: Column) -> Column:
    """Cuts from the first opening to the first closing tag, again and again, until a closing tag comes first."""

    def cut(parts: Column) -> Column:  # the last one has no closing tag behind it
        stop = F.array_position(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.contains(OPEN)), False)
        return bound(F.when(stop > 0, stop - 1).otherwise(F.size(parts) - 1).cast("int"), lambda n: joined(parts, n))

    def joined(parts: Column, n: Column) -> Column:  # of which the first n are cut
        before = F.array_join(F.transform(F.slice(parts, F.lit(1), n), lambda p: F.substring_index(p, OPEN, 1)), "")
        return F.concat(before, F.array_join(F.slice(parts, n + 1, F.size(parts) - n), CLOSE))

    return F.when(text.contains(OPEN) & text.contains(CLOSE), bound(F.split(text, CLOSE, -1), cut)).otherwise(text)


def without_generator_elements(text: Column) -> Column:
    """Cuts generator <meta> tags and comments; one alone on its line takes the line."""

    def escaped(t: Column) -> Column:
        return F.replace(F.replace(t, F.lit(ESCAPE), F.lit(ESCAPED[ESCAPE])), F.lit(GONE), F.lit(ESCAPED[GONE]))

    def marked(t: Column) -> Column:
        return F.when(t.rlike(GENERATOR_META) | t.rlike(GENERATOR_COMMENT), F.lit(ESCAPE + GONE)).otherwise(escaped(t))

    def elements(before: Column, pattern: str) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(before, F.lit(pattern), F.lit(1)), marked), "")

    def without(text: Column, tail: Column, rest: Column) -> Column:
        upto = lambda t, end: F.left(t, F.length(t) - F.length(end))
        out = F.concat(elements(upto(text, tail), ELEMENT_OR_TEXT), elements(upto(tail, rest), TAG_OR_TEXT), escaped(rest))
        out = F.replace(F.regexp_replace(out, CUT_LINE, ""), F.lit(ESCAPE + GONE), F.lit(""))
        return F.replace(F.replace(out, F.lit(ESCAPED[GONE]), F.lit(GONE)), F.lit(ESCAPED[ESCAPE]), F.lit(ESCAPE))

    # no comment ends behind the last -->, and no tag behind the last >
    cut = bound(F.substring_index(text, "-->", -1), lambda tail: bound(F.substring_index(tail, ">", -1), lambda rest: without(text, tail, rest)))
    return F.when(text.rlike("(?i)<meta|<!--"), cut).otherwise(text)


def without_banners(text: Column) -> Column:
    return F.regexp_replace(text, BANNER, "")


def cleaned(text: Column) -> Column:
    """Privacy scrub: invisible characters, then generator headers. Provenance wrappers stay."""
    for step in (without_invisibles, without_metadata, without_generator_elements):
        text = bound(text, step)
    return without_banners(text)


def sniffed(content: Column) -> Column:
    """The format by leading bytes, then by the start of valid UTF-8 text; else unknown."""
    return bound(content, _sniffed)


def _sniffed(content: Column) -> Column:
    starts = lambda at, hexed: F.substring(content, at, len(hexed) // 2) == F.unhex(F.lit(hexed))
    text = content.cast("string")
    head = F.translate(F.regexp_replace(F.substring(text, 1, 512), r"^\p{IsWhite_Space}+", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    riff = starts(1, "52494646")
    return (
        F.when(starts(1, "89504E470D0A1A0A"), "png")
        .when(starts(1, "FFD8FF"), "jpeg")
        .when(riff & starts(9, "57454250"), "webp")
        .when(riff & starts(9, "57415645"), "riff-wav")
        .when(riff & starts(9, "41564920"), "riff-avi")
        .when(starts(1, "664C6143"), "flac")
        .when(starts(1, "4F676753"), "ogg")
        .when(starts(5, "66747970") & (F.length(content) >= 12), "isobmff")
        .when(starts(1, "494433"), "mp3")
        .when(starts(1, "FF") & (F.conv(F.hex(F.substring(content, 2, 1)), 16, 10).cast("int") >= 224), "mp3")
        .when(~F.is_valid_utf8(text), "unknown")
        .when(head.startswith("<?xml") & head.contains("<svg") | head.startswith("<svg"), "svg")
        .when(head.startswith("<!doctype html") | head.startswith("<html"), "html")
        .otherwise("text")
    )
