"""Exact expectations for text marks, the registry's SQL twins."""

import duckdb
import pytest
from pyspark.sql import functions as F

from marklens.functions import text as T
from marklens.operators import inspect
from marklens.plans import queries

SF = "/root/testdata/sf0.001"
WRAPPED = "see" + queries.selectors("a jumb box") + " there\n"
CLEANED = {
    "one\u200btwo\u2067three\u2069\n": "onetwothree\n",
    WRAPPED: WRAPPED,
    "<i>k</i><!-- GENERATOR: t --><i>l</i>\n": "<i>k</i><i>l</i>\n",
    "a\n  <!-- created with t --> \t<!-- generator -->\nb": "a\nb",
    "<!-- by hand -->\n": "<!-- by hand -->\n",
    "%% made by Generator: t\nKept.\n": "Kept.\n",
    "A generator: it hums.\n": "A generator: it hums.\n",
    'x\n<META charset=u NAME = " generator ">\ny': "x\ny",
    "<meta name='author'>y": "<meta name='author'>y",
    "x<metadata>a</metadata>y<metadata b>c</metadata>z</metadata>": "xyz</metadata>",
    "</metadata><metadata></metadata>": "</metadata><metadata></metadata>",
    "\ue000\n \ue000\ue002 \n\ue002\n<!-- generator -->\n\ue000": "\ue000\n \ue000\ue002 \n\ue002\n\ue000",
    "no marks\n": "no marks\n",
    "": "",
}
HYGIENE = {*range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF, *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0xAD, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x1680}


def runs_of(text):
    """Maximal runs of selectors (bytes they stand for) and single other characters."""
    out = []
    for c in map(ord, text):
        byte = c - 0xFE00 if 0xFE00 <= c <= 0xFE0F else c - 0xE0100 + 16 if 0xE0100 <= c <= 0xE01EF else None
        if byte is None:
            out.append(chr(c))
        elif out and isinstance(out[-1], list):
            out[-1].append(byte)
        else:
            out.append([byte])
    return out


def kind_of(run):
    if b"jumb" in bytes(run) or b"c2pa" in bytes(run).lower():
        return "W"
    return "M" if len(run) >= 8 else "H"


def shown(run):
    return "".join(chr(0xFE00 + b if b < 16 else 0xE0100 + b - 16) for b in run) if isinstance(run, list) else run


def brute_counts(text):
    parts = runs_of(text)
    kinds = [kind_of(p) for p in parts if isinstance(p, list)]
    return kinds.count("H") + sum(ord(p) in HYGIENE for p in parts if isinstance(p, str)), kinds.count("M"), kinds.count("W")


def brute_clean(text):
    """The scrub, by definition, a character or a line at a time."""
    h, m, _ = brute_counts(text)
    if not h and m:
        return text
    t = "".join(shown(p) for p in runs_of(text) if (kind_of(p) != "H" if isinstance(p, list) else ord(p) not in HYGIENE))
    done = ""
    while "<metadata" in t and (z := t.find("</metadata>")) >= 0 and (a := t.find("<metadata")) < z:
        done, t = done + t[:a], t[z + 11 :]
    t = done + t
    gone = [False] * len(t)
    at = 0
    while at < len(t):
        end = 0
        if t[at : at + 5].lower() == "<meta":
            end = t.find(">", at) + 1
            tag = t[at:end].lower()
            is_mark = False
            for i in range(1, len(tag)):
                if tag[i - 1] in " \t\n\r\f" and tag.startswith("name", i):
                    rest = tag[i + 4 :].lstrip()
                    if rest.startswith("="):
                        value = rest[1:].lstrip()
                        quote = value[:1] if value[:1] in "\"'" and value else ""
                        value = value[1:].split(quote)[0].strip() if quote and quote in value[1:] else None if quote else value
                        is_mark |= value == "generator" if quote else bool(value and value.startswith("generator") and value[9:10] and value[9] in " \t\n\r\f\v/>")
        elif t.startswith("<!--", at):
            end = t.find("-->", at + 4) + 3 if t.find("-->", at + 4) >= 0 else 0
            is_mark = "generator" in t[at:end].lower() or "created with" in t[at:end].lower()
        if end:
            gone[at:end] = [is_mark] * (end - at)
            at = end
        else:
            at += 1
    # lines by what is left of them: a cut element may span several
    out, line, cut = [], "", False
    for c, g in zip(t, gone):
        if g:
            cut = True
            continue
        line += c
        if c == "\n":
            out.append("" if cut and not line.strip(" \t\r\f\v\n") else line)
            line, cut = "", False
    out.append("" if cut and not line.strip(" \t\r\f\v") else line)
    kept = []
    for line in "".join(out).split("\n"):
        low = line.lstrip(" \t\r\f\v").lower()
        banner = low.startswith(("generator:", "x-generator:")) or low.startswith(("#", "//", ";", "--", "%", "rem ", "'")) and "generator:" in low
        kept.append((line, banner))
    joined = ""
    for i, (line, banner) in enumerate(kept):
        if not banner:
            joined += line + ("\n" if i < len(kept) - 1 else "")
    return joined


def test_cleaned(spark):
    rows = spark.createDataFrame(list(enumerate(CLEANED)), "asset_id long, text string")
    got = {r["before"]: r["after"] for r in inspect.cleaned(rows).collect()}
    assert got == CLEANED


def test_counts_and_cleaning_equal_brute_force(spark):
    import random

    rng = random.Random(11)
    pieces = ["a", " ", "\n", "\t", "\u200b", "\u2003", "\ufe0f", "\ufe0f" * 9, queries.selectors("xC2PAy"), "<!--", "-->", "generator", "created with ", "<meta ", "name=", "'generator'",
              "generator", ">", "<", "# ", "Generator: ", "<metadata", "</metadata>", "\ue000", "\ue002", "\ue001", "x-"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(3000)] + list(CLEANED)
    rows = spark.createDataFrame(list(enumerate(texts)), "asset_id long, text string")
    scan = {r["asset_id"]: (r["n_hygiene"], r["n_malformed"], r["n_wrapper"]) for r in inspect.scanned(rows).collect()}
    after = {r["asset_id"]: r["after"] for r in inspect.cleaned(rows).collect()}
    assert [(t, scan[i]) for i, t in enumerate(texts)] == [(t, brute_counts(t)) for t in texts]
    assert [x for x in ((t, after[i], brute_clean(t)) for i, t in enumerate(texts)) if x[1] != x[2]] == []


def test_long_texts_take_linear_time(spark):
    import time

    n = 60_000
    texts = ["<!-- generator -->" * n, "<!--" * 4 * n, "<metadata " * 2 * n, "<meta " * 3 * n, "<!--" * 2 * n + ">", "<metadata>" * n + "</metadata>" * n, "\ufe0f" * 5 * n, " " * 10 * n + "generator:", "<metadata></metadata>" * n]
    began = time.time()
    done = inspect.verified(inspect.cleaned(spark.createDataFrame(list(enumerate(texts)), "asset_id long, text string")))
    assert done.count() == len(texts) and len(done.collect()) == len(texts)
    assert time.time() - began < 60


def test_malformed_run_is_kept_and_fails_closed(spark):
    rows = spark.createDataFrame([(1, "x" + "️" * 12 + "y\n"), (2, None)], "asset_id long, text string")
    assert {r["asset_id"]: r["invisibles"] for r in inspect.scanned(rows).collect()} == {1: "malformed", 2: "confirmed_absent"}
    assert {r["asset_id"]: (r["exit_code"], r["changed"]) for r in inspect.cleaned(rows).collect()} == {1: (30, False), 2: (0, False)}


def test_malformed_run_in_the_output_is_not_verified(spark):
    run = "x" + "\ufe0f" * 12
    rows = spark.createDataFrame([(1, run + "\u200b"), (2, "a\u200bb"), (3, run)], "asset_id long, text string")
    done = inspect.cleaned(rows)
    assert {r["asset_id"]: r["exit_code"] for r in done.collect()} == {1: 0, 2: 0, 3: 30}
    checked = inspect.verified(done)
    assert {r["asset_id"]: (r["verified"], r["exit_code"]) for r in checked.collect()} == {1: (False, 30), 2: (True, 0), 3: (False, 30)}
    assert inspect.worst_exit(checked.where("asset_id < 3").withColumn("g", F.lit(1)), "g").first()["worst_exit"] == 30
    kept = spark.createDataFrame([(4, run + "\u200b", 0), (5, "a\u200b", 0)], "asset_id long, after string, exit_code int")
    assert {r["asset_id"]: r["exit_code"] for r in inspect.verified(kept).collect()} == {4: 10, 5: 10}


@pytest.mark.parametrize(
    "content, form",
    [(b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff\xe0", "jpeg"), (b"RIFF\0\0\0\0WAVEfmt ", "riff-wav"), (b"\0\0\0\x18ftypM4A ", "isobmff"), (b"ID3\x04", "mp3"),
     (b"\xff\xfb\x90", "mp3"), (b"fLaC", "flac"), (b"OggS", "ogg"), (b"  <svg/>", "svg"), (b"<!DOCTYPE html>", "html"), (b"", "text"), (b"\xc0" * 40, "unknown")],
)
def test_sniffed(spark, content, form):
    assert spark.createDataFrame([(bytearray(content),)], "content binary").select(T.sniffed(F.col("content"))).first()[0] == form


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want.fetchall()))


def test_registry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
