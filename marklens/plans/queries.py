"""Queries over the text tables. The tables hold no marks, so both sides put the same ones in first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrow, samples
from ..functions import text as T
from ..operators import containers, fidelity, inspect, pixelmark, report
from . import classes, media_queries, policy


def selectors_of(content: bytes) -> str:
    """Bytes as variation selectors."""
    return "".join(chr(0xFE00 + b if b < 16 else 0xE0100 + b - 16) for b in content)


def selectors(message: str) -> str:
    return selectors_of(message.encode())


#: By doc_id % 10, what is put before and after the text.
MARKS = {
    0: ("soft\u00adhyphen ", ""), 1: ("\u2066", "\u2069"), 2: ("figure", selectors("store jumb/C2pa box")), 3: ("y" + "\ufe0e" * 9, ""),
    4: ("// generator: tool 7\n", ""), 5: ("<b>q</b><!-- created with tool 7 --><i>r</i>\n", ""), 6: ("<meta content=a name=generator >\n", ""),
    7: ("\ue000 kept \ue002\n<!-- made by a Generator -->\n\ue000\n", ""), 8: ("z" + "\ufe01" * 8 + "\u2060", ""), 9: ("<metadata>k</metadata>d\ufe0fe ", "\n -- x-generator: y"),
}
MARKED = "CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN '{a}' || coalesce(text, '') || '{b}'" for k, (a, b) in MARKS.items()) + " ELSE coalesce(text, '') END"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    case = text
    for k, (a, b) in MARKS.items():
        case = F.when(F.col("doc_id") % 10 == k, F.concat(F.lit(a), text, F.lit(b))).otherwise(case)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", case.alias("text"))


def scan(spark, sf_dir):
    return inspect.scanned(marked(spark, sf_dir), "doc_id")


def state_by_lang(spark, sf_dir):
    scan_ = inspect.scanned(marked(spark, sf_dir).withColumn("id", F.struct("doc_id", "lang")), "id")
    return scan_.groupBy(F.col("id.lang").alias("lang"), "invisibles").agg(F.count(F.lit(1)).alias("n"), F.sum("n_hygiene").alias("n_hygiene"))


def sniff_format(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lit("documents").alias("origin"), "text")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("pages").alias("origin"), F.col("html").alias("text"))
    both = docs.unionByName(pages).select("origin", T.sniffed(F.coalesce("text", F.lit("")).cast("binary")).alias("format"))
    return both.groupBy("origin", "format").agg(F.count(F.lit(1)).alias("n"))


def clean(spark, sf_dir):
    done = inspect.cleaned(marked(spark, sf_dir), "doc_id")
    return done.select("doc_id", "changed", "exit_code", F.sha2("after", 256).alias("after_sha256"))


def verify(spark, sf_dir):
    return inspect.verified(inspect.cleaned(marked(spark, sf_dir), "doc_id"), "doc_id")


#: By doc_id % 13, exit codes that later steps may give (a collision, an unreadable file, ...), put in so that all six occur.
CODES = {1: 10, 2: 50, 3: 40, 4: 2}


def worst_by_group(spark, sf_dir):
    """By source and doc_id % 50: groups in which the worst code is not the largest one."""
    done = inspect.verified(inspect.cleaned(marked(spark, sf_dir).withColumn("id", F.struct("doc_id", "source")), "id"), "id")
    code = F.col("exit_code")
    for k, put in CODES.items():
        code = F.when(F.col("id.doc_id") % 13 == k, put).otherwise(code)
    return inspect.worst_exit(done.select(F.col("id.source").alias("source"), (F.col("id.doc_id") % 50).alias("part"), code.alias("exit_code")), "source", "part")


#: By doc_id % 8, a media file around the text (its bytes are T, little-endian length L), and its classes found or malformed.
FILES = {
    0: ("FFD8" "FFE10024" + (b"http://ns.adobe.com/xap/1.0/\0" + b"<x/>\n").hex() + "FFDA", "jpeg", ["xmp"], []),
    1: ("FFD8" "FFEB0006" + b"jumb".hex() + "FFED0010" + b"Photoshop 3.0\0".hex() + "FFDA0000", "jpeg", ["c2pa", "iptc"], []),
    2: ("664C6143" "00000002ABCD" "84000001FF", "flac", ["vorbis"], []),
    3: ("664C6143" "80000002ABCD", "flac", [], []),
    4: ("89504E470D0A1A0A" "00000003" + b"tEXta\0b".hex() + "00000000" "00000000" + b"IEND".hex() + "00000000", "png", ["png_text"], []),
    5: ("89504E470D0A1A0A" "00000004" + b"caBXjumb".hex() + "00000000" "7FFFFFFF" + b"IDAT".hex(), "png", ["c2pa"], ["png_text", "exif", "xmp"]),
    6: ("00000010" + b"ftypM4A 0000".hex() + "0000000E" + b"uuid..jumb".hex() + "00000000" + b"mdat".hex(), "isobmff", ["c2pa"], []),
    7: (b"ID3\4\0\0\0\0\0\4TXXX".hex(), "mp3", ["id3"], ["ape", "mp3_info", "mp3_ancillary"]),
}


def container_states(spark, sf_dir):
    start = F.lit(None).cast("binary")
    for k, (hexed, *_) in FILES.items():
        start = F.when(F.col("doc_id") % 8 == k, F.unhex(F.lit(hexed))).otherwise(start)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select(F.col("doc_id").alias("asset_id"), F.concat(start, F.coalesce("text", F.lit("")).cast("binary")).alias("content"))
    return containers.states(files).withColumnRenamed("asset_id", "doc_id")


def text_locations(spark, sf_dir):
    found = inspect.located(marked(spark, sf_dir), "doc_id").select("doc_id", "class", "state", F.explode_outer("locations").alias("l"), F.array_join("evidence", "; ").alias("evidence"))
    return found.select("doc_id", "class", "state", F.col("l.offset").alias("byte_start"), F.col("l.length").alias("length"), F.col("l.detail").alias("detail"), "evidence")


def as_assets(rows, id_col="doc_id"):
    return rows.select(F.col(id_col).alias("asset_id"), F.col("text").cast("binary").alias("content"))


def report_rows(spark, sf_dir):
    made = report.reports(report.inspected(as_assets(marked(spark, sf_dir))))
    return made.select(
        F.col("asset_id").alias("doc_id"), "format", "exit_code", F.size("scan_states").alias("n_states"),
        F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["class"], f["scan_state"], F.size(f["locations"]))), ",").alias("findings"),
    )


def verify_report(spark, sf_dir):
    """Cleaned texts against reports that say their invisible characters are gone. By doc_id % 6, the report is of another policy
    (0), of none (1), or of another format (2); in every seventh text a mark has come back since."""
    done = inspect.cleaned(marked(spark, sf_dir), "doc_id")
    of = lambda k: F.col("doc_id") % 6 == k
    digest = F.when(of(0), '"another"').when(of(1), "null").otherwise(f'"{policy.Policy().digest}"')
    value = F.format_string('{"policy_digest": %s, "output_format": %s, "stripped_and_proven_gone": ["invisible Unicode"]}', digest, F.when(of(2), '"png"').otherwise("null"))
    output = F.concat("after", F.when(F.col("doc_id") % 7 == 3, "\u2060").otherwise(""))
    rows = done.select(F.col("doc_id").alias("asset_id"), value.alias("value"), output.cast("binary").alias("content"))
    found = report.with_found(rows, "content", "format", "found")
    return report.verified(found).select(F.col("asset_id").alias("doc_id"), "verified", "exit_code", F.array_join("problems", "; ").alias("problems"))


def plan_rows(spark, sf_dir):
    """The plan of each format that the documents' files have, and how many files it is for."""
    formats = media_queries.tagged_files(spark, sf_dir).select(T.sniffed(F.col("content")).alias("format")).groupBy("format").agg(F.count(F.lit(1)).alias("files"))
    plan = policy.planned(spark, keep=["id3", "Strip-XMP"], no_degrade=True).select("format", "place", "id", "name", "runs", "reason")
    return formats.join(F.broadcast(plan), "format")  # a few dozen rows


#: Pixels across, and how many values of a pixel become one in the second picture: of every fifth document, and of others.
ACROSS, COARSE, FINE = 32, 128, 4
#: Bytes below it turn a block's bit over.
LOW = 101


def picture_fidelity(spark, sf_dir):
    """Each text's bytes as a grey PNG of eight lines at least, against the same with fewer shades."""

    def drawn(texts: pa.Array, steps: pa.Array) -> pa.Array:
        out = []
        for text, step in zip(texts, steps.to_pylist()):
            content = np.frombuffer(text.as_py(), np.uint8)
            grey = np.zeros((max(8, -(-len(content) // ACROSS)), ACROSS, 1), np.uint8)
            grey.ravel()[: len(content)] = content
            out.append(dict(zip(("before", "after"), (samples.png_of(np.repeat(g, 3, axis=2)) for g in (grey, grey - grey % np.uint8(step))))))
        return pa.array(out, pa.struct([("before", pa.binary()), ("after", pa.binary())]))

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t"), F.when(F.col("doc_id") % 5 == 0, COARSE).otherwise(FINE).alias("step"))
    pairs = texts.select("doc_id", arrow.by_slices(drawn, "struct<before: binary, after: binary>", files=True)(F.col("t"), F.col("step")).alias("p"))
    made = fidelity.measures(pairs.select(F.col("doc_id").alias("asset_id"), "p.before", "p.after"))
    return made.select(F.col("asset_id").alias("doc_id"), F.round("psnr_db", 6).alias("psnr_db"), F.round("ssim", 6).alias("ssim"), "passed", "exit_code")


def pixel_marks(spark, sf_dir):
    """Pictures of whole lines, read for the pixel mark. By doc_id % 5: the first payload's pattern on grey (1), the second's (2), the
    first's with the bits of blocks whose byte is low turned over (3), else the text's bytes as colours."""
    payloads = [np.array([b == "1" for b in p]) for p in pixelmark.PAYLOADS.values()]

    def drawn(ids: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for asset, text in zip(ids.to_pylist(), texts):
            content = np.frombuffer(text.as_py(), np.uint8)
            high, kind = max(8, -(-len(content) // (3 * ACROSS))), (asset or 0) % 5
            if kind in (1, 2, 3):
                picture, block = np.full((high, ACROSS, 3), 128, np.uint8), np.arange(high // 8 * (ACROSS // 8))
                payload = payloads[kind == 2]
                bits = payload[block % len(payload)]
                if kind == 3 and len(content):
                    bits ^= content[block % len(content)] < LOW
                patches = np.where(bits, 156, 166).astype(np.uint8).reshape(-1, ACROSS // 8)
                for y in (0, 1):
                    for x in (2, 3):
                        picture[y : high // 8 * 8 : 8, x::8, 2] = patches
            else:
                picture = np.zeros((high, ACROSS, 3), np.uint8)
                picture.ravel()[: len(content)] = content
            out.append(samples.png_of(picture))
        return pa.array(out, pa.binary())

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("asset_id"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    files = docs.select("asset_id", arrow.by_slices(drawn, "binary", files=True)(F.col("asset_id"), F.col("t")).alias("content"))
    found = pixelmark.decisions(files)
    return found.select(F.col("asset_id").alias("doc_id"), "state", "blocks", *(F.col("agreements")[n].alias(c) for n, c in (("sdxl-48", "sdxl"), ("compvis-136", "compvis"))))


QUERIES = {
    "sniff_format": sniff_format,
    "scan_text": scan,
    "scan_states": lambda s, d: inspect.scan_states(scan(s, d), "doc_id"),
    "state_by_lang": state_by_lang,
    "selector_spans": lambda s, d: inspect.spans(marked(s, d), "doc_id"),
    "clean_text": clean,
    "verify_text": verify,
    "worst_exit": worst_by_group,
    "container_states": container_states,
    "text_locations": text_locations,
    "report_rows": report_rows,
    "verify_report": verify_report,
    "plan_rows": plan_rows,
    "picture_fidelity": picture_fidelity,
    "pixel_marks": pixel_marks,
}

# The SQL twins, written by themselves: they share no pattern with the expressions above. RE2 reads them.
_SEL = r"\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"
_ODD = r"\x{AD}\x{1680}\x{2000}-\x{200F}\x{202A}-\x{202F}\x{205F}-\x{2064}\x{2066}-\x{2069}\x{3000}\x{FEFF}"
_KIND = rf"""CASE WHEN NOT regexp_matches(tok, '^[{_SEL}]') THEN 'T'
  WHEN regexp_matches(tok, '\x{{E015A}}\x{{E0165}}\x{{E015D}}\x{{E0152}}|[\x{{E0133}}\x{{E0153}}]\x{{E0122}}[\x{{E0140}}\x{{E0160}}][\x{{E0131}}\x{{E0151}}]') THEN 'W'
  WHEN length(tok) > 7 THEN 'M' ELSE 'H' END"""


def _tokens(of: str, source: str, name: str) -> str:
    """{name}: tokens of a column, numbered, with kinds; {name}_n: how many of each kind a document has."""
    runs = f"regexp_extract_all({of}, '[{_SEL}]+|[^{_SEL}]+')"
    return f"""{name} AS (SELECT doc_id, i, tok, {_KIND} AS kind FROM (SELECT doc_id, unnest({runs}) AS tok, unnest(range(len({runs}))) AS i FROM {source})),
{name}_n AS (SELECT doc_id, count(*) FILTER (kind = 'H') AS h, count(*) FILTER (kind = 'M') AS m, count(*) FILTER (kind = 'W') AS w,
  string_agg(tok, '' ORDER BY i) FILTER (kind <> 'H') AS kept FROM {name} GROUP BY doc_id)"""


_WS = r"[ \t\r\f\v]"
_DOCS = rf"""d AS (SELECT doc_id, lang, source, {MARKED} AS t FROM documents),
{_tokens('t', 'd', 'tok')},
s AS (SELECT d.doc_id, lang, source, t, coalesce(kept, '') AS kept, (coalesce(h, 0) + len(regexp_extract_all(t, '[{_ODD}]')))::BIGINT AS n_hygiene,
  coalesce(m, 0)::BIGINT AS n_malformed, coalesce(w, 0)::BIGINT AS n_wrapper FROM d LEFT JOIN tok_n USING (doc_id)),
r AS (SELECT *, CASE WHEN regexp_matches(lower(ltrim(t)), '^(<!doctype html|<html)') THEN 'html' WHEN starts_with(lower(ltrim(t)), '<svg') THEN 'svg' ELSE 'text' END AS format,
  CASE WHEN n_hygiene > 0 THEN 'confirmed_present' WHEN n_malformed > 0 THEN 'malformed' ELSE 'confirmed_absent' END AS invisibles,
  CASE WHEN n_wrapper > 0 THEN 'confirmed_present' END AS c2pa FROM s),
cut AS (SELECT *, array_to_string(list_transform(
    regexp_extract_all(regexp_replace(regexp_replace(kept, '[{_ODD}]', '', 'g'), '(?s)<metadata.*?</metadata>', '', 'g'), '(?s)(?i:<meta)[^>]*>|<!--.*?-->|<|[^<]+'),
    lambda x: CASE WHEN regexp_matches(lower(x), '(?s)^<meta[^>]*\sname\s*=\s*["'']?\s*generator\s*["''\s/>]') OR regexp_matches(lower(x), '(?s)^<!--.*(generator|created with)')
      THEN chr(63742) ELSE x END), '') AS joined FROM r),
c AS (SELECT *, CASE WHEN n_hygiene = 0 AND n_malformed > 0 THEN t ELSE
  regexp_replace(replace(regexp_replace(joined, '(?m)^{_WS}*(?:\x{{F8FE}}{_WS}*)+(?:\n|\z)', '', 'g'), chr(63742), ''),
    '(?im)^{_WS}*((#|//|;|--|%|rem |'')[^\n]*generator:|(x-)?generator:)[^\n]*(\n|\z)', '', 'g') END AS after,
  CASE WHEN n_hygiene = 0 AND n_malformed > 0 THEN 30 ELSE 0 END AS exit_code FROM cut),
{_tokens('after', 'c', 'out')},
v AS (SELECT c.doc_id, source, CASE WHEN exit_code <> 0 THEN exit_code WHEN coalesce(h, 0) + len(regexp_extract_all(after, '[{_ODD}]')) > 0 THEN 10
  WHEN coalesce(m, 0) > 0 THEN 30 ELSE 0 END AS exit_code FROM c LEFT JOIN out_n USING (doc_id))"""

_REPORTS = [
    (k, form, c, honesty, "not_attempted" if honesty != "confirmable" else "confirmed_present" if c in found else "malformed" if c in broken else "confirmed_absent", int(c in found))
    for k, (_, form, found, broken) in FILES.items()
    for honesty, table in (("confirmable", classes.CONFIRMABLE), ("blind", classes.BLIND), ("unaddressed", classes.UNADDRESSED))
    for c in table.get(form, ())
]
_PUT = " ".join(f"WHEN {k} THEN {code}" for k, code in CODES.items())
_SPANS = f"regexp_extract_all(t, '[{_SEL}]+|[{_ODD}]|[^{_SEL}{_ODD}]+')"

_BITS = {"sdxl": f"{0xB3EC907BB19E:048b}", "compvis": "".join(f"{x:08b}" for x in b"StableDiffusionV1")}
_DRAWN = lambda sql: sql.replace("{sdxl}", _BITS["sdxl"]).replace("{compvis}", _BITS["compvis"])

ORACLES = {
    "container_states": f"""SELECT doc_id, format, class, honesty, state, n::BIGINT AS n FROM documents JOIN (VALUES {', '.join(map(str, _REPORTS))}) r(k, format, class, honesty, state, n) ON doc_id % 8 = k
UNION ALL SELECT doc_id, NULL, NULL, NULL, 'unsupported_format', 0 FROM documents WHERE doc_id IS NULL""",
    "sniff_format": "SELECT origin, CASE WHEN regexp_matches(lower(ltrim(t)), '^(<!doctype html|<html)') THEN 'html' ELSE 'text' END AS format, count(*) AS n FROM (SELECT 'documents' AS origin, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'pages', coalesce(html, '') FROM pages) GROUP BY ALL",
    "scan_text": f"WITH {_DOCS} SELECT doc_id, format, n_hygiene, n_malformed, n_wrapper, invisibles, c2pa FROM r",
    "scan_states": f"WITH {_DOCS} SELECT doc_id, 'invisibles' AS class, 'confirmable' AS honesty, invisibles AS state FROM r UNION ALL SELECT doc_id, 'c2pa', 'confirmable', c2pa FROM r WHERE c2pa IS NOT NULL",
    "state_by_lang": f"WITH {_DOCS} SELECT lang, invisibles, count(*) AS n, sum(n_hygiene)::BIGINT AS n_hygiene FROM r GROUP BY ALL",
    "selector_spans": f"WITH {_DOCS} SELECT doc_id, kind, byte_end - strlen(tok) AS byte_start, byte_end FROM (SELECT *, sum(strlen(tok)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS byte_end FROM tok) WHERE kind <> 'T'",
    "clean_text": f"WITH {_DOCS} SELECT doc_id, t <> after AS changed, exit_code, sha256(after) AS after_sha256 FROM c",
    "verify_text": f"WITH {_DOCS} SELECT doc_id, exit_code = 0 AS verified, exit_code FROM v",
    "worst_exit": f"""WITH {_DOCS}, e AS (SELECT source, doc_id % 50 AS part, CASE doc_id % 13 {_PUT} ELSE exit_code END AS code FROM v)
SELECT source, part, (ARRAY[0, 10, 50, 30, 40, 2])[max(list_position([0, 10, 50, 30, 40, 2], code))] AS worst_exit, count(*) AS n FROM e GROUP BY source, part""",
    "text_locations": f"""WITH {_DOCS}, sp AS (SELECT doc_id, unnest({_SPANS}) AS tok, unnest(range(len({_SPANS}))) AS i FROM d),
k AS (SELECT doc_id, tok, CASE WHEN regexp_matches(tok, '^[{_ODD}]$') THEN 'H' ELSE {_KIND} END AS kind, sum(strlen(tok)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT - strlen(tok) AS pos FROM sp),
g AS (SELECT doc_id, CASE WHEN kind = 'W' THEN 'c2pa' ELSE 'invisibles' END AS class, count(*) FILTER (kind = 'H') AS h,
  string_agg('a long run of variation selectors at byte ' || pos || ' is no wrapper and stays', '; ' ORDER BY pos) FILTER (kind = 'M') AS runs FROM k WHERE kind <> 'T' GROUP BY ALL),
l AS (SELECT doc_id, CASE WHEN kind = 'W' THEN 'c2pa' ELSE 'invisibles' END AS class, pos, strlen(tok) AS length FROM k WHERE kind IN ('W', 'H'))
SELECT doc_id, class, CASE WHEN class = 'invisibles' AND h = 0 THEN 'malformed' ELSE 'confirmed_present' END AS state, pos AS byte_start, length,
  CASE WHEN pos IS NULL THEN NULL WHEN class = 'c2pa' THEN 'variation-selector wrapper' ELSE 'invisible character' END AS detail,
  concat_ws('; ', CASE WHEN h > 0 THEN h || ' invisible characters' END, runs) AS evidence
FROM g LEFT JOIN l USING (doc_id, class)""",
    "report_rows": f"""WITH {_DOCS}, sp AS (SELECT doc_id, unnest({_SPANS}) AS tok FROM d),
k AS (SELECT doc_id, count(*) FILTER (kind = 'H') AS h, count(*) FILTER (kind = 'W') AS w FROM (
  SELECT doc_id, CASE WHEN regexp_matches(tok, '^[{_ODD}]$') THEN 'H' ELSE {_KIND} END AS kind FROM sp) GROUP BY doc_id)
SELECT doc_id, format, CASE WHEN invisibles = 'malformed' THEN 30 ELSE 0 END AS exit_code, 1 + (c2pa IS NOT NULL)::INT AS n_states,
  concat_ws(',', CASE WHEN c2pa IS NOT NULL THEN 'c2pa:' || c2pa || ':' || w END, CASE WHEN invisibles <> 'confirmed_absent' THEN 'invisibles:' || invisibles || ':' || h END) AS findings
FROM r LEFT JOIN k USING (doc_id)""",
    "verify_report": f"""WITH {_DOCS}, o AS (SELECT c.doc_id, format, doc_id % 7 = 3 OR coalesce(h, 0) + len(regexp_extract_all(after, '[{_ODD}]')) > 0 AS back, coalesce(m, 0) > 0 AS runs FROM c LEFT JOIN out_n USING (doc_id)),
p AS (SELECT doc_id, runs AND NOT coalesce(back, false) AS bad, concat_ws('; ', CASE WHEN doc_id % 6 IN (0, 1) THEN 'the report is not of this policy' END,
  CASE WHEN doc_id % 6 = 2 THEN 'the report tells of png, not of ' || format END, CASE WHEN back THEN 'invisible Unicode was gone and is back' END) AS said FROM o)
SELECT doc_id, NOT bad AND said = '' AS verified, CASE WHEN bad THEN 30 WHEN said <> '' THEN 10 ELSE 0 END AS exit_code,
  CASE WHEN bad THEN 'invisible Unicode can''t be read in the output' ELSE said END AS problems FROM p""",
    "plan_rows": f"""WITH t AS (SELECT unnest([{', '.join(f"{{'id': '{i}', 'name': '{n}', 'place': {o}, 'kind': '{k}', 'formats': {f}, 'targets': {c}::VARCHAR[]}}" for i, n, o, k, f, c in policy.TRANSFORMS)}]) AS t),
x AS (SELECT unnest(t.formats) AS format, t.place AS place, t.id AS id, t.name AS name, CASE WHEN t.kind IN ('pixel', 'audio') THEN 'left as it is: no_degrade'
  WHEN list_contains(t.targets, 'id3') THEN 'left as it is: keep id3' WHEN t.name = 'strip-xmp' THEN 'left as it is: keep Strip-XMP' END AS reason FROM t),
f AS (SELECT (['png', 'riff-wav', 'webp', 'flac', 'jpeg', 'isobmff', 'mp3', 'text'])[doc_id % 8 + 1] AS format, count(*) AS files FROM documents GROUP BY 1)
SELECT format, files, place, id, name, reason IS NULL AS runs, reason FROM x JOIN f USING (format)""",
    "picture_fidelity": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CASE WHEN doc_id % 5 = 0 THEN 128 ELSE 4 END AS step FROM documents),
e AS (SELECT doc_id, step, greatest(8, (length(h) + 63) // 64) AS high, regexp_extract_all(h, '..') AS x FROM d),
p AS (SELECT doc_id, step, high, unnest(range(high * 32)) AS i, unnest(list_resize(x, high * 32, '00')) AS x FROM e),
q AS (SELECT doc_id, high, i, a, a - a % step AS b FROM (SELECT *, ('0x' || x)::INT AS a FROM p)),
w AS (SELECT doc_id, high, i // 256 AS wy, (i % 32) // 8 AS wx, count(*) AS n, sum((a - b) * (a - b)) AS squares, avg(a) AS ma, avg(b) AS mb,
  var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS both_ FROM q GROUP BY ALL),
m AS (SELECT doc_id, sum(n) AS n, sum(squares) AS squares,
  avg((2 * ma * mb + 6.5025) * (2 * both_ + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))) FILTER (wy < high // 8) AS ssim FROM w GROUP BY doc_id),
r AS (SELECT doc_id, CASE WHEN squares = 0 THEN 120.0::DOUBLE ELSE 10 * log10(65025 * n / squares) END AS psnr, ssim FROM m)
SELECT doc_id, round(psnr, 6) AS psnr_db, round(ssim, 6) AS ssim, psnr >= 25 AND ssim >= 0.6 AS passed, CASE WHEN psnr >= 25 AND ssim >= 0.6 THEN 0 ELSE 50 END AS exit_code FROM r""",
    "pixel_marks": _DRAWN("""WITH e AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS x FROM documents),
h AS (SELECT doc_id, greatest(8, (len(x) + 95) // 96) AS high, x FROM e),
p AS (SELECT doc_id, high, len(x) AS n, unnest(range(high * 96)) AS i, unnest(list_resize(x, high * 96, '00')) AS x FROM h),
q0 AS (SELECT doc_id, any_value(high) AS high, any_value(n) AS n, i // 3 AS px, max(('0x' || x)::INT) FILTER (i % 3 = 0) AS r, max(('0x' || x)::INT) FILTER (i % 3 = 1) AS g,
  max(('0x' || x)::INT) FILTER (i % 3 = 2) AS b FROM p GROUP BY ALL),
low AS (SELECT doc_id, i AS place FROM p WHERE doc_id % 5 = 3 AND i < n AND ('0x' || x)::INT < 101),
k AS (SELECT *, px // 32 // 8 * 4 + px % 32 // 8 AS block, px // 32 < high // 8 * 8 AND px // 32 % 8 < 2 AND px % 8 IN (2, 3) AS patch FROM q0 WHERE doc_id % 5 IN (1, 2, 3)),
m AS (SELECT k.doc_id, high, px, 128 AS r, 128 AS g, CASE WHEN NOT patch THEN 128 WHEN (CASE WHEN k.doc_id % 5 = 2 THEN substr('{compvis}', (block % 136 + 1)::INT, 1) ELSE substr('{sdxl}', (block % 48 + 1)::INT, 1) END = '1') = (place IS NULL) THEN 156 ELSE 166 END AS b
  FROM k LEFT JOIN low ON k.doc_id = low.doc_id AND place = block % nullif(n, 0)),
q AS (SELECT doc_id, high, px, r, g, b FROM q0 WHERE coalesce(doc_id % 5 NOT IN (1, 2, 3), true) UNION ALL SELECT * FROM m),
u AS (SELECT doc_id, high, px // 32 AS y, px % 32 AS x, greatest(0, least(255, ((b - ((r * 4899 + g * 9617 + b * 1868 + 8192) >> 14)) * 8061 + 2097152 + 8192) >> 14)) AS u FROM q),
l AS (SELECT doc_id, high, y // 2 AS y, x // 2 AS x, max(u) FILTER (y % 2 = 0 AND x % 2 = 0) AS a, max(u) FILTER (y % 2 = 0 AND x % 2 = 1) AS b,
  max(u) FILTER (y % 2 = 1 AND x % 2 = 0) AS c, max(u) FILTER (y % 2 = 1 AND x % 2 = 1) AS d FROM u WHERE y < high // 8 * 8 GROUP BY ALL),
v AS (SELECT doc_id, y // 4 * 4 + x // 4 AS num, max((d * sqrt(0.5) + b * sqrt(0.5)) * sqrt(0.5) + (c * sqrt(0.5) + a * sqrt(0.5)) * sqrt(0.5)) AS val
  FROM l WHERE y % 4 > 0 OR x % 4 > 0 GROUP BY ALL),
t AS (SELECT doc_id, num, (val % 36 > 18)::INT AS bit FROM v),
""") + ",\n".join(f"""{c}_b AS (SELECT doc_id, num % {len(bits)} AS k, sum(bit) * 255 > 127 * count(*) AS shown FROM t GROUP BY ALL),
{c} AS (SELECT doc_id, round(({bits.count('0')} + sum(CASE WHEN NOT shown THEN 0 WHEN substr('{bits}', k::INT + 1, 1) = '1' THEN 1 ELSE -1 END)) / {len(bits)}, 3) AS {c} FROM {c}_b GROUP BY doc_id)"""
        for c, bits in _BITS.items()) + """
SELECT doc_id, CASE WHEN n >= 48 AND sdxl >= 0.8 OR n >= 136 AND compvis >= 0.8 THEN 'confirmed_present' ELSE 'confirmed_absent' END AS state, n AS blocks, sdxl, compvis
FROM (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id) JOIN sdxl USING (doc_id) JOIN compvis USING (doc_id)""",
}
