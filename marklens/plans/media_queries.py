"""Queries over media files that are built around the documents' texts, by the same bytes on both sides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrow, jpeg
from ..functions import text as T
from ..operators import audit, clean, fidelity, outputs, report, rewrite
from . import policy

# -- files of every format -------------------------------------------------------------------------------------------
SIGNATURE = "89504E470D0A1A0A"
NO_CRC = "00000000"


def _bytes(hexed: str) -> Column:
    return F.unhex(F.lit(hexed))


def _ascii(text: str) -> Column:
    return _bytes(text.encode("latin-1").hex())


def _big(n: Column, digits: int = 8) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), digits, "0"))


def _little(n: Column) -> Column:
    return F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(n.cast("long"), s).bitwiseAND(255)), 2, "0")) for s in (0, 8, 16, 24)))


def _chunk(kind: str, body: Column) -> Column:
    return F.concat(_big(F.length(body)), _ascii(kind), body, _bytes(NO_CRC))


def _riff(form: str, *parts: tuple[str, Column]) -> Column:
    padded = [F.concat(_ascii(kind), _little(F.length(body)), body, F.when(F.length(body) % 2 == 1, _bytes("00")).otherwise(_bytes(""))) for kind, body in parts]
    body = F.concat(_ascii(form), *padded)
    return F.concat(_ascii("RIFF"), _little(F.length(body)), body)


def _box(kind: str, body: Column) -> Column:
    return F.concat(_big(F.length(body) + 8), _ascii(kind), body)


def _syncsafe(n: Column) -> Column:
    return F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(n.cast("long"), s).bitwiseAND(127)), 2, "0")) for s in (21, 14, 7, 0)))


def movie(text: Column) -> Column:
    """An MP4 with the text as its tags and, from two chunks on, as its media."""
    size = F.length(text)
    at = size + 116  # what stands before the media's first byte
    table = _box("stco", F.concat(_bytes("0000000000000002"), _big(at), _big(at + F.floor(size / 2))))
    track = _box("trak", _box("mdia", _box("minf", _box("stbl", table))))
    tags = _box("udta", _box("meta", F.concat(_bytes("00000000"), _box("ilst", text))))
    return F.concat(_box("ftyp", _ascii("M4A 0000")), _box("moov", F.concat(track, tags)), _box("mdat", text))


def tagged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, content: by doc_id % 8 a PNG, WAV, WebP, FLAC, JPEG, MP4, MP3 or text around each text, with a tag that holds it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    t, digest = F.col("t"), F.md5("t").cast("binary")
    frame = F.concat(_bytes("FFFB90C0" + "00" * 17), digest, _bytes("00" * (396 - 32)))
    made = [
        F.concat(_bytes(SIGNATURE), _chunk("IHDR", _bytes("00" * 13)), _chunk("tEXt", F.concat(_bytes("6B00"), t)), _chunk("IDAT", t), _chunk("IEND", _bytes(""))),
        _riff("WAVE", ("fmt ", _bytes("00" * 16)), ("LIST", F.concat(_ascii("INFO"), t)), ("data", t)),
        _riff("WEBP", ("VP8L", t), ("EXIF", t)),
        F.concat(_ascii("fLaC"), _bytes("00000022" + "00" * 34), _bytes("84"), _big(F.length(t), 6), t, t),
        F.concat(_bytes("FFD8FFE00007" + b"JFIF\0".hex() + "FFFE0022"), digest, _bytes("FFDA0002"), t),
        movie(t),
        F.concat(_ascii("ID3\4\0\0"), _syncsafe(F.length(t)), t, frame, frame),
        F.concat(t, F.lit("x​").cast("binary")),
    ]
    content = F.lit(None).cast("binary")
    for k, column in enumerate(made):
        content = F.when(F.col("doc_id") % 8 == k, column).otherwise(content)
    return docs.select(F.col("doc_id").alias("asset_id"), content.alias("content"))


def cleaned_files(spark, sf_dir):
    """The clean run over all formats: what each file comes out as, and what is proven gone."""
    made = clean.cleaned(tagged_files(spark, sf_dir), pixels=False)
    gone = F.array_join(F.array_sort("stripped_and_proven_gone"), ",")
    return made.select(F.col("asset_id").alias("doc_id"), "output_format", "exit_code", "no_op", gone.alias("gone"), F.length("output").cast("long").alias("bytes"), F.sha2("output", 256).alias("sha256"))


def chunk_offsets(spark, sf_dir):
    """Every document as an MP4, before and after its tags are left out: where its chunks are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("asset_id"), movie(F.coalesce("text", F.lit("")).cast("binary")).alias("content"))
    made = rewrite.rewritten(docs, ["ilst"]).where("exit_code = 0")
    before, after = rewrite.chunk_offsets(docs), rewrite.chunk_offsets(made)
    both = before.withColumnRenamed("at", "was").join(after, ["asset_id", "chunk"])
    return both.select(F.col("asset_id").alias("doc_id"), "chunk", "was", F.col("at").alias("now"))


def format_audit(spark, sf_dir):
    """Detections of all files, over every subset of format, class and state. near: the sketch's count of assets is within a tenth of the exact one."""
    found = report.detections(tagged_files(spark, sf_dir), pixels=False).where("class IS NOT NULL")
    rolled = audit.rolled_up(found, "format", "class", "state")
    # each asset has one row per class: in groups that leave the class out the exact number needs its own count
    exact = found.cube("format", "class", "state").agg(F.grouping_id().cast("int").alias("l"), F.count_distinct("asset_id").alias("n"))
    exact = exact.select(F.col("format").alias("f"), F.col("class").alias("c"), F.col("state").alias("s"), "l", "n")
    both = rolled.join(exact, F.expr("level = l AND format <=> f AND class <=> c AND state <=> s"))
    return both.select("format", "class", "state", "level", "rows", F.expr("abs(assets - n) <= greatest(1, n / 10)").alias("near"))


# -- pictures ----------------------------------------------------------------------------------------------------------
#: Blocks in a line of a picture, and what a byte of text stands for as a coefficient.
BLOCKS, SCALE = 16, 2


def drawn(texts: pa.Array) -> pa.Array:
    """Each text as a grey JPEG, eight bytes a block: its first line of coefficients."""
    out = []
    for text in texts:
        content = np.frombuffer(text.as_py(), np.uint8)
        lines = max(1, -(-len(content) // (8 * BLOCKS)))
        plane = np.zeros((lines, BLOCKS, 64), np.int16)
        values = np.zeros(lines * BLOCKS * 8, np.int64)
        values[: len(content)] = (content.astype(np.int64) - 96) * SCALE
        plane[..., :8] = values.reshape(lines, BLOCKS, 8)
        out.append(jpeg.of_coefficients(8 * BLOCKS, 8 * lines, [plane], [(1, 1)]))
    return pa.array(out, pa.binary())


def jpeg_pixels(spark, sf_dir):
    """Each text as a grey JPEG: its pixels in total, decoded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    files = docs.select("doc_id", arrow.by_slices(drawn, "binary", files=True)(F.col("t")).alias("content"))
    found = files.select("doc_id", fidelity.totals(T.sniffed(F.col("content")), F.col("content")).alias("f"))
    return found.select("doc_id", "f.width", "f.height", "f.total", "f.squares", "f.problem")


# -- plans and places --------------------------------------------------------------------------------------------------
def document_plans(spark, sf_dir):
    """What is planned for each document's and page's format: how many files each step runs for, and why it doesn't."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("html").alias("text"))
    formats = docs.unionByName(pages).select(T.sniffed(F.coalesce("text", F.lit("")).cast("binary")).alias("format")).groupBy("format").agg(F.count(F.lit(1)).alias("files"))
    plan = policy.planned(spark, keep=["MC08"]).select("format", "place", "id", "runs", "reason", "run_here")
    return formats.join(F.broadcast(plan), "format")  # a few dozen rows


def output_places(spark, sf_dir):
    """Documents as files, by source and name: where each one would be written, and which of those of one place is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    form = F.element_at(F.array(*map(F.lit, ["png", "jpeg", "text"])), (F.col("doc_id") % 3 + 1).cast("int"))
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), (F.col("doc_id") % 40).cast("string"), F.lit("."), F.col("lang"))
    files = docs.select(
        F.concat(F.lit("/in/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit("/"), name).alias("path"), name.alias("relative"), form.alias("format"),
        (F.col("doc_id") % 11 == 0).alias("no_op"), F.when(F.col("doc_id") % 13 == 0, 30).otherwise(0).alias("exit_code"),
    )
    decided = outputs.decided(outputs.destinations(files, "/out"))
    return decided.select("dest", "decision", "exit_code").groupBy("dest", "decision", "exit_code").agg(F.count(F.lit(1)).alias("files"))


QUERIES = {
    "cleaned_files": cleaned_files,
    "chunk_offsets": chunk_offsets,
    "format_audit": format_audit,
    "jpeg_pixels": jpeg_pixels,
    "document_plans": document_plans,
    "output_places": output_places,
}

# -- the SQL twins -----------------------------------------------------------------------------------------------------
_BE = "unhex(printf('%08X', ({})::BIGINT))"
_LE = "unhex(printf('%02X%02X%02X%02X', (({0})::BIGINT) & 255, (({0})::BIGINT >> 8) & 255, (({0})::BIGINT >> 16) & 255, (({0})::BIGINT >> 24) & 255))"
_HEX = lambda s: f"unhex('{s.encode('latin-1').hex()}')"
_PAD = "CASE WHEN n % 2 = 1 THEN unhex('00') ELSE unhex('') END"
_PADDED = "(n + n % 2)"
_FRAME = "unhex('FFFB90C0" + "00" * (17 + 396) + "')"
_CLEAN = [
    ("png", "PNG text chunk", f"unhex('{SIGNATURE}') || {_BE.format(13)} || {_HEX('IHDR')} || unhex('{'00' * 17}') || {_BE.format('n')} || {_HEX('IDAT')} || t || unhex('{NO_CRC}') || {_BE.format(0)} || {_HEX('IEND')} || unhex('{NO_CRC}')"),
    ("riff-wav", "RIFF ancillary chunk", f"{_HEX('RIFF')} || {_LE.format('4 + 24 + 8 + ' + _PADDED)} || {_HEX('WAVEfmt ')} || {_LE.format(16)} || unhex('{'00' * 16}') || {_HEX('data')} || {_LE.format('n')} || t || {_PAD}"),
    ("webp", "EXIF metadata", f"{_HEX('RIFF')} || {_LE.format('4 + 8 + ' + _PADDED)} || {_HEX('WEBPVP8L')} || {_LE.format('n')} || t || {_PAD}"),
    ("flac", "Vorbis comment", f"{_HEX('fLaC')} || unhex('80000022{'00' * 34}') || t"),
    ("jpeg", "", f"unhex('FFD8FFE00007') || {_HEX('JFIF')} || unhex('00FFDA0002') || t"),
    ("isobmff", "MP4 ilst tag", f"{_BE.format(16)} || {_HEX('ftypM4A 0000')} || {_BE.format(84)} || {_HEX('moov')} || {_BE.format(56)} || {_HEX('trak')} || {_BE.format(48)} || {_HEX('mdia')} || {_BE.format(40)} || {_HEX('minf')} || {_BE.format(32)} || {_HEX('stbl')} || {_BE.format(24)} || {_HEX('stco')} || unhex('0000000000000002') || {_BE.format(108)} || {_BE.format('108 + n // 2')} || {_BE.format(20)} || {_HEX('udta')} || {_BE.format(12)} || {_HEX('meta')} || unhex('00000000') || {_BE.format('8 + n')} || {_HEX('mdat')} || t"),
    ("mp3", "ID3 tag,MPEG ancillary data", f"{_FRAME} || {_FRAME}"),
    ("text", "invisible Unicode", f"t || {_HEX('x')}"),
]
_T = "SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents"
# Detections of the files as they go in: format, class, state.
_SEEN = {
    "png": {"png_text": 1, "c2pa": 0, "exif": 0, "xmp": 0}, "riff-wav": {"id3": 0, "riff_ancillary": 1, "c2pa": 0}, "webp": {"exif": 1, "xmp": 0, "c2pa": 0, "riff_ancillary": 0}, "flac": {"vorbis": 1},
    "jpeg": {"exif": 0, "xmp": 0, "c2pa": 0, "iptc": 0}, "isobmff": {"c2pa": 0, "ilst": 1}, "mp3": {"id3": 1, "ape": 0, "mp3_info": 0, "mp3_ancillary": 1}, "text": {"invisibles": 1},
}
_PICTURES, _SOUNDS = ["synthid_image", "tree_ring", "stable_signature", "visible_overlay", "c2pa_soft_binding", "generative_fingerprint"], ["synthid_audio", "audioseal", "c2pa_soft_binding"]
_NOT_TRIED = {**dict.fromkeys(("png", "jpeg", "webp"), _PICTURES), **dict.fromkeys(("riff-wav", "isobmff", "mp3", "flac"), _SOUNDS)}
_FOUND = [(k, f, c, "confirmed_present" if there else "confirmed_absent") for k, (f, *_) in enumerate(_CLEAN) for c, there in _SEEN[f].items()]
_FOUND += [(k, f, c, "not_attempted") for k, (f, *_) in enumerate(_CLEAN) for c in _NOT_TRIED.get(f, ())]
_STEPS = [(f, place, i, i != "MC08", "left as it is: keep MC08" if i == "MC08" else None, i not in policy.NOT_RUN_HERE) for i, _, place, _, formats, _ in policy.TRANSFORMS for f in formats if f in ("text", "html")]
_VALUES = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in rows)

ORACLES = {
    "cleaned_files": f"WITH d AS ({_T}), o AS (" + " UNION ALL ".join(f"SELECT doc_id, '{form}' AS output_format, '{gone}' AS gone, {made} AS made FROM d WHERE doc_id % 8 = {k}" for k, (form, gone, made) in enumerate(_CLEAN))
    + ") SELECT doc_id, output_format, 0 AS exit_code, false AS no_op, gone, octet_length(made)::BIGINT AS bytes, sha256(made) AS sha256 FROM o",
    # a range join of offsets with what was taken out before them
    "chunk_offsets": f"""WITH d AS ({_T}), o AS (SELECT doc_id, n, unnest([0, 1]) AS chunk, unnest([116 + n, 116 + n + n // 2]) AS was FROM d),
g AS (SELECT doc_id, 16 + 8 + 56 + 8 + 12 AS gone_at, 8 + n AS gone FROM d)
SELECT o.doc_id, chunk::BIGINT AS chunk, was, was - coalesce(sum(gone), 0)::BIGINT AS now FROM o LEFT JOIN g ON o.doc_id = g.doc_id AND gone_at < was GROUP BY o.doc_id, chunk, was""",
    "format_audit": f"""WITH f AS (SELECT doc_id, format, class, state FROM documents JOIN (VALUES {_VALUES(_FOUND)}) v(k, format, class, state) ON doc_id % 8 = k)
SELECT format, class, state, grouping(format, class, state)::INT AS level, count(*) AS rows, true AS near FROM f GROUP BY CUBE (format, class, state)""",
    "jpeg_pixels": f"""WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS x FROM documents),
h AS (SELECT doc_id, greatest(1, (len(x) + {8 * BLOCKS - 1}) // {8 * BLOCKS}) AS lines, x FROM d),
c AS (SELECT doc_id, lines, unnest(range(lines * {8 * BLOCKS})) AS i, unnest(list_resize([(('0x' || y)::INT - 96) * {SCALE} for y in x], lines * {8 * BLOCKS}, 0)) AS v FROM h),
w AS (SELECT u, p, (CASE WHEN u = 0 THEN sqrt(0.125) ELSE 0.5 END) * cos((2 * p + 1) * u * pi() / 16) * sqrt(0.125) AS f FROM range(8) a(u), range(8) b(p)),
s AS (SELECT doc_id, lines, i // 8 AS block, p, least(255, greatest(0, floor(sum(v * f) + {128.5 + jpeg.LIFT})))::BIGINT AS grey FROM c JOIN w ON u = i % 8 GROUP BY doc_id, lines, block, p)
SELECT doc_id, {8 * BLOCKS} AS width, (8 * lines)::INT AS height, sum(grey * 24)::BIGINT AS total, sum(grey * grey * 24)::BIGINT AS squares, NULL::VARCHAR AS problem FROM s GROUP BY doc_id, lines""",
    "document_plans": f"""WITH t AS (SELECT coalesce(text, '') AS t FROM documents UNION ALL SELECT coalesce(html, '') FROM pages),
f AS (SELECT CASE WHEN regexp_matches(lower(ltrim(t)), '^(<!doctype html|<html)') THEN 'html' ELSE 'text' END AS format, count(*) AS files FROM t GROUP BY 1)
SELECT format, files, place, id, runs, reason, run_here FROM f JOIN (VALUES {_VALUES(_STEPS)}) p(format, place, id, runs, reason, run_here) USING (format)""",
    "output_places": """WITH f AS (SELECT doc_id, '/out/' || coalesce(source, 'none') || '/' || (doc_id % 40) || '.' ||
  CASE doc_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' ELSE lang END AS dest, doc_id % 11 = 0 AS no_op, CASE WHEN doc_id % 13 = 0 THEN 30 ELSE 0 END AS code FROM documents),
w AS (SELECT *, min(CASE WHEN code = 0 AND NOT no_op THEN doc_id END) OVER (PARTITION BY dest) AS first FROM f),
d AS (SELECT dest, CASE WHEN code <> 0 THEN 'failed' WHEN doc_id > first THEN 'collides' WHEN no_op THEN 'no-op' ELSE 'write' END AS decision, code FROM w)
SELECT dest, decision, CASE WHEN decision = 'collides' THEN 2 ELSE code END AS exit_code, count(*) AS files FROM d GROUP BY ALL""",
}
