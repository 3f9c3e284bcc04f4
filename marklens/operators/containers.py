"""Marks in media files: elements from a walk of each file, then column expressions.

Only the walk is Python, one Arrow batch at a time; it hands on the payload of small metadata elements
and never that of pixels, sound or film, of which it copies nothing. Which element is a mark, its evidence, and the states of classes
that were not found are expressions over the array of a file's elements: a file stays in its row, nothing is shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, binary, mp3
from ..functions import text as T
from ..plans import classes

EXIF = "struct<make: string, model: string, software: string, exposure: boolean, aperture: boolean, iso: boolean, lens: boolean>"
ELEMENT = f"struct<kind: string, start: long, total: long, manifest: boolean, payload: binary, exif: {EXIF}, detail: string, notes: array<string>, broken: boolean>"
WALKED = f"struct<complete: boolean, elements: array<{ELEMENT}>>"
_EXIF = pa.struct([(n, pa.string() if n in ("make", "model", "software") else pa.bool_()) for n in ("make", "model", "software", "exposure", "aperture", "iso", "lens")])
_NAMES = ["kind", "start", "total", "manifest", "payload", "exif", "detail", "notes", "broken"]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), _EXIF, pa.string(), pa.list_(pa.string()), pa.bool_()]
_WALKED = pa.struct([("complete", pa.bool_()), ("elements", pa.list_(pa.struct(list(zip(_NAMES, _TYPES)))))])
#: Elements that may carry a manifest; in RIFF any chunk but the sound.
MANIFEST_KINDS = {"jpeg": {"EB"}, "isobmff": {"uuid"}}
RIFF = ("webp", "riff-wav", "riff-avi")
#: Formats whose content is read as text, not walked.
TEXT = ["text", "html", "svg"]


def is_media(form: Column) -> Column:
    """Whether a file is walked and not read as text; true for null."""
    return ~F.coalesce(form, F.lit("none")).isin(TEXT)


def walked(content: Column, form: Column) -> Column:
    """WALKED of a media file, null for texts. Null content (a file over the source's cap) is read as nothing, not complete."""

    def one(form: str | None, content: bytes | None) -> dict:
        if form == "mp3":
            found, complete = mp3.walk(content)
            out = [(m.kind, m.start, m.total, False, None, None, m.detail, m.notes, m.broken) for m in found]
        elif form in binary.WALKS:
            found, complete = binary.walk(content, form)
            out = []
            for e in found:
                end = e.start + e.total
                is_exif = e.kind in ("eXIf", "EXIF") or e.kind == "E1" and content.startswith(binary.EXIF_START, e.body)
                looked_at = e.kind in MANIFEST_KINDS.get(form, ()) or form in RIFF and e.kind != "data"
                carried = content[e.body : end if e.kind in binary.CARRIED.get(form, ()) else min(end, e.body + binary.HEAD)]
                out.append((e.kind, e.start, e.total, looked_at and binary.carries_manifest(content, e.body, end), carried, binary.exif(content[e.body : end]) if is_exif else None, None, [], False))
        else:  # nothing to walk: complete if its bytes are there
            out, complete = [], content is not None
        return {"complete": complete, "elements": [dict(zip(_NAMES, row)) for row in out]}

    def walk(content: pa.Array, form: pa.Array) -> pa.Array:
        return pa.array([one(f.as_py(), c.as_py()) for c, f in zip(content, form)], _WALKED)

    once = arrow.by_slices(walk, WALKED)
    return F.when(is_media(form), once(F.when(is_media(form), content), F.when(is_media(form), form)))


def read_once(assets: DataFrame) -> DataFrame:
    """asset_id, format, content, walked: a row per asset; format is null where content is."""
    form = F.when(F.col("content").isNotNull(), T.sniffed(F.col("content")))
    rows = assets.select(F.col("asset_id").cast("long").alias("asset_id"), form.alias("format"), "content")
    return rows.withColumn("walked", walked(F.col("content"), F.col("format")))


def elements(assets: DataFrame) -> DataFrame:
    """asset_id, format, complete, and the fields of ELEMENT: a row per element of each media file; a file without any has one
    row of null kind."""
    rows = read_once(assets).where("walked IS NOT NULL").select("asset_id", "format", "walked")
    return rows.select("asset_id", "format", F.col("walked.complete").alias("complete"), F.inline_outer("walked.elements"))


def mark_class(form: Column, e: Column) -> Column:
    """The class of an ELEMENT that is a mark, else null."""
    kind = e["kind"]
    _starts = lambda prefix: F.substring(e["payload"], 1, len(prefix)) == F.lit(prefix)
    keyword = F.split(F.decode(e["payload"], "ISO-8859-1"), "\x00")[0]
    is_riff = form.isin("webp", "riff-wav", "riff-avi")
    return (
        F.when((form == "png") & (kind == "iTXt") & (keyword == "XML:com.adobe.xmp"), "xmp")
        .when((form == "png") & kind.isin("tEXt", "zTXt", "iTXt"), "png_text")
        .when((form == "png") & (kind == "eXIf"), "exif")
        .when((form == "png") & (kind == "caBX"), "c2pa")
        .when((form == "jpeg") & (kind == "E1") & _starts(binary.EXIF_START), "exif")
        .when((form == "jpeg") & (kind == "E1") & _starts(binary.XMP_START), "xmp")
        .when((form == "jpeg") & (kind == "ED") & _starts(binary.IPTC_START), "iptc")
        .when(is_riff & (kind == "EXIF"), "exif")
        .when(is_riff & (kind == "XMP "), "xmp")
        .when(is_riff & (kind == "C2PA"), "c2pa")
        .when(is_riff & (kind == "id3 "), "id3")
        .when(is_riff & (kind == "LIST"), F.when(_starts(b"INFO"), "riff_ancillary"))
        .when((form == "flac") & (kind == "4"), "vorbis")
        .when((form == "isobmff") & (kind == "ilst"), "ilst")
        .when((form == "mp3") & kind.isin("ID3v2", "ID3v1"), "id3")
        .when((form == "mp3") & (kind == "APE"), "ape")
        .when((form == "mp3") & (kind == "info"), "mp3_info")
        .when((form == "mp3") & (kind == "ancillary"), "mp3_ancillary")
        .when(e["manifest"], "c2pa")
    )


def evidence(of_class: Column, e: Column) -> Column:
    """What an element says of its origin: software and make of EXIF, the tool of XMP, a text chunk's keyword."""
    packet = F.make_valid_utf8(e["payload"].cast("string"))  # packets need not be UTF-8
    tool = [F.nullif(F.trim(F.regexp_extract(packet, p, 1)), F.lit("")) for p in ('CreatorTool="([^"]*)"', "<(?:xmp:)?CreatorTool>([^<]*)<")]
    keyword = F.substring(F.regexp_replace(F.split(F.decode(e["payload"], "ISO-8859-1"), "\x00")[0], r"[^\x20-\x7E]", ""), 1, 80)
    said = (
        F.when(of_class == "exif", F.array(F.concat(F.lit("Software: "), e["exif"]["software"]), F.concat(F.lit("Make: "), e["exif"]["make"])))
        .when(of_class == "xmp", F.array(F.coalesce(*tool), F.when(F.lower(packet).contains("c2pa"), "references a C2PA manifest")))
        .when(of_class == "png_text", F.array(F.nullif(keyword, F.lit(""))))
        .otherwise(e["notes"])
    )
    return F.array_compact(said)


def marks_in(form: Column, elements: Column) -> Column:
    """array<struct<class, start, total, kind, detail, broken, evidence>> of an array of ELEMENT: those that are marks."""
    named = F.transform(elements, lambda e: F.struct(mark_class(form, e).alias("class"), e.alias("e")))
    return F.transform(
        F.filter(named, lambda x: x["class"].isNotNull()),
        lambda x: F.struct(x["class"], x["e"]["start"], x["e"]["total"], x["e"]["kind"], x["e"]["detail"], x["e"]["broken"], evidence(x["class"], x["e"]).alias("evidence")),
    )


def marks(assets: DataFrame) -> DataFrame:
    """asset_id, format, class, start, total, kind, detail, broken, evidence: a row per mark found."""
    rows = read_once(assets).where("walked IS NOT NULL").select("asset_id", "format", marks_in(F.col("format"), F.col("walked.elements")).alias("marks"))
    return rows.select("asset_id", "format", F.inline("marks"))


def state_of(form: Column, complete: Column, honesty: Column, mine: Column) -> Column:
    """struct<state, n> of a class, given the marks of it."""
    n = F.size(F.filter(mine, lambda m: ~m["broken"])).cast("long")
    absent = F.when(~complete, "malformed").when(form.isin(classes.SUPPORTED), "confirmed_absent").otherwise("unsupported_format")
    state = (
        F.when(honesty.isNull(), "unsupported_format").when(honesty != "confirmable", "not_attempted")
        .when(F.exists(mine, lambda m: m["broken"]), "malformed").when(n > 0, "confirmed_present").otherwise(absent)
    )
    return F.struct(state.alias("state"), n.alias("n"))


def states(assets: DataFrame) -> DataFrame:
    """asset_id, format, class, honesty, state, n: a row per class that the format's report names.

    Found: confirmed_present, or malformed if it is there but can't be read. Not found: malformed if the walk broke
    off, else confirmed_absent (unsupported_format where the format is not scanned in full). Blind and unaddressed
    classes are not_attempted. A file that was not read, or is of no known format, has one row of null class and
    state unsupported_format. Text assets have none: see :mod:`inspect`.
    """
    rows = read_once(assets).where("walked IS NOT NULL")
    rows = rows.select("asset_id", "format", F.col("walked.complete").alias("complete"), marks_in(F.col("format"), F.col("walked.elements")).alias("marks"))
    rows = rows.select("asset_id", "format", "complete", "marks", F.explode_outer(classes.of_format(F.col("format"))).alias("c"))
    mine = F.filter("marks", lambda m: m["class"] == F.col("c.class"))
    seen = T.bound(mine, lambda m: state_of(F.col("format"), F.col("complete"), F.col("c.honesty"), m))
    rows = rows.select("asset_id", "format", F.col("c.class").alias("class"), F.col("c.honesty").alias("honesty"), seen.alias("seen"))
    return rows.select("asset_id", "format", "class", "honesty", F.col("seen.state").alias("state"), F.col("seen.n").alias("n"))


def camera_hint(makes: list[str], exif: Column | None = None) -> Column:
    """Whether EXIF facts speak of a capture: a known make, exposure, aperture and ISO, and a lens."""
    exif = F.col("exif") if exif is None else exif
    known = F.exists(F.array(*(F.lit(m.lower()) for m in makes)).cast("array<string>"), lambda m: F.lower(exif["make"]).contains(m))
    return F.coalesce(known & exif["exposure"] & exif["aperture"] & exif["iso"] & exif["lens"], F.lit(False))
