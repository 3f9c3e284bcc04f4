"""Files without their plain tags: PNG chunks, RIFF chunks, FLAC blocks, JPEG segments, MP4 tag lists and MP3 tags are left out,
all others copied as they are (but for sizes and offsets that follow from it, and MP3's own bytes that no decoder reads).

What carries a provenance manifest is never left out here, and no pixel or sample changes. One file at a time, in an
Arrow batch; a file whose walk does not reach its end is refused, as a rewrite would cut it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, binary, mp3, mp4
from ..functions import text as T
from .fidelity import gathered

# Elements by the class they are dropped for; elements that "unlisted" leaves alone; flags of a WebP header
# that announce a chunk; exit codes.
DROPPED = {
    "png": {"tEXt": "png_text", "zTXt": "png_text", "eXIf": "exif"},
    "riff": {"id3 ": "id3", "XMP ": "xmp", "EXIF": "exif", **dict.fromkeys(("bext", "iXML", "aXML", "_PMX", "cue ", "smpl", "inst"), "riff_production")},
    "flac": {"4": "vorbis"},
    "jpeg": {},
}
LEFT_ALONE = {
    "png": {"IHDR", "IDAT", "IEND", "PLTE", "iCCP", "gAMA", "cHRM", "sRGB", "sBIT", "pHYs", "bKGD", "tRNS", "acTL", "fcTL", "fdAT", "cICP", "mDCv", "cLLi", "caBX"},
    "riff": {"fmt ", "data", "fact", "VP8 ", "VP8L", "VP8X", "ALPH", "ANIM", "ANMF", "ICCP", "movi", "hdrl", "idx1", "strh", "strf", "C2PA"},
    "flac": {"0", "1", "3", "5", "127"},
    "jpeg": {"E0", "EE", *(f"{m:02X}" for m in range(0xC0, 0xE0))},
}
ICC_START = b"ICC_PROFILE\0"
ANNOUNCED = {"ICCP": 0x20, "EXIF": 0x08, "XMP ": 0x04}
FAMILY = {"png": "png", "webp": "riff", "riff-wav": "riff", "flac": "flac", "jpeg": "jpeg", "isobmff": "mp4", "mp3": "mp3"}
EXIT_MALFORMED, EXIT_UNSUPPORTED = 30, 40
#: What can be asked for.
CLASSES = ["ape", "exif", "id3", "ilst", "iptc", "mp3_ancillary", "mp3_info", "png_text", "riff_ancillary", "riff_production", "unlisted", "vorbis", "xmp"]
#: Classes by transform; those of a transform that is not here are not dropped by this module.
BY_TRANSFORM = {
    "MC02": ["xmp", "iptc"], "MC03": ["exif"], "MC04": ["png_text"], "MC05": ["id3", "ilst"], "MC13": ["ape"], "MC14": ["mp3_info"], "MC15": ["mp3_ancillary"],
    "MC09": ["riff_ancillary", "id3"], "MC12": ["riff_production"], "MC10": ["vorbis"], "MC06": ["unlisted"], "MC11": ["unlisted"],
}
REWRITTEN = "struct<content: binary, removed: array<string>, exit_code: int>"
_REWRITTEN = pa.struct([("content", pa.binary()), ("removed", pa.list_(pa.string())), ("exit_code", pa.int32())])


def class_of(content: bytes, e: binary.Element, family: str) -> str | None:
    """The class an element goes with, or None if it always stays."""
    if family == "png" and e.kind == "iTXt":
        return "xmp" if content.startswith(b"XML:com.adobe.xmp", e.body) else "png_text"
    if family == "jpeg":
        return jpeg_class(content, e)
    if family == "riff" and e.kind == "LIST":
        kind = content[e.body : e.body + 4]
        return "riff_ancillary" if kind == b"INFO" else None if kind in (b"movi", b"hdrl") else "unlisted"
    return DROPPED[family].get(e.kind, None if e.kind in LEFT_ALONE[family] else "unlisted")


def jpeg_class(content: bytes, e: binary.Element) -> str | None:
    """Application segments and comments; those that decoding needs, and manifests, have none."""
    starts = lambda *prefixes: content.startswith(prefixes, e.body)
    if e.kind == "E1":
        return "exif" if starts(binary.EXIF_START) else "xmp" if starts(binary.XMP_START) else "unlisted"
    if e.kind == "ED" and starts(binary.IPTC_START):
        return "iptc"
    return "unlisted" if e.kind == "FE" or e.kind >= "E2" and e.kind < "F0" and e.kind != "EE" and not (e.kind == "E2" and starts(ICC_START)) else None


def without(content: bytes, form: str, drop: set[str]) -> tuple[bytes, list[str]]:
    """The file without the elements of these classes, and the kinds that went. Raises ValueError for a broken file."""
    family = FAMILY[form]
    if family == "mp3":
        return mp3.without(content, drop)
    if family == "mp4":
        return mp4.without_tags(content) if "ilst" in drop else (content, [])
    elements, complete = binary.walk(content, form)
    if not complete or not elements and family != "jpeg":
        raise ValueError("the walk does not reach the file's end")
    kept, removed = [], []
    for e in elements:
        goes = class_of(content, e, family) in drop
        if goes and family != "flac" and e.kind not in DROPPED[family] and binary.carries_manifest(content, e.body, e.start + e.total):
            goes = False
        (removed if goes else kept).append(e)
    if not removed:
        return content, []
    if family == "jpeg":
        edges = [0, *(x for e in removed for x in (e.start, e.start + e.total)), len(content)]
        return b"".join(content[a:z] for a, z in zip(edges[::2], edges[1::2])), [e.kind for e in removed]
    parts = [bytearray(content[e.start : e.start + e.total]) for e in kept]
    if family == "png":
        made = content[:8] + b"".join(parts)
    elif family == "flac":
        for i, p in enumerate(parts):
            p[0] = p[0] & 0x7F | (0x80 if i == len(parts) - 1 else 0)
        made = content[:4] + b"".join(parts) + content[elements[-1].start + elements[-1].total :]
    else:
        there = {e.kind for e in kept}
        for e, p in zip(kept, parts):
            if form == "webp" and e.kind == "VP8X" and len(p) > 8:
                p[8] &= ~sum(flag for kind, flag in ANNOUNCED.items() if kind not in there) & 0xFF
        body = content[8:12] + b"".join(parts)
        made = content[:4] + len(body).to_bytes(4, "little") + body
    return made, [e.kind for e in removed]


def rewrite(content: Column, form: Column, drop: Column) -> Column:
    """REWRITTEN of a file. drop: an array of classes (null: none); those that this module does not drop do nothing.

    A file without such elements comes out as it was (removed is empty). Exit 30 and null content: the walk breaks off;
    40: another format, or null content.
    """

    def one(content: bytes | None, form: str | None, wanted: list[str] | None) -> dict:
        made, removed, code = None, [], EXIT_UNSUPPORTED
        if content is not None and form in FAMILY:
            try:
                (made, removed), code = without(content, form, set(wanted or ()) & set(CLASSES)), 0
            except ValueError:
                code = EXIT_MALFORMED
        return {"content": made, "removed": removed, "exit_code": code}

    def each(content: pa.Array, form: pa.Array, drop: pa.Array) -> pa.Array:
        return pa.array([one(*(x.as_py() for x in row)) for row in zip(content, form, drop)], _REWRITTEN)

    return arrow.by_slices(each, REWRITTEN, files=True)(content, form, drop)


def rewritten(assets: DataFrame, drop: list[str] | Column) -> DataFrame:
    """assets (asset_id, content) -> asset_id, format, and the fields of REWRITTEN, a row per file. drop: classes, or a column of an
    array of them per file; a class that this module does not drop is an error in a list. See :func:`rewrite`."""
    if isinstance(drop, list):
        if unknown := set(drop) - set(CLASSES):
            raise ValueError(f"not dropped here: {sorted(unknown)}")
        drop = F.array(*map(F.lit, drop)).cast("array<string>")
    form = F.when(F.col("content").isNotNull(), T.sniffed(F.col("content")))
    rows = assets.select(F.col("asset_id").cast("long").alias("asset_id"), form.alias("format"), "content", drop.alias("drop"))
    rows = rows.select("asset_id", "format", rewrite(F.col("content"), F.col("format"), F.col("drop")).alias("r"))
    return rows.select("asset_id", "format", "r.*")


def dropped_by(transforms: list[str]) -> list[str]:
    """The classes that these transforms drop here."""
    return sorted({c for t in transforms for c in BY_TRANSFORM.get(t, ())})


def chunk_offsets(assets: DataFrame) -> DataFrame:
    """assets (asset_id, content) -> asset_id, chunk, at: where each chunk of an MP4's media starts, by its tables. Other
    files, null contents and files without tables have no row."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for asset, content in zip(*batch.columns):
            yield from ((asset.as_py(), i, at) for i, at in enumerate(mp4.chunk_offsets(content.as_py())))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield from gathered(rows(b), [pa.int64()] * 3, ["asset_id", "chunk", "at"])

    read = assets.where("content IS NOT NULL").where(T.sniffed(F.col("content")) == "isobmff")
    return read.select(F.col("asset_id").cast("long").alias("asset_id"), "content").mapInArrow(batches, "asset_id long, chunk long, at long")
