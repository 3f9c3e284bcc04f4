"""Mark classes and the states a scan may report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats that are scanned in full; classes by format and how far they can be told.
SUPPORTED = ["png", "jpeg", "webp", "riff-wav", "isobmff", "mp3", "flac", "svg", "html", "text"]
CONFIRMABLE = {
    "png": ["png_text", "c2pa", "exif", "xmp"],
    "jpeg": ["exif", "xmp", "c2pa", "iptc"],
    "webp": ["exif", "xmp", "c2pa", "riff_ancillary"],
    "riff-wav": ["id3", "riff_ancillary", "c2pa"],
    "riff-avi": ["id3", "riff_ancillary", "c2pa"],
    "isobmff": ["c2pa", "ilst"],
    "mp3": ["id3", "ape", "mp3_info", "mp3_ancillary"],
    "flac": ["vorbis"],
    "svg": ["invisibles"],
    "html": ["invisibles"],
    "text": ["invisibles"],
}
BLIND = {
    **dict.fromkeys(("png", "jpeg", "webp"), ["synthid_image", "tree_ring", "stable_signature"]),
    **dict.fromkeys(("riff-wav", "isobmff", "mp3", "flac", "ogg"), ["synthid_audio", "audioseal"]),
}
UNADDRESSED = {
    **dict.fromkeys(("png", "jpeg", "webp"), ["visible_overlay", "c2pa_soft_binding", "generative_fingerprint"]),
    **dict.fromkeys(("riff-wav", "isobmff", "mp3", "flac", "ogg"), ["c2pa_soft_binding"]),
}
#: Exit codes from mildest to worst.
EXIT_RANK = [0, 10, 50, 30, 40, 2]


def class_table(spark: SparkSession) -> DataFrame:
    """format, class, honesty, place: every class that a format's report has a row for."""
    rows = []
    for honesty, table in (("confirmable", CONFIRMABLE), ("blind", BLIND), ("unaddressed", UNADDRESSED)):
        rows += [(f, c, honesty, i) for f, classes in table.items() for i, c in enumerate(classes)]
    return spark.createDataFrame(rows, "format string, class string, honesty string, place int")


def of_format(form: Column) -> Column:
    """array<struct<class, honesty, place>>: what a format's report has a row for; null for other formats. A few dozen literals."""
    rows: dict[str, list] = {}
    for honesty, table in (("confirmable", CONFIRMABLE), ("blind", BLIND), ("unaddressed", UNADDRESSED)):
        for f, names in table.items():
            rows.setdefault(f, []).extend(F.struct(F.lit(c).alias("class"), F.lit(honesty).alias("honesty"), F.lit(i).alias("place")) for i, c in enumerate(names))
    return F.try_element_at(F.create_map(*(x for f, listed in rows.items() for x in (F.lit(f), F.array(*listed)))), form)
