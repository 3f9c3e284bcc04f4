"""What a file says of how it was made: claims of its manifests, and hints of EXIF. Nothing is verified: a claim is
reported as a claim.

Reading a manifest is Python, a file at a time; what it means is column expressions over its actions and signers.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, manifest
from ..functions import text as T
from . import containers

# How a capture and generated media are called in an action's source type.
CAPTURE = "digitalcapture"
GENERATIVE = ["trainedalgorithmicmedia", "compositewithtrainedalgorithmicmedia", "algorithmicmedia"]
SIGNATURE_STATUS = "not verified"
_ACTION = pa.struct([("action", pa.string()), ("source", pa.string()), ("agent", pa.string())])
_MANIFEST = pa.struct([("label", pa.string()), ("actions", pa.list_(_ACTION)), ("signers", pa.list_(pa.string()))])
MANIFESTS = "array<struct<label: string, actions: array<struct<action: string, source: string, agent: string>>, signers: array<string>>>"


def stores(content: Column, form: Column) -> Column:
    """MANIFESTS of a file; null where it has no well-formed store."""

    def read(content: bytes | None, form: str | None):
        if content is None:
            return None
        if form in containers.TEXT:
            runs = re.findall("[︀-️\U000e0100-\U000e01ef]{8,}", content.decode())
            found = (manifest.manifests(d[d.find(b"jumb") - 4 :]) for d in map(manifest.decoded_run, runs) if d.find(b"jumb") >= 4)
            found = next((m for m in found if m), None)
        else:
            found = manifest.store_of(content, form)
        return found and [{"label": label, "actions": [dict(zip(("action", "source", "agent"), a)) for a in actions], "signers": signers} for label, actions, signers in found]

    def each(content: pa.Array, form: pa.Array) -> pa.Array:
        return pa.array([read(c.as_py(), f.as_py()) for c, f in zip(content, form)], pa.list_(_MANIFEST))

    # a store holds the word, as it is or as selectors (j is U+E015A): other files don't go to Python
    word = F.contains(content, F.unhex(F.lit("6A756D62")))
    maybe = word | form.isin(containers.TEXT) & content.cast("string").contains("\U000e015a\U000e0165")
    return arrow.by_slices(each, MANIFESTS)(F.when(maybe, content), form)  # said to be so that no plan runs it twice


def manifests(assets: DataFrame) -> DataFrame:
    """asset_id, format, manifests (null: no well-formed store): a row per asset with content."""
    rows = assets.where("content IS NOT NULL").select(F.col("asset_id").cast("long").alias("asset_id"), T.sniffed(F.col("content")).alias("format"), "content")
    return rows.select("asset_id", "format", stores(F.col("content"), F.col("format")).alias("manifests"))


def last_segment(uri: Column, segment: str) -> Column:
    return F.coalesce(F.lower(uri).rlike(f"(^|/){segment}$"), F.lit(False))


def with_reading(rows: DataFrame, content: str, form: str, walked: str, makes: list[str], generators: list[str]) -> DataFrame:
    """rows with status, claim, hint and line. content, form, walked: its columns, see :func:`containers.walked`.

    certified: a manifest claims a capture, or a camera vendor signed it, and no generative action follows in it or
    in a later one. generative: one does. uncertain: EXIF looks like a camera's. none: else. The first manifest with a claim counts.
    """
    known = lambda name: F.filter(F.array(*map(F.lit, makes)).cast("array<string>"), lambda m: F.lower(name).contains(F.lower(m)))

    def generative(a: Column) -> Column:
        """Why an action is generative, else null."""
        kind = F.coalesce(*(F.when(last_segment(a["source"], g), g) for g in GENERATIVE))
        by = F.try_element_at(F.filter(F.array(*map(F.lit, generators)).cast("array<string>"), lambda g: F.contains(F.lower(a["agent"]), g)), F.lit(1))
        return F.coalesce(F.concat(F.lit("then "), a["action"], F.lit(" of source "), kind), F.concat(F.lit("then "), a["action"], F.lit(" by "), by))

    taken = lambda a: (a["action"] == "c2pa.created") & last_segment(a["source"], CAPTURE)
    first = lambda found: F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))
    told = lambda m: F.struct(
        m["label"].alias("label"),
        F.array_position(F.transform(m["actions"], taken), F.lit(True)).cast("int").alias("taken"),
        first(F.transform(m["signers"], lambda s: F.try_element_at(known(s), F.lit(1)))).alias("vendor"),
        F.transform(m["actions"], generative).alias("made"),
    )
    rows = rows.withColumn("stores_", stores(F.col(content), F.col(form)))
    rows = rows.withColumn("m_", F.transform("stores_", told))
    rows = rows.withColumn("at_", F.array_position(F.transform("m_", lambda m: (m["taken"] > 0) | m["vendor"].isNotNull()), F.lit(True)).cast("int"))
    rows = rows.withColumn("c_", F.when(F.col("at_") > 0, F.try_element_at("m_", F.col("at_"))))
    claim = F.when(F.col("c_.taken") > 0, F.concat(F.lit("manifest "), "c_.label", F.lit(" c2pa.created with digitalSourceType digitalCapture"))).otherwise(
        F.concat(F.lit("manifest "), "c_.label", F.lit(" signed by the camera vendor "), "c_.vendor")
    )
    inside = first(F.slice("c_.made", F.col("c_.taken") + 1, F.greatest(F.size("c_.made") - F.col("c_.taken"), F.lit(0))))
    after = F.slice("m_", F.col("at_") + 1, F.greatest(F.size("m_") - F.col("at_"), F.lit(0)))
    outside = first(F.transform(after, lambda m: F.concat(first(m["made"]), F.lit(" in manifest "), m["label"])))
    seen = F.try_element_at(F.filter(F.transform(f"{walked}.elements", lambda e: e["exif"]), lambda x: x.isNotNull()), F.lit(1))
    rows = rows.withColumns({"claimed_": F.when(F.col("c_").isNotNull(), claim), "later_": F.when(F.col("c_").isNotNull(), F.coalesce(inside, outside)), "exif_": seen})
    camera = F.when(containers.camera_hint(makes, F.col("exif_")), F.concat(F.lit("EXIF of a camera, make "), "exif_.make"))
    rows = rows.withColumn("camera_", camera)
    status = F.when(F.col("later_").isNotNull(), "generative").when(F.col("claimed_").isNotNull(), "certified").when(F.col("camera_").isNotNull(), "uncertain").otherwise("none")
    rows = rows.withColumns({"status": status, "claim": F.nullif(F.concat_ws("; ", "claimed_", "later_"), F.lit("")), "hint": F.when(F.col("claimed_").isNull(), F.col("camera_"))})
    line = (
        F.when(F.col("status") == "certified", F.concat(F.lit("Capture claimed: "), "claim", F.lit(f". Signature: {SIGNATURE_STATUS}.")))
        .when(F.col("status") == "generative", F.concat(F.lit("Capture claimed, then generated: "), "claim", F.lit(f". Signature: {SIGNATURE_STATUS}.")))
        .when(F.col("status") == "uncertain", F.concat(F.lit("Perhaps a capture: "), "hint", F.lit(".")))
        .otherwise("")
    )
    return rows.withColumn("line", line).drop("stores_", "m_", "at_", "c_", "claimed_", "later_", "exif_", "camera_")


def readings(assets: DataFrame, makes: list[str], generators: list[str]) -> DataFrame:
    """asset_id, status, claim, hint, line: a row per asset with content. See :func:`with_reading`."""
    rows = containers.read_once(assets.where("content IS NOT NULL"))
    return with_reading(rows, "content", "format", "walked", makes, generators).select("asset_id", "status", "claim", "hint", "line")
