"""Reports: every asset's detections, findings, plan and survivors as one row, as JSON or as text; verification of an
output against the report of the run that made it.

An asset stays in its row: its detections are an array, made from one walk, one look at its pixels or one pass over its
text; reports and verifications are expressions over these arrays, and only :func:`detections` makes a long table of them.
Dimensions (classes, labels, the plan per format) are a few dozen literals or rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import classes
from ..plans import policy as P
from . import containers, inspect, pixelmark
from .inspect import LOCATION

DETECTION = f"struct<class: string, label: string, note: string, honesty: string, state: string, place: int, locations: array<{LOCATION}>, evidence: array<string>, citation: string>"
#: How a mark's element is called in a location, where it is not the element's own kind.
PLACES = {"jpeg": "JPEG segment", "png": "PNG chunk", "flac": "FLAC block", "isobmff": "MP4 box", "webp": "RIFF chunk", "riff-wav": "RIFF chunk", "riff-avi": "RIFF chunk"}
PIXEL_CLASS, IMAGES = "dwtdct", ["png", "jpeg", "webp"]
EXIT_BAD, EXIT_UNREAD, EXIT_MISMATCH = 30, 40, 10


def _named(policy: P.Policy):
    """label, note and citation of a class."""
    rows = [x for c, label in policy.labels.items() for x in (F.lit(c), F.struct(F.lit(label).alias("label"), F.lit(policy.notes.get(c)).cast("string").alias("note"), F.lit(policy.citations.get(c)).cast("string").alias("citation")))]
    known = F.create_map(*rows) if rows else F.create_map().cast("map<string, struct<label: string, note: string, citation: string>>")
    return lambda c: F.try_element_at(known, c)


def _detection(named, of_class, honesty, state, place, locations, evidence) -> Column:
    about = named(of_class)
    return F.struct(
        of_class.alias("class"), about["label"].alias("label"), about["note"].alias("note"), honesty.alias("honesty"), state.alias("state"), place.cast("int").alias("place"),
        locations.cast(f"array<{LOCATION}>").alias("locations"), evidence.cast("array<string>").alias("evidence"), about["citation"].alias("citation"),
    )


def media_found(named, form: Column, walked: Column, marks: Column) -> Column:
    """array<DETECTION> of a walked file: a row per class of its format; an asset that was not read, or is of no known format,
    has one of null class."""
    of_element = F.create_map(*(F.lit(x) for pair in PLACES.items() for x in pair))

    def where(m: Column) -> Column:
        place = F.coalesce(F.try_element_at(of_element, form), F.when(m["kind"].isin("info", "ancillary"), "MPEG frame").otherwise(m["kind"]))
        return F.struct(place.alias("container"), m["start"].alias("offset"), m["total"].alias("length"), F.coalesce(m["detail"], m["kind"]).alias("detail"))

    def row(c: Column) -> Column:
        def made(mine: Column) -> Column:
            state = containers.state_of(form, walked["complete"], c["honesty"], mine)["state"]
            return _detection(named, c["class"], c["honesty"], state, c["place"], F.transform(mine, where), F.flatten(F.transform(mine, lambda m: m["evidence"])))

        in_order = F.array_sort(F.filter(marks, lambda m: m["class"] == c["class"]), lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(0))
        return T.bound(in_order, made)

    nothing = F.array(F.struct(F.lit(None).cast("string").alias("class"), F.lit(None).cast("string").alias("honesty"), F.lit(None).cast("int").alias("place")))
    return F.transform(F.coalesce(classes.of_format(form), nothing), row).cast(f"array<{DETECTION}>")


def text_found(named, form: Column, spans: Column) -> Column:
    """array<DETECTION> of a text: always a row of invisible characters; of wrappers, only where there are."""
    none = F.array()
    absent = F.array(_detection(named, F.lit("invisibles"), F.lit("confirmable"), F.lit("confirmed_absent"), F.lit(0), none, none))
    place = lambda c: F.when(c == "invisibles", 0)

    def rows(found: Column) -> Column:
        made = F.transform(found, lambda f: _detection(named, f["class"], F.lit("confirmable"), f["state"], place(f["class"]), f["locations"], f["evidence"])).cast(f"array<{DETECTION}>")
        return F.concat(F.when(F.exists(found, lambda f: f["class"] == "invisibles"), F.array().cast(f"array<{DETECTION}>")).otherwise(absent.cast(f"array<{DETECTION}>")), made)

    return T.bound(inspect.text_classes(spans), rows)


def with_found(rows: DataFrame, content: str, form: str, found: str, policy: P.Policy | None = None, pixels: bool = True, walk: bool = False) -> DataFrame:
    """rows with two more columns for the content: its format (null where it is null) and its detections, array<DETECTION>.
    pixels: pictures get a row for the pixel mark as well, for which they are decoded. walk: the file's walk stays as walked_."""
    named, c, f = _named(policy or P.Policy()), F.col(content), F.col(form)
    rows = rows.withColumn(form, F.when(c.isNotNull(), T.sniffed(c)))
    rows = rows.withColumns({"walked_": containers.walked(c, f), "spans_": T.spans(F.when(~containers.is_media(f), c.cast("string")))})
    rows = rows.withColumn("marks_", containers.marks_in(f, F.col("walked_.elements")))
    made = F.when(F.col("walked_").isNotNull(), media_found(named, f, F.col("walked_"), F.col("marks_"))).otherwise(text_found(named, f, F.col("spans_")))
    if pixels:
        rows = rows.withColumn("votes_", pixelmark.votes(c, f))
        pixel = T.bound(
            pixelmark.decision(f, F.col("votes_")),
            lambda d: F.array(_detection(named, F.lit(PIXEL_CLASS), F.lit("confirmable"), d["state"], F.lit(90), F.array(), d["evidence"])).cast(f"array<{DETECTION}>"),
        )
        made = F.concat(made, F.when(f.isin(IMAGES), pixel).otherwise(F.array().cast(f"array<{DETECTION}>")))
    return rows.withColumn(found, made).drop(*([] if walk else ["walked_"]), "spans_", "marks_", *(["votes_"] if pixels else []))


def inspected(assets: DataFrame, policy: P.Policy | None = None, pixels: bool = True) -> DataFrame:
    """asset_id, format, found (array<DETECTION>): a row per asset (asset_id, content), repeated ones too."""
    rows = assets.select(F.col("asset_id").cast("long").alias("asset_id"), "content")
    return with_found(rows, "content", "format", "found", policy, pixels).select("asset_id", "format", "found")


def detections(assets: DataFrame, policy: P.Policy | None = None, pixels: bool = True) -> DataFrame:
    """asset_id, format and the fields of DETECTION: a row per asset and class of its report; an asset that was not read, or is of
    no known format, has one of null class."""
    return inspected(assets, policy, pixels).select("asset_id", "format", F.inline("found"))


def findings(found: DataFrame) -> DataFrame:
    """The detections that a report states as findings: confirmable ones that are present or can't be read."""
    return found.where("honesty = 'confirmable' AND state IN ('confirmed_present', 'malformed')")


def in_rows(found: DataFrame) -> DataFrame:
    """Detections of a long table put together again: asset_id, format, found. Assets told apart by id alone."""
    fields = [f.split(":")[0].strip() for f in ("class", "label", "note", "honesty", "state", "place", "locations", "evidence", "citation")]
    return found.groupBy("asset_id", "format").agg(F.collect_list(F.struct(*fields)).alias("found"))


def is_finding(d: Column) -> Column:
    return F.coalesce((d["honesty"] == "confirmable") & d["state"].isin("confirmed_present", "malformed"), F.lit(False))


def ranked(found: Column) -> Column:
    """Detections in a report's order: by the class table, found ones without a place in it first."""

    def rank(d: Column) -> Column:
        of = F.when(d["honesty"] == "confirmable", 0).when(d["honesty"] == "blind", 100).otherwise(200)
        return F.when(d["state"].isin("confirmed_present", "malformed") & d["place"].isNull(), -1).otherwise(F.coalesce(d["place"], F.lit(0)) + of)

    in_order = F.array_sort(F.transform(found, lambda d: F.struct(rank(d).alias("rank"), d["class"].alias("class"), d.alias("d"))), lambda x, y: F.when(x["rank"] < y["rank"], -1).when(x["rank"] > y["rank"], 1).when(x["class"] < y["class"], -1).when(x["class"] > y["class"], 1).otherwise(0))
    return F.transform(in_order, lambda x: x["d"])


def scan_states(found: Column) -> Column:
    return F.transform(F.filter(found, lambda d: d["class"].isNotNull()), lambda d: F.struct(d["class"], d["label"], d["honesty"], d["state"]))


def listed_findings(found: Column) -> Column:
    return F.transform(F.filter(found, is_finding), lambda d: F.struct(d["class"], d["label"], d["honesty"], d["state"].alias("scan_state"), d["note"], d["locations"], d["evidence"]))


def survivors(found: Column, degrades: Column) -> Column:
    """Blind classes, and which degrading transforms are in the run."""
    named = F.when(F.size(degrades) > 0, F.array_join(degrades, ", ")).otherwise("none")
    return F.transform(F.filter(found, lambda d: d["honesty"] == "blind"), lambda d: F.struct(d["class"], named.alias("transform"), d["citation"]))


STEPS = "array<struct<place: int, id: string, name: string, kind: string, targets: array<string>, runs: boolean, reason: string, run_here: boolean>>"


def with_plan(rows: DataFrame, form: str, policy: P.Policy, keep: list[str], no_degrade: bool) -> DataFrame:
    """rows with steps (STEPS): the plan of each one's format, in its order."""
    step = F.struct("place", "id", "name", "kind", "targets", "runs", "reason", "run_here")
    plan = P.planned(rows.sparkSession, policy, keep, no_degrade).groupBy(F.col("format").alias("f_")).agg(F.array_sort(F.collect_list(step)).alias("steps_"))
    rows = rows.join(F.broadcast(plan), F.expr(f"{form} <=> f_"), "left_outer")  # a row per format
    return rows.withColumn("steps", F.coalesce(F.col("steps_").cast(STEPS), F.array().cast(STEPS))).drop("f_", "steps_")


def reports(found: DataFrame, policy: P.Policy | None = None, keep: list[str] = (), no_degrade: bool = False, verb: str = "inspect") -> DataFrame:
    """A row per asset of detections (long) or of inspected assets (in rows), see the module; arrays are in the order of the class
    table, found ones first."""
    policy = policy or P.Policy()
    per = (found if "found" in found.columns else in_rows(found)).withColumn("found", ranked(F.col("found")))
    per = with_plan(per, "format", policy, keep, no_degrade)
    some = lambda when: F.exists("found", when)
    unread, bad = some(lambda d: d["class"].isNull()), some(lambda d: is_finding(d) & (d["state"] == "malformed"))
    degrades = F.transform(F.filter("steps", lambda s: s["runs"] & s["kind"].isin(*P.DEGRADES)), lambda s: s["id"])
    return per.select(
        "asset_id", F.lit(policy.version).alias("policy_version"), F.lit(policy.digest).alias("policy_digest"), F.lit(verb).alias("verb"), "format", F.col("format").alias("output_format"),
        scan_states(F.col("found")).alias("scan_states"), listed_findings(F.col("found")).alias("findings"),
        F.transform(F.filter("steps", lambda s: s["runs"]), lambda s: F.struct(s["id"].alias("transform"), s["name"], F.lit("proposed").alias("outcome"))).alias("actions"),
        F.array().cast("array<string>").alias("stripped_and_proven_gone"),
        F.transform(F.filter("steps", lambda s: ~s["runs"]), lambda s: F.struct(F.concat_ws(" ", s["id"], s["name"]).alias("item"), s["reason"])).alias("kept"),
        survivors(F.col("found"), degrades).alias("survived"),
        F.when(unread, "not read: too large, or of no known format").alias("error"),
        F.when(unread, EXIT_UNREAD).when(bad, EXIT_BAD).otherwise(0).alias("exit_code"),
    )


def as_json(made: DataFrame) -> DataFrame:
    """asset_id, value: a report as one JSON object, nulls included."""
    return made.select("asset_id", F.to_json(F.struct(*made.columns), {"ignoreNullFields": "false"}).alias("value"))


def as_text(made: DataFrame) -> DataFrame:
    """asset_id, value: a report to read."""

    def section(title: str, lines: Column, even_if_empty: bool) -> Column:
        body = F.array_join(F.transform(F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("none"))), lambda x: F.concat(F.lit("  "), x, F.lit("\n"))), "")
        return F.when(F.lit(even_if_empty) | (F.size(lines) > 0), F.concat(F.lit(f"{title}:\n"), body)).otherwise("")

    def described(f: Column) -> Column:
        """A finding, where it is, and what it says of itself."""
        at = F.transform(f["locations"], lambda x: joined("  at ", x["offset"].cast("string"), ", ", x["length"].cast("string"), " bytes: ", x["container"], " ", x["detail"]))
        note = F.array_compact(F.array(joined("  ", f["note"])))
        return F.concat(F.array(joined(F.coalesce(f["label"], f["class"]), ": ", f["scan_state"])), note, at, F.transform(f["evidence"], lambda e: joined("  ", e)))

    known = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    joined = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    value = F.concat(
        joined("policy ", F.col("policy_version"), "\nverb: ", F.col("verb"), " | format: ", known("format"), " | output: ", known("output_format"), "\n"),
        F.coalesce(joined("digest: ", F.col("policy_digest"), "\n"), F.lit("")), F.coalesce(joined("error: ", F.col("error"), "\n"), F.lit("")), F.lit("\n"),
        section("scan states", F.transform("scan_states", lambda s: joined(s["label"], ": ", s["state"])), True), F.lit("\n"),
        section("findings", F.flatten(F.transform("findings", described)), False),
        section("actions", F.transform("actions", lambda a: joined(a["transform"], " ", a["name"], ": ", a["outcome"])), False),
        section("stripped and proven gone", F.col("stripped_and_proven_gone"), True),
        section("kept", F.transform("kept", lambda k: joined(k["item"], ": ", k["reason"])), True),
        section("survived", F.transform("survived", lambda s: joined(s["class"], " | ", s["transform"], F.coalesce(joined(" | ", s["citation"]), F.lit("")))), True),
        joined("\nexit: ", F.col("exit_code").cast("string"), "\n"),
    )
    return made.select("asset_id", value.alias("value"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """asset_id, class, label, was, now, gone: each class found before, and what it is in the output's detections."""
    was = before.where("state = 'confirmed_present'").select("asset_id", "class", "label", F.col("state").alias("was"))
    now = after.where("class IS NOT NULL").select(F.col("asset_id").alias("of"), F.col("class").alias("c"), F.col("state").alias("now"))
    both = was.join(now, F.expr("asset_id = of AND class = c"), "left_outer")
    return both.select("asset_id", "class", "label", "was", "now", F.expr("NOT coalesce(now, 'confirmed_absent') = 'confirmed_present'").alias("gone"))


def verified_against(made: DataFrame, outputs: DataFrame, policy: P.Policy | None = None) -> DataFrame:
    """made: asset_id, value (a report's JSON); outputs: detections of the outputs, long or in rows. See :func:`verified`."""
    seen = outputs if "found" in outputs.columns else in_rows(outputs)
    return verified(seen.join(made.select("asset_id", "value"), "asset_id", "left_outer"), policy)


def verified(rows: DataFrame, policy: P.Policy | None = None) -> DataFrame:
    """rows: asset_id, format, found (of the output), value (the report's JSON). Returns asset_id, verified, problems, exit_code.

    Not read 40, else malformed 30, else 10 for a report that is missing or does not parse, that names no policy, or another policy or
    format than this one, or a label that it says is gone and is there again; else 0.
    """
    policy = policy or P.Policy()
    labels = lambda state: F.array_sort(F.array_distinct(F.transform(F.filter("found", lambda d: d["state"] == state), lambda d: F.coalesce(d["label"], d["class"]))))
    said = rows.select("asset_id", "format", labels("malformed").alias("bad"), labels("confirmed_present").alias("present"), "value", F.coalesce(F.expr("try_parse_json(value)").isNotNull(), F.lit(False)).alias("parses"))
    said = said.select(
        "asset_id", "format", "bad", "present", "parses", F.get_json_object("value", "$.policy_digest").alias("digest"), F.get_json_object("value", "$.output_format").alias("emitted"),
        F.from_json(F.get_json_object("value", "$.stripped_and_proven_gone"), "array<string>").alias("gone"),
    )
    problem = lambda when, text: F.when(F.coalesce(when, F.lit(False)), text)
    same = F.coalesce(F.col("digest") == policy.digest, F.lit(False))
    differ = F.array_compact(
        F.concat(
            F.array(
                problem(~F.col("parses"), F.lit("the report can't be parsed")),
                problem(F.col("parses") & ~same, F.lit("the report is not of this policy")),
                problem(F.col("parses") & (F.col("emitted") != F.col("format")), F.concat(F.lit("the report tells of "), "emitted", F.lit(", not of "), "format")),
            ),
            F.transform(F.array_intersect("present", F.coalesce("gone", F.array().cast("array<string>"))), lambda x: F.concat(x, F.lit(" was gone and is back"))),
        )
    )
    unread = ~F.coalesce(F.col("format").isin(classes.SUPPORTED), F.lit(False))
    problems = (
        F.when(unread, F.array(F.concat(F.lit("outputs of this format are not read: "), F.coalesce("format", F.lit("unknown")))))
        .when(F.size("bad") > 0, F.transform("bad", lambda x: F.concat(x, F.lit(" can't be read in the output"))))
        .otherwise(differ)
    )
    both = said.select("asset_id", problems.alias("problems"), unread.alias("unread"), (F.size("bad") > 0).alias("broken"))
    code = F.when(F.col("unread"), EXIT_UNREAD).when(F.col("broken"), EXIT_BAD).when(F.size("problems") > 0, EXIT_MISMATCH).otherwise(0)
    return both.select("asset_id", (code == 0).alias("verified"), "problems", code.alias("exit_code"))
