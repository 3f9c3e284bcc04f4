"""The clean run: inspect, plan, rewrite, inspect again, prove, report, in one lineage.

A file stays in its row from its content to its report; nothing is joined but the plan (a row per format), and each walk, look at
the pixels and rewrite happens once. Whether marks are gone is what the second inspection says, not what the rewrite did.

What the owner has not confirmed is not run here: manifests stay, pixels and sounds are left alone (plans name these steps, and
reports say so). Another step may hand in changed pixels or sound: a column ``edited`` takes the content's place, and how far it
is from the content is measured; below the floors nothing is written.

Exit codes: 0; 10 a mark that the run is for is still there; 30 a targeted class can't be read, the rewrite fails, or a changed file can't be
measured; 40 not read: null, empty or too large content, or another format; 50 a changed picture below a floor. 2 is the sink's: see
:mod:`outputs` and ``sources/sink.py``. With any but 0 there is no output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import classes
from ..plans import policy as P
from ..sources import sink
from . import capture, containers, fidelity, outputs, report, rewrite

EXIT_REMAINS, EXIT_BAD, EXIT_UNREAD = 10, 30, 40
ACTIONS = "array<struct<transform: string, name: string, outcome: string, result: string>>"
NAMES = "array<string>"


def _classes(ids: Column) -> Column:
    """What the media transforms of a run drop."""
    table = F.create_map(*(x for i, cs in rewrite.BY_TRANSFORM.items() for x in (F.lit(i), F.array(*map(F.lit, cs)))))
    return F.array_distinct(F.flatten(F.transform(ids, lambda i: F.coalesce(F.try_element_at(table, i), F.array().cast(NAMES)))))


def _scrubbed(text: Column, ids: Column) -> Column:
    """A text after the text transforms of a run."""
    invisible = lambda t: F.when(F.array_contains(ids, "MC07"), T.without_invisibles(t)).otherwise(t)

    def headers(t: Column) -> Column:
        for step in (T.without_metadata, T.without_generator_elements):
            t = T.bound(t, step)
        return T.without_banners(t)

    return T.bound(T.bound(text, invisible), lambda t: F.when(F.array_contains(ids, "MC08"), headers(t)).otherwise(t))


def _in_state(found: str, of: Column, state: str) -> Column:
    """Detections of these classes in a state."""
    return F.filter(found, lambda d: F.array_contains(of, d["class"]) & (d["state"] == state))


def cleaned(
    assets: DataFrame, policy: P.Policy | None = None, keep: list[str] = (), no_degrade: bool = False, strip_capture: bool = False,
    makes: list[str] = (), generators: list[str] = (), pixels: bool = True,
) -> DataFrame:
    """assets: content, perhaps edited, and any other columns, which stay. Adds output (null where nothing is to be written) and the report:
    policy_version, policy_digest, verb, format, output_format, capture, scan_states, findings, actions, stripped_and_proven_gone, kept, survived,
    sanity, no_op, error, exit_code. A certified capture comes out as it went in unless strip_capture."""
    policy = policy or P.Policy()
    own = [c for c in assets.columns if c != "edited"]
    rows = assets if "edited" in assets.columns else assets.withColumn("edited", F.lit(None).cast("binary"))
    # before
    rows = report.with_found(rows, "content", "format", "before", policy, pixels, walk=True)
    rows = capture.with_reading(rows, "content", "format", "walked_", list(makes), list(generators)).drop("walked_")
    rows = report.with_plan(rows.withColumn("before", report.ranked(F.col("before"))), "format", policy, list(keep), no_degrade)
    ids = lambda when: F.transform(F.filter("steps", when), lambda s: s["id"])
    certified = (F.col("status") == "certified") & F.lit(not strip_capture)
    rows = rows.withColumns({"certified": certified, "run": ids(lambda s: s["runs"] & s["run_here"])})
    targets = F.array_distinct(F.flatten(F.transform(F.filter("steps", lambda s: s["runs"] & s["run_here"]), lambda s: s["targets"])))
    rows = rows.withColumn("targets", targets)
    unread = ~F.coalesce(F.col("format").isin(classes.SUPPORTED) & (F.length("content") > 0), F.lit(False))
    unknown = F.transform(_in_state("before", F.col("targets"), "malformed"), lambda d: d["label"])
    rows = rows.withColumns({"unread": unread, "unknown": unknown})
    goes = ~F.col("unread") & ~F.col("certified") & (F.size("unknown") == 0)
    # the rewrite
    source, is_media = F.coalesce("edited", "content"), containers.is_media(F.col("format"))
    rows = rows.withColumn("made", rewrite.rewrite(F.when(goes & is_media, source), F.col("format"), _classes(F.col("run"))))
    scrubbed = F.when(goes & ~is_media, T.bound(source.cast("string"), lambda t: _scrubbed(t, F.col("run")))).cast("binary")
    rows = rows.withColumn("out", F.when(is_media, F.col("made.content")).otherwise(scrubbed))
    # after
    rows = report.with_found(rows, "out", "output_format", "after", policy, pixels)
    rows = rows.withColumn("after", report.ranked(F.col("after")))
    pair = F.col("edited").isNotNull() & goes
    rows = rows.withColumn("sums", fidelity.sums(F.when(pair & (F.col("format") == F.col("output_format")), F.col("format")), F.when(pair, F.col("content")), F.when(pair, F.col("out"))))
    rows = rows.withColumn("sanity", F.when(pair, fidelity.judged(F.col("format"), F.col("sums"), policy.floors)))
    # the proof
    was = lambda: _in_state("before", F.col("targets"), "confirmed_present")
    still = F.transform(_in_state("after", F.col("targets"), "confirmed_present"), lambda d: d["class"])
    rows = rows.withColumn("still", F.when(goes, still).otherwise(F.array().cast(NAMES)))
    named = lambda found, when: F.transform(F.filter(found, when), lambda d: F.coalesce(d["label"], d["class"]))
    rows = rows.withColumns({"left": named(was(), lambda d: F.array_contains(F.col("still"), d["class"])), "gone": named(was(), lambda d: ~F.array_contains(F.col("still"), d["class"]))})
    failed = F.when(is_media, F.col("made.exit_code")).otherwise(0)
    code = (
        F.when(F.col("unread"), EXIT_UNREAD).when(F.col("certified"), 0).when(F.size("unknown") > 0, EXIT_BAD).when(failed != 0, failed)
        .when(F.coalesce(F.col("sanity.exit_code"), F.lit(0)) != 0, F.col("sanity.exit_code")).when(F.size("left") > 0, EXIT_REMAINS).otherwise(0)
    )
    rows = rows.withColumn("exit_code", code)
    done = (F.col("exit_code") == 0) & ~F.col("certified")
    rows = rows.withColumn("output", F.when(F.col("exit_code") == 0, F.when(F.col("certified"), F.col("content")).otherwise(F.col("out"))))
    rows = rows.withColumn("no_op", done & (F.col("output") == F.col("content")))
    error = (
        F.when(F.col("unread"), "not read: null, empty or too large, or a format that is not cleaned").when(F.col("certified"), None)
        .when(F.size("unknown") > 0, F.concat(F.lit("whether it is there can't be told: "), F.array_join("unknown", ", ")))
        .when(failed != 0, "the file can't be rewritten").when(F.col("sanity.refusal").isNotNull(), F.col("sanity.refusal"))
        .when(F.size("left") > 0, F.concat(F.lit("still there: "), F.array_join("left", ", ")))
    )
    kept = F.transform(F.filter("steps", lambda s: ~s["runs"]), lambda s: F.struct(F.concat_ws(" ", s["id"], s["name"]).alias("item"), s["reason"].alias("reason")))
    whole = F.array(F.struct(F.lit("the whole asset").alias("item"), F.lit("certified capture").alias("reason")))
    shown = F.when(done | (F.col("exit_code") == EXIT_REMAINS), F.col("after")).otherwise(F.col("before"))
    return rows.select(
        *own, "output", F.lit(policy.version).alias("policy_version"), F.lit(policy.digest).alias("policy_digest"), F.lit("clean").alias("verb"), "format",
        F.coalesce("output_format", "format").alias("output_format"), F.struct("status", "claim", "hint", "line", F.col("certified").alias("kept")).alias("capture"),
        report.scan_states(shown).alias("scan_states"), report.listed_findings(shown).alias("findings"), _actions(done).alias("actions"),
        F.when(done, F.col("gone")).otherwise(F.array().cast(NAMES)).alias("stripped_and_proven_gone"), F.when(F.col("certified"), whole).otherwise(kept).alias("kept"),
        report.survivors(F.col("before"), F.array().cast(NAMES)).alias("survived"), "sanity", "no_op", error.alias("error"), "exit_code",
    )


def _actions(done: Column) -> Column:
    """What became of each step of the plan, in its order."""
    present = lambda s: F.filter("before", lambda d: F.array_contains(s["targets"], d["class"]) & (d["state"] == "confirmed_present"))

    def action(s: Column) -> Column:
        ran = s["runs"] & s["run_here"] & ~F.col("certified")
        outcome = (
            F.when(F.col("certified"), "not run: certified capture").when(~s["runs"], s["reason"]).when(~s["run_here"], "not run here: the owner has not confirmed it")
            .when(~done, "not written").when(F.col("no_op"), "no-op").when((s["id"] == "MC14") & (F.size(present(s)) > 0), "rewritten").otherwise("applied")
        )
        result = (
            F.when(~ran, "not applied").when(F.size(s["targets"]) == 0, "applied").when(F.size(present(s)) == 0, "nothing of this kind was there")
            .when(F.size(F.col("still")) == 0, "removed, and seen to be gone")
            .when(F.exists(present(s), lambda d: F.array_contains(F.col("still"), d["class"])), "some of this kind is left").otherwise("removed, and seen to be gone")
        )
        return F.struct(s["id"].alias("transform"), s["name"], outcome.alias("outcome"), result.alias("result"))

    return F.transform("steps", action).cast(ACTIONS)


def clean_files(files: DataFrame, folder: str, work: str, overwrite: bool = False, **how) -> DataFrame:
    """The whole job. files: path, relative, content (see ``sources/inputs.py``); folder: where outputs go; work: a new folder that all
    executors share. Returns path, dest, decision, outcome, exit_code, report (JSON): a row per file.

    Reports and outputs are written to work once, so that deciding and writing repeat nothing; a decision of two files for one place falls to
    the first by path.
    """
    spark = files.sparkSession
    rows = cleaned(files.select("path", F.coalesce("relative", F.substring_index("path", "/", -1)).alias("relative"), "content"), **how).drop("content")
    said = F.to_json(F.struct(*(c for c in rows.columns if c not in ("path", "relative", "output"))), {"ignoreNullFields": "false"})
    rows.select("path", "relative", "output_format", "no_op", "exit_code", "output", said.alias("report")).write.parquet(f"{work}/cleaned")
    made = spark.read.parquet(f"{work}/cleaned")
    named = outputs.destinations(made.withColumn("format", F.col("output_format")), folder)
    decisions = outputs.decided(named, overwrite=overwrite)
    decisions.write.parquet(f"{work}/decided")
    decisions = spark.read.parquet(f"{work}/decided")
    chosen = decisions.where("decision = 'write'").select("path", "dest")
    outcomes = sink.written(chosen.join(made.select("path", F.col("output").alias("content")), "path"), folder, f"{work}/outcomes", overwrite)
    outcomes = outcomes.select("path", "outcome", F.col("exit_code").alias("written_code"))
    both = decisions.join(outcomes, "path", "left_outer").join(made.select("path", "report"), "path")
    code = F.when(F.coalesce("written_code", F.lit(0)) != 0, F.col("written_code")).otherwise(F.col("exit_code"))
    return both.select("path", "dest", "decision", "outcome", code.alias("exit_code"), "report")
