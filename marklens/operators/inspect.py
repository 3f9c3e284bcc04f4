"""Inspection, cleaning and verification of text assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import classes


def scanned(assets: DataFrame, id_col: str = "asset_id", text_col: str = "text") -> DataFrame:
    """id, format, n_hygiene, n_malformed, n_wrapper, invisibles, c2pa: a row per text asset."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = assets.select(id_col, T.sniffed(text.cast("binary")).alias("format"), T.counted(text).alias("n"))
    counted = counted.select(id_col, "format", F.col("n.hygiene").alias("n_hygiene"), F.col("n.malformed").alias("n_malformed"), F.col("n.wrapper").alias("n_wrapper"))
    absent = F.when(F.col("format").isin(classes.SUPPORTED), "confirmed_absent").otherwise("unsupported_format")
    state = F.when(F.col("n_hygiene") > 0, "confirmed_present").when(F.col("n_malformed") > 0, "malformed").otherwise(absent)
    return counted.select("*", state.alias("invisibles"), F.when(F.col("n_wrapper") > 0, "confirmed_present").alias("c2pa"))


def scan_states(scan: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """Long form: id, class, honesty, state. Classes that only count when present have a row only then."""
    dim = F.broadcast(classes.class_table(scan.sparkSession))  # a few dozen rows
    rows = scan.join(dim, "format").where("honesty = 'confirmable'").select(id_col, "class", "honesty", F.col("invisibles").alias("state"))
    present = scan.where("c2pa IS NOT NULL").select(id_col, F.lit("c2pa").alias("class"), F.lit("confirmable").alias("honesty"), F.col("c2pa").alias("state"))
    return rows.unionByName(present)


def cleaned(assets: DataFrame, id_col: str = "asset_id", text_col: str = "text") -> DataFrame:
    """id, before, after, changed, exit_code: 30 where only malformed runs are found, else 0."""
    rows = assets.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("before"))
    rows = rows.select(id_col, "before", T.counted(F.col("before")).alias("n"))
    fails = (F.col("n.hygiene") == 0) & (F.col("n.malformed") > 0)
    out = rows.select(id_col, "before", F.when(fails, F.col("before")).otherwise(T.cleaned(F.col("before"))).alias("after"), F.when(fails, 30).otherwise(0).alias("exit_code"))
    return out.withColumn("changed", F.col("before") != F.col("after"))


def verified(clean: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """id, verified, exit_code: 30 where the output's state is malformed, 10 where it holds what cleaning removes."""
    rows = clean.select(id_col, "exit_code", T.counted(F.col("after")).alias("n"))
    hygiene, malformed = F.col("n.hygiene") > 0, F.col("n.malformed") > 0
    code = F.when(F.col("exit_code") != 0, F.col("exit_code")).when(~hygiene & malformed, 30).when(hygiene, 10).otherwise(0)
    return rows.select(id_col, (code == 0).alias("verified"), code.alias("exit_code"))


def worst_exit(codes: DataFrame, *by: str) -> DataFrame:
    """The worst exit code (by severity, not by number) per group."""
    rank = F.array_position(F.array(*map(F.lit, classes.EXIT_RANK)), F.col("exit_code"))
    return codes.groupBy(*by).agg(F.max_by("exit_code", rank).alias("worst_exit"), F.count(F.lit(1)).alias("n"))


def spans(assets: DataFrame, id_col: str = "asset_id", text_col: str = "text") -> DataFrame:
    """id, kind, byte_start, byte_end of each variation-selector run."""
    rows = assets.select(F.struct(id_col).alias("id"), T.spans(F.coalesce(F.col(text_col), F.lit(""))).alias("spans")).select("id", F.inline("spans"))
    return rows.where("kind <> 'S'").select("id.*", "kind", F.col("offset").alias("byte_start"), (F.col("offset") + F.col("length")).alias("byte_end"))


LOCATION = "struct<container: string, offset: bigint, length: bigint, detail: string>"


def text_classes(spans: Column) -> Column:
    """array<struct<class, state, locations, evidence>> of a text's SPANS (null: none): the classes found in it."""
    of = lambda *kinds: F.filter(spans, lambda s: s["kind"].isin(*kinds))
    where = lambda found, container, detail: F.transform(
        found, lambda s: F.struct(F.lit(container).alias("container"), s["offset"], s["length"], F.lit(detail).alias("detail"))
    ).cast(f"array<{LOCATION}>")
    none = F.array().cast("array<string>")

    def invisibles(found: Column) -> Column:
        n = F.size(F.filter(found, lambda s: s["kind"] != "M"))
        count = F.when(n > 0, F.array(F.format_string("%d invisible characters", n))).otherwise(none)
        runs = F.transform(F.filter(found, lambda s: s["kind"] == "M"), lambda s: F.format_string("a long run of variation selectors at byte %d is no wrapper and stays", s["offset"]))
        single = where(F.filter(found, lambda s: s["kind"] != "M"), "text", "invisible character")
        state = F.when(n > 0, "confirmed_present").otherwise("malformed")
        return F.when(F.size(found) > 0, F.struct(F.lit("invisibles").alias("class"), state.alias("state"), single.alias("locations"), F.concat(count, runs).alias("evidence")))

    def wrapper(found: Column) -> Column:
        at = where(found, "text C2PA wrapper", "variation-selector wrapper")
        return F.when(F.size(found) > 0, F.struct(F.lit("c2pa").alias("class"), F.lit("confirmed_present").alias("state"), at.alias("locations"), none.alias("evidence")))

    return F.array_compact(F.array(T.bound(of("H", "S", "M"), invisibles), T.bound(of("W"), wrapper)))


def located(assets: DataFrame, id_col: str = "asset_id", text_col: str = "text") -> DataFrame:
    """id, class, state, locations, evidence: a row per text asset and class found, with byte offsets in their order."""
    rows = assets.select(F.struct(id_col).alias("id"), T.spans(F.coalesce(F.col(text_col), F.lit(""))).alias("spans"))
    return rows.select("id", F.inline(text_classes(F.col("spans")))).select("id.*", "class", "state", "locations", "evidence")
