"""How close an output file is to its input: PSNR and SSIM of pictures, log-spectral distance of sounds.

A row holds both files, so no pixel is shuffled: each pair is read side by side in bands and handed on as a few
sums; measures, floors and exit codes are column expressions over these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, samples
from ..functions import text as T

# Value for equal pictures, floors, least edge of a picture, least frames of a sound, exit codes.
EQUAL_DB, PSNR_FLOOR, SSIM_FLOOR, LEAST_EDGE = 120.0, 25.0, 0.6, 8
EXIT_MALFORMED, EXIT_UNSUPPORTED, EXIT_BELOW_FLOOR = 30, 40, 50
#: Rows of results that are handed on at once.
ROWS_AT_ONCE = 2048
SUMS = "struct<width: int, height: int, samples: long, squares: long, windows: long, similar: double, frames: long, distance: double, problem: string>"
_SUMS = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int64()), ("squares", pa.int64()), ("windows", pa.int64()), ("similar", pa.float64()), ("frames", pa.int64()), ("distance", pa.float64()), ("problem", pa.string())])


def measured(form: str | None, before: bytes | None, after: bytes | None, opened: tuple[Callable[[], samples.Bands] | None, ...]) -> tuple:
    """The fields of SUMS of one pair; opened: what gives each one's bands, if both are pictures."""
    nothing = (None,) * 8
    if form not in samples.SOUNDS and form not in samples.PICTURES:
        return (*nothing, "unsupported")
    try:
        if form in samples.PICTURES:
            (height, width, one), (*size, two) = (o() for o in opened)
            if [height, width] != size:
                return (*nothing, "mismatch")
            return (width, height, *samples.picture_sums(one, two), None, None, None)
        one, two = samples.SOUNDS[form](before), samples.SOUNDS[form](after)
        if one.rate != two.rate:
            return (*nothing, "mismatch")
        return (*nothing[:6], *samples.spectral_sums(one.samples, two.samples), None)
    except samples.Unread:
        return (*nothing, "unsupported")
    except samples.Unreadable:
        return (*nothing, "malformed")


def sums(form: Column, before: Column, after: Column) -> Column:
    """SUMS of a pair of one format (null: formats that differ). problem: unsupported (no content, formats that differ or
    are not read here), malformed, mismatch (other size or rate), else null."""

    def each(form: pa.Array, before: pa.Array, after: pa.Array) -> pa.Array:
        forms, ones, twos = (c.to_pylist() for c in (form, before, after))
        pairs = zip(samples.pictures(forms, ones), samples.pictures(forms, twos))
        rows = map(measured, forms, ones, twos, pairs)  # a pair at a time, in bands
        return pa.array([dict(zip(_SUMS.names, r)) for r in rows], _SUMS)

    return arrow.by_slices(each, SUMS)(form, before, after)


def gathered(rows: Iterator[tuple], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of few numbers in batches, not one by one."""
    while held := list(islice(rows, ROWS_AT_ONCE)):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), types)], names)


TOTALS = "struct<width: int, height: int, total: long, squares: long, problem: string>"
_TOTALS = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("total", pa.int64()), ("squares", pa.int64()), ("problem", pa.string())])


def totals(form: Column, content: Column) -> Column:
    """TOTALS of a picture: its size, the sum of its samples, and of their squares. problem: unsupported or malformed."""

    def one(opened: Callable[[], samples.Bands] | None) -> dict:
        if opened is None:
            return {"problem": "unsupported"}
        try:
            height, width, bands = opened()
            total = squares = 0
            for band in bands:
                numbers = band.reshape(-1).astype(np.float64)  # whole numbers far below 2**53, so the sums are exact
                total, squares = total + int(numbers.sum()), squares + int(numbers @ numbers)
            return {"width": width, "height": height, "total": total, "squares": squares}
        except samples.Unread:
            return {"problem": "unsupported"}
        except samples.Unreadable:
            return {"problem": "malformed"}

    def each(form: pa.Array, content: pa.Array) -> pa.Array:
        return pa.array(list(map(one, samples.pictures(form.to_pylist(), content.to_pylist()))), _TOTALS)

    return arrow.by_slices(each, TOTALS)(form, content)


def judged(form: Column, found: Column, floors: tuple[float, float] = (PSNR_FLOOR, SSIM_FLOOR)) -> Column:
    """struct<psnr_db, ssim, lsd_db, passed, refusal, exit_code> of a pair's SUMS.

    Pictures pass at or above both floors; one below a floor was measured and gives 50. Sounds, which have no floor, pass where
    they were measured. A picture with an edge under 8, or a file that is not read here, gives 40. A file that can't be
    read, pairs of other size or rate, and sounds of under four frames were not measured: null measures, 30. Null
    contents are not read (40).
    """
    psnr = F.when(found["squares"] == 0, EQUAL_DB).when(found["samples"] > 0, 10 * F.log10(65025.0 * found["samples"] / found["squares"]))
    measures = F.struct(
        psnr.alias("psnr_db"), F.when(found["windows"] > 0, found["similar"] / found["windows"]).alias("ssim"),
        F.when(found["frames"] >= samples.LEAST_FRAMES, found["distance"] / found["frames"]).alias("lsd_db"),
    )

    def verdict(m: Column) -> Column:
        unread = F.coalesce(found["problem"] == "unsupported", F.lit(False)) | F.coalesce(F.least(found["width"], found["height"]) < LEAST_EDGE, F.lit(False))
        both = m["psnr_db"].isNotNull() & m["ssim"].isNotNull()
        passed = F.coalesce(F.when(~form.isin(*samples.SOUNDS), (m["psnr_db"] >= floors[0]) & (m["ssim"] >= floors[1])).otherwise(m["lsd_db"].isNotNull()), F.lit(False)) & ~unread
        scores = F.format_string("PSNR %.2f dB, SSIM %.4f; at least %.1f dB and %.2f are asked for", m["psnr_db"], m["ssim"], F.lit(floors[0]), F.lit(floors[1]))
        refusal = (
            F.when(unread, "can't be measured: format or size").when(found["problem"].isNotNull(), F.concat(F.lit("not measured: "), found["problem"]))
            .when(~passed, F.when(both, scores).otherwise("not measured: too short"))
        )
        code = F.when(unread, EXIT_UNSUPPORTED).when(passed, 0).when(both, EXIT_BELOW_FLOOR).otherwise(EXIT_MALFORMED)
        return F.struct(m["psnr_db"], m["ssim"], m["lsd_db"], passed.alias("passed"), refusal.alias("refusal"), code.alias("exit_code"))

    return T.bound(measures, verdict)


def measures(pairs: DataFrame) -> DataFrame:
    """pairs (asset_id, before, after) -> asset_id, format, and the fields of :func:`judged`: a row per pair, repeated rows too."""
    kind = lambda c: F.when(F.col(c).isNotNull(), T.sniffed(F.col(c)))
    rows = pairs.select(F.col("asset_id").cast("long").alias("asset_id"), kind("before").alias("one"), kind("after").alias("two"), "before", "after")
    rows = rows.select("asset_id", F.when(F.col("one") == F.col("two"), F.col("one")).alias("format"), "before", "after")
    rows = rows.select("asset_id", "format", sums(F.col("format"), F.col("before"), F.col("after")).alias("sums"))
    return rows.select("asset_id", "format", judged(F.col("format"), F.col("sums")).alias("j")).select("asset_id", "format", "j.*")
