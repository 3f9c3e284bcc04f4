"""Reading of the published pixel mark that image generators put into the blue-difference plane. Nothing is altered.

Per file, blocks vote in one pass over its bands of lines and only the votes, a few dozen numbers, go on; majority,
agreement with the published payloads, decision and evidence are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, jpeg, samples
from ..functions import text as T

# Payloads, least agreement, quantization step, edge of a block, weights of luma and blue difference in 2**14ths.
PAYLOADS = {"sdxl-48": f"{0xB3EC907BB19E:048b}", "compvis-136": "".join(f"{b:08b}" for b in b"StableDiffusionV1")}
AGREEMENT, STEP, BLOCK = 0.8, 36.0, 4
RED, GREEN, BLUE, DIFFERENCE = 4899, 9617, 1868, 8061
VOTES = "struct<blocks: long, ones: array<array<long>>, subsampled: boolean, unread: boolean>"
_VOTES = pa.struct([("blocks", pa.int64()), ("ones", pa.list_(pa.list_(pa.int64()))), ("subsampled", pa.bool_()), ("unread", pa.bool_())])


def blue_difference(pixels: np.ndarray) -> np.ndarray:
    r, g, b = (pixels[..., i].astype(np.int64) for i in range(3))
    luma = (r * RED + g * GREEN + b * BLUE + 2**13) >> 14
    return np.clip(((b - luma) * DIFFERENCE + (128 << 14) + 2**13) >> 14, 0, 255)


def block_bits(pixels: np.ndarray) -> np.ndarray:
    """The bit of each block, row by row: of the low band of a Haar step (lower pixels before upper ones, right before
    left: the order decides ties), the largest value but the first, of equal ones the first; whether it lies in the upper
    half of its step."""
    high, wide = (n // 4 * 4 for n in pixels.shape[:2])
    u = blue_difference(pixels)[:high, :wide].astype(np.float64)
    s = np.sqrt(0.5)
    left, right = (u[1::2, i::2] * s + u[::2, i::2] * s for i in (0, 1))
    low = right * s + left * s
    down, across = low.shape[0] // BLOCK, low.shape[1] // BLOCK
    blocks = np.abs(low[: down * BLOCK, : across * BLOCK].reshape(down, BLOCK, across, BLOCK).swapaxes(1, 2).reshape(-1, BLOCK * BLOCK))
    return np.fmod(blocks[:, 1:].max(1, initial=0), STEP) > STEP / 2


def voted(bands: Iterator[np.ndarray]) -> tuple[int, list[list[int]]]:
    """Of a picture in bands: its blocks, and per payload how many of each bit's are ones."""
    count, ones = 0, [np.zeros(len(p), np.int64) for p in PAYLOADS.values()]
    for band in samples.in_windows(bands, 2 * BLOCK):
        bits = block_bits(band)
        place = np.flatnonzero(bits) + count
        ones = [o + np.bincount(place % len(o), minlength=len(o)) for o in ones]
        count += len(bits)
    return count, [o.tolist() for o in ones]


def votes(content: Column, form: Column) -> Column:
    """VOTES of a picture, null for other formats; null blocks where it can't be read, or its form is not read here (unread)."""

    def one(form: str | None, content: bytes | None, opened: Callable[[], samples.Bands] | None) -> dict | None:
        if opened is None:
            return None
        count = ones = None
        unread = False
        try:
            count, ones = voted(opened()[2])  # a file at a time, in bands of lines
        except samples.Unreadable:
            pass
        except samples.Unread:
            unread = True
        return {"blocks": count, "ones": ones, "subsampled": form == "jpeg" and bool(jpeg.subsampled(content)), "unread": unread}

    def vote(content: pa.Array, form: pa.Array) -> pa.Array:
        forms, contents = form.to_pylist(), content.to_pylist()
        return pa.array(list(map(one, forms, contents, samples.pictures(forms, contents))), _VOTES)

    picture = form.isin(*samples.PICTURES)
    return arrow.by_slices(vote, VOTES)(F.when(picture, content), F.when(picture, form))


def agreement(votes: Column, i: int, payload: str) -> Column:
    """Share of the payload's bits that the majority of their blocks show; a bit without blocks shows 0."""
    n = len(payload)

    def shown(b: Column, k: Column) -> Column:
        mine = F.floor(votes["blocks"] / n) + F.when(k < votes["blocks"] % n, 1).otherwise(0)
        return F.when((255 * b > 127 * mine) == (F.substring(F.lit(payload), k + 1, F.lit(1)) == "1"), 1).otherwise(0)

    return F.round(F.aggregate(F.transform(F.element_at(votes["ones"], i + 1), shown), F.lit(0), lambda t, x: t + x) / n, 3)


def decision(form: Column, votes: Column) -> Column:
    """struct<state, evidence, blocks, agreements> of a file's VOTES.

    A payload is present if every bit has a block and the agreement is 0.8 or more. A PNG or JPEG that can't be read is
    malformed. Other formats and forms, which are not decoded here, and null contents are unsupported_format; so is a JPEG of
    subsampled colours in which nothing is found, as its writer has thrown away what the mark would lie in.
    """

    def decided(score: Column) -> Column:
        blocks = votes["blocks"]
        present = {name: (blocks >= len(p)) & (score[name] >= AGREEMENT) for name, p in PAYLOADS.items()}
        said = [
            F.format_string(f"payload {name} matches %.3f of its bits in %d blocks, {AGREEMENT:.2f} are needed: %s", score[name], blocks, F.when(there, "found").otherwise("not found"))
            for name, there in present.items()
        ]
        some = present["sdxl-48"] | present["compvis-136"]
        state = (
            F.when(~F.coalesce(form.isin(*samples.PICTURES), F.lit(False)) | votes["unread"], "unsupported_format").when(blocks.isNull(), "malformed")
            .when(some, "confirmed_present").when(votes["subsampled"], "unsupported_format").otherwise("confirmed_absent")
        )
        evidence = F.when(blocks.isNull(), F.array().cast("array<string>")).otherwise(F.array(*said))
        return F.struct(state.alias("state"), evidence.alias("evidence"), blocks.alias("blocks"), F.when(blocks.isNotNull(), score).alias("agreements"))

    return T.bound(F.create_map(*(x for i, (name, p) in enumerate(PAYLOADS.items()) for x in (F.lit(name), agreement(votes, i, p)))), decided)


def decisions(assets: DataFrame) -> DataFrame:
    """assets (asset_id, content) -> asset_id, format, and the fields of :func:`decision`; an empty table gives no rows, a repeated
    row one each."""
    form = F.when(F.col("content").isNotNull(), T.sniffed(F.col("content")))
    rows = assets.select(F.col("asset_id").cast("long").alias("asset_id"), form.alias("format"), "content")
    rows = rows.select("asset_id", "format", votes(F.col("content"), F.col("format")).alias("votes"))
    return rows.select("asset_id", "format", decision(F.col("format"), F.col("votes")).alias("d")).select("asset_id", "format", "d.*")
