"""Arrow functions over columns of whole files. A task's batch may hold thousands of files: they are looked at and handed on a few
at a time, so neither what is made of them nor what was needed for it piles up."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes and files that are looked at at once, or one file. No effect on results.
AT_ONCE, FILES = 1_000_000, 512


def slices(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    rows = len(columns[0])
    size = np.full(rows, AT_ONCE // FILES, np.int64)
    for c in columns:
        if any(kind(c.type) for kind in (pa.types.is_binary, pa.types.is_string, pa.types.is_large_binary, pa.types.is_large_string)):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(size), 0
    while at < rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, side="right")))
        yield tuple(c.slice(at, end - at) for c in columns)
        at = end


def given_back() -> None:
    """The worker's freed memory goes back: idle workers of one step stay while others run."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def by_slices(each: Callable[..., pa.Array], kind: str, files: bool = False) -> Callable[..., Column]:
    """A column function of each (arrays to an array of as many values). Said to be non-deterministic, so that no plan runs it twice.
    files: what is made is large and handed on slice by slice; else a batch's results are put together, so that one worker may
    run several functions."""

    def handed_on(batches):
        for columns in batches:
            for part in slices(columns if isinstance(columns, tuple) else (columns,)):
                yield each(*part)
            del columns
            given_back()

    def together(*columns: pa.Array) -> pa.Array:
        made = [each(*part) for part in slices(columns)]
        made = pa.concat_arrays(made) if made else each(*columns)
        given_back()
        return made

    made, how = (handed_on, F.ArrowUDFType.SCALAR_ITER) if files else (together, F.ArrowUDFType.SCALAR)
    return F.arrow_udf(made, kind, how).asNondeterministic()
