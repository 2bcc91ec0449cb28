"""Dealing rows to tasks by ranges of an integer key, with bounds that the driver knows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: The most ranges that a table is cut into, whatever its size: bounds go to the driver and to all tasks.
MOST_RANGES = 16_384
_NULL = -(1 << 63)


def range_bounds(docs: DataFrame, key: str, least: int, most: int) -> np.ndarray:
    """Cuts between ranges of about equally many rows: least to most each, for small tables a few ranges a core; MOST_RANGES of them at most.

    A key of many rows (or null, the least of all) is a cut several times over. What reaches the driver is one number for each range.
    """
    n = docs.select(key).count()
    per = min(most, max(least, n // (6 * docs.sparkSession.sparkContext.defaultParallelism)))
    ranges = min(MOST_RANGES, max(1, -(-n // per)))
    if ranges == 1:
        return np.zeros(0, np.int64)
    value = F.coalesce(F.col(key).cast("long"), F.lit(_NULL).cast("long"))
    cuts = docs.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges))).head()[0]
    return np.array(sorted(cuts or []), np.int64)


def ranges_of(keys: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first range that may have each key, and how many may; a null key is less than all others."""
    x = keys.fill_null(_NULL).to_numpy(zero_copy_only=False)
    first, last = np.searchsorted(bounds, x, side="left"), np.searchsorted(bounds, x, side="right")
    return np.minimum(first + 1, last), np.maximum(last - first, 1)


def range_of(keys: pa.Array, bounds: np.ndarray, salt: np.ndarray | None = None) -> np.ndarray:
    """The range of each key; where several may have it, salt chooses one (the last without it)."""
    first, many = ranges_of(keys, bounds)
    return (first + (many - 1 if salt is None else salt % many)).astype(np.int32)


def runs(batches, column: str):
    """(value of column, batches of it) for batches sorted by it, as they come."""
    held = iter(batches)
    rest = None

    def of(value):
        nonlocal rest
        while True:
            while rest is None or not rest.num_rows:
                rest = next(held, None)
                if rest is None:
                    return
            values = rest.column(column).to_numpy(zero_copy_only=False)
            other = values != value
            upto = int(np.argmax(other)) if other.any() else len(values)
            if not upto:
                return
            part, rest = rest.slice(0, upto), rest.slice(upto) if upto < len(values) else None
            yield part

    while True:
        while rest is None or not rest.num_rows:
            rest = next(held, None)
            if rest is None:
                return
        value = rest.column(column)[0].as_py()
        parts = of(value)
        yield value, parts
        for _ in parts:  # what the caller left
            pass
