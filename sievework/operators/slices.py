"""Work on many reviews in slices of whole reviews, one after another: disk is bounded by a slice and the result.

Every row is in exactly one slice, so a result whose rows of one review need that review's rows alone is the slices' results
together. A slice is worked on by all executors; its shuffles and steps go before the next begins.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from contextlib import AbstractContextManager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import gathered

#: Rows of all relations together that a slice has about.
SLICE_ROWS = 12_000_000
#: Slices at most: beyond it they grow with the input, and so does the disk of one; each costs its jobs' plans and code again.
MOST = 40


def slices(relations: Iterable[DataFrame], rows: int = SLICE_ROWS) -> list[Column]:
    """Conditions on review_id, each row meeting exactly one: ranges of numbers, which Parquet's statistics can skip, else hashes.

    Empty where one slice is enough. A review is never divided.
    """
    key = F.col("review_id")
    keys = functools.reduce(DataFrame.unionByName, [r.select(key) for r in relations])
    n = min(-(-keys.count() // rows), MOST)
    if n < 2:
        return []
    if not isinstance(keys.schema["review_id"].dataType, T.NumericType):
        return [F.pmod(F.xxhash64(key), F.lit(n)) == i for i in range(n)]
    ends = sorted(set(keys.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000)).first()[0] or []))
    between = [(key >= a) & (key < b) for a, b in zip(ends, ends[1:], strict=False)]
    return [(key < ends[0]) | key.isNull(), *between, key >= ends[-1]] if ends else []


def in_slices(where: list[Column], relations: dict[str, DataFrame], open_: Callable[[dict[str, DataFrame]], AbstractContextManager[DataFrame]], name: str) -> DataFrame:
    """The rows that open_ gives of each slice of the relations, written; it is closed once a slice's rows are."""
    return gathered(name, [functools.partial(open_, {n: r.where(hit) for n, r in relations.items()}) for hit in where])
