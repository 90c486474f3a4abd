"""Joins on intervals of lines that one hot file or hunk doesn't spoil.

Intervals are cut into bins of lines and meet on (keys, bin), so a key with any share of the rows spreads over tasks;
each pair is seen in one bin only, that of the later start. Costs follow the intervals' lengths in bins and the pairs
that there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import overlaps

BIN_LINES = 64
#: Lines of a stretch in which the line after a given one is looked up in one task.
STRETCH = 4096


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(F.least(start, end) / width), F.floor(F.greatest(start, end) / width))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str] = ("start_line", "end_line"), right_span: tuple[str, str] = ("other_start", "other_end"), width: int = BIN_LINES) -> DataFrame:
    """Pairs of equal keys whose spans overlap, all columns of both; each pair once. Null spans and keys meet nothing."""
    (a, b), (c, d) = (tuple(map(F.col, s)) for s in (left_span, right_span))
    both = left.withColumn("__bin", F.explode(_bins(a, b, width))).join(right.withColumn("__bin", F.explode(_bins(c, d, width))), [*keys, "__bin"])
    return both.where(overlaps(a, b, c, d) & (F.col("__bin") == F.floor(F.greatest(a, c) / width))).drop("__bin")


def first_lines(node: DataFrame, line: DataFrame, keys: list[str], stretch: int = STRETCH) -> DataFrame:
    """(keys, node, line_number) of nodes (keys, node, start_line, end_line): the first added line within their spans, else the first line.

    line: (keys, line_number, kind). The next line after a node's start is looked up in its stretch of lines, else it is the
    first of a later stretch, so a node of any length costs one row.
    """
    at = lambda c: F.floor(F.col(c) / stretch).alias("stretch")
    none = F.lit(None).cast("long")
    points = node.select(*keys, at("start_line"), F.col("start_line").cast("long").alias("at"), F.lit(0).alias("is_line"), "node", F.col("end_line").cast("long").alias("end"), none.alias("any"), none.alias("added"))
    number = F.col("line_number").cast("long")
    lines = line.select(*keys, at("line_number"), number.alias("at"), F.lit(1).alias("is_line"), F.lit(None).cast(node.schema["node"].dataType).alias("node"), none.alias("end"), number.alias("any"), F.when(F.col("kind") == "addition", number).alias("added"))
    both = points.unionByName(lines)
    after = W.partitionBy(*keys, "stretch").orderBy("at", "is_line").rowsBetween(0, W.unboundedFollowing)
    here = both.withColumns({f"next_{c}": F.first(c, ignorenulls=True).over(after) for c in ("any", "added")}).where("is_line = 0")
    later = W.partitionBy(*keys).orderBy("stretch").rowsBetween(1, W.unboundedFollowing)
    heads = both.groupBy(*keys, "stretch").agg(F.min("any").alias("any"), F.min("added").alias("added"))
    heads = heads.select(*keys, "stretch", *[F.min(c).over(later).alias(f"later_{c}") for c in ("any", "added")])
    found = here.join(heads, [*keys, "stretch"])
    within = [F.coalesce(f"next_{c}", f"later_{c}") for c in ("added", "any")]
    added, any_ = [F.min(F.when(w <= F.col("end"), w)) for w in within]
    return found.groupBy(*keys, "node").agg(F.coalesce(added, any_).alias("line_number")).where("line_number is not null")
