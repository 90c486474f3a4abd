"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Every source gets its weight's share of the total; a source whose share exceeds ``max_epochs`` times its size is clamped
there and the excess goes to the free sources by weight, again and again until none exceeds. A source's target over its
size is then taken as whole repetitions of all its documents and one seeded fractional repetition: the documents with
the lowest seeded hashes, up to the hash at which their sizes reach the fraction, and up to three more that fit what is
still missing. That hash is found by two rounds of 4,096 bins a source and an exact running sum inside the last bin, so
no source is gathered in a task. Rows of one key, size and text share a hash; where the fraction ends among them, as
many of them are taken as fit, counted in buckets.

Defined cases: a null text has size 0; a null source is a source; a source of size 0 takes nothing; copies of a row are
taken one by one, and which of equal rows is left out makes no difference; an empty table gives an empty table; other
columns are ignored (or carried by ``mix_documents``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small

WORD = r"[^\x20\x09-\x0D]+"
BITS, BINS = 63, 4096
SEED = 20_240_229
#: Rows that may be added to a source's fractional repetition to come nearer to its target.
EXTRAS = 3
#: Buckets in which the copies of a row are numbered.
BUCKETS = 256
PARTS = "array<struct<draw:bigint,rows:bigint>>"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: str, size: Column, text: str, seed: int) -> Column:
    """A seeded hash of the row in 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), size, F.col(text)), 1)


def repeating_weights(sources: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """(source, weight): the distinct sources by code point, null last, weigh the cycle's values in turn.

    The ranking runs in one task; sources are a dimension, not rows.
    """
    n = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    return sources.select("source").distinct().select("source", F.element_at(F.array(*map(F.lit, cycle)), (n % len(cycle) + 1).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, share: float = 1.0, max_epochs: float = 3.0) -> DataFrame:
    """Adds target to (source, weight, source_size); share: of all sizes. Rounds end when no free source exceeds its cap."""
    cap = F.col("source_size") * F.lit(max_epochs)
    total = sources.agg(F.sum("source_size")).first()[0]
    level = 0.0
    while total:
        held = F.col("weight") * F.lit(level) >= cap
        fixed, weight = sources.agg(F.sum(F.when(held, cap).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("weight")))).first()
        rising = (share * total - fixed) / weight if weight else level
        if rising <= level * (1 + 1e-12):
            break
        level = rising
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def _within(rows: DataFrame, at: str) -> DataFrame:
    """For each source the bin (column at) in which the running size passes ``want``, and what lies before it."""
    bins = rows.groupBy("source", at).agg(F.sum("size").alias("s"), F.first("want").alias("want"))
    run = F.sum("s").over(W.partitionBy("source").orderBy(at).rowsBetween(W.unboundedPreceding, 0))
    passed = bins.withColumn("before", run - F.col("s")).where((F.col("before") <= F.col("want")) & (F.col("want") < F.col("before") + F.col("s")))
    return passed.select("source", F.col(at), (F.col("want") - F.col("before")).alias("want"))


def mixing_plan(sized: DataFrame, weights: DataFrame, share: float = 1.0, max_epochs: float = 3.0) -> DataFrame:
    """(source, source_size, target, whole, cut, parts): rows of a source are taken ``whole`` times, those with draw <= cut
    once more, and of those with a draw in parts as many rows once more as it says: the copies at which the fraction ends,
    and a few rows, each of the largest size within what is still missing.

    sized: columns source, size, draw. Written; as many rows as sources.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = totals.join(weights.withColumnRenamed("source", "w"), F.col("source").eqNullSafe(F.col("w")), "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    filled = water_fill(cut(known, "sources"), share, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-9)
    plan = cut(filled.select("source", "source_size", "target", whole.cast("int").alias("whole"), F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size")).alias("want")), "targets")

    def joined(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
        right = small(cut(right, "bins")).withColumnRenamed("source", "r_source").withColumnsRenamed({c: f"r_{c}" for c in on})
        same = F.col("source").eqNullSafe(F.col("r_source"))
        for c in on:
            same = same & (F.col(c) == F.col(f"r_{c}"))
        return left.join(right, same).drop("r_source", *[f"r_{c}" for c in on])

    bits = (BINS - 1).bit_length()
    binned = sized.select("source", "size", "draw", F.shiftright("draw", BITS - bits).alias("b1"), F.shiftright("draw", BITS - 2 * bits).alias("b2"))
    first = joined(binned.where("size > 0"), _within(joined(binned, plan.where("want > 0").select("source", "want")), "b1"), "b1")
    second = joined(first.drop("want"), _within(first, "b2"), "b2").groupBy("source", "b2", "draw").agg(F.sum("size").alias("s"), F.first("size").alias("size"), F.first("want").alias("want"))
    run = F.sum("s").over(W.partitionBy("source").orderBy("draw").rowsBetween(W.unboundedPreceding, 0))
    fits, start = F.col("run") <= F.col("want"), F.first(F.shiftleft("b2", BITS - 2 * bits)) - 1
    spent = F.coalesce(F.max(F.when(fits, F.col("run"))), F.lit(0))
    cuts = second.withColumn("run", run).groupBy("source").agg(F.coalesce(F.max(F.when(fits, F.col("draw"))), start).alias("cut"), (F.first("want") - spent).alias("gap"), F.min(F.when(~fits, F.struct("draw", "size"))).alias("end"))
    some = F.floor(F.col("gap") / F.col("end.size"))
    ended = F.array_compact(F.array(F.when(some > 0, F.struct(F.col("end.draw").alias("draw"), some.cast("long").alias("rows"))))).cast(PARTS)
    cuts = cut(cuts.select("source", "cut", (F.col("gap") - F.coalesce(some, F.lit(0)) * F.coalesce("end.size", F.lit(0))).alias("gap"), ended.alias("parts")), "cuts")
    for _ in range(EXTRAS):
        rest = joined(sized.where("size > 0"), cuts).where("draw > cut").where(~F.exists("parts", lambda p: p["draw"] == F.col("draw")))
        best = rest.where("size <= gap").groupBy(F.col("source").alias("e")).agg(F.max_by(F.struct("draw", "size"), F.struct("size", "draw")).alias("one"))
        more = F.array_compact(F.array(F.when(F.col("one").isNotNull(), F.struct(F.col("one.draw").alias("draw"), F.lit(1).cast("long").alias("rows")))))
        cuts = cuts.join(best, F.col("source").eqNullSafe(F.col("e")), "left").select("source", "cut", (F.col("gap") - F.coalesce("one.size", F.lit(0))).alias("gap"), F.concat("parts", more).cast(PARTS).alias("parts"))
        cuts = cut(cuts, "cuts")
    out = plan.join(cuts.withColumnRenamed("source", "c"), F.col("source").eqNullSafe(F.col("c")), "left")
    told = out.select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1).cast("long")).alias("cut"), F.coalesce("parts", F.array().cast(PARTS)).alias("parts"))
    return cut(told, "mix")


def _repeated(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, draw) of the plan's parts that several rows share."""
    wanted = small(cut(plan.select(F.col("source").alias("p_source"), F.explode("parts.draw").alias("p_draw")), "parts"))
    met = sized.join(wanted, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("draw") == F.col("p_draw")))
    return cut(met.groupBy("source", "draw").agg(F.count("*").alias("n")).where("n > 1"), "repeated")


def _times(rows: DataFrame, sized: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with source, draw, other columns) and the plan's columns and times: how often each row is taken."""
    right = small(plan).withColumnRenamed("source", "p_source")
    told = rows.join(right, F.col("__source").eqNullSafe(F.col("p_source")))
    part = F.try_element_at(F.filter("parts", lambda p: p["draw"] == F.col("__draw")), F.lit(1))["rows"]
    told = told.withColumns({"__part": part, "__times": (F.col("whole") + ((F.col("__draw") <= F.col("cut")) | part.isNotNull()).cast("int")).cast("int")})
    repeated = _repeated(sized, plan)
    if not repeated.count():
        return told.drop("__part")
    # Copies at which a fraction ends: written with a bucket each, and numbered behind the earlier buckets' rows.
    among = told.join(small(repeated.select(F.col("source").alias("r_source"), F.col("draw").alias("r_draw"))), F.col("__source").eqNullSafe(F.col("r_source")) & (F.col("__draw") == F.col("r_draw")), "left")
    ends = F.col("r_draw").isNotNull()
    copies = cut(among.where(ends).drop("r_source", "r_draw").withColumn("__bucket", F.pmod(F.monotonically_increasing_id(), F.lit(BUCKETS))), "copies")
    run = F.sum("n").over(W.partitionBy("__source", "__draw").orderBy("__bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    before = copies.groupBy("__source", "__draw", "__bucket").agg(F.count("*").alias("n")).withColumn("before", run).select(F.col("__source").alias("b_source"), F.col("__draw").alias("b_draw"), F.col("__bucket").alias("b_bucket"), "before")
    same = F.col("__source").eqNullSafe(F.col("b_source")) & (F.col("__draw") == F.col("b_draw")) & (F.col("__bucket") == F.col("b_bucket"))
    place = F.row_number().over(W.partitionBy("__source", "__draw", "__bucket").orderBy(F.lit(1)))
    numbered = copies.withColumn("__place", place).join(small(cut(before, "before")), same)
    taken = numbered.withColumn("__times", (F.col("whole") + (F.col("before") + F.col("__place") <= F.col("__part")).cast("int")).cast("int")).drop("b_source", "b_draw", "b_bucket", "before", "__bucket", "__place", "__part")
    return among.where(~ends).drop("r_source", "r_draw", "__part").unionByName(taken)


def mix(docs: DataFrame, weights: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.0, max_epochs: float = 3.0, seed: int = SEED) -> DataFrame:
    """(key, size, source_size, target, taken, times) for every row."""
    size = words(F.col(text))
    sized = cut(docs.select(F.col(key), F.col(source).alias("source"), size.alias("size"), draw(key, size, text, seed).alias("draw")), "sizes")
    plan = mixing_plan(sized, repeating_weights(sized) if weights is None else weights, share, max_epochs)
    rows = _times(sized.withColumnsRenamed({"source": "__source", "draw": "__draw"}), sized, plan)
    return rows.select(key, "size", "source_size", "target", (F.col("size") * F.col("__times")).cast("long").alias("taken"), F.col("__times").alias("times"))


def mix_documents(docs: DataFrame, weights: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.0, max_epochs: float = 3.0, seed: int = SEED) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it."""
    size = words(F.col(text))
    sized = cut(docs.select(F.col(source).alias("source"), size.alias("size"), draw(key, size, text, seed).alias("draw")), "sizes")
    plan = mixing_plan(sized, repeating_weights(sized) if weights is None else weights, share, max_epochs)
    rows = _times(docs.select(F.struct("*").alias("__row"), F.col(source).alias("__source"), draw(key, size, text, seed).alias("__draw")), sized, plan)
    return rows.select("__row", F.explode(F.array_repeat(F.lit(1), F.col("__times")))).select("__row.*")


def op5_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs).drop("times")
