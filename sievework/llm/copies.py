"""Near copies by shingle similarity: links of near-dedup that SimHash fingerprints cannot reach.

Two texts are near copies if the sets of their shingles have a Jaccard similarity of at least the one asked for.
Candidates share one of 24 bands of 5 minimum hashes: a pair at similarity s does so with probability
1 - (1 - s^5)^24, which is 0.9999 at 0.8 and grows with s. Every candidate is verified on the exact sets.

Texts are ranked by the number of their bucket mates, for those with most are the likeliest to have copies, then by their
order. In each bucket the first lead: they are compared with all others; a text with a near copy that ranks before it goes
and leaves all buckets, a lead leaves its bucket, and the rest go on with more leads. So a group of copies around a
common text costs about one comparison a member, and of texts that stay any two that share a bucket were compared.

Most comparisons end at a bound that loses nothing: every text has a map of 1,024 bits, of which each shingle sets one.
A bit that is set for one text only stands for a shingle that the other lacks, so the bits that differ bound the
similarity from above. Only pairs that the bound leaves open are read.

Defined cases: a text without words has no bands and no copies here (all of them are one text already); an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free, small
from .shingles import SEED, shingle_hashes, words_of

BANDS, DEPTH = 24, 5
#: Buckets of at most so many rows are compared in the first round; in larger ones the number of leads grows so from round to round.
SMALL, GROWTH = 8, 16
#: Longs of a text's map of bits.
LONGS = 16
#: Pairs of a lead that meet one copy of its text; more pairs are dealt to more copies.
SHARE = 64
#: Hashes taken at once: bounds memory on very long texts.
BLOCK = 1024
#: Rows of two whole texts in an Arrow batch.
PAIR_ROWS = 100
_draw = np.random.default_rng(SEED)
SALT = _draw.integers(0, 1 << 64, (BANDS * DEPTH, 1), np.uint64)
ODD = _draw.integers(0, 1 << 64, (BANDS * DEPTH, 1), np.uint64) | np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """The band keys of a set of hashes, as signed longs; none for an empty set."""
    if not len(hashes):
        return []
    low = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        low = np.minimum(low, ((hashes[at : at + BLOCK] ^ SALT) * ODD).min(axis=1))
    keys = [xxhash.xxh64_intdigest(b.tobytes(), n) for n, b in enumerate(low.reshape(BANDS, DEPTH))]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those pairs (a, z) whose shingle sets are as similar as asked; a row with many pairs as a is salted."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(32)
        def known(text: str | None) -> np.ndarray:
            return np.unique(shingle_hashes(words_of(text), words))

        for batch in batches:
            hit = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                x, y = known(one.as_py()), known(two.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    dealt = pairs.join(shares, "a").select("a", "z", F.pmod(F.xxhash64("z"), F.col("shares")).cast("int").alias("share"))
    one = shares.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).join(texts.select(F.col("r").alias("a"), F.col("text").alias("one")), "a")
    two = dealt.join(texts.select(F.col("r").alias("z"), F.col("text").alias("two")), "z")
    return two.join(one.select("a", "share", "one"), ["a", "share"]).select("a", "z", "one", "two").mapInArrow(near, "a long, z long")


def bit_map(hashes: np.ndarray) -> list[int]:
    """The map of a set of hashes, as signed longs."""
    bits = np.zeros(64 * LONGS, bool)
    bits[(hashes >> np.uint64(40)) % np.uint64(64 * LONGS)] = True
    return np.packbits(bits).view(np.int64).tolist()


def _may_be_near(one: Column, two: Column, size_one: Column, size_two: Column, similarity: float) -> Column:
    """False only if the maps or the sizes of two texts rule out that similarity."""

    def lacking(x: Column, y: Column) -> Column:
        return reduce(Column.__add__, [F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i))))) for i in range(LONGS)])

    both = F.least(size_one - lacking(one, two), size_two - lacking(two, one))
    return both >= similarity * (size_one + size_two - both)


def near_copies(pairs: DataFrame, classes: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(r): the texts that have a near copy before them.

    pairs: (a, z), further candidates, written; classes: (o, r, size, bits, bands), one row a distinct text, written; rows: (r, text).
    """
    banded = classes.select("r", F.explode("bands").alias("b"))
    buckets = cut(banded.groupBy("b").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    mates = banded.join(buckets, "b").groupBy("r").agg(F.sum("n").alias("mates"))
    rank = F.struct((-F.coalesce("mates", F.lit(0))).alias("m"), "o").alias("rank")
    ranked = cut(classes.join(mates, "r", "left").select("r", rank, "size", "bits", "bands"), "ranked")
    named = ranked.select("r", "rank")
    known = pairs.join(named.toDF("a", "x"), "a").join(named.toDF("z", "y"), "z")
    known = cut(known.select(F.when(F.col("x") < F.col("y"), F.struct("a", "z")).otherwise(F.struct(F.col("z").alias("a"), F.col("a").alias("z"))).alias("p")).select("p.*").distinct(), "pairs")
    asked = cut(ranked.where("rank.m < 0").select("r").unionByName(known.select(F.explode(F.array("a", "z")).alias("r"))).distinct(), "asked")
    texts = cut(rows.join(small(asked), "r", "left_semi"), "texts")
    gone = cut(_verified(known, texts, words, similarity).select(F.col("z").alias("r")).distinct(), "gone", PAIR_ROWS)
    members = ranked.where("rank.m < 0").select("r", "rank", "size", "bits", F.explode("bands").alias("b")).join(buckets, "b").join(small(gone), "r", "left_anti")
    tried, leads_of, live = known, 1, None
    while True:
        old, live = live, cut(members, "live")
        free(old)
        if not live.limit(1).count():
            return gone
        slot = F.when(F.col("n") <= SMALL, F.col("r")).otherwise(F.pmod(F.xxhash64("r"), F.lit(leads_of)))
        leads = live.groupBy("b", slot.alias("slot")).agg(F.min(F.struct("rank", "r", "size", "bits")).alias("l")).select("b", F.col("l.r").alias("a"), F.col("l.rank").alias("rank1"), F.col("l.size").alias("size1"), F.col("l.bits").alias("bits1"))
        open_ = (F.col("rank1") < F.col("rank")) & _may_be_near(F.col("bits"), F.col("bits1"), F.col("size"), F.col("size1"), similarity)
        met = live.join(leads, (live.b == leads.b) & open_).select("a", F.col("r").alias("z")).distinct()
        met = cut(met.join(tried, ["a", "z"], "left_anti"), "pairs")
        found = cut(_verified(met, texts, words, similarity).select(F.col("z").alias("r")).distinct(), "gone", PAIR_ROWS)
        tried, gone = tried.unionByName(met), gone.unionByName(found)
        members = live.join(leads.select("b", F.col("a").alias("r")), ["b", "r"], "left_anti").join(small(found), "r", "left_anti").select(*live.columns)
        leads_of *= GROWTH
