"""SimHash near-dedup with covering locality-sensitive hashing.

A document's 64-bit SimHash is the bitwise majority of the XXH64 hashes of its word shingles. For radius r, each bit
gets a non-zero vector of r + 1 bits; every non-zero vector v of r + 1 bits gives a table whose mask keeps the bits
with odd inner product. Any r differing bits leave at least one v orthogonal to all their vectors, so any pair within
the radius agrees under that table's mask: no pair can be missed.

Defined cases: a null or wordless text has fingerprint 0 and links like any other; texts with fewer words than a
shingle hash as one shingle; repeated rows give repeated results; an empty table gives no rows; other columns are
ignored. Rows with a null key get a result with the component of their fingerprint.

Buckets of two fingerprints are verified as a pair. Members of larger buckets meet in the words half-way between them:
a second way to the same links, exact at any bucket size, without the pairs of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import copies
from .common import BROADCAST_ROWS, components, cut, small
from .shingles import digest_of, shingle_hashes, words_of

#: Hashes whose bits are counted at once: bounds memory on very long texts.
BLOCK = 65_536
ROW = "__row"


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash: a bit is set if more than half of the hashes set it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def simhash64(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    return majority(shingle_hashes(words_of(text), words))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp): the signed form of each row's SimHash. Narrow: no shuffle."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((simhash64(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=[key, "fp"])

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(hashed, f"{key} long, fp long")


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius + 1) - 1 masks over 64 bits, as signed longs; radius 0: the full mask."""
    count = (1 << (radius + 1)) - 1
    vectors = [1 + bit % count for bit in range(64)]
    masks = [sum(1 << bit for bit in range(64) if (vectors[bit] & v).bit_count() % 2) for v in range(1, count + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints linked by chains of steps of at most ``radius`` bits.

    prints: distinct column fp. Buckets of two are verified as pairs. Fingerprints in larger buckets are compared
    through the words half-way between them, of which each has a bounded number of neighbours; so a bucket of any size
    costs in proportion to its members and no pair of it is enumerated. Two words within an even radius meet in a word at
    most radius / 2 bits from both; within an odd radius r in one at most (r - 1) / 2 from one and (r + 1) / 2 from the other,
    so a word links its closer neighbours with all. A member has 65 such words at radius 1 and 2, 2,081 at 3 and 4, 43,745
    at 5 and 6.
    """
    tables = F.array(*[F.struct(F.lit(n).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for n, m in enumerate(covering_masks(radius))])
    rows = prints.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.k")
    buckets = cut(rows.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = buckets.where("n = 2").where(near).select("a", "b")
    crowded = rows.join(buckets.where("n > 2").select("t", "k"), ["t", "k"])
    if radius == 2:
        flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b) for b in range(64)])
        ball = crowded.select("fp").distinct().select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
        met = ball.groupBy("mid").agg(F.array_sort(F.collect_set("fp")).alias("fps")).where("size(fps) > 1")
        more = met.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b"))
    elif radius == 0:
        more = crowded.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    else:
        half = radius // 2
        near_flips = [sum(1 << b for b in bits) for n in range(radius - half + 1) for bits in combinations(range(64), n)]
        flips = prints.sparkSession.createDataFrame(pa.table({"flip": pa.array(np.array(near_flips, np.uint64).view(np.int64))}))
        ball = crowded.select("fp").distinct().crossJoin(F.broadcast(flips)).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), (F.bit_count("flip") <= half).alias("close"))
        hubs = ball.groupBy("mid").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("a"), F.count("*").alias("n")).where("n > 1 and a is not null").select("mid", "a")
        more = ball.join(hubs, "mid").where("a <> fp").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
    return pairs.unionByName(more).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: key, fp (signed), component_id (the least key reachable through links)."""
    marked = cut(fingerprints(docs, key, text, words), "simhash")
    groups = cut(marked.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), "prints")
    parts = cut(components(links(groups.select("fp"), radius)), "parts")
    heads = parts.join(groups, parts.id == groups.fp).groupBy("component").agg(F.min("least").alias("head"))
    joined = parts.join(heads, "component").select(F.col("id").alias("fp"), "head")
    classes = cut(groups.join(joined, "fp", "left").select("fp", F.coalesce("head", "least").alias("component_id"), "n"), "classes")
    # A fingerprint of so many rows is one of at most BROADCAST_ROWS: these are broadcast, so no task gets all rows of one.
    hot = F.col("n") > (groups.agg(F.sum("n")).first()[0] or 0) / BROADCAST_ROWS
    known = F.broadcast(classes.where(hot).drop("n"))
    cold = marked.join(known.select("fp"), "fp", "left_anti").join(classes.where(~hot).drop("n"), "fp")
    return marked.join(known, "fp").unionByName(cold).select(key, "fp", "component_id")


def _sketches(rows: DataFrame, key: str, text: str, words: int, similarity: float | None) -> DataFrame:
    """(o, mark, fp, size, bits, bands): a row's order, the digest of its words, its SimHash and, for a similarity, what copies.py needs.

    Rows are ordered by key, nulls last, then a hash of the text and the row's number. Narrow.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, prints, sizes, maps, keys = [], [], [], [], []
            for x in batch.column(3):
                found = words_of(x.as_py())
                hashes = shingle_hashes(found, words)
                marks.append(digest_of(found))
                prints.append(majority(hashes))
                distinct = np.unique(hashes) if similarity else hashes[:0]
                sizes.append(len(distinct))
                maps.append(copies.bit_map(distinct) if similarity else [])
                keys.append(copies.bands(distinct))
            fps = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(marks, pa.binary()), pa.array(fps), pa.array(sizes, pa.int64()), pa.array(maps, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], names=["r", "k", "t", "mark", "fp", "size", "bits", "bands"])

    told = rows.select(F.col(ROW).alias("r"), F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("x"))
    found = told.mapInArrow(sketched, f"r long, k {dict(rows.dtypes)[key]}, t long, mark binary, fp long, size long, bits array<long>, bands array<long>")
    return found.select(F.struct(F.col("k").isNull().alias("n"), "k", "t", "r").alias("o"), "mark", "fp", "size", "bits", "bands")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2, similarity: float | None = None) -> DataFrame:
    """docs, all columns, without near-duplicates: rows are ordered by key, nulls last, then a hash of the text and row number.

    Of equal texts the first row stays. Without a similarity texts link if their fingerprints do, within the radius, and the
    first text of each component stays. With one, a text goes if its shingle set has at least that Jaccard similarity with
    that of a text that ranks before it (copies.py tells the ranks); pairs of linked fingerprints are candidates, and pairs
    that copies.py finds, as no radius of 64 bits that can be paid for covers a similarity such as 0.8. So no two texts
    that stay are near copies, and each that goes has one.

    Defined cases: all null and wordless texts are one text; a row with a null or repeated key is a row of its own;
    identical rows leave one; an empty table gives no rows; columns may have any names but ``__row``.
    """
    rows = cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    marked = cut(_sketches(rows, key, text, words, similarity), "simhash")
    first = F.min_by(F.struct("o", "fp", "size", "bits", "bands"), "o").alias("h")
    classes = cut(marked.groupBy("mark").agg(first).select("h.*", F.col("h.o.r").alias("r")), "classes")
    prints = cut(classes.groupBy("fp").agg(F.min("r").alias("a")), "prints")
    same = classes.select("fp", F.col("r").alias("z")).join(prints, "fp").where("a <> z").select("a", "z")
    near = links(prints.select("fp"), radius).join(prints.select(F.col("fp").alias("a"), F.col("a").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("a").alias("z")), "b")
    tied = cut(same.unionByName(near.select(F.col("x").alias("a"), "z")), "tied")
    if similarity:
        gone = copies.near_copies(tied, classes, rows.select(F.col(ROW).alias("r"), F.col(text).alias("text")), words, similarity)
        kept = classes.select("r").join(gone, "r", "left_anti")
    else:
        parts = components(tied.select("a", F.col("z").alias("b")))
        whole = classes.select("o", "r").join(parts, classes.r == parts.id, "left").groupBy(F.coalesce("component", "r").alias("g"))
        kept = whole.agg(F.min("o").alias("o")).select(F.col("o.r").alias("r"))
    gone = cut(rows.select(ROW).join(kept, F.col(ROW) == kept.r, "left_anti"), "dropped")
    return rows.join(small(gone), ROW, "left_anti").select(*docs.columns)


def op9_simhash(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
