"""Sharding by a k-d tree, in DataFrame functions only.

Every row is a point of metadata coordinates with a weight (its bytes). A node that holds more than one shard is split
at the weighted median along its widest dimension, until every leaf holds one. All nodes of a level are split together:
one aggregation gives their extents, and the medians are found by radix selection: passes over bins of the coordinate
followed by ties, of which only the bin that the median lies in comes back for each node. A tie is a hash of the row and
then one of its number, fixed when the points are written: points that share a coordinate, and rows that are equal, are
split as evenly as any; a source or a group of copies of any size may span shards.

Defined cases: a null text has no bytes and weighs 1, and its CRC is 0; null metadata are coordinate 0; repeated rows
are placed each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, free, small

SHARDS, STEP, TOLERANCE = 16, 13, 2e-4
#: Rows of a shard numbered in one task.
SLOT_ROWS, LEAST_BUCKETS = 20_000, 64


def metadata_dimensions(columns: list[str]) -> list[Column]:
    """Coordinates of the documents table: log size, then those of the columns that are there."""
    known = {"n_chars": F.col("n_chars"), "lang": F.crc32(F.col("lang").cast("binary")), "source": F.crc32(F.col("source").cast("binary")), "doc_id": F.col("doc_id")}
    return [F.log2("size"), *(known[c] for c in known if c in columns)]


def _scaled(points: DataFrame, count: int) -> DataFrame:
    """Coordinates as whole numbers of 31 bits, each dimension over its own extent."""
    ends = points.agg(*[f(F.get("at", F.lit(i))).alias(f"{n}{i}") for i in range(count) for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def one(i: int) -> Column:
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        wide = hi is not None and hi > lo
        value = (F.get("at", F.lit(i)) - F.lit(lo)) / F.lit(hi - lo) if wide else F.lit(0.0)
        return F.floor(F.coalesce(value, F.lit(0.0)) * (2**31 - 1)).cast("long")

    return points.withColumn("at", F.array(*[one(i) for i in range(count)]))


def _split(state: DataFrame, counts: dict[int, int], dims: int) -> DataFrame:
    """state with every node of more than one shard split in two; a node is named by its first shard."""
    spark = state.sparkSession
    open_nodes = [n for n, k in counts.items() if k > 1]
    extents = [f(F.get("at", F.lit(i))) for i in range(dims) for f in (F.min, F.max)]
    split = small(spark.createDataFrame([(n,) for n in open_nodes], "node long"))
    rows = state.join(split, "node").groupBy("node").agg(F.sum("size"), *extents).collect()  # as many as nodes
    search = {}
    for r in rows:
        widths = [r[3 + 2 * i] - r[2 + 2 * i] for i in range(dims)]
        half = counts[r[0]] // 2
        search[r[0]] = {"dim": widths.index(max(widths)), "want": r[1] * half / counts[r[0]], "far": TOLERANCE * r[1] / counts[r[0]], "lo": 0, "half": half, "done": False}
    shift = 62 - STEP
    while shift > -STEP and not all(s["done"] for s in search.values()):
        width = STEP + min(shift, 0)
        at = max(shift, 0)
        table = spark.createDataFrame([(n, s["dim"], s["lo"], s["want"]) for n, s in search.items() if not s["done"]], "node long, dim int, lo long, want double")
        inside = state.join(F.broadcast(table), "node").withColumn("order", _order(F.col("dim")))
        bins = inside.withColumn("bin", F.shiftright(F.col("order") - F.col("lo"), at)).where((F.col("order") >= F.col("lo")) & (F.col("bin") < 2**width)).groupBy("node", "bin").agg(F.sum("size").alias("s"), F.first("want").alias("want"))
        run = F.sum("s").over(W.partitionBy("node").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        met = bins.withColumn("run", run).where((F.col("run") - F.col("s") <= F.col("want")) & (F.col("want") < F.col("run"))).select("node", "bin", "s", (F.col("run") - F.col("s")).alias("before"))
        for r in met.collect():  # one a node
            s = search[r["node"]]
            s["lo"] += r["bin"] << at
            s["want"] -= r["before"]
            if r["s"] <= s["far"] or shift <= 0:
                s["done"] = True
                s["lo"] += (1 << at) if s["want"] * 2 > r["s"] else 0
        shift -= STEP
    table = spark.createDataFrame([(n, s["dim"], s["lo"], s["half"]) for n, s in search.items()], "node long, dim int, cut long, half long")
    moved = F.when(_order(F.col("dim")) >= F.col("cut"), F.col("node") + F.col("half")).otherwise(F.col("node"))
    for n, s in search.items():
        counts[n + s["half"]] = counts[n] - s["half"]
        counts[n] = s["half"]
    return cut(state.join(F.broadcast(table), "node", "left").withColumn("node", F.coalesce(moved, F.col("node"))).select(*state.columns), "kd")


def _order(dim: Column) -> Column:
    """Coordinate, then a hash for ties, in 62 bits."""
    return F.shiftleft(F.get("at", dim), 31) + F.col("tie")


def kd_shards(docs: DataFrame, dimensions: list[Column] | None = None, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot): shards of near equal bytes, and gapless places in them.

    dimensions may use all columns of docs and size; shards is as given, or what the target bytes of a leaf ask for.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    sized = docs.withColumns({"size": (F.octet_length(body) + 1).cast("long"), "__crc": F.crc32(body.cast("binary"))})
    dims = dimensions if dimensions is not None else metadata_dimensions(docs.columns)
    # 31 bits: the row's hash, then its number in the written table, so that equal rows are parted too.
    tie = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.col(key), F.col("__crc"), F.col("size")), 48), 15) + F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 49)
    points = cut(sized.select(F.col(key), "size", F.col("__crc").alias("text_crc32"), F.array(*[d.cast("double") for d in dims]).alias("at"), tie.alias("tie"), F.lit(0).cast("long").alias("node")), "points")
    count, total = points.agg(F.count("*"), F.sum("size")).first()
    leaves = shards or max(1, math.ceil((total or 0) / (target_bytes or 1 << 28)))
    state, counts = _scaled(points, len(dims)), {0: leaves}
    while count and any(k > 1 for k in counts.values()):
        before, old = dict(counts), state
        state = _split(state, counts, len(dims))
        free(old)
        if counts == before:
            break  # only nodes without rows are left
    return _numbered(state, count, leaves, key)


def _numbered(state: DataFrame, count: int, leaves: int, key: str) -> DataFrame:
    """Slots: a row number in each of many buckets of a shard, after the rows of the shard's earlier buckets."""
    buckets = max(LEAST_BUCKETS, count // (leaves * SLOT_ROWS))
    rows = state.withColumn("bucket", F.pmod(F.xxhash64("tie", F.col(key)), F.lit(buckets)))
    sizes = rows.groupBy("node", "bucket").agg(F.count("*").alias("n"))
    run = F.sum("n").over(W.partitionBy("node").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    starts = cut(sizes.select("node", "bucket", run.alias("start")), "starts")
    place = F.row_number().over(W.partitionBy("node", "bucket").orderBy(key, "text_crc32", "size")) - 1
    return rows.withColumn("place", place).join(small(starts), ["node", "bucket"]).select(key, "size", "text_crc32", F.col("node").cast("int").alias("shard"), (F.col("start") + F.col("place")).alias("slot"))


def op1_sharding(docs: DataFrame) -> DataFrame:
    out = kd_shards(docs, shards=SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
