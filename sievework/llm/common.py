"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import BATCH_ROWS, BROADCAST_ROWS, batches_of, cut, free, kept, released, scratch_root, small

__all__ = ["BATCH_ROWS", "BROADCAST_ROWS", "batches_of", "components", "crc32_sql", "cut", "empty_like", "free", "held_out_rows", "kept", "released", "scratch_root", "small", "with_length"]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b: long): one row (id, component) per node, component the least id.

    Alternating large-star and small-star rounds, each written to the shared folder; no adjacency list is collected.
    Self-loops and repeated edges are allowed; no edges give no rows.
    """
    state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == before:
            break
        before = tuple(mark)
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = linked.unionByName(low.select("u", F.col("m").alias("v")))
        old, state = state, cut(step.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        free(old)
    leaves = state.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.unionByName(state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def held_out_rows(key: str = "doc_id") -> F.Column:
    """True where crc32 of the key as text leaves no remainder by 5: these rows never train a model."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_length(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with the column of text lengths, if there is one, brought up to date."""
    return docs.withColumn(length, F.length(F.col(text)).cast(dict(docs.dtypes)[length])) if length in docs.columns else docs


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's ASCII characters: each one, then eight shifts."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
