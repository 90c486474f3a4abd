"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, graph, merkle, mixing, packing, pii, quality, repair, sharding, simhash, topk, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(table: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(_table(spark, sf_dir, table))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": _over("documents", sharding.op1_sharding),
        "op2_toxicity": lambda spark, d: toxicity.op2_toxicity(_table(spark, d, "documents"), _table(spark, d, "labels")),
        "op3_pii": _over("documents", pii.op3_pii),
        "op4_audio": _over("documents", audio.op4_audio),
        "op5_mixing": _over("documents", mixing.op5_mixing),
        "op6_urls": _over("pages", urls.op6_urls),
        "op7_packing": _over("documents", packing.op7_packing),
        "op8_quality": lambda spark, d: quality.op8_quality(_table(spark, d, "documents"), _table(spark, d, "labels")),
        "op10_graph": _over("embeddings", graph.op10_graph),
        "op9_simhash": _over("documents", simhash.op9_simhash),
        "op11_repair": _over("conversations", repair.op11_repair),
        "op12_merkle": _over("documents", merkle.op12_merkle),
        "op13_topk": _over("embeddings", topk.op13_topk),
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_repair": repair.oracle(), "op12_merkle": merkle.oracle(), "op13_topk": topk.ORACLE}
