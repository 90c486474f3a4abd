"""Equal rows in bulk: shards near one size, sources near their targets, long secrets whole."""

from pyspark.sql import functions as F

from sievework.llm import mixing, pii, sharding


def equal(spark, n, source="'one'"):
    return spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x " * 50).alias("text"), F.lit("en").alias("lang"), F.expr(source).alias("source"), F.lit(100).cast("long").alias("n_chars"))


def others(spark, n):
    text = F.concat(F.lit("y "), F.repeat(F.lit("z "), (F.col("id") % 60).cast("int")))
    return spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("fr").alias("lang"), F.when(F.col("id") % 2 == 0, "one").otherwise("two").alias("source"), F.length(text).cast("long").alias("n_chars"))


def test_shards_of_equal_rows(spark):
    for docs in (equal(spark, 1600), equal(spark, 800).unionByName(others(spark, 800))):
        sizes = [r.b for r in sharding.op1_sharding(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
        mean = sum(sizes) / 16
        assert len(sizes) == 16 and max(abs(s - mean) for s in sizes) <= 2 * 122


def test_mix_of_equal_rows(spark):
    halves = equal(spark, 600, "CASE WHEN id < 300 THEN 'one' ELSE 'two' END")
    for docs in (halves, halves.unionByName(others(spark, 600))):
        out = mixing.op5_mixing(docs).cache()
        for r in out.groupBy("target").agg(F.sum("taken").alias("t"), F.max("size").alias("largest")).collect():
            assert abs(r.t - r.target) <= r.largest
        assert out.where("taken > 3 * size").count() == 0
        told = {r.source: r.w for r in mixing.mix_documents(docs).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " +"))).alias("w")).collect()}
        assert sorted(told.values()) == sorted(r.t for r in out.groupBy("target").agg(F.sum("taken").alias("t")).collect())


def test_secrets_of_any_length(spark):
    texts = ["key sk-" + "aB3" * 30 + " end", "key " + "0af9" * 20 + " end", "key sk-" + "aB3" * 5 + " end"]
    spans = [r.spans for r in pii.op3_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert spans[0] == "secret:4:97" and spans[1] == "secret:4:84" and "secret" not in spans[2]
