"""The pipeline and each of its stages on tables with every odd case, and on none."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, r long, component string, spans string, id string, taken int, part int, offset int"
TEXTS = [None, "", "  \n\t", "one", "a plain text of several words that stays", "a plain text of several words that stays", "A Plain text of several words that stays", "you stupid worthless idiot, shut up you moron", "mail me at someone@example.org or 10.0.0.1 please do it now", "word " * 30_000, "tie", "tie", "漢字 é \U0001f600 text with signs of many kinds in it"]


def rows():
    out = [(i, t, "en", None if i == 3 else f"s{i % 3}", len(t or ""), *[None] * 9) for i, t in enumerate(TEXTS)]
    return [*out, out[4], (None, "a text without a key", None, None, None, *[None] * 9), (None, "another text without a key", None, None, None, *[None] * 9), (4, "another text under a key that is taken", "en", "s1", 10, *[None] * 9)]


@pytest.fixture
def folder(spark, tmp_path):
    def write(table, labels=((7, 1, 1), (4, 1, 0), (None, 0, 0), (4, 0, 1), (99, 1, None))):
        spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return write


def test_every_stage_on_odd_rows(spark, folder):
    sf = folder(rows())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda frame: sorted((str(r.doc_id), str(r.text)) for r in frame.select("doc_id", "text").collect())
    every = texts(docs)
    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns and texts(clean) == sorted(t for t in every if t[0] != "7")
    unique = stages["simhash_near_dedup"](spark, docs, sf)
    left = texts(unique)
    assert unique.columns == docs.columns and [k for k, _ in left].count("None") == 2 and ("4", "another text under a key that is taken") in left
    assert left == sorted([("0", "None"), ("3", "one"), ("4", TEXTS[4]), ("4", "another text under a key that is taken"), ("7", TEXTS[7]), ("8", TEXTS[8]), ("9", TEXTS[9]), ("10", "tie"), ("12", TEXTS[12]), ("None", "a text without a key"), ("None", "another text without a key")])
    masked = stages["pii"](spark, docs, sf)
    told = {r.doc_id: r for r in masked.where("doc_id in (0, 8, 9)").collect()}
    assert masked.columns == docs.columns and masked.count() == len(every) and told[0].text is None and told[9].text == TEXTS[9]
    assert told[8].text == "mail me at <EMAIL> or <IP> please do it now" and told[8].n_chars == len(told[8].text)
    mixed = stages["mixing"](spark, docs, sf)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 9
    packed = stages["packing"](spark, docs, sf)
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    whole = packed.where("doc_id = 9").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).first()
    assert per <= 4096 and whole.n == whole.t == 30_001 and packed.where("doc_id is null").count() == 2


def test_the_whole_run_on_odd_rows_and_on_none(spark, folder, tmp_path):
    sf = folder(rows())
    out = corpus_pipeline.run(spark, sf)
    assert out.where("doc_id = 7").count() == 0 and out.where("doc_id is null").count() >= 1 and out.count() > 8
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_a_run_without_rows(spark, folder):
    out = corpus_pipeline.run(spark, folder([], labels=()))
    assert out.count() == 0 and "sequence_id" in out.columns


def test_a_run_leaves_no_tables_but_its_result(spark, folder):
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    from pathlib import Path

    sf = folder(rows())
    before = {p.name for d in Path(root).glob("sievework-*") for p in d.iterdir()}
    out = corpus_pipeline.run(spark, sf)
    left = {p.name.rsplit("-", 1)[0] for d in Path(root).glob("sievework-*") for p in d.iterdir() if p.name not in before}
    assert left == {"packing"} and out.count() > 0
