"""A training corpus from raw documents: toxicity, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared
folder and reads them again as the next stage's docs; what a stage wrote on its way is deleted then. SQL cannot express
the trained stages, so there is no ORACLE_SQL.

In every stage columns may have any names (but ``__row`` and ``__spans``), rows may repeat, and an empty table gives an
empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sievework.llm import common, mixing, packing, pii, simhash, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained classifier scores below one half; trained on these documents' labels.

    Null and empty texts have no hits and stay; rows without a key are scored like others; without labels the classifier
    keeps its built-in weights; equal texts get equal scores, so ties stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash over shingles of five words, then their similarity of 0.8 or more.

    No two documents that stay are near copies, and each that goes has one. Of equal texts the least key stays, nulls last.
    Null and wordless texts are one group; rows with a null or repeated key are rows of their own; identical rows leave
    one; texts of any length count whole.
    """
    return simhash.drop_near_duplicates(docs, words=5, similarity=0.8)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text.

    Null and empty texts stay as they are, and so do texts without personal data; rows are neither dropped nor merged.
    """
    masked = pii.mask_documents(docs)
    return common.with_length(masked)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for: a row repeats at most three times, or is left out.

    A null source is a source; null and empty texts have no words and are taken as often as their source's whole
    repetitions; rows that share key and size share one decision; reruns agree.
    """
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4,096 tokens, every token of every row in exactly one.

    Null and empty texts are the end token alone; repeated rows are packed as often as they occur; keys may be null.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", reject_toxic), ("simhash_near_dedup", drop_copies), ("pii", mask_personal_data), ("mixing", mix_sources), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with common.released():
            out = stage(spark, before, sf_dir)
            with common.kept():
                docs = common.cut(out, name)
        common.free(before)
    return docs
