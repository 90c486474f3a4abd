"""Sinks: bundles of relations with a manifest of hashes, deliveries, JSON lines of traces, a Markdown report."""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_shared_path, markdown_cell
from .files import write_files

# A name that may become a folder.
SAFE_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{2,127}")


def preflight(name: str, root: str, target: str) -> str:
    """The local folder that a review's output goes to, refused before any work if it must not be written.

    The name must be safe, the folder new, inside the root and outside the reviewed tree, and the root no symbolic link.
    """
    if not SAFE_ID.fullmatch(name):
        raise ValueError("an unsafe name")
    folder = Path(root)
    if folder.is_symlink():
        raise ValueError("the output folder is a symbolic link")
    planned, tree = (folder / name).resolve(), Path(target).resolve(strict=True)
    if planned.is_relative_to(tree):
        raise ValueError("the output would change the reviewed tree")
    if planned.exists():
        raise FileExistsError(str(planned))
    return str(planned)


def write_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each relation as Parquet below a staging folder, then move it to path at once.

    Returns the manifest: (relation, file, sha256, rows), one row a file.
    """
    spark = next(iter(tables.values())).sparkSession
    jvm = spark.sparkContext._jvm
    staging, final = jvm.org.apache.hadoop.fs.Path(f"{path}.staging"), jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise FileExistsError(path)
    fs.delete(staging, True)
    for name, rows in tables.items():
        rows.write.parquet(f"{path}.staging/{name}")
    counts = spark.createDataFrame([(name, spark.read.parquet(f"{path}.staging/{name}").count()) for name in tables], "relation string, rows long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}.staging")
    parts = F.split("path", "/")
    told = files.select(F.element_at(parts, -2).alias("relation"), F.element_at(parts, -1).alias("file"), F.sha2("content", 256).alias("sha256")).join(counts, "relation", "full_outer")
    told.coalesce(1).write.json(f"{path}.staging/manifest")
    if not fs.rename(staging, final):
        raise OSError(f"cannot move to {path}")
    return spark.read.json(f"{path}/manifest")


def changed_files(path: str, spark: SparkSession) -> DataFrame:
    """(relation, file) of a bundle whose content is not what its manifest says."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    parts = F.split("path", "/")
    now = files.select(F.element_at(parts, -2).alias("relation"), F.element_at(parts, -1).alias("file"), F.sha2("content", 256).alias("now"))
    told = spark.read.json(f"{path}/manifest").where("file is not null").select("relation", "file", "sha256")
    return told.join(now, ["relation", "file"], "full_outer").where("not now <=> sha256").select("relation", "file")


def bundle_rows(tables: dict[str, DataFrame], key: str = "review_id") -> DataFrame:
    """(review_id, file, value): every relation's rows as JSON lines of one file a relation, to be written by review."""
    parts = [rows.select(key, F.lit(f"{name}.jsonl").alias("file"), F.to_json(F.struct(*sorted(c for c in rows.columns if c != key))).alias("value")) for name, rows in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def write_deliveries(delivery: DataFrame, assignment: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Write deliveries (task_id, ref, text), each at exactly the place assigned to its task, below root; returns (written, refused).

    All files of a call appear together, in a folder that must not exist; two deliveries for one place are an error.
    """
    both = delivery.join(assignment.select("task_id", F.col("delivery_ref").alias("wanted")), "task_id", "left")
    good = F.coalesce((F.col("ref") == F.col("wanted")) & is_shared_path(F.col("ref")), F.lit(False))
    write_files(both.where(good).select(F.col("ref").alias("path"), F.col("text").alias("content")), root)
    return both.where(good).drop("wanted"), both.where(~good).drop("wanted")


def trace_lines(trace: DataFrame) -> DataFrame:
    """(review_id, value): one JSON line an event, to be written as text by review."""
    return trace.select("review_id", F.to_json(F.struct(*sorted(trace.columns))).alias("value"))


def markdown_report(decision: DataFrame, finding: DataFrame) -> DataFrame:
    """(review_id, report): status and a table of findings by id."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "finding_id", "severity", "status", markdown_cell(F.col("category"))), F.lit(" |"))
    listed = finding.groupBy("review_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("finding_id", row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    head = F.concat(F.lit("# Review "), F.col("review_id").cast("string"), F.lit("\n\nStatus: "), F.col("status"), F.lit("\n\n| finding | severity | status | category |\n|---|---|---|---|\n"))
    return decision.join(listed, "review_id", "left").select("review_id", F.concat(head, F.coalesce("rows", F.lit(""))).alias("report"))
