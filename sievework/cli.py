"""Decide a folder of patches: ``python -m sievework.cli PATCHES OUT``; the exit code is that of the worst review.

Without more, only what patches alone can tell is decided: secrets (new-side, exact rules), files out of scope, broken hunks;
the result holds files, masked lines, findings and decisions. With ``--outcomes``, JSON lines of what the reviewing agents
came to (path, agent_id, status, error_code), whole runs are decided with one recheck, and OUT holds a folder of twelve files
and a manifest for each review.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalars import EXIT_CODE, GATE_RANK, rank
from .operators import assembly, patch, policy, secrets
from .operators.run import ReviewRun
from .session import build_session
from .sources import bundles, files, readers, sinks


def decide_patches(patches: DataFrame, max_lines: int = patch.MAX_LINES) -> dict[str, DataFrame]:
    """Relations of (review_id, raw_diff)."""
    small, large = patch.within_bytes(patches)
    lines = patch.raw_lines(small)
    body, files = patch.numbered(lines), patch.files(lines, max_lines)
    rows = patch.source_lines(body, files).withColumns({"line_key": F.xxhash64("hunk_id", "ordinal", "side"), "pos": F.col("ordinal")})
    seen = secrets.observations(rows)
    found = secrets.findings(seen).where("level = 'E3'").select("review_id", F.concat_ws(":", F.lit("secret"), "line_key", F.substring("fingerprint", 1, 12)).alias("finding_id"), F.lit("secret").alias("category"), F.lit("high").alias("severity"), "status")
    broken = patch.broken_hunks(lines).select("review_id").unionByName(large.select("review_id")).distinct()
    held = found.select("review_id", F.lit("B001").alias("rule")).unionByName(assembly.out_of_scope(files).select("review_id", F.lit("N002").alias("rule")))
    rules = held.groupBy("review_id").agg(F.collect_set("rule").alias("rules"))
    reviews = patches.select("review_id").distinct().join(rules, "review_id", "left").join(broken.withColumn("failure", F.lit(policy.INPUT_FAILURE)), "review_id", "left")
    return {"files": files, "lines": secrets.masked_lines(rows, seen), "findings": found, "decisions": policy.decided(reviews)}


def run_patches(patches: DataFrame, outcomes: DataFrame, out: str, max_lines: int = patch.MAX_LINES) -> DataFrame:
    """Whole runs of (review_id, raw_diff) with the agents' outcomes: their files below out, and their decisions."""
    run = ReviewRun(patches, outcomes, max_lines=max_lines)
    files.write_files(files.at_paths(bundles.review_files(run)), out)
    return run.decisions


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("patches")
    parser.add_argument("out")
    parser.add_argument("--outcomes")
    parser.add_argument("--max-changed-lines", type=int, default=patch.MAX_LINES, choices=range(1, 5001), metavar="1..5000")
    args = parser.parse_args(argv)
    spark = build_session(app="sievework")
    patches = readers.read_patches(spark, args.patches).select(F.xxhash64("path").alias("review_id"), "raw_diff")
    if args.outcomes:
        known = readers.read_patches(spark, args.patches).select(F.xxhash64("path").alias("review_id"), F.element_at(F.split("path", "/"), -1).alias("path"))
        told = spark.read.schema("path string, agent_id string, status string, error_code string, repair_exhausted boolean").json(args.outcomes).fillna(False, ["repair_exhausted"])
        decisions = run_patches(patches, told.join(known, "path").drop("path"), args.out, args.max_changed_lines)
    else:
        sinks.write_bundle(decide_patches(patches, args.max_changed_lines), args.out)
        decisions = spark.read.parquet(f"{args.out}/decisions")
    worst = decisions.agg(F.max_by("status", rank(F.col("status"), GATE_RANK))).first()[0]
    return EXIT_CODE.get(worst or "PASS", 3)


if __name__ == "__main__":
    sys.exit(main())
