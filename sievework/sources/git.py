"""Git reviews as a data source: one partition a request, read on executors, with rejects as rows.

``spark.read.format("git_reviews").option("requests", text)`` takes JSON lines of requests; ``read_requests`` a table of
any size. Repositories are in a folder that executors share. A request that can't be compared gives a row with an error
code, and the others go on.
"""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.patch import MAX_BYTES
from .readers import DIFF_OPTIONS, GIT_ENVIRONMENT, Refused, git_command, resolve_revision, worktree_root

REQUEST = ["review_id", "repository", "base", "target", "staged", "unstaged"]
ROW = "review_id long, repository string, raw_diff string, source string, base_revision string, base_oid string, target_revision string, target_oid string, repository_fingerprint string, diff_hash string, bytes long, error_code string, error string"
DEFAULTS = {"base": "HEAD", "target": None, "staged": True, "unstaged": True}
TIMEOUT = 30


def _limited(repository: str, arguments: list[str], most: int, timeout: float) -> bytes:
    """A git command's output; refused as soon as it is longer than most bytes or takes too long."""
    late = threading.Event()
    with subprocess.Popen(git_command(repository, *arguments), stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=os.environ | GIT_ENVIRONMENT) as run:
        timer = threading.Timer(timeout, lambda: (late.set(), run.kill()))
        timer.start()
        try:
            out = run.stdout.read(most + 1)
            if len(out) > most:
                run.kill()
                raise Refused("DIFF_TOO_LARGE", f"more than {most} bytes")
            code = run.wait()
        finally:
            timer.cancel()
    if late.is_set():
        raise Refused("GIT_TIMEOUT", f"no answer in {timeout:g} s")
    if code:
        raise Refused("GIT_FAILED", f"git gave {code}")
    return out


def compared(request: dict, most: int = MAX_BYTES, timeout: float = TIMEOUT) -> tuple:
    """The row of a request: what it compares, or why it can't be compared."""
    told = DEFAULTS | {k: v for k, v in request.items() if v is not None}
    base, target, staged, unstaged = (told[k] for k in DEFAULTS)
    source = "revision_range" if target else "worktree" if staged and unstaged else "staged" if staged else "unstaged"
    try:
        if not (target or staged or unstaged):
            raise Refused("NOTHING_TO_COMPARE", "neither the index nor the work tree")
        root = worktree_root(str(told["repository"]))
        first, last = resolve_revision(root, base), resolve_revision(root, target) if target else None
        which = [first, last] if last else [first] if staged and unstaged else ["--cached", first] if staged else []
        raw = _limited(root, ["diff", *DIFF_OPTIONS, *which, "--"], most, timeout)
        if not raw:
            raise Refused("EMPTY_DIFF", "nothing changed")
    except (Refused, OSError, KeyError, subprocess.SubprocessError) as e:
        code = e.code if isinstance(e, Refused) else "GIT_FAILED"
        return told.get("review_id"), told.get("repository"), None, source, base, None, target, None, None, None, None, code, str(e)
    text = raw.decode("utf-8", "replace")
    return told["review_id"], told["repository"], text, source, base, first, target, last, hashlib.sha256(root.encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), len(raw), None, None


class Request(InputPartition):
    def __init__(self, request: dict) -> None:
        self.request = request


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.requests = [json.loads(line) for line in options.get("requests", "").splitlines() if line.strip()]
        self.most, self.timeout = int(options.get("maxbytes", MAX_BYTES)), float(options.get("timeout", TIMEOUT))

    def partitions(self) -> list[InputPartition]:
        return [Request(r) for r in self.requests]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is not None:
            yield compared(partition.request, self.most, self.timeout)


class GitReviews(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_reviews"

    def schema(self) -> str:
        return ROW

    def reader(self, schema: T.StructType) -> GitReader:
        return GitReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitReviews)


def read_requests(requests: DataFrame, most: int = MAX_BYTES, timeout: float = TIMEOUT) -> DataFrame:
    """The rows of a table of requests (review_id, repository, and any of base, target, staged, unstaged)."""
    arrow = to_arrow_schema(T.StructType.fromDDL(ROW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for request in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, compared(request, most, timeout)))], arrow)

    known = [c for c in REQUEST if c in requests.columns]
    return requests.select(known).repartition("review_id").mapInArrow(run, ROW)
