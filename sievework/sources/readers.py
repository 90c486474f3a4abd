"""Sources: patches (files or a Git work tree), strict JSON documents, the policy, package digests."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.patch import MAX_BYTES
from ..operators.transport import canonical

MAX_DOCUMENT_BYTES = 2_097_152
# What a revision may look like, and an object id.
REVISION = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_./~^@{}-]*")
OBJECT_ID = re.compile(r"[0-9a-f]{40}|[0-9a-f]{64}")
# Options that make a diff the same on every machine.
DIFF_OPTIONS = ["--no-ext-diff", "--no-textconv", "--no-color", "--full-index", "--find-renames=50%", "--unified=3", "--submodule=short"]


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw_diff): one patch a file, invalid UTF-8 replaced."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("raw_diff"))


GIT_ENVIRONMENT = {"GIT_TERMINAL_PROMPT": "0"}


class Refused(ValueError):
    """A request that can't be compared, with the code of the reason."""

    def __init__(self, code: str, why: str) -> None:
        super().__init__(why)
        self.code = code


def git_command(repository: str, *arguments: str) -> list[str]:
    """A read-only git command: no locks, no pager."""
    return ["git", "--no-optional-locks", "--no-pager", "-C", repository, *arguments]


def _git(repository: str, *arguments: str, timeout: int = 30) -> str:
    run = subprocess.run(git_command(repository, *arguments), capture_output=True, timeout=timeout, check=True, env=os.environ | GIT_ENVIRONMENT)
    return run.stdout.decode("utf-8", "replace")


def worktree_root(path: str) -> str:
    """The resolved path, refused if it is not the root of a git work tree."""
    root = Path(path).resolve(strict=True)
    try:
        top = Path(_git(str(root), "rev-parse", "--show-toplevel").strip()).resolve(strict=True)
    except subprocess.CalledProcessError as e:
        raise Refused("NOT_A_WORK_TREE", "not a git work tree") from e
    if top != root:
        raise Refused("NOT_A_WORK_TREE", "not the root of its work tree")
    return str(root)


def resolve_revision(repository: str, revision: str) -> str:
    """The commit's object id."""
    if not REVISION.fullmatch(revision):
        raise Refused("UNSAFE_REVISION", "unsafe revision")
    try:
        found = _git(repository, "rev-parse", "--verify", "--quiet", "--end-of-options", f"{revision}^{{commit}}").strip().lower()
    except subprocess.CalledProcessError as e:
        raise Refused("NO_SUCH_COMMIT", "no such commit") from e
    if not OBJECT_ID.fullmatch(found):
        raise Refused("NO_SUCH_COMMIT", "git gave no object id")
    return found


def git_diff(repository: str, base: str = "HEAD", target: str | None = None, staged: bool = True, unstaged: bool = True, timeout: int = 30) -> str:
    """The patch between two revisions, or of index and work tree, the index, or the work tree alone; read-only, on the driver."""
    first = resolve_revision(repository, base)
    if target is None and not (staged or unstaged):
        raise ValueError("nothing to compare")
    which = [first, resolve_revision(repository, target)] if target else [first] if staged and unstaged else ["--cached", first] if staged else []
    return _git(repository, "diff", *DIFF_OPTIONS, *which, "--", timeout=timeout)


def read_review(spark: SparkSession, review_id: int, repository: str, base: str = "HEAD", target: str | None = None, staged: bool = True, unstaged: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row of what a review compares: (review_id, raw_diff, source, base_oid, target_oid, diff_hash, bytes).

    A patch that is empty or larger than the cap is refused, not cut.
    """
    root = worktree_root(repository)
    raw = git_diff(root, base, target, staged, unstaged)
    size = len(raw.encode())
    if not 1 <= size <= max_bytes:
        raise ValueError(f"a patch of {size} bytes")
    source = "revision_range" if target else "worktree" if staged and unstaged else "staged" if staged else "unstaged"
    row = (review_id, raw, source, resolve_revision(root, base), resolve_revision(root, target) if target else None, hashlib.sha256(raw.encode()).hexdigest(), size)
    return spark.createDataFrame([row], "review_id long, raw_diff string, source string, base_oid string, target_oid string, diff_hash string, bytes long")


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) JSON objects: at most 2 MiB, UTF-8, no repeated keys; accepted with their canonical form and digest."""
    raw = spark.read.format("binaryFile").load(path).select("path", "length", F.when(F.col("length") <= MAX_DOCUMENT_BYTES, F.decode("content", "UTF-8")).alias("text"), F.sha2("content", 256).alias("sha256"))
    both = raw.withColumn("canonical", canonical("text"))
    good = F.coalesce(F.col("canonical").startswith("{"), F.lit(False))
    return both.where(good), both.where(~good).select("path", "length")


# The fields of the documents that roles exchange, in their order.
DELIVERY = ["schema_name", "schema_version", "review_id", "trace_id", "task_id", "parent_task_id", "role", "attempt", "status", "input_artifacts", "output", "evidence", "started_at", "finished_at", "model_usage", "output_sha256"]
ASSIGNMENT = ["schema_name", "schema_version", "review_id", "trace_id", "task_id", "parent_task_id", "role", "attempt", "skill_name", "skill_version", "review_input", "role_context", "deadline_at", "delivery_ref"]
CONTEXT = ["schema_name", "schema_version", "review_id", "role", "source_artifact_ids", "lines", "metadata", "cloud_safe"]


def read_fields(spark: SparkSession, path: str, fields: list[str], exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) JSON objects of exactly these fields; exact: whose bytes are their canonical form.

    accepted: (path, canonical, sha256); rejected: (path, reason).
    """
    raw = spark.read.format("binaryFile").load(path).select("path", "length", F.when(F.col("length") <= MAX_DOCUMENT_BYTES, F.col("content")).alias("content"))
    both = raw.withColumns({"canonical": canonical(F.make_valid_utf8(F.col("content").cast("string"))), "sha256": F.sha2("content", 256)})
    keys = F.array_sort(F.coalesce(F.json_object_keys("canonical"), F.array().cast("array<string>")))
    reason = F.when(F.col("content").isNull(), "TOO_LARGE").when(F.col("canonical").isNull() | ~F.col("canonical").startswith("{"), "NOT_AN_OBJECT").when(keys != F.array(*map(F.lit, sorted(fields))), "FIELDS").when(F.lit(exact) & (F.col("canonical").cast("binary") != F.col("content")), "NOT_CANONICAL")
    told = both.withColumn("reason", reason)
    return told.where("reason is null").select("path", "canonical", "sha256"), told.where("reason is not null").select("path", "reason")


def read_deliveries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_fields(spark, path, DELIVERY, exact=False)


def read_assignments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_fields(spark, path, ASSIGNMENT)


def read_role_contexts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_fields(spark, path, CONTEXT)


def package_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the files below path, relative to it; a local folder with a symbolic link in it is refused."""
    local = Path(path)
    if local.exists() and any(p.is_symlink() for p in [local, *local.rglob("*")]):
        raise ValueError("a package holds no symbolic links")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = re.escape(str(local.resolve()) if local.exists() else path.rstrip("/"))
    return files.select(F.regexp_replace("path", f"^.*?{root}/", "").alias("path"), F.sha2("content", 256).alias("sha256"))


def read_settings(path: str | None = None, keys: tuple[str, ...] = (), environment: dict[str, str] | None = None) -> dict[str, str]:
    """Settings of a file of KEY=VALUE lines and the environment, which wins; for the driver only, never a column."""
    found = {}
    for line in Path(path).read_text().splitlines() if path else ():
        name, mark, value = line.strip().partition("=")
        if mark and not name.startswith("#"):
            found[name.removeprefix("export ").strip()] = value.strip().strip("'\"")
    own = os.environ if environment is None else environment
    found |= {k: own[k] for k in {*found, *keys} if own.get(k)}
    if missing := [k for k in keys if not found.get(k)]:
        raise KeyError(", ".join(missing))
    return {k: v for k, v in found.items() if not keys or k in keys}


def load_policy(path: str, sha256: str | None = None) -> dict:
    """A TOML policy, refused if its digest is not the pinned one."""
    raw = Path(path).read_bytes()
    if sha256 and hashlib.sha256(raw).hexdigest() != sha256:
        raise ValueError("policy digest differs from the pinned one")
    return tomllib.loads(raw.decode())
