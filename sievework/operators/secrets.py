"""Secrets in patch lines: exact rules, suspected values, masking, and the disclosure gate."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Secret types and their patterns.
RULES = {"OPENAI_KEY": r"\bsk-[A-Za-z0-9]{32,}\b", "AWS_ACCESS_KEY": r"\bAKIA[A-Z0-9]{16}\b", "GITHUB_TOKEN": r"\bgh[opsu]_[A-Za-z0-9]{36,}\b"}
#: Suspected values: an assignment of a quoted value to a name that says secret, and enough different signs in it.
SUSPECTED = r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\b\s*[=:]\s*[\"']([A-Za-z0-9+/=_-]{16,})[\"']"
MIN_ENTROPY = 3.0
MASK = re.compile(r"<REDACTED:[A-Z0-9_]+:([0-9a-f]{12})>")


def entropy(value: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - (F.size(F.filter(chars, lambda x: x == c)) / n) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n))


def observations(lines: DataFrame) -> DataFrame:
    """(review_id, line_key, secret_type, value, level, status): all hits on all text lines, both sides."""
    def tagged(kind: str, pattern: str, group: int, level: str, status: str) -> Column:
        return F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(group)), lambda v: F.struct(F.lit(kind).alias("secret_type"), v.alias("value"), F.lit(level).alias("level"), F.lit(status).alias("status")))

    found = F.concat(*[tagged(t, p, 0, "E3", "confirmed") for t, p in RULES.items()], tagged("SUSPECTED_VALUE", SUSPECTED, 1, "E2", "suspected"))
    rows = lines.select("review_id", "line_key", "kind", "side", F.explode(found).alias("o")).select("review_id", "line_key", "kind", "side", "o.*")
    return rows.where((F.col("level") == "E3") | (entropy(F.col("value")) >= MIN_ENTROPY)).distinct()


def findings(seen: DataFrame) -> DataFrame:
    """Only added lines yield findings."""
    return seen.where("kind = 'addition'").select("review_id", "line_key", "secret_type", F.sha2("value", 256).alias("fingerprint"), "level", "status")


def mask_token(secret_type: Column, value: Column) -> Column:
    return F.concat(F.lit("<REDACTED:"), secret_type, F.lit(":"), F.substring(F.sha2(value, 256), 1, 12), F.lit(">"))


def masked_lines(lines: DataFrame, seen: DataFrame) -> DataFrame:
    """Lines with every hit masked: one text for all hits of a line; longest values first. Hashes of both texts."""
    marks = seen.groupBy("review_id", "line_key").agg(F.sort_array(F.collect_set(F.struct(F.length("value").alias("n"), "value", mask_token(F.col("secret_type"), F.col("value")).alias("mask"))), False).alias("marks"))
    out = lines.join(marks, ["review_id", "line_key"], "left")
    text = F.when(F.col("marks").isNull(), F.col("content")).otherwise(F.aggregate("marks", F.col("content"), lambda a, m: F.replace(a, m["value"], m["mask"])))
    out = out.withColumn("masked", text)
    return out.select("review_id", "line_key", "pos", "kind", "side", "file_path", F.col("masked").alias("content"), F.sha2("content", 256).alias("source_hash"), F.sha2("masked", 256).alias("content_hash"), F.col("marks").isNotNull().alias("redacted"))


def disclosure(masked: DataFrame, secret_status: DataFrame, max_lines: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(lines, status): lines only of reviews whose secret scan succeeded and that are within the limit; one status row each."""
    sizes = masked.groupBy("review_id").agg(F.count(F.when(F.col("kind") != "context", 1)).alias("changed"))
    status = secret_status.select("review_id", "skill_status").join(sizes, "review_id", "left").fillna(0, ["changed"])
    why = F.when(F.col("skill_status") != "success", "secret_scan_incomplete").when(F.col("changed") > max_lines, "changed_line_limit")
    status = status.select("review_id", why.isNull().alias("cloud_safe"), why.alias("reason"), "changed")
    return masked.join(status.where("cloud_safe").select("review_id"), "review_id", "left_semi"), status


def positional_mismatches(source: DataFrame, shown: DataFrame) -> DataFrame:
    """Reviews whose two line sequences are not the same keys in the same order."""
    place = F.row_number().over(W.partitionBy("review_id").orderBy("pos"))
    a = source.select("review_id", place.alias("n"), F.col("line_key").alias("a"))
    b = shown.select("review_id", place.alias("n"), F.col("line_key").alias("b"))
    both = a.join(b, ["review_id", "n"], "full_outer")
    return both.groupBy("review_id").agg(F.bool_or(~F.col("a").eqNullSafe(F.col("b"))).alias("bad")).where("bad").select("review_id")


def _behind(text: str, start: int, mark: str, piece: str, last: bool) -> int | None:
    """Where the text goes on behind a part that the mark stands for and the piece that follows it; None without one.

    The part is hashed on from one place of the piece to the next, so a text is read once whatever it repeats.
    """
    digest, read = hashlib.sha256(), start
    end = len(text) - len(piece) if last else text.find(piece, start + 1)
    if last and (end <= start or not text.endswith(piece)):
        return None
    while end >= 0:
        digest.update(text[read:end].encode())
        read = end
        if digest.copy().hexdigest().startswith(mark):
            return end + len(piece)
        end = -1 if last else text.find(piece, end + 1)
    return None


@F.pandas_udf(T.BooleanType())
def is_redaction_only(source: pd.Series, shown: pd.Series) -> pd.Series:
    """True where shown is source with some parts replaced by masks whose digests start as the parts' own do."""

    def proven(a: str | None, b: str | None) -> bool:
        if a is None or b is None:
            return a is b
        pieces, marks = MASK.split(b)[::2], MASK.findall(b)
        at = len(pieces[0]) if a.startswith(pieces[0]) else None
        for n, (mark, piece) in enumerate(zip(marks, pieces[1:], strict=True), 1):
            at = None if at is None else _behind(a, at, mark, piece, n == len(marks))
        return at == len(a)

    return pd.Series([proven(a, b) for a, b in zip(source, shown, strict=True)])
