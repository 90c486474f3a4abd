"""Unified patches as relations: sections, hunks, numbered lines, files.

Input: (review_id, raw_diff). A patch is split at line feeds (a trailing carriage return goes); the header scan of a
section ends at its first hunk. Counters are windows inside a section or hunk, so reviews are the unit of parallelism.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import content_hash, is_language_python, stable_id

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(?:.*)$"
NO_NEWLINE = r"\ No newline at end of file"
MAX_BYTES, MAX_LINES = 10_485_760, 1000


def within_bytes(patches: DataFrame, limit: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): patches are rejected whole, never cut."""
    fits = F.octet_length("raw_diff") <= limit
    return patches.where(fits), patches.where(~fits)


def raw_lines(patches: DataFrame) -> DataFrame:
    """(review_id, pos, text, section, hunk): section counts file headers so far, hunk the hunk headers in the section."""
    lines = patches.select("review_id", F.posexplode(F.split("raw_diff", "\n")).alias("pos", "text")).withColumn("text", F.regexp_replace("text", r"\r$", ""))
    by_review = W.partitionBy("review_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.sum(F.col("text").startswith("diff --git ").cast("int")).over(by_review)).where("section > 0")
    by_section = W.partitionBy("review_id", "section").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("hunk", F.sum(F.col("text").rlike(HUNK).cast("int")).over(by_section))


#: Escapes of a quoted name and their bytes, beside octal numbers.
ESCAPES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "\\": 92}
#: A name in a header: quoted, with escapes, or plain up to the end.
QUOTED = r'"((?:[^"\\]|\\.)*)"'


def unquoted(name: F.Column) -> F.Column:
    """A name without its quotes, its escapes and octal numbers as bytes of UTF-8; names without quotes stay."""
    inner = F.regexp_extract(name, f"^{QUOTED}$", 1)
    parts = F.regexp_extract_all(inner, F.lit(r"(\\[0-7]{3}|\\.|[^\\]+)"), F.lit(1))
    byte = lambda c: F.unhex(F.lpad(F.conv(c, 10, 16), 2, "0"))
    known = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])

    def one(part: F.Column) -> F.Column:
        rest = F.substring(part, 2, 3)
        octal = F.unhex(F.lpad(F.conv(rest, 8, 16), 2, "0"))
        return F.when(part.rlike(r"^\\[0-7]{3}$"), octal).when(part.startswith("\\"), F.coalesce(byte(F.try_element_at(known, rest).cast("string")), rest.cast("binary"))).otherwise(part.cast("binary"))

    whole = F.aggregate(F.transform(parts, one), F.lit("").cast("binary"), lambda a, b: F.concat(a, b))
    return F.when(name.rlike(f"^{QUOTED}$"), F.make_valid_utf8(whole.cast("string"))).otherwise(name)


def _side(name: F.Column, mark: str) -> F.Column:
    """A header's name without the mark of its side; null for what has another."""
    plain = unquoted(name)
    return F.when(plain.startswith(f"{mark}/"), F.substring(plain, 3, 1 << 30))


def sections(lines: DataFrame) -> DataFrame:
    """One row per file section: paths, change type, binary flag. Quoted names are decoded."""
    head = lines.where("hunk = 0")

    def first(pattern: str, group: int = 1) -> F.Column:
        return F.max(F.when(F.col("text").rlike(pattern), F.regexp_extract("text", pattern, group)))

    def flag(pattern: str) -> F.Column:
        return F.max(F.col("text").rlike(pattern))

    out = head.groupBy("review_id", "section").agg(
        first(rf"^diff --git ({QUOTED}|a/.*?) (?:\"b/|b/).*$").alias("git_old"), first(rf"^diff --git (?:{QUOTED}|a/.*?) (\"b/.*\"|b/.*)$", 2).alias("git_new"), first(r"^--- (.*?)\t?$").alias("minus"), first(r"^\+\+\+ (.*?)\t?$").alias("plus"),
        first("^rename from (.*)$").alias("from"), first("^rename to (.*)$").alias("to"), flag("^new file mode").alias("added"), flag("^deleted file mode").alias("deleted"), flag("^(Binary files|GIT binary patch)").alias("is_binary"),
    )
    kind = F.when(F.col("added"), "added").when(F.col("deleted"), "deleted").when(F.col("from").isNotNull() & F.col("to").isNotNull(), "renamed").otherwise("modified")
    out = out.withColumn("change_type", kind)
    old = F.when(kind != "added", F.coalesce(unquoted(F.col("from")), _side(F.col("minus"), "a"), _side(F.col("git_old"), "a")))
    new = F.when(kind != "deleted", F.coalesce(unquoted(F.col("to")), _side(F.col("plus"), "b"), _side(F.col("git_new"), "b")))
    out = out.select("review_id", "section", "change_type", "is_binary", old.alias("old_path"), new.alias("new_path"))
    return out.withColumn("file_id", stable_id("file", F.coalesce("old_path", F.lit("")), F.coalesce("new_path", F.lit("")), F.col("change_type"), digits=16))


def hunks(lines: DataFrame) -> DataFrame:
    """(review_id, section, hunk, header, old_start, old_count, new_start, new_count) from the headers; counts default to 1."""
    head = lines.where("hunk > 0").where(F.col("text").rlike(HUNK))
    part = [F.regexp_extract("text", HUNK, n) for n in range(1, 5)]
    count = lambda c: F.when(c == "", 1).otherwise(c.try_cast("int"))
    return head.select("review_id", "section", "hunk", F.col("text").alias("header"), part[0].try_cast("int").alias("old_start"), count(part[1]).alias("old_count"), part[2].try_cast("int").alias("new_start"), count(part[3]).alias("new_count"))


def numbered(lines: DataFrame) -> DataFrame:
    """Lines of hunks with kind, ordinal and old and new line numbers (null on the side a line is not on)."""
    body = lines.where("hunk > 0").where(~F.col("text").rlike(HUNK) & ~F.col("text").startswith(NO_NEWLINE))
    sign = F.substring("text", 1, 1)
    kind = F.when(sign == "+", "addition").when(sign == "-", "deletion").when(sign == " ", "context").otherwise("invalid")
    body = body.withColumn("kind", kind).join(hunks(lines), ["review_id", "section", "hunk"])
    run = W.partitionBy("review_id", "section", "hunk").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    old, new = F.col("kind").isin("context", "deletion"), F.col("kind").isin("context", "addition")
    return body.select(
        "review_id", "section", "hunk", "header", (F.row_number().over(W.partitionBy("review_id", "section", "hunk").orderBy("pos"))).alias("ordinal"), "kind", F.substring("text", 2, 1 << 30).alias("content"),
        F.when(old, F.col("old_start") + F.sum(old.cast("int")).over(run) - 1).cast("int").alias("old_line"), F.when(new, F.col("new_start") + F.sum(new.cast("int")).over(run) - 1).cast("int").alias("new_line"), "old_count", "new_count",
    )


def broken_hunks(lines: DataFrame) -> DataFrame:
    """Hunks whose declared counts differ from the observed ones, or that hold a line without a known sign."""
    seen = numbered(lines).where("not (kind = 'invalid' and content = '')").groupBy("review_id", "section", "hunk").agg(
        F.count("old_line").alias("old_seen"), F.count("new_line").alias("new_seen"), F.sum((F.col("kind") == "invalid").cast("int")).alias("invalid")
    )
    both = hunks(lines).join(seen, ["review_id", "section", "hunk"], "left").fillna(0, ["old_seen", "new_seen", "invalid"])
    return both.where("old_count <> old_seen or new_count <> new_seen or invalid > 0").select("review_id", "section", "hunk", "old_count", "old_seen", "new_count", "new_seen", "invalid")


def files(lines: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """Files with counts, language, content hash and why they are excluded from analysis, if they are."""
    body = numbered(lines)
    counts = body.groupBy("review_id", "section").agg(
        F.sum((F.col("kind") == "addition").cast("int")).alias("additions"), F.sum((F.col("kind") == "deletion").cast("int")).alias("deletions"), F.count_distinct("hunk").alias("hunks"), (F.count("new_line") - F.count(F.when(F.col("old_line").isNotNull(), F.col("new_line")))).alias("seen_additions"), (F.count("old_line") - F.count(F.when(F.col("new_line").isNotNull(), F.col("old_line")))).alias("seen_deletions"),
        F.array_sort(F.collect_set(F.struct("hunk", "header"))).alias("seen"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk", "ordinal", "kind", "content"))), lambda x: F.concat_ws("\0", x["kind"], x["content"])), "\n"), 256).alias("content_hash"),
    )
    declared = hunks(lines).groupBy("review_id", "section").agg(F.array_sort(F.collect_set(F.struct("hunk", "header"))).alias("declared"))
    out = sections(lines).join(counts, ["review_id", "section"], "left").join(declared, ["review_id", "section"], "left").fillna(0, ["additions", "deletions", "hunks", "seen_additions", "seen_deletions"])
    named = lambda c: F.coalesce(F.transform(c, lambda h: stable_id("hunk", F.col("file_id"), h["hunk"], h["header"], digits=16)), F.array().cast("array<string>"))
    out = out.withColumns({"hunk_ids": named("declared"), "seen_hunk_ids": named("seen")}).drop("declared", "seen")
    total = F.sum(F.col("additions") + F.col("deletions")).over(W.partitionBy("review_id"))
    path = F.coalesce("new_path", "old_path")
    out = out.withColumns({"changed_lines": total, "language": F.when(is_language_python(path), "python").otherwise("unknown"), "content_hash": F.coalesce("content_hash", content_hash(F.lit("")))})
    why = F.when(F.col("is_binary"), "binary").when(F.col("language") == "unknown", "unsupported_language").when(F.col("changed_lines") > max_lines, "changed_line_limit")
    return out.withColumns({"exclusion_reason": why, "analysis_eligible": why.isNull()})


def source_lines(body: DataFrame, file_rows: DataFrame, include_context: bool = True, include_deletions: bool = True, python_only: bool = False, placed: bool = False) -> DataFrame:
    """Lines with the path, side and number they are known by: deletions on the old side, all others on the new.

    placed: adds pos, which orders a review's lines.
    """
    rows = file_rows.where(F.col("language") == "python") if python_only else file_rows
    kinds = ["addition", *(["context"] if include_context else []), *(["deletion"] if include_deletions else [])]
    gone = F.col("kind") == "deletion"
    out = body.where(F.col("kind").isin(kinds)).join(rows.select("review_id", "section", "old_path", "new_path", "file_id"), ["review_id", "section"])
    out = out.withColumn("hunk_id", stable_id("hunk", F.col("file_id"), F.col("hunk"), F.col("header"), digits=16))
    return out.select("review_id", F.when(gone, F.col("old_path")).otherwise(F.col("new_path")).alias("file_path"), "file_id", "hunk_id", "ordinal", "kind", F.when(gone, "old").otherwise("new").alias("side"), F.when(gone, F.col("old_line")).otherwise(F.col("new_line")).alias("line_number"), "content", *([F.struct("section", "hunk", "ordinal").alias("pos")] if placed else []))


def in_scope(file_rows: DataFrame) -> DataFrame:
    return file_rows.where("language = 'python' and not is_binary and additions > 0")


def index_lists(file_rows: DataFrame) -> DataFrame:
    """(review_id, binary, unsupported): paths in file order."""
    path = F.coalesce("new_path", "old_path")

    def listed(test: F.Column) -> F.Column:
        return F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("section", path.alias("p"))))), lambda x: x["p"])

    return file_rows.groupBy("review_id").agg(listed(F.col("is_binary")).alias("binary"), listed((F.col("language") == "unknown") & ~F.col("is_binary")).alias("unsupported"))
