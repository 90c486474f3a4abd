"""Every operator as a query over the driver's tables, with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import agents, assembly, code, patch, routing, secrets, transport, validation
from ..sources import sinks
from ..streaming import trace as stream
from . import faults, gated, whole  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES, add, add_sliced  # noqa: F401
from .registry import joined as _joined


# ---- patches -----------------------------------------------------------------------------------------------------


def patches(docs: DataFrame, wrong_every: int = 0) -> DataFrame:
    """(review_id, raw_diff) from documents: every fifth line replaced, every third of five added, the rest context."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "t"))
    body = F.when(F.col("n") % 5 == 0, F.concat(F.lit("-"), "t", F.lit("\n+"), "t")).when(F.col("n") % 5 == 3, F.concat(F.lit("+"), "t")).otherwise(F.concat(F.lit(" "), "t"))
    whole = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", body.alias("b")))), lambda x: x["b"]), "\n").alias("body"), F.count("*").alias("new"), F.sum((F.col("n") % 5 != 3).cast("int")).alias("old"))
    path = F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".md").otherwise(".py"))
    extra = F.when(F.col("doc_id") % wrong_every == 0, 1).otherwise(0) if wrong_every else F.lit(0)
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,"), (F.col("old") + extra).cast("string"), F.lit(" +1,"), F.col("new").cast("string"), F.lit(" @@\n"))
    binary = F.when(F.col("doc_id") % 11 == 0, "\ndiff --git a/img.bin b/img.bin\nnew file mode 100644\nBinary files /dev/null and b/img.bin differ").otherwise("")
    return whole.select(F.col("doc_id").alias("review_id"), F.concat(head, "body", binary).alias("raw_diff"))


_N = "WITH text_line AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"
_PATH = "'src/d' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.md' ELSE '.py' END"
_COUNTS = _N + ", c AS (SELECT doc_id, count(*) AS new, count(*) FILTER (n % 5 <> 3) AS old, count(*) FILTER (n % 5 IN (0, 3)) AS additions, count(*) FILTER (n % 5 = 0) AS deletions FROM text_line GROUP BY doc_id)"


def _documents(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda docs: f(patch.raw_lines(patches(docs)))


D = ("documents",)
add("a06_byte_cap", lambda d: patch.within_bytes(d.select(F.col("doc_id").alias("review_id"), F.col("text").alias("raw_diff")), 4000)[1].select("review_id", F.octet_length("raw_diff").alias("bytes")), tables=D, sql="SELECT doc_id AS review_id, strlen(text)::INT AS bytes FROM documents WHERE strlen(text) > 4000")
add("b01_sections", _documents(lambda x: x.groupBy("review_id").agg(F.max("section").alias("sections"))), tables=D, sql="SELECT doc_id AS review_id, CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 1 END::BIGINT AS sections FROM documents")


def _octal(name: F.Column) -> F.Column:
    """A name as git quotes it: every byte as an octal number."""
    return F.array_join(F.transform(F.regexp_extract_all(F.hex(name.cast("binary")), F.lit("(..)"), F.lit(1)), lambda b: F.concat(F.lit("\\"), F.lpad(F.conv(b, 16, 8), 3, "0"))), "")


def _quoted(docs: DataFrame) -> DataFrame:
    """A renamed file for each document, its names the first and the last characters of the text."""
    name = lambda part: _octal(F.regexp_replace(part, r"[\r\n/]", "_"))
    old, new = name(F.substring("text", 1, 20)), name(F.expr("right(text, 20)"))
    text = F.concat(F.lit('diff --git "a/src/'), old, F.lit('.py" "b/src/'), new, F.lit('\\t.py"\nsimilarity index 100%\nrename from "src/'), old, F.lit('.py"\nrename to "src/'), new, F.lit('\\t.py"'))
    return docs.where("text is not null").select(F.col("doc_id").alias("review_id"), text.alias("raw_diff"))


add("b02_quoted_names", lambda d: patch.sections(patch.raw_lines(_quoted(d))).select("review_id", "change_type", "old_path", "new_path"), tables=D, sql="SELECT doc_id AS review_id, 'renamed' AS change_type, 'src/' || regexp_replace(left(text, 20), '[\r\n/]', '_', 'g') || '.py' AS old_path, 'src/' || regexp_replace(right(text, 20), '[\r\n/]', '_', 'g') || chr(9) || '.py' AS new_path FROM documents WHERE text IS NOT NULL")
add("b03_classify", _documents(lambda x: patch.sections(x).drop("file_id")), tables=D, sql=f"SELECT doc_id AS review_id, 1::BIGINT AS section, 'modified' AS change_type, false AS is_binary, {_PATH} AS old_path, {_PATH} AS new_path FROM documents UNION ALL SELECT doc_id, 2, 'added', true, NULL, 'img.bin' FROM documents WHERE doc_id % 11 = 0")
add("b04_hunk_header", _documents(lambda x: patch.hunks(x).drop("header", "section", "hunk")), tables=D, sql=_COUNTS + " SELECT doc_id AS review_id, 1 AS old_start, old::INT AS old_count, 1 AS new_start, new::INT AS new_count FROM c")
add("b05_line_numbers", _documents(lambda x: patch.numbered(x).select("review_id", "ordinal", "kind", "old_line", "new_line")), tables=D, sql=_N + """, l AS (SELECT doc_id AS review_id, n, n + (n + 4) // 5 AS before, n - (n + 1) // 5 + 1 AS o, n + 1 AS w FROM text_line)
    SELECT review_id, (before + 1)::INT AS ordinal, CASE WHEN n % 5 = 0 THEN 'deletion' WHEN n % 5 = 3 THEN 'addition' ELSE 'context' END AS kind, CASE WHEN n % 5 <> 3 THEN o::INT END AS old_line, CASE WHEN n % 5 <> 0 THEN w::INT END AS new_line FROM l
    UNION ALL SELECT review_id, (before + 2)::INT, 'addition', NULL, w::INT FROM l WHERE n % 5 = 0""")
add("b06_integrity", lambda d: patch.broken_hunks(patch.raw_lines(patches(d, 13))).select("review_id", "old_count", "old_seen", "new_count", "new_seen", "invalid"), tables=D, sql=_COUNTS + " SELECT doc_id AS review_id, (old + 1)::INT AS old_count, old AS old_seen, new::INT AS new_count, new AS new_seen, 0::BIGINT AS invalid FROM c WHERE doc_id % 13 = 0")
_FILES = "SELECT doc_id AS review_id, additions, deletions, 1::BIGINT AS hunks, CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE 'python' END AS language, additions + deletions AS changed_lines, CASE WHEN doc_id % 7 = 0 THEN 'unsupported_language' WHEN additions + deletions > {cap} THEN 'changed_line_limit' END AS exclusion_reason FROM c UNION ALL SELECT doc_id, 0, 0, 0, 'unknown', additions + deletions, 'binary' FROM c WHERE doc_id % 11 = 0"
_FILE_COLUMNS = ["review_id", "additions", "deletions", "hunks", "language", "changed_lines", "exclusion_reason"]
add("b07_file_rollup", _documents(lambda x: patch.files(x).select(_FILE_COLUMNS)), tables=D, sql=_COUNTS + " " + _FILES.format(cap=1000))
add("a07_line_cap", _documents(lambda x: patch.files(x, 10).where("exclusion_reason = 'changed_line_limit'").select("review_id", "changed_lines", "analysis_eligible")), tables=D, sql=_COUNTS + " SELECT doc_id AS review_id, additions + deletions AS changed_lines, false AS analysis_eligible FROM c WHERE additions + deletions > 10 AND doc_id % 7 <> 0")
add("b09_source_lines", _documents(lambda x: patch.source_lines(patch.numbered(x), patch.files(x), python_only=True).groupBy("review_id", "side", "kind").agg(F.count("*").alias("n"), F.sum("line_number").alias("numbers"))), tables=D, sql=_N + """, l AS (SELECT doc_id AS review_id, n, n - (n + 1) // 5 + 1 AS o, n + 1 AS w FROM text_line WHERE doc_id % 7 <> 0),
    r AS (SELECT review_id, CASE WHEN n % 5 = 0 THEN 'deletion' WHEN n % 5 = 3 THEN 'addition' ELSE 'context' END AS kind, CASE WHEN n % 5 = 0 THEN o ELSE w END AS num FROM l UNION ALL SELECT review_id, 'addition', w FROM l WHERE n % 5 = 0)
    SELECT review_id, CASE WHEN kind = 'deletion' THEN 'old' ELSE 'new' END AS side, kind, count(*) AS n, sum(num)::BIGINT AS numbers FROM r GROUP BY ALL""")
add("b10_in_scope", _documents(lambda x: patch.in_scope(patch.files(x)).select("review_id", "new_path", "additions")), tables=D, sql=_COUNTS + f" SELECT doc_id AS review_id, {_PATH} AS new_path, additions FROM c WHERE doc_id % 7 <> 0 AND additions > 0")
add("c01_index_lists", _documents(lambda x: patch.index_lists(patch.files(x)).select("review_id", _joined("binary"), _joined("unsupported"))), tables=D, sql=f"SELECT doc_id AS review_id, CASE WHEN doc_id % 11 = 0 THEN 'img.bin' ELSE '' END AS binary, CASE WHEN doc_id % 7 = 0 THEN {_PATH} ELSE '' END AS unsupported FROM documents")
add("e01_changed_lines", lambda x: x.groupBy("review_id").agg(F.sum((F.col("kind") == "addition").cast("int")).alias("additions"), F.sum((F.col("kind") == "deletion").cast("int")).alias("deletions")), "line", sql="SELECT review_id, count(*) FILTER (kind = 'addition') AS additions, count(*) FILTER (kind = 'deletion') AS deletions FROM line GROUP BY review_id")
add("c02_added_lines", lambda x: routing.added(x).groupBy("review_id").agg(F.count("*").alias("n")), "line", sql="SELECT review_id, count(*) AS n FROM line WHERE kind = 'addition' AND side = 'new' GROUP BY review_id")

# ---- scalar functions --------------------------------------------------------------------------------------------

_PATHS = "CASE p_partkey % 10 WHEN 0 THEN '/abs/x.py' WHEN 1 THEN 'a//b.py' WHEN 2 THEN 'a/../b.py' WHEN 3 THEN 'tests/unit/a.py' WHEN 4 THEN 'src/test_a.pyi' WHEN 5 THEN 'C:/x' WHEN 6 THEN 'shared/r1/out.json' WHEN 7 THEN 'shared/.hidden/x' WHEN 8 THEN 'src/attest_x.py' ELSE 'Src/Main.PY' END"
add("f01_stable_id", lambda d: d.select("doc_id", scalars.stable_id("x", F.col("doc_id"), F.col("source")).alias("id")), tables=D, sql="SELECT doc_id, 'x-' || left(sha256(doc_id || chr(0) || source), 20) AS id FROM documents")
add("f02_content_hash", lambda d: d.select("doc_id", scalars.content_hash(F.col("text"), F.lit(None)).alias("hash")), tables=D, sql="SELECT doc_id, sha256(text || chr(0) || 'None') AS hash FROM documents")
add("f04_paths", lambda p: p.select("p_partkey", F.expr(_PATHS).alias("path")).select("p_partkey", scalars.is_repository_path(F.col("path")).alias("repository"), scalars.is_shared_path(F.col("path")).alias("shared"), scalars.is_test_path(F.col("path")).alias("test"), scalars.is_language_python(F.col("path")).alias("python")), tables=("part",), sql=f"SELECT p_partkey, NOT (path[1] = '/' OR contains(path, '//') OR contains(path, ':') OR list_has_any(string_split(path, '/'), ['', '.', '..'])) AS repository, regexp_full_match(path, 'shared(/[A-Za-z0-9_-][A-Za-z0-9_.-]*)+') AS shared, contains('/' || lower(path), '/tests/') OR contains('/' || lower(path), '/test_') AS test, lower(path) LIKE '%.py' OR lower(path) LIKE '%.pyi' AS python FROM (SELECT p_partkey, {_PATHS} AS path FROM part)")
add("f06_safe_ids", lambda p: p.select("p_partkey", F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("id"), F.concat(F.lit("L:"), F.col("p_partkey").cast("string")).alias("ref")).select("p_partkey", F.col("id").rlike(scalars.IDENTIFIER).alias("identifier"), F.col("ref").rlike(scalars.LINE_REF).alias("line_ref")), tables=("part",), sql="SELECT p_partkey, regexp_full_match(lower(replace(p_name, ' ', '-')), '[a-z0-9][a-z0-9-]*') AS identifier, true AS line_ref FROM part")
add("f13_redact", lambda d: d.select("doc_id", F.sha2(scalars.redact(F.col("text")), 256).alias("hash")), tables=D, sql=r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(bearer\s+)[A-Za-z0-9._~+/-]+', '\1<redacted>', 'g'), '(?i)\b((?:[a-z0-9]+[_-])*(?:api[_-]?key|secret[_-]?key|access[_-]?key|gateway[_-]?key|token|password)|authorization)(\s*[=:]\s*)("[^"]*"|''[^'']*''|[^\s,;]+)', '\1\2<redacted>', 'g'), '\b(?:gh[opsu]_[A-Za-z0-9]{8,}|sk-[A-Za-z0-9_-]{8,})\b', '<redacted-token>', 'g')) AS hash FROM documents""")
add("f14_exact_key", lambda d: d.where("text is not null").select("doc_id", scalars.sanitize_error(F.concat(F.lit("failed with "), F.substring("text", 1, 12), F.lit(": "), "text"), 5000, F.substring("text", 1, 12)).alias("t")).select("doc_id", F.col("t").startswith("failed with [REDACTED]: [REDACTED]").alias("redacted"), (F.length("t") <= 5000).alias("bounded")), tables=D, sql="SELECT doc_id, length(text) > 0 AS redacted, true AS bounded FROM documents WHERE text IS NOT NULL")
add("w13_output_cap", lambda d: d.select("doc_id", F.length(scalars.bounded_output(F.col("text"))).alias("kept")), tables=D, sql="SELECT doc_id, least(length(text), 16000)::INT AS kept FROM documents")
_ZONE = "CASE event_id % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+00:00' WHEN 2 THEN '+02:00' ELSE '' END"
add("f22_f23_times", lambda e: e.select("event_id", scalars.parse_utc(F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.expr(_ZONE))).alias("t"), F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("event_id") % 7 - 2).alias("u")).select("event_id", F.unix_seconds("t").alias("utc_seconds"), scalars.duration_ms(F.col("t"), F.col("u")).alias("ms")), tables=("events",), sql=f"SELECT event_id, CASE WHEN event_id % 4 < 2 THEN floor(epoch(ts))::BIGINT END AS utc_seconds, CASE WHEN event_id % 4 < 2 THEN greatest((event_id % 7 - 2) * 1000, 0)::BIGINT ELSE 0 END AS ms FROM events")
add("f14_sanitize", lambda p: p.select("page_id", scalars.sanitize_error(F.concat(F.replace("url", F.lit("://"), F.lit("://me:pw@")), F.lit("&token=abc sk-0123456789"))).alias("text")), tables=("pages",), sql="SELECT page_id, replace(url, '://', '://[REDACTED]@') || '&token=[REDACTED] [REDACTED]' AS text FROM pages")
add("f15_origin", lambda p: p.select("page_id", scalars.public_origin(F.when(F.col("page_id") % 9 == 0, F.regexp_replace("url", "^https?:", "")).otherwise(F.col("url"))).alias("origin")), tables=("pages",), sql="SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '[INVALID_URL]' ELSE lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#:]+)', 1)) END AS origin FROM pages")
add("f19_cost", lambda c: agents.costed_calls(c).select("call_id", F.round(F.col("cost").cast("double"), 9).alias("cost")), "call", sql="SELECT call_id, CASE WHEN prompt_tokens IS NOT NULL AND completion_tokens IS NOT NULL THEN round((coalesce(cache_hit_tokens, 0) * 0.003625 + (prompt_tokens - coalesce(cache_hit_tokens, 0)) * 0.435 + completion_tokens * 0.87)::DOUBLE / 1000000, 9) END AS cost FROM call")
add("f21_retry", lambda c: c.select("call_id", scalars.retry_delay(F.col("retry_after"), F.col("retry_number")).alias("delay")), "call", sql="SELECT call_id, least(greatest(coalesce(try_cast(retry_after AS DOUBLE), 0.25 * 2 ** (retry_number - 1)), 0), 2.0)::DOUBLE AS delay FROM call")
add("f24_deadline", lambda c: c.select("call_id", scalars.is_admissible(F.col("started_at") + F.expr("INTERVAL 45 SECONDS"), F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("admissible")), "call", sql="SELECT call_id, started_at + INTERVAL 45 SECONDS > TIMESTAMP '2024-01-15 00:00:00' AS admissible FROM call")
add("f27_markdown", lambda p: p.select("page_id", F.sha2(scalars.markdown_cell(F.col("html")), 256).alias("cell")), tables=("pages",), sql=r"SELECT page_id, sha256(left(regexp_replace(replace(html, '|', '\|'), '[\r\n]+', ' ', 'g'), 500)) AS cell FROM pages")
add("f17_canonical_json", lambda e: e.select("event_id", transport.canonical(F.expr("CASE event_id % 5 WHEN 0 THEN concat('{\"b\": 1, \"a\" : [', event_id, ', null]}') WHEN 1 THEN '{\"a\":1,\"a\":2}' WHEN 2 THEN '{\"a\": NaN}' WHEN 3 THEN concat('{\"u\":\"\\\\u00e9', event_id, '\"}') ELSE 'none' END")).alias("canonical")), tables=("events",), sql="""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"a":[' || event_id || ',null],"b":1}' || chr(10) WHEN 3 THEN '{"u":"é' || event_id || '"}' || chr(10) END AS canonical FROM events""")
add("c13_c15_errors", lambda c: agents.classified_calls(c).select("call_id", "code", "retryable", "policy_code"), "call", sql="""SELECT call_id, code, coalesce(code IN ('TIMEOUT', 'RATE_LIMIT', 'TRANSPORT_ERROR') OR code = 'PROVIDER_ERROR' AND status_code >= 500, false) AS retryable, CASE code WHEN 'AUTHENTICATION_ERROR' THEN 'MODEL_AUTH_ERROR' WHEN 'INSUFFICIENT_BALANCE' THEN 'MODEL_QUOTA_EXCEEDED' WHEN 'RATE_LIMIT' THEN 'RATE_LIMITED' WHEN 'TIMEOUT' THEN 'TIMEOUT' ELSE CASE WHEN code IS NOT NULL THEN 'MODEL_ERROR' END END AS policy_code
    FROM (SELECT *, CASE WHEN status = 'failed' THEN CASE WHEN class_name LIKE '%Timeout%' THEN 'TIMEOUT' WHEN status_code = 401 THEN 'AUTHENTICATION_ERROR' WHEN status_code = 402 THEN 'INSUFFICIENT_BALANCE' WHEN status_code = 429 THEN 'RATE_LIMIT' WHEN status_code >= 500 THEN 'PROVIDER_ERROR' WHEN class_name LIKE '%Connection%' THEN 'TRANSPORT_ERROR' ELSE 'PROVIDER_ERROR' END END AS code FROM call)""")
add("m03_validity", lambda c: agents.classified_calls(c).select("call_id", "validity"), "call", sql="""SELECT call_id, CASE WHEN status = 'success' THEN CASE WHEN finish_reason = 'length' THEN 'OUTPUT_TRUNCATED' WHEN trim(content) = '' THEN 'EMPTY_RESPONSE' WHEN content LIKE '%:' THEN 'INVALID_JSON' WHEN content NOT LIKE '%summary%' THEN 'SCHEMA_ERROR' ELSE 'OK' END END AS validity FROM call""")

# ---- secrets and disclosure --------------------------------------------------------------------------------------

def _tampered(masked: DataFrame) -> DataFrame:
    """Masked lines as shown; of three, one is right, one has a word more and one another mask."""
    n = F.col("line_key") % 3
    return masked.withColumn("shown", F.when(n == 1, F.concat("content", F.lit(" more"))).when(n == 2, F.regexp_replace("content", ":[0-9a-f]{12}>", ":000000000000>")).otherwise(F.col("content"))).select("line_key", "shown")


_SEEN = r"""hits AS (SELECT review_id, line_key, kind, 'SUSPECTED_VALUE' AS type, unnest(regexp_extract_all(content, '(?i)\b(?:token|secret|password|passwd|api[_-]?key)\b\s*[=:]\s*[\x22\x27]([A-Za-z0-9+/=_-]{16,})[\x22\x27]', 1)) AS value FROM line
    UNION SELECT review_id, line_key, kind, 'AWS_ACCESS_KEY', unnest(regexp_extract_all(content, '\bAKIA[A-Z0-9]{16}\b')) FROM line UNION SELECT review_id, line_key, kind, 'OPENAI_KEY', unnest(regexp_extract_all(content, '\bsk-[A-Za-z0-9]{32,}\b')) FROM line UNION SELECT review_id, line_key, kind, 'GITHUB_TOKEN', unnest(regexp_extract_all(content, '\bgh[opsu]_[A-Za-z0-9]{36,}\b')) FROM line),
    bits AS (SELECT value, -sum(p * log2(p)) AS bits FROM (SELECT value, c, count(*) / strlen(value) AS p FROM (SELECT value, unnest(string_split(value, '')) AS c FROM (SELECT DISTINCT value FROM hits)) GROUP BY value, c) GROUP BY value),
    seen AS (SELECT * FROM hits JOIN bits USING (value) WHERE type <> 'SUSPECTED_VALUE' OR bits >= 3)"""
add("x01_x02_secrets", lambda x: secrets.findings(secrets.observations(x)).select("review_id", "line_key", "secret_type", "fingerprint", "level", "status"), "line", sql=", " + _SEEN + " SELECT review_id, line_key, type AS secret_type, sha256(value) AS fingerprint, CASE WHEN type = 'SUSPECTED_VALUE' THEN 'E2' ELSE 'E3' END AS level, CASE WHEN type = 'SUSPECTED_VALUE' THEN 'suspected' ELSE 'confirmed' END AS status FROM seen WHERE kind = 'addition'")
add("c03_d14_masked_lines", lambda x: secrets.masked_lines(x, secrets.observations(x)).where("redacted").select("line_key", "source_hash", "content_hash"), "line", sql=", " + _SEEN + ", one AS (SELECT line_key, value, type FROM seen QUALIFY count(*) OVER (PARTITION BY line_key) = 1) SELECT line_key, sha256(content) AS source_hash, sha256(replace(content, value, '<REDACTED:' || type || ':' || left(sha256(value), 12) || '>')) AS content_hash FROM line JOIN one USING (line_key)")
add("c04_disclosure", lambda x: secrets.disclosure(secrets.masked_lines(x, secrets.observations(x)), x.groupBy("review_id").agg(F.when(F.col("review_id") % 10 == 3, "failed").otherwise("success").alias("skill_status")), 20)[1], "line", sql="SELECT review_id, reason IS NULL AS cloud_safe, reason, changed FROM (SELECT review_id, count(*) FILTER (kind <> 'context') AS changed, CASE WHEN review_id % 10 = 3 THEN 'secret_scan_incomplete' WHEN count(*) FILTER (kind <> 'context') > 20 THEN 'changed_line_limit' END AS reason FROM line GROUP BY review_id)")
add("d15_positional", lambda x: secrets.positional_mismatches(x, x.where("line_key % 101 <> 7")), "line", sql="SELECT DISTINCT review_id FROM line WHERE line_key % 101 = 7")
add("f16_redaction_proof", lambda x: _tampered(secrets.masked_lines(x, secrets.observations(x)).where("redacted")).join(x.select("line_key", F.col("content").alias("source")), "line_key").select("line_key", secrets.is_redaction_only("source", "shown").alias("proven")), "line", sql=", " + _SEEN + " SELECT DISTINCT line_key, line_key % 3 = 0 AS proven FROM seen")
add("b13_t05_line_refs", lambda x: agents.line_refs(x).select("line_key", "line_ref"), "line", sql="SELECT line_key, 'line-' || left(sha256(file_path || chr(0) || side || chr(0) || pos || chr(0) || content), 20) AS line_ref FROM line")

# ---- routing and coverage ----------------------------------------------------------------------------------------

_ADDED = ", a AS (SELECT * FROM line WHERE kind = 'addition' AND side = 'new')"
_R01 = _ADDED + r""", cand AS (SELECT review_id, 'sql_injection' AS category, 'high' AS severity, line_key, file_path FROM a WHERE regexp_matches(content, '(?i)\b(?:execute|executemany|raw|query)\s*\(|\b(?:SELECT|INSERT|UPDATE|DELETE)\b')
    UNION ALL SELECT review_id, 'command_injection', 'high', line_key, file_path FROM a WHERE regexp_matches(content, '\b(?:os\.system|os\.popen|subprocess\.|shell\s*=\s*True)') UNION ALL SELECT review_id, 'dangerous_call', 'high', line_key, file_path FROM a WHERE regexp_matches(content, '\b(?:eval|exec|pickle\.loads?|yaml\.load)\s*\(')
    UNION ALL SELECT review_id, 'auth_boundary', 'high', line_key, file_path FROM a WHERE regexp_matches(content, '(?i)\b(?:auth|authorize|permission|is_admin|role|access[_-]?control|jwt|token)\b') OR regexp_matches(file_path, '(?i)\b(?:auth|authorize|permission|is_admin|role|access[_-]?control|jwt|token)\b')
    UNION ALL SELECT review_id, 'performance', 'medium', line_key, file_path FROM a WHERE regexp_matches(content, '(?i)^\s*(?:for|while)\b|\b(?:sleep|select\s+\*|\.all\(\)|N\+1)\b') UNION ALL SELECT review_id, 'exception_handling', 'medium', line_key, file_path FROM a WHERE regexp_matches(content, '^\s*except(?:\s+Exception)?\s*:')
    UNION ALL SELECT review_id, 'logic', 'medium', line_key, file_path FROM a WHERE regexp_matches(content, '^\s*(?:if|elif|return)\b'))"""
_TEST = "(file_path LIKE 'tests/%' OR file_path LIKE '%/tests/%' OR file_path LIKE 'test\\_%' ESCAPE '\\' OR file_path LIKE '%/test\\_%' ESCAPE '\\')"
_GAP = f", gap AS (SELECT review_id, 'test_gap' AS category, 'low' AS severity, arg_min(line_key, pos) FILTER (side = 'new' AND NOT {_TEST}) AS line_key, arg_min(file_path, pos) FILTER (side = 'new' AND NOT {_TEST}) AS file_path FROM line GROUP BY review_id HAVING bool_or(file_path LIKE '%.py' AND NOT {_TEST}) AND NOT bool_or(file_path LIKE '%.py' AND {_TEST}) AND line_key IS NOT NULL)"
add("r01_rules", lambda x: routing.rule_candidates(x).drop("route_source", "reason"), "line", sql=_R01 + " SELECT * FROM cand")
add("r02_test_gap", lambda x: routing.test_gaps(x).drop("route_source", "reason"), "line", sql=_GAP + " SELECT * FROM gap")


def _analysis(lines: DataFrame) -> DataFrame:
    text = F.when(F.col("review_id") % 4 == 0, "Changes the SQL query of the database").when(F.col("review_id") % 4 == 1, "Loop with latency and permission checks").otherwise("Renames things")
    return lines.select("review_id").distinct().select("review_id", text.alias("summary"))


_HINT = _ADDED + r""", spec AS (SELECT * FROM (VALUES (0, 'sql_injection', 'high', '(?i)\b(sql|query|execute|cursor|select|insert|update|delete)\b'), (1, 'auth_boundary', 'high', '(?i)\b(auth|authorize|permission|role|is_admin|token)\b'), (1, 'performance', 'medium', '(?i)\b(for|while|all|sleep|query|request)\b'), (2, 'logic', 'low', 'q\bq'), (3, 'logic', 'low', 'q\bq')) s(m, category, severity, pattern)),
    hint AS (SELECT review_id, category, severity, arg_min(line_key, (NOT regexp_matches(file_path || chr(10) || content, pattern), pos)) AS line_key, min(file_path) AS file_path FROM a JOIN spec ON spec.m = review_id % 4 GROUP BY ALL)"""
add("r03_hints", lambda x: routing.semantic_hints(x, _analysis(x)).drop("route_source", "reason"), "line", sql=_HINT + " SELECT * FROM hint")


def _routes(x: DataFrame) -> DataFrame:
    return routing.merged_routes(routing.rule_candidates(x).unionByName(routing.test_gaps(x)).unionByName(routing.semantic_hints(x, _analysis(x))))


_WHY = """, why AS (SELECT * FROM (VALUES ('rule', 'sql_injection', 'Database query construction changed and requires injection analysis.'), ('rule', 'command_injection', 'Command execution surface changed and requires injection and dangerous-call checks.'), ('rule', 'dangerous_call', 'A dangerous execution or deserialization API changed.'), ('rule', 'auth_boundary', 'Authentication or authorization boundary logic changed.'),
    ('rule', 'performance', 'A loop, blocking call, or broad data access may affect performance.'), ('rule', 'exception_handling', 'Broad exception handling changed and requires semantic review.'), ('rule', 'logic', 'Control-flow or return semantics changed.'), ('rule', 'test_gap', 'Production Python changed without a corresponding test-file change.'),
    ('llm', 'logic', 'Diff Analyzer semantics were used to focus quality review.'), ('llm', 'sql_injection', 'Diff Analyzer semantics requested bounded follow-up for sql_injection.'), ('llm', 'auth_boundary', 'Diff Analyzer semantics requested bounded follow-up for auth_boundary.'), ('llm', 'performance', 'Diff Analyzer semantics requested bounded follow-up for performance.')) w(route_source, category, reason))"""
_MERGED = _R01 + _GAP + _HINT.replace(_ADDED, "") + _WHY + ", src AS (SELECT *, 'rule' AS route_source FROM cand UNION ALL SELECT *, 'rule' FROM gap UNION ALL SELECT *, 'llm' FROM hint), route AS (SELECT review_id, category, line_key, file_path, CASE max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS severity, CASE WHEN count(DISTINCT route_source) > 1 THEN 'hybrid' ELSE min(route_source) END AS route_source, array_to_string(list_sort(list(DISTINCT reason)), ' ') AS reason FROM src JOIN why USING (route_source, category) GROUP BY review_id, category, line_key, file_path)"
add("r04_merge", lambda x: _routes(x).select("review_id", "category", "line_key", "severity", "route_source", "reason", _joined("skills"), "route_id"), "line", sql=_MERGED + """, m AS (SELECT * FROM (VALUES ('sql_injection', 'detect_injection,security_semantic_review'), ('command_injection', 'detect_injection,detect_dangerous_call,security_semantic_review'), ('dangerous_call', 'detect_dangerous_call,security_semantic_review'), ('auth_boundary', 'security_semantic_review,review_code_quality'), ('performance', 'review_code_quality'), ('exception_handling', 'review_code_quality'), ('logic', 'review_code_quality'), ('test_gap', 'review_code_quality')) t(category, skills))
    SELECT review_id, category, line_key, severity, route_source, reason, skills, 'route-' || left(sha256(review_id || chr(0) || category || chr(0) || file_path || chr(0) || line_key), 20) AS route_id FROM route JOIN m USING (category)""")
add("w09_route_order", lambda x: routing.ordered_routes(_routes(x)).select("review_id", "category", "line_key", "place"), "line", sql=_MERGED + " SELECT review_id, category, line_key, row_number() OVER (PARTITION BY review_id ORDER BY category, file_path, line_key)::INT AS place FROM route")


def _odd_routes(x: DataFrame) -> DataFrame:
    """The merged routes, and some of the categories that only hints can name."""
    kind = F.when(F.col("review_id") % 3 == 0, "secret").when(F.col("review_id") % 3 == 1, "scope_limit").otherwise("tool_failure")
    odd = routing.added(x).where("pos = 3").select("review_id", kind.alias("category"), F.lit("low").alias("severity"), "line_key", "file_path", F.lit("llm").alias("route_source"), F.lit("asked").alias("reason"))
    return routing.merged_routes(routing.rule_candidates(x).unionByName(routing.test_gaps(x)).unionByName(routing.semantic_hints(x, _analysis(x))).unionByName(odd))


add("r06_plan", lambda x: routing.skill_plan(x, _odd_routes(x)), "line", sql=_MERGED + """, m AS (SELECT * FROM (VALUES ('secret', ['detect_secret', 'security_semantic_review']), ('scope_limit', ['security_semantic_review', 'review_code_quality']), ('tool_failure', ['security_semantic_review', 'review_code_quality']), ('sql_injection', ['detect_injection', 'security_semantic_review']), ('command_injection', ['detect_injection', 'detect_dangerous_call', 'security_semantic_review']), ('dangerous_call', ['detect_dangerous_call', 'security_semantic_review']), ('auth_boundary', ['security_semantic_review', 'review_code_quality']), ('performance', ['review_code_quality']), ('exception_handling', ['review_code_quality']), ('logic', ['review_code_quality']), ('test_gap', ['review_code_quality'])) t(category, skills)),
    every AS (SELECT review_id, category FROM route UNION ALL SELECT review_id, CASE review_id % 3 WHEN 0 THEN 'secret' WHEN 1 THEN 'scope_limit' ELSE 'tool_failure' END FROM a WHERE pos = 3), per AS (SELECT review_id, unnest(skills) AS skill FROM every JOIN m USING (category)), n AS (SELECT review_id, skill, count(*) AS routes FROM per GROUP BY ALL)
    SELECT r.review_id, u.skill, on_ OR coalesce(routes, 0) > 0 AS planned, on_ OR coalesce(routes, 0) > 0 AS mandatory, coalesce(routes, 0) AS routes, CASE WHEN on_ THEN 'Always-on coverage required by the frozen MVP trust boundary.' WHEN coalesce(routes, 0) > 0 THEN 'A deterministic risk route requires this Skill.' ELSE 'No changed line matched this Skill''s frozen risk triggers.' END AS reason
    FROM (SELECT DISTINCT review_id FROM line) r CROSS JOIN (VALUES ('detect_secret', true), ('detect_injection', false), ('detect_dangerous_call', false), ('security_semantic_review', true), ('review_code_quality', true)) u(skill, on_) LEFT JOIN n ON n.review_id = r.review_id AND n.skill = u.skill""")
add("r07_semantic_status", lambda x: routing.semantic_status(x, routing.semantic_hints(x, _analysis(x)).where("review_id % 5 <> 1"), x.where("review_id % 9 = 2")), "line", sql=_HINT + " SELECT review_id, CASE WHEN review_id % 9 = 2 THEN 'failed' WHEN hinted THEN 'success' ELSE 'not_requested' END AS semantic_status, review_id % 9 = 2 OR hinted AS model_used FROM (SELECT review_id, review_id % 5 <> 1 AND review_id IN (SELECT review_id FROM hint) AS hinted FROM (SELECT DISTINCT review_id FROM line))")
add("d18_misplaced_hints", lambda x: routing.misplaced_hints(routing.semantic_hints(x, _analysis(x)).withColumn("line_key", F.when(F.col("review_id") % 6 == 1, F.col("line_key") + 50_000).otherwise(F.col("line_key"))), x), "line", sql=_HINT + " SELECT DISTINCT review_id FROM hint WHERE review_id % 6 = 1")
add("c17_fallback_plan", lambda x: routing.fallback_plan(x).where("planned").select("review_id", "skill", "routes"), "line", sql="SELECT DISTINCT review_id, s.skill, 0::BIGINT AS routes FROM line CROSS JOIN (VALUES ('detect_secret'), ('security_semantic_review'), ('review_code_quality')) s(skill)")


def _plan(route: DataFrame) -> DataFrame:
    return routing.skill_plan(route, route.select("review_id", "route_id", F.array("skill").alias("skills"))).select("review_id", "skill", "planned")


_PLAN = ", plan AS (SELECT r.review_id, u.skill, u.skill IN ('detect_secret', 'security_semantic_review', 'review_code_quality') OR bool_or(u.skill = r.skill) AS planned FROM route r CROSS JOIN (VALUES ('detect_secret'), ('detect_injection'), ('detect_dangerous_call'), ('security_semantic_review'), ('review_code_quality')) u(skill) GROUP BY r.review_id, u.skill)"
add("d19_reconcile", lambda r, c: routing.reconcile_coverage(_plan(r), c), "route", "coverage", sql=_PLAN + ", own AS (SELECT review_id, skill, status, error_code FROM coverage GROUP BY ALL) SELECT p.review_id, p.skill, CASE WHEN NOT planned THEN 'skipped' ELSE coalesce(c.status, 'failed') END AS status, CASE WHEN planned AND c.status IS NULL THEN 'MISSING_EXECUTION_RESULT' WHEN planned THEN c.error_code END AS error_code FROM plan p LEFT JOIN own c USING (review_id, skill)")
add("d19_unplanned", lambda r, c: routing.unplanned_coverage(_plan(r), c), "route", "coverage", sql=_PLAN + " SELECT c.review_id, coverage_id, skill FROM coverage c JOIN plan p USING (review_id, skill) WHERE NOT planned")
add("e15_e19_coverage_metrics", agents.coverage_metrics, "coverage", sql="SELECT review_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(DISTINCT skill) AS skills, sum(duration_ms)::BIGINT AS duration_ms, max(CASE status WHEN 'failed' THEN 2 WHEN 'skipped' THEN 1 ELSE 0 END) AS worst FROM coverage GROUP BY review_id")

# ---- agents, traces, transport -----------------------------------------------------------------------------------

add("w07_budget", lambda c: agents.within_budget(c).select("review_id", "call_id", "review_call_index"), "call", sql="SELECT review_id, call_id, n::INT AS review_call_index FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY started_at, call_id) AS n FROM call) WHERE n <= 4")
add("e16_call_summary", lambda c: agents.call_summary(c).withColumn("cost", F.round(F.col("cost").cast("double"), 8)), "call", sql="SELECT review_id, agent_id, count(*) AS calls, count(*) FILTER (status = 'failed') AS failures, coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens, coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens, round(coalesce(sum((coalesce(cache_hit_tokens, 0) * 0.003625 + (prompt_tokens - coalesce(cache_hit_tokens, 0)) * 0.435 + completion_tokens * 0.87)), 0)::DOUBLE / 1000000, 8) AS cost FROM call GROUP BY ALL")
add("w06_f22_trace", lambda c: agents.trace(c), "call", sql="SELECT review_id, call_id, row_number() OVER w AS sequence, greatest(coalesce(epoch_us(started_at) // 1000 - epoch_us(lag(started_at) OVER w) // 1000, 0), 0) AS since_ms, status FROM call WINDOW w AS (PARTITION BY review_id ORDER BY started_at, call_id)")
add("e17_envelope", agents.envelope, "call", sql="SELECT review_id, min(started_at) AS first, max(started_at + to_milliseconds(latency_ms)) AS last FROM call GROUP BY review_id")
_LOOP = """, n AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY started_at, call_id) AS i FROM call), k AS (SELECT review_id, agent_id, i, CASE WHEN status = 'failed' THEN CASE WHEN class_name LIKE '%Timeout%' THEN 'TIMEOUT' WHEN status_code = 401 THEN 'AUTHENTICATION_ERROR' WHEN status_code = 402 THEN 'INSUFFICIENT_BALANCE' WHEN status_code = 429 THEN 'RATE_LIMIT' WHEN status_code >= 500 THEN 'PROVIDER_ERROR' WHEN class_name LIKE '%Connection%' THEN 'TRANSPORT_ERROR' ELSE 'PROVIDER_ERROR' END
        WHEN finish_reason = 'length' THEN 'OUTPUT_TRUNCATED' WHEN trim(content) = '' THEN 'EMPTY_RESPONSE' WHEN content LIKE '%:' THEN 'INVALID_JSON' WHEN content NOT LIKE '%summary%' THEN 'SCHEMA_ERROR' END AS why, status = 'failed' AS broke, status_code FROM n WHERE i <= 4),
    kind AS (SELECT *, CASE WHEN why IS NULL THEN 'ok' WHEN NOT broke THEN 'repair' WHEN why IN ('TIMEOUT', 'RATE_LIMIT', 'TRANSPORT_ERROR') OR why = 'PROVIDER_ERROR' AND coalesce(status_code, 0) >= 500 THEN 'retry' ELSE 'fail' END AS kind FROM k),
    run AS (SELECT *, count(*) OVER w AS nth, count(*) FILTER (kind = 'retry') OVER w AS retries, count(*) FILTER (kind = 'repair') OVER w AS repairs FROM kind WINDOW w AS (PARTITION BY review_id, agent_id ORDER BY i)),
    ended AS (SELECT review_id, agent_id, coalesce(min(nth) FILTER (kind IN ('ok', 'fail') OR retries > 1 OR repairs > 1), max(nth)) AS nth FROM run GROUP BY ALL), outcome AS (SELECT r.review_id, r.agent_id, r.why AS failure, r.nth AS calls FROM run r JOIN ended e ON e.review_id = r.review_id AND e.agent_id = r.agent_id AND e.nth = r.nth)"""


def _disclosed(x: DataFrame) -> DataFrame:
    return x.select("review_id").distinct().select("review_id", (F.col("review_id") % 10 != 3).alias("cloud_safe"))


def _context(h: DataFrame) -> DataFrame:
    """A context line at each of fifty lines of a hunk's new side, a hunk a span."""
    return h.select("review_id", F.col("new_path").alias("file_path"), "hunk_id", F.lit("new").alias("side"), F.lit(0).alias("first"), F.lit(49).alias("last"), F.lit("line-").alias("prefix"))


add("c12_repair_exhausted", agents.repair_exhausted, "call", sql=_LOOP + " SELECT DISTINCT review_id FROM outcome WHERE failure IN ('OUTPUT_TRUNCATED', 'EMPTY_RESPONSE', 'INVALID_JSON', 'SCHEMA_ERROR')")
add("m01_agent_outcomes", agents.agent_outcomes, "call", sql=_LOOP + " SELECT review_id, agent_id, CASE WHEN failure IS NULL THEN 'success' ELSE 'failed' END AS status, failure, calls::INT AS calls FROM outcome")
add("e15_e18_run_metrics", lambda c, k: agents.run_metrics(c, k).withColumn("cost", F.round("cost", 8)), "coverage", "call", sql=""" SELECT coalesce(c.review_id, k.review_id) AS review_id, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, coalesce(skipped, 0) AS skipped, coalesce(calls, 0) AS calls, coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(completion_tokens, 0) AS completion_tokens, coalesce(prompt_tokens + completion_tokens, 0) AS total_tokens, coalesce(cost, 0) AS cost, coalesce(latency_ms, 0) AS latency_ms
    FROM (SELECT review_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM coverage GROUP BY review_id) c FULL JOIN (SELECT review_id, count(*) AS calls, coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, round(coalesce(sum((coalesce(cache_hit_tokens, 0) * 0.003625 + (prompt_tokens - coalesce(cache_hit_tokens, 0)) * 0.435 + completion_tokens * 0.87)), 0)::DOUBLE / 1000000, 8) AS cost, sum(latency_ms)::BIGINT AS latency_ms FROM call GROUP BY review_id) k ON c.review_id = k.review_id""")
add("f26_f28_call_ids", lambda c: agents.call_ids(c.select("review_id", "agent_id", F.lit("v1").alias("prompt_version"), F.col("retry_number").alias("attempt"), F.col("call_id").alias("review_call_index"), F.lit("m").alias("model"), F.lit(4096).alias("max_tokens"), F.concat(F.lit("q"), F.col("call_id").cast("string")).alias("message"))).select("review_id", "review_call_index", "request_hash", "call_hash", "user"), "call", sql=""" SELECT review_id, call_id AS review_call_index, h AS request_hash, 'call-' || left(sha256(concat_ws(chr(0), review_id, agent_id, 'v1', retry_number, call_id, h)), 20) AS call_hash, 'reviewer-' || left(sha256(review_id::VARCHAR), 20) AS user FROM (SELECT *, sha256('{"max_tokens":2048,"messages":[{"content":"q' || call_id || '","role":"user"}],"model":"m","prompt_version":"v1"}') AS h FROM call)""")
add("m04_role_context", lambda x: agents.role_context(secrets.masked_lines(x, secrets.observations(x)), _disclosed(x), "security_scanner")[0].groupBy("review_id").agg(F.count("*").alias("lines"), F.max("line_ref").alias("last")), "line", sql=", " + _SEEN + ", shown AS (SELECT l.*, coalesce(replace(content, value, '<REDACTED:' || type || ':' || left(sha256(value), 12) || '>'), content) AS masked FROM line l LEFT JOIN seen USING (line_key, review_id, kind) WHERE file_path LIKE '%.py' AND review_id % 10 <> 3) SELECT review_id, count(*) AS lines, max('line-' || left(sha256(file_path || chr(0) || side || chr(0) || pos || chr(0) || masked), 20)) AS last FROM shown GROUP BY review_id")
add("m04_rejected_context", lambda x: agents.role_context(x, _disclosed(x), "diff_analyzer")[1], "line", sql=" SELECT review_id, CASE WHEN review_id % 10 = 3 THEN 'CONTEXT_UNSAFE' ELSE 'CONTEXT_INVALID' END AS failure FROM line GROUP BY review_id HAVING review_id % 10 = 3 OR NOT bool_or(file_path LIKE '%.py')")
add("m06_diff_analysis", lambda d: agents.diff_analyses(patch.files(patch.raw_lines(patches(d)), 10), d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("review_id"), F.lit("said").alias("summary")), d.where("doc_id % 4 = 0").select(F.col("doc_id").alias("review_id"), F.lit("TIMEOUT").alias("reason"))), tables=D, sql=_COUNTS + " SELECT doc_id AS review_id, CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 1 END::BIGINT AS files, additions::BIGINT AS additions, deletions::BIGINT AS deletions, (additions + deletions)::BIGINT AS changed_lines, CASE WHEN doc_id % 4 = 0 THEN 'Deterministic fallback analysis: TIMEOUT' WHEN doc_id % 3 = 0 THEN 'Deterministic fallback analysis: no analysis' ELSE 'said' END AS summary, additions + deletions > 10 AND doc_id % 7 <> 0 AND (doc_id % 4 = 0 OR doc_id % 3 = 0) AS truncated FROM c")
add("m07_review_artifacts", lambda d, c, k: agents.review_artifacts(d, c, k, "security-scanner", "Security Scanner", "SecurityReview", "security_semantic_review", "v1").select("review_id", "artifact_id", "coverage_id", "findings", "evidence", "lines", "duration_ms"), "draft", "context_line", "call", sql=""", sound AS (SELECT * FROM draft WHERE review_id NOT IN (SELECT review_id FROM draft x WHERE NOT EXISTS (FROM context_line c WHERE c.review_id = x.review_id AND c.line_ref = x.line_ref)))
    SELECT s.review_id, 'artifact-' || left(sha256(concat_ws(chr(0), s.review_id, 'security-scanner', 'v1')), 20) AS artifact_id, 'coverage-' || left(sha256(concat_ws(chr(0), s.review_id, 'security_semantic_review', 'v1')), 20) AS coverage_id, n AS findings, n AS evidence, lines, coalesce(ms, 0)::BIGINT AS duration_ms FROM (SELECT review_id, count(DISTINCT (turn, line_ref)) AS n FROM sound GROUP BY review_id) s JOIN (SELECT review_id, count(DISTINCT line_ref) AS lines FROM context_line GROUP BY review_id) c USING (review_id) LEFT JOIN (SELECT review_id, sum(latency_ms) AS ms FROM call WHERE agent_id = 'security-scanner' GROUP BY review_id) k USING (review_id)""")
add_sliced("m04_finding_summaries", lambda f, p, k, e, h: agents.finding_summaries(f, p, k, e, _context(h)).select("review_id", "finding_id", "category", "severity", _joined("line_refs"), _joined("levels")), "finding", "place", "link", "evidence", "hunk", sql=""" SELECT f.review_id, f.finding_id, category, severity, line_refs, levels FROM (SELECT DISTINCT review_id, finding_id, category, severity FROM finding) f JOIN (SELECT p.review_id, p.finding_id, array_to_string(list_sort(list(DISTINCT 'line-' || p.start_line)), ',') AS line_refs FROM place p JOIN hunk h ON h.review_id = p.review_id AND h.hunk_id = p.hunk_id AND h.new_path = p.file_path WHERE side = 'new' AND start_line < 50 GROUP BY ALL) r USING (review_id, finding_id)
    LEFT JOIN (SELECT review_id, finding_id, string_agg(level, ',' ORDER BY first) AS levels FROM (SELECT k.review_id, k.finding_id, level, min(k.evidence_id) AS first FROM (SELECT DISTINCT review_id, finding_id, evidence_id FROM link) k JOIN (SELECT DISTINCT review_id, evidence_id, level FROM evidence) e ON e.review_id = k.review_id AND e.evidence_id = k.evidence_id GROUP BY ALL) GROUP BY ALL) l USING (review_id, finding_id)""")
add("d17_unknown_refs", agents.unknown_references, "draft", "context_line", sql="SELECT DISTINCT review_id FROM draft d WHERE NOT EXISTS (FROM context_line c WHERE c.review_id = d.review_id AND c.line_ref = d.line_ref)")
_ROLE = "CASE conv_id % 3 WHEN 0 THEN 'security_scanner' WHEN 1 THEN 'diff_analyzer' ELSE 'quality_reviewer' END"


def _context_faults(t: DataFrame) -> DataFrame:
    """Contexts of conversations: a source or two, a line for each turn; some of everything wrong."""
    t = t.selectExpr("conv_id AS review_id", f"{_ROLE} AS role", "turn", "sha2(text, 256) AS content_hash")
    context = t.select("review_id", "role").distinct().withColumn("diff_hash", F.sha2(F.col("review_id").cast("string"), 256))
    n = F.col("review_id")
    sources = F.when(n % 11 == 0, F.array(F.lit("a"), F.lit("a"))).when((F.col("role") == "security_scanner") == (n % 13 != 0), F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    source = context.select("review_id", "role", F.explode(sources).alias("source_id"))
    line = t.where("review_id % 23 <> 5").select("review_id", "role", F.lit("src/a.py").alias("file_path"), F.lit("h1").alias("hunk_id"), F.lit("new").alias("side"), F.col("turn").alias("line_number"), "content_hash", F.lit("").alias("line_ref"))
    line = agents.trusted_refs(line, context).withColumn("line_ref", F.when((n % 17 == 3) & (F.col("line_number") == 0), "line-0").otherwise(F.col("trusted"))).drop("trusted", "diff_hash")
    line = line.unionByName(line.where("review_id % 19 = 4"))
    skills = F.array(*map(F.lit, agents.FROZEN_COVERAGE))
    coverage = context.select("review_id", F.explode(F.when(n % 12 == 6, F.slice(skills, 1, 2)).otherwise(skills)).alias("skill"))
    reference = line.where("line_number = 1").select("review_id", F.lit("f").alias("finding_id"), F.when(n % 15 == 9, "line-9").otherwise(F.col("line_ref")).alias("line_ref"))
    return agents.context_faults(context, source, line, coverage, reference)


add("t05_context_faults", _context_faults, tables=("conversations",), sql=f"""WITH c AS (SELECT conv_id AS review_id, {_ROLE} AS role, count(*) AS turns, bool_or(turn = 0) AS zero, bool_or(turn = 1) AS one FROM conversations GROUP BY ALL),
    s AS (SELECT *, CASE WHEN review_id % 11 = 0 THEN 2 WHEN (role = 'security_scanner') = (review_id % 13 <> 0) THEN 2 ELSE 1 END AS sources, review_id % 23 <> 5 AS lined FROM c)
    SELECT review_id, role, 'SOURCES_REPEATED' AS fault FROM s WHERE review_id % 11 = 0 UNION ALL SELECT review_id, role, 'SOURCE_COUNT' FROM s WHERE sources <> CASE WHEN role = 'security_scanner' THEN 2 ELSE 1 END UNION ALL SELECT review_id, role, 'NO_LINES' FROM s WHERE NOT lined
    UNION ALL SELECT review_id, role, 'LINES_REPEATED' FROM s WHERE lined AND review_id % 19 = 4 UNION ALL SELECT review_id, role, 'LINE_REF_UNDERIVED' FROM s WHERE lined AND zero AND review_id % 17 = 3 UNION ALL SELECT review_id, role, 'COVERAGE_NOT_FROZEN' FROM s WHERE role = 'security_scanner' AND review_id % 12 = 6
    UNION ALL SELECT review_id, role, 'FOREIGN_REFERENCE' FROM s WHERE role = 'security_scanner' AND lined AND one AND review_id % 15 = 9""")
add("m05_draft_evidence", lambda d, c: agents.draft_findings(d, c)[1].drop("evidence_id"), "draft", "context_line", sql="SELECT review_id, 'E1' AS level, 'llm' AS source, sha256(text) AS content_hash FROM draft d WHERE review_id NOT IN (SELECT review_id FROM draft x WHERE NOT EXISTS (FROM context_line c WHERE c.review_id = x.review_id AND c.line_ref = x.line_ref))")
add_sliced("d16_finding_lines", lambda p, h: agents.finding_lines(p, _context(h)).select("review_id", "finding_id", "line_ref"), "place", "hunk", sql="SELECT p.review_id, finding_id, 'line-' || start_line AS line_ref FROM place p JOIN hunk h ON h.review_id = p.review_id AND h.hunk_id = p.hunk_id AND h.new_path = p.file_path WHERE side = 'new' AND start_line < 50")
add_sliced("d26_evidence_levels", lambda k, e: agents.evidence_levels(k, e.select("review_id", "evidence_id", "level").distinct()).select("review_id", "finding_id", _joined("levels")), "link", "evidence", sql="SELECT review_id, finding_id, string_agg(level, ',' ORDER BY first) AS levels FROM (SELECT k.review_id, k.finding_id, level, min(k.evidence_id) AS first FROM link k JOIN (SELECT DISTINCT review_id, evidence_id, level FROM evidence) e ON e.review_id = k.review_id AND e.evidence_id = k.evidence_id GROUP BY ALL) GROUP BY ALL")
def _assignment(o: DataFrame) -> DataFrame:
    return o.where("o_orderkey % 12 <> 0").selectExpr("o_orderkey AS task_id", "o_orderkey AS review_id", "concat('t', o_orderkey) AS trace_id", "o_orderkey + 1 AS parent_task_id", "'diff' AS role", "1 AS attempt", "concat('d', o_orderkey) AS input_sha256", "concat('c', o_orderkey) AS context_sha256", "timestamp '2026-01-01 00:00:00' AS deadline_at")


def _delivery(o: DataFrame) -> DataFrame:
    """Deliveries of the orders, with one fault each by the key modulo 12."""
    but = lambda n, wrong, right: f"CASE WHEN o_orderkey % 12 = {n} THEN {wrong} ELSE {right} END"
    return o.selectExpr("o_orderkey AS task_id", but(1, "-1", "o_orderkey") + " AS review_id", but(2, "'u'", "concat('t', o_orderkey)") + " AS trace_id", but(3, "0", "o_orderkey + 1") + " AS parent_task_id", but(4, "'quality'", "'diff'") + " AS role", but(5, "2", "1") + " AS attempt", but(6, "'x'", "concat('d', o_orderkey)") + " AS input_sha256", but(7, "'x'", "concat('c', o_orderkey)") + " AS context_sha256", but(8, "timestamp '2026-01-01 00:00:01'", "timestamp '2026-01-01 00:00:00'") + " AS finished_at", but(9, "0", "1") + " AS model_calls", but(10, "'BLOCKED'", "'SUCCESS'") + " AS status")


#: A request's input document: canonical, safe and of its review, but for some.
_DOC = "concat('{\"cloud_safe\":', CASE WHEN o_orderkey % 7 = 5 THEN 'false' ELSE 'true' END, CASE WHEN o_orderkey % 7 = 2 THEN ', ' ELSE ',' END, '\"review_id\":', CASE WHEN o_orderkey % 7 = 4 THEN o_orderkey + 1 ELSE o_orderkey END, '}\\n')"
_DRAFT = "{\"category\":\"secret\",\"claim\":\"c\",\"confidence\":0.5,\"line_refs\":[\"a\",\"b\"],\"recommendation\":\"r\",\"severity\":\"low\",\"title\":\"t\"}"
#: A role's payload: 0 and 1 are a review's, 2 is the analyst's, the others are neither.
_PAYLOAD = "concat('{', CASE o_orderkey % 10 WHEN 0 THEN '\"findings\":[],' WHEN 1 THEN '\"findings\":[" + _DRAFT + "],' WHEN 2 THEN '\"affected_symbols\":[],\"change_intents\":[\"a\"],' WHEN 3 THEN '\"findings\":[],\"more\":1,' WHEN 4 THEN '\"findings\":[" + _DRAFT.replace("0.5", "1.5") + "],' WHEN 5 THEN '\"findings\":[" + _DRAFT.replace("[\"a\",\"b\"]", "[\"a\",\"a\"]") + "],' WHEN 6 THEN '\"findings\":[" + ",".join([_DRAFT] * 11) + "],' WHEN 7 THEN '\"findings\":[" + _DRAFT.replace("[\"a\",\"b\"]", "[]") + "],' ELSE '' END, '\"summary\":\"', CASE WHEN o_orderkey % 10 = 8 THEN ' ' ELSE concat('s', o_orderkey) END, '\"}')"


def _read(documents: DataFrame) -> DataFrame:
    return documents.withColumns({"canonical": transport.canonical("text"), "sha256": F.sha2("text", 256)})


def _drafts(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks of reviews, and the drafts of those whose number is no multiple of 4: their findings."""
    task = f.where("review_id % 3 <> 0").select(F.col("review_id").alias("task_id")).distinct().selectExpr("task_id", "'security_scanner' AS role", "concat('all of ', task_id) AS summary", "concat('shared/', task_id) AS ref", "concat('d', task_id) AS sha256")
    draft = f.where("review_id % 3 <> 0 and review_id % 4 <> 0").selectExpr("review_id AS task_id", "crc32(finding_id) AS place", "finding_id AS claim", "array(hunk_id, side) AS line_refs", "confidence_pct / 4 AS confidence").distinct()
    return task, draft


_TASKS = """, task AS (SELECT DISTINCT review_id AS task_id, 'all of ' || review_id AS summary FROM finding WHERE review_id % 3 <> 0), d AS (SELECT DISTINCT review_id AS task_id, finding_id AS claim, hunk_id, side, confidence_pct / 4 AS confidence FROM finding WHERE review_id % 3 <> 0 AND review_id % 4 <> 0),
    told AS (SELECT task_id, coalesce(claim, summary) AS summary, '{"confidence":' || coalesce(confidence::VARCHAR, 'null') || ',"input_artifact":{"ref":"shared/' || task_id || '","sha256":"d' || task_id || '"},"line_refs":[' || CASE WHEN claim IS NULL THEN '' ELSE '"' || hunk_id || '","' || side || '"' END || '],"role":"security_scanner","summary":"' || coalesce(claim, summary) || '"}' || chr(10) AS j FROM task LEFT JOIN d USING (task_id))"""


def _wrong(f: DataFrame) -> DataFrame:
    """Faults of the deliveries' own evidence after some was altered, by the task modulo 7."""
    task, draft = _drafts(f)
    evidence, n = transport.worker_evidence(task, draft), F.col("task_id") % 7
    evidence = evidence.withColumns({"content_hash": F.when(n == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")), "evidence_id": F.when(n == 1, F.lit("evidence-x")).otherwise(F.col("evidence_id")), "summary": F.when(n == 2, F.lit("said otherwise")).otherwise(F.col("summary"))}).where("task_id % 7 <> 3")
    return transport.delivery_faults(task, draft, evidence)


add("d23_correlation", lambda o: transport.correlate(_delivery(o), _assignment(o)), tables=("orders",), sql="SELECT o_orderkey AS task_id, CASE o_orderkey % 12 WHEN 0 THEN 'UNASSIGNED' WHEN 1 THEN 'REVIEW_ID_MISMATCH' WHEN 2 THEN 'TRACE_ID_MISMATCH' WHEN 3 THEN 'PARENT_TASK_ID_MISMATCH' WHEN 4 THEN 'ROLE_MISMATCH' WHEN 5 THEN 'ATTEMPT_MISMATCH' WHEN 6 THEN 'INPUT_SHA256_MISMATCH' WHEN 7 THEN 'CONTEXT_SHA256_MISMATCH' WHEN 8 THEN 'LATE' WHEN 9 THEN 'CALLS' ELSE 'BLOCKED' END AS fault FROM orders WHERE o_orderkey % 12 <> 11")
add("d24_request_correlation", lambda o: transport.correlate_request(_assignment(o).where("task_id % 12 <> 0"), o.where("o_orderkey % 7 <> 1").selectExpr("o_orderkey AS review_id", "concat('t', o_orderkey) AS trace_id", "CASE WHEN o_orderkey % 7 = 2 THEN -1 ELSE o_orderkey + 1 END AS root_task_id", "CASE WHEN o_orderkey % 7 = 3 THEN 'other' ELSE concat('d', o_orderkey) END AS input_sha256", "CASE WHEN o_orderkey % 7 = 4 THEN timestamp '2025-12-31 00:00:00' ELSE timestamp '2026-01-02 00:00:00' END AS deadline_at")).withColumnRenamed("review", "review_id"), tables=("orders",), sql="SELECT o_orderkey AS review_id, CASE o_orderkey % 7 WHEN 1 THEN 'UNREQUESTED' WHEN 2 THEN 'PARENT_TASK_ID_MISMATCH' WHEN 3 THEN 'INPUT_SHA256_MISMATCH' ELSE 'LATE' END AS fault FROM orders WHERE o_orderkey % 12 <> 0 AND o_orderkey % 7 IN (1, 2, 3, 4)")
add("a10_request_source", lambda o: transport.request_faults(o.selectExpr("o_orderkey AS review_id", "concat('shared/', o_orderkey) AS input_ref", f"sha2(concat({_DOC}, CASE WHEN o_orderkey % 7 = 3 THEN 'x' ELSE '' END), 256) AS input_sha256", "CASE WHEN o_orderkey % 7 = 0 THEN timestamp '2026-01-01 00:00:00' ELSE timestamp '2026-01-03 00:00:00' END AS deadline_at"), _read(o.where("o_orderkey % 7 <> 1").selectExpr("concat('shared/', o_orderkey) AS ref", f"{_DOC} AS text")), F.expr("timestamp '2026-01-02 00:00:00'")), tables=("orders",), sql="SELECT o_orderkey AS review_id, CASE o_orderkey % 7 WHEN 0 THEN 'EXPIRED' WHEN 1 THEN 'INPUT_MISSING' WHEN 2 THEN 'NOT_CANONICAL' WHEN 3 THEN 'DIGEST_MISMATCH' WHEN 4 THEN 'REVIEW_MISMATCH' ELSE 'NOT_SAFE' END AS fault FROM orders WHERE o_orderkey % 7 <> 6")
for _role, _name in (("security_scanner", "security"), ("diff_analyzer", "diff")):
    add(f"a12_{_name}_payloads", lambda o, role=_role: transport.role_payloads(o.selectExpr("o_orderkey AS key", f"{_PAYLOAD} AS canonical"), role)[0].select("key", F.col("payload.summary").alias("summary")), tables=("orders",), sql=f"SELECT o_orderkey AS key, 's' || o_orderkey AS summary FROM orders WHERE o_orderkey % 10 IN {'(0, 1)' if _name == 'security' else '(2, 2)'}")
add("d25_u05_digest_diff", lambda p: transport.digest_diff(p.where("p_partkey % 7 <> 0").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.sha2("p_name", 256).alias("sha256")), p.where("p_partkey % 5 <> 0").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.sha2(F.when(F.col("p_partkey") % 3 == 0, F.lit("x")).otherwise(F.col("p_name")), 256).alias("sha256"))), tables=("part",), sql="SELECT 'f' || p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'unexpected' ELSE 'changed' END AS state FROM part WHERE (p_partkey % 5 = 0) <> (p_partkey % 7 = 0) OR (p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0)")
add("e21_tree_digest", lambda p: transport.tree_digest(p.select((F.col("p_partkey") % 20).alias("package"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.sha2("p_name", 256).alias("sha256"))), tables=("part",), sql="""SELECT p_partkey % 20 AS package, sha256('[' || string_agg('{"path":"f' || p_partkey || '","sha256":"' || sha256(p_name) || '"}', ',' ORDER BY 'f' || p_partkey) || ']' || chr(10)) AS digest FROM part GROUP BY 1""")
add("e22_quiet", lambda o: transport.quiet(o.select(F.col("o_orderkey").alias("key"), F.explode(F.array(*[F.struct(F.expr(f"CAST(CASE WHEN o_orderkey % 5 = 1 AND {i} = 0 THEN 1 WHEN o_orderkey % 5 = 2 AND {i} = 1 THEN 64 WHEN o_orderkey % 5 = 3 AND {i} = 2 THEN 129 ELSE {i} * 65 END AS INT)").alias("t"), F.expr(f"CASE WHEN o_orderkey % 5 = 4 AND {i} = 1 THEN 'b' ELSE 'a' END").alias("u")) for i in range(3)])).alias("s")).select("key", F.col("s.t").alias("elapsed"), F.col("s.u").alias("usage"))), tables=("orders",), sql="SELECT o_orderkey AS key, o_orderkey % 5 = 0 AS quiet FROM orders")
add("t01_control", lambda o: transport.control_messages(o.selectExpr("o_orderkey AS task_id", "o_custkey AS review_id", "CASE WHEN o_orderkey % 9 = 0 THEN repeat('x', 4050) ELSE 'diff' END AS role", "'d' || CAST(o_orderkey AS STRING) AS input_sha256")), tables=("orders",), sql="""SELECT task_id, message, strlen(message) <= 4096 AS fits FROM (SELECT o_orderkey AS task_id, '{"input_sha256":"d' || o_orderkey || '","review_id":' || o_custkey || ',"role":"' || CASE WHEN o_orderkey % 9 = 0 THEN repeat('x', 4050) ELSE 'diff' END || '","task_id":' || o_orderkey || '}' AS message FROM orders)""")
add("f18_t02_delivery", lambda f: transport.worker_evidence(*_drafts(f)).select("task_id", "evidence_id", "summary", "content_hash"), "finding", sql=_TASKS + " SELECT task_id, 'evidence-' || left(sha256(j), 20) AS evidence_id, summary, sha256(j) AS content_hash FROM told")
add("t03_delivery_faults", lambda f: _wrong(f), "finding", sql=_TASKS + " SELECT task_id, unnest(CASE task_id % 7 WHEN 0 THEN ['HASH_MISMATCH', 'ID_MISMATCH'] WHEN 1 THEN ['ID_MISMATCH'] WHEN 2 THEN ['HASH_MISMATCH', 'OUTPUT_MISMATCH'] ELSE ['OUTPUT_MISMATCH'] END) AS fault FROM task WHERE task_id % 7 < 4 UNION SELECT task_id, 'DUPLICATE_EVIDENCE' FROM d WHERE task_id % 7 = 1 GROUP BY task_id HAVING count(*) > 1")
add("t04_blocked_deliveries", lambda f, c: transport.blocked_deliveries(f.select("review_id").distinct(), c), "finding", "coverage", sql="SELECT DISTINCT review_id FROM finding WHERE review_id NOT IN (SELECT review_id FROM coverage WHERE status = 'failed' AND skill IN ('detect_secret', 'detect_injection', 'detect_dangerous_call'))")
add("c19_commands", lambda p: transport.accepted_commands(p.select("p_partkey", (F.col("p_partkey") % 4 == 3).cast("int").alias("returncode"), F.when(F.col("p_partkey") % 5 == 0, "Permission denied").when(F.col("p_partkey") % 7 == 0, "total 0 B").otherwise("ok").alias("stdout"), F.lit("").alias("stderr")), True).select("p_partkey"), tables=("part",), sql="SELECT p_partkey FROM part WHERE p_partkey % 4 <> 3 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0")
add("a19_trace_lines", lambda c: sinks.trace_lines(c.select("review_id", "call_id", "status")), "call", sql="""SELECT review_id, '{"call_id":' || call_id || ',"review_id":' || review_id || ',"status":"' || status || '"}' AS value FROM call""")
add("s01_sessions", lambda e: stream.sessions(e).drop("value"), tables=("events",), sql="SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS end, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("event_id")


# ---- assembly ----------------------------------------------------------------------------------------------------

add("c06_scope", _documents(lambda x: assembly.out_of_scope(patch.files(x))), tables=D, sql=_COUNTS + " SELECT doc_id AS review_id FROM c WHERE doc_id % 7 = 0 OR doc_id % 11 = 0 OR additions + deletions > 1000")
add("c11_deterministic_plan", lambda r: assembly.deterministic_plan(_plan(r)), "route", sql=_PLAN + " SELECT review_id, skill FROM plan WHERE planned AND skill LIKE 'detect%'")
add("u07_skipped_skills", lambda r: assembly.skipped_skills(_plan(r)), "route", sql=_PLAN + " SELECT review_id, skill FROM plan WHERE NOT planned")
add("x12_x13_suite", lambda c: assembly.suite(c).groupBy("review_id").agg(assembly.roll_up(F.col("status")).alias("status"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "status"))), lambda x: x["status"]), ",").alias("statuses")), "coverage", sql=""", g AS (SELECT r.review_id, place, coalesce(c.status, 'skipped') AS st FROM (SELECT DISTINCT review_id FROM coverage) r CROSS JOIN (VALUES (0, 'detect_secret'), (1, 'detect_injection'), (2, 'detect_dangerous_call')) s(place, skill) LEFT JOIN coverage c ON c.review_id = r.review_id AND c.skill = s.skill)
    SELECT review_id, CASE WHEN bool_or(st = 'failed') THEN 'failed' WHEN bool_or(st = 'skipped') THEN 'partial' ELSE 'success' END AS status, string_agg(st, ',' ORDER BY place) AS statuses FROM g GROUP BY review_id""")
add("c16_artifact_or_failure", lambda c: assembly.artifact_or_failure(c, c, ["diff-analyzer", "security-scanner", "quality-reviewer"]), "call", sql="SELECT r.review_id, a.agent_id, coalesce(min(c.status), 'failed') AS status, count(c.call_id) AS calls FROM (SELECT DISTINCT review_id FROM call) r CROSS JOIN (VALUES ('diff-analyzer'), ('security-scanner'), ('quality-reviewer')) a(agent_id) LEFT JOIN call c ON c.review_id = r.review_id AND c.agent_id = a.agent_id GROUP BY ALL")
add("e20_u06_first_by_id", lambda f: assembly.first_by_id(f, "fingerprint", "finding_id").select("review_id", "fingerprint", "finding_id"), "finding", sql="SELECT review_id, fingerprint, min(finding_id) AS finding_id FROM finding GROUP BY ALL")
add("w08_ordered_distinct", lambda c: c.groupBy("review_id").agg(F.array_join(assembly.ordered_distinct(F.col("agent_id"), F.col("call_id")), ",").alias("agents")), "call", sql="SELECT review_id, string_agg(agent_id, ',' ORDER BY first) AS agents FROM (SELECT review_id, agent_id, min(call_id) AS first FROM call GROUP BY ALL) GROUP BY review_id")
add("b15_known_paths", validation.known_paths, "hunk", sql="SELECT review_id, old_path AS path FROM hunk UNION SELECT review_id, new_path FROM hunk")
add("b12_node_line", lambda f, p: assembly.node_lines(p.select("review_id", "hunk_id", F.col("finding_id").alias("node"), "start_line", "end_line"), f.select("review_id", "hunk_id", F.col("start_line").alias("line_number"), F.when(F.col("side") == "new", "addition").otherwise("context").alias("kind"))), "finding", "place", sql="SELECT n.review_id, n.hunk_id, n.finding_id AS node, coalesce(min(l.start_line) FILTER (l.side = 'new'), min(l.start_line)) AS line_number FROM place n JOIN finding l ON l.review_id = n.review_id AND l.hunk_id = n.hunk_id AND l.start_line BETWEEN n.start_line AND n.end_line GROUP BY ALL")
add("u08_appended", lambda e: assembly.appended(e.where("start_line < 30 or start_line is null"), e, e.where("start_line >= 30 and start_line <> 33")), "evidence", sql="SELECT DISTINCT review_id FROM evidence WHERE start_line = 33")
add("c20_complete_routes", lambda o: assembly.complete_routes(o.select((F.col("o_orderkey") / 4).cast("long").alias("review_id"), F.get(F.array(*map(F.lit, assembly.ROLES)), F.when(F.col("o_orderkey") % 44 == 3, 0).otherwise(F.col("o_orderkey") % 4).cast("int")).alias("role"))), tables=("orders",), sql="SELECT o_orderkey // 4 AS review_id FROM orders GROUP BY 1 HAVING count(*) = 4 AND count(DISTINCT CASE WHEN o_orderkey % 44 = 3 THEN 0 ELSE o_orderkey % 4 END) = 4")
add("c18_control_allowed", lambda o: o.select(F.col("o_orderkey").alias("task_id"), assembly.is_control_message(F.expr("CASE o_orderkey % 6 WHEN 0 THEN '{\"input_sha256\":\"d\",\"review_id\":1,\"role\":\"diff\",\"task_id\":2}' WHEN 1 THEN '{\"input_sha256\":\"d\",\"review_id\":1,\"role\":\"diff\"}' WHEN 2 THEN '{\"input_sha256\":\"d\",\"review_id\":1,\"role\":{\"deep\":[{\"prompt\":1}]},\"task_id\":2}' WHEN 3 THEN '[1]' WHEN 4 THEN '{\"content\":1,\"input_sha256\":\"d\",\"review_id\":1,\"role\":\"diff\",\"task_id\":2}' ELSE 'no json' END")).alias("allowed")), tables=("orders",), sql="SELECT o_orderkey AS task_id, o_orderkey % 6 = 0 AS allowed FROM orders")
add("f25_t08_without_times", lambda e: e.select("event_id", assembly.without_times(F.expr("concat('{\"z\":', event_id, ',\"createdAt\":\"', event_id, '\",\"list\":[\"b\",\"a\"],\"in\":{\"updated_at\":1,\"k\":[2,1]}}')")).alias("plain")), tables=("events",), sql="""SELECT event_id, '{"in":{"k":[2,1]},"list":["a","b"],"z":' || event_id || '}' || chr(10) AS plain FROM events""")

# ---- code detectors: no SQL equivalent ---------------------------------------------------------------------------

#: Snippets of Python, one hunk each; every line is an addition.
SNIPPETS = [
    'cursor.execute("SELECT * FROM t WHERE id=" + user_id)', 'query = f"SELECT {x}"\ncursor.execute(query)', 'db.execute("SELECT 1")', 'cursor.execute("SELECT ? FROM t", (x,))', 'os.system("deploy " + branch)', 'import subprocess\nsubprocess.run(command, shell=True)', 'subprocess.run(["git", "status"], check=True)',
    "eval(text)", "from builtins import eval as evaluate\nevaluate(text)", "import subprocess as process\nprocess.call(cmd, shell=True)", 'os.popen("ls")', "x = 1\nreturn x", "def broken(:", '# os.system("x")\nprint("eval(x)")', "    if a:\n        os.system(b)", "import os.path\nos.system(name)",
    "import os\nos.execv(path, args)", "fabric.run(command, shell=True)", 'import os\nexec(code)\nos.spawnvp(mode, file)',
]


def snippet_lines(docs: DataFrame) -> DataFrame:
    """A hunk for each document: a snippet, then the document's lines as comments."""
    table = F.array(*[F.lit(s) for s in SNIPPETS])
    text = F.regexp_replace(F.regexp_replace("text", "\n", "\n# "), "[^\n -~]", "?")
    whole = F.concat(F.get(table, (F.col("doc_id") % len(SNIPPETS)).cast("int")), F.lit("\n# "), F.coalesce(text, F.lit("")))
    rows = docs.select(F.col("doc_id").alias("review_id"), F.posexplode(F.split(whole, "\n")).alias("ordinal", "content"))
    return rows.select("review_id", F.lit("src/a.py").alias("file_path"), F.lit("h1").alias("hunk_id"), "ordinal", F.lit("addition").alias("kind"), F.lit("new").alias("side"), (F.col("ordinal") + 1).cast("long").alias("line_number"), "content")


def _rules(*names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda d: code.detect_code(snippet_lines(d)).where(F.col("rule").isin(*names)).select("review_id", "rule", "line", "status", "level")


#: What each snippet must give, told by hand: (snippet, rule, line), by query.
_EXPECTED = {
    "x03_sql": [(0, "CS-INJECT-SQL-DYNAMIC", 1), (1, "CS-INJECT-SQL-DYNAMIC", 2)],
    "x04_shell": [(n, "CS-INJECT-SHELL-DYNAMIC", line) for n, line in ((4, 1), (5, 2), (9, 2), (14, 2), (15, 2))],
    "x05_x07_danger": [(4, "CS-DANGER-OS-SYSTEM", 1), (5, "CS-DANGER-SUBPROCESS-SHELL", 2), (7, "CS-DANGER-DYNAMIC-EXEC", 1), (8, "CS-DANGER-DYNAMIC-EXEC", 2), (9, "CS-DANGER-SUBPROCESS-SHELL", 2), (14, "CS-DANGER-OS-SYSTEM", 2), (15, "CS-DANGER-OS-SYSTEM", 2), (18, "CS-DANGER-DYNAMIC-EXEC", 2)],
    "x08_d21_observed": [(10, "B605", 1), (16, "B606", 2), (17, "B604", 1), (18, "B606", 3)],
}
for _name, _found in _EXPECTED.items():
    _sure = "'suspected' AS status, 'E2' AS level" if "observed" in _name else "'confirmed' AS status, 'E3' AS level"
    _values = ", ".join(f"({n}, '{rule}', {line})" for n, rule, line in _found)
    add(_name, _rules(*{rule for _, rule, _ in _found} | (set(code.OBSERVED) if "observed" in _name else set())), tables=D, sql=f"SELECT doc_id AS review_id, rule, line::BIGINT AS line, {_sure} FROM documents JOIN (VALUES {_values}) x(snippet, rule, line) ON snippet = doc_id % {len(SNIPPETS)}")
add("x09_x10_detector", lambda d: code.detect_code(snippet_lines(d)).where("error_code is null").groupBy("review_id").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence")), tables=D, sql=f"SELECT doc_id AS review_id, n::BIGINT AS n, confidence::DOUBLE AS confidence FROM documents JOIN (VALUES (0, 1, 1), (1, 1, 1), (4, 2, 2), (5, 2, 2), (7, 1, 1), (8, 1, 1), (9, 2, 2), (10, 1, 0.9), (14, 2, 2), (15, 2, 2), (16, 1, 0.75), (17, 1, 0.6), (18, 2, 1.75)) x(snippet, n, confidence) ON snippet = doc_id % {len(SNIPPETS)}")
add("b11_x11_envelope", lambda d: code.detect_code(snippet_lines(d)).where("error_code is not null").select("review_id", "error_code", "level"), tables=D, sql=f"SELECT doc_id AS review_id, 'CONTEXT_INSUFFICIENT' AS error_code, 'E0' AS level FROM documents WHERE doc_id % {len(SNIPPETS)} = 12")
