"""Projections of the driver's tables onto the relations of a review, as SQL that Spark and DuckDB both run.

Every relation is keyed by review_id. Identifiers, intervals and enumerations come from whole-number arithmetic on the
tables' columns, so both engines see the same rows. A fifth of the reviews is calm (their records are sound), so that
decisions of every status occur; the others hold every kind of fault.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ID = "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS INT) AS STRING) || '-' || CAST(CAST(l_shipdate AS DATE) AS STRING)"
_CATEGORY = "CASE l_partkey % 9 WHEN 0 THEN 'secret' WHEN 1 THEN 'sql_injection' WHEN 2 THEN 'command_injection' WHEN 3 THEN 'dangerous_call' WHEN 4 THEN 'auth_boundary' WHEN 5 THEN 'logic' WHEN 6 THEN 'exception_handling' WHEN 7 THEN 'performance' ELSE 'test_gap' END"
_SEVERITY = "CASE WHEN l_orderkey % 5 = 0 THEN CASE WHEN l_quantity > 25 THEN 'low' ELSE 'info' END WHEN l_quantity > 40 THEN 'critical' WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 20 THEN 'medium' WHEN l_quantity > 10 THEN 'low' ELSE 'info' END"
_TAX = "CAST(ROUND(l_tax * 100) AS INT)"
_FILE = "CAST(CASE WHEN l_orderkey % 5 = 0 OR l_partkey % 3 <> 0 THEN l_suppkey % 4 ELSE l_suppkey % 5 END AS STRING)"
_OWNER = "'a-' || CAST(l_orderkey AS STRING) || CASE WHEN l_suppkey % 2 = 0 THEN '-s' ELSE '-q' END"
_SIDE = "CASE WHEN l_linenumber % 4 = 0 AND l_orderkey % 5 <> 0 THEN 'old' ELSE 'new' END"
_NAMED = "CASE WHEN l_linenumber % 4 = 0 AND l_orderkey % 5 <> 0 AND CAST(CASE WHEN l_partkey % 3 <> 0 THEN l_suppkey % 4 ELSE l_suppkey % 5 END AS INT) = 3 THEN 'src/old3.py' ELSE 'src/m' || " + _FILE + " || '.py' END"
_FINDING = f"""SELECT l_orderkey AS review_id, {_OWNER} AS artifact_id, 'f-' || {_ID} AS finding_id, {_CATEGORY} AS category, {_SEVERITY} AS severity,
        CASE WHEN l_partkey % 37 = 0 THEN 'unverified' WHEN l_returnflag = 'A' THEN 'confirmed' WHEN l_returnflag = 'N' THEN 'suspected' ELSE 'dismissed' END AS status,
        {_NAMED} AS file_path, l_partkey % 40 AS start_line, l_partkey % 40 + l_linenumber % 3 AS end_line, {_SIDE} AS side, 'h' || {_FILE} AS hunk_id,
        CASE WHEN l_suppkey % 2 = 0 THEN 'security-scanner' ELSE 'quality-reviewer' END AS agent_id, CASE WHEN l_orderkey % 5 = 0 THEN 'fp-' || {_ID} ELSE 'fp-' || CAST(l_partkey % 50 AS STRING) END AS fingerprint,
        100 - CAST(ROUND(l_discount * 100) AS INT) AS confidence_pct FROM lineitem"""
_PLACE = f"SELECT l_orderkey AS review_id, 'f-' || {_ID} AS finding_id, {_NAMED} AS file_path, 'h' || {_FILE} AS hunk_id, {_SIDE} AS side, l_partkey % 40 + {{shift}} AS start_line, l_partkey % 40 + l_linenumber % 3 + {{shift}} AS end_line, 's-' || CAST(l_partkey % 40 AS STRING) AS snippet_hash FROM lineitem WHERE {{where}}"
_EVIDENCE = f"""SELECT l_orderkey AS review_id, {_OWNER} AS artifact_id, '{{prefix}}-' || {_ID} AS evidence_id, 'f-' || {_ID} AS finding_id, {{level}} AS level,
        CASE l_suppkey % 4 WHEN 0 THEN 'rule' WHEN 1 THEN 'static_tool' WHEN 2 THEN 'llm' ELSE 'human' END AS source,
        CASE l_partkey % 3 WHEN 0 THEN 'detect_secret' WHEN 1 THEN 'detect_injection' ELSE 'detect_dangerous_call' END AS detector_name,
        CASE l_linenumber % 3 WHEN 0 THEN '1.0.0' WHEN 1 THEN '1.1.0' ELSE '0.9.0' END AS detector_version,
        {{located}} {_NAMED} END AS file_path, {{located}} l_partkey % 40 + {{shift}} END AS start_line, {{located}} l_partkey % 40 + {{shift}} END AS end_line,
        {{located}} {_SIDE} END AS side, {{located}} 'h' || CASE WHEN l_partkey % 11 = 0 AND l_orderkey % 5 <> 0 THEN '9' ELSE {_FILE} END END AS hunk_id, {{located}} 's-' || CAST(l_partkey % 40 AS STRING) END AS snippet_hash,
        'c-' || CAST(l_partkey % 60 AS STRING) AS content_hash FROM lineitem WHERE {{where}}"""
_SOMEWHERE = "CASE WHEN l_orderkey % 5 = 0 OR l_partkey % 43 <> 0 THEN"
_LEVEL = f"CASE WHEN l_orderkey % 5 = 0 THEN 'E1' ELSE 'E' || CAST({_TAX} % 4 AS STRING) END"
_SHIFT = "CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_linenumber % 2 END"

#: Lines of code that stand in for some lines of prose; the secrets are made up.
_CODE = [
    "'cursor.execute(sql)'", "'os.system(cmd)'", "'value = eval(text)'", "'if user.is_admin:'", "'for item in items:'", "'    except Exception:'", "'return total'", "'key = \"AKIA' || 'IOSFODNN7EXAMPLE\"'", "'key = \"sk-' || 'exampleEXAMPLE0123456789exampleEX\"'", "'key = \"ghp_' || 'exampleEXAMPLE0123456789exampleEXAMP0\"'",
    "'password = \"correct-horse-battery-9\"'", "'token: \"a1b2c3d4e5f6g7h8\"'", "'while True:'", "'data = yaml.load(stream)'", "'subprocess.run(args)'", "'rows = query(x)'",
]
_CONTENT = "CASE WHEN n % 5 IN (0, 3) AND (doc_id + n) % 4 = 0 THEN CASE (doc_id * 3 + n) % 16 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_CODE)) + " END ELSE content END"


def _union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


#: Number, category, skill, whether mandatory and where of the routes that a review may have beside its first.
_MORE_ROUTES = [(2, "sql_injection", "detect_injection", "o_orderkey % 2 = 0", "o_orderkey % 3 = 1"), (3, "performance", "review_code_quality", "true", "o_orderkey % 12 = 1"), (4, "auth_boundary", "security_semantic_review", "true", "o_orderkey % 24 = 1")]
_ROUTE_FILE = "CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 4 ELSE o_orderkey % 6 END"
_SKILL_GRID = "CROSS JOIN (SELECT 0 AS n, 'detect_secret' AS skill UNION ALL SELECT 1, 'security_semantic_review' UNION ALL SELECT 2, 'review_code_quality' UNION ALL SELECT 3, 'detect_injection') s"
_COVERED = "o.o_orderkey AS review_id, 'c-' || CAST(o.o_orderkey AS STRING) || '-' || s.skill AS coverage_id"


#: Relation -> SQL over the driver's tables.
RELATIONS: dict[str, str] = {
    "review": """SELECT o_orderkey AS review_id, CASE WHEN o_orderkey % 83 = 7 THEN ' ' ELSE 't-' || CAST(o_orderkey AS STRING) END AS trace_id, CASE WHEN o_orderkey % 89 <> 3 THEN CAST('2026-01-01 00:00:00' AS TIMESTAMP) END AS decided_at,
        o_orderkey AS diff_review_id, CASE WHEN o_orderkey % 97 = 11 THEN o_orderkey + 1 ELSE o_orderkey END AS risk_review_id, o_orderkey % 40 = 1 AS truncated, o_orderkey % 40 = 2 AS unsupported, o_orderkey % 31 = 4 AS repair_exhausted, o_orderkey % 29 = 5 AS recheck_exhausted FROM orders""",
    "finding": _union(_FINDING, _FINDING + " WHERE l_partkey % 101 = 0 AND l_orderkey % 5 <> 0"),
    "place": _union(_PLACE.format(shift="0", where="l_partkey % 31 <> 0 OR l_orderkey % 5 = 0"), _PLACE.format(shift="6", where="l_partkey % 6 = 0 AND l_partkey % 31 <> 0")),
    "evidence": _union(
        _EVIDENCE.format(prefix="e", level=_LEVEL, located=_SOMEWHERE, shift=_SHIFT, where="true"),
        _EVIDENCE.format(prefix="e2", level=f"CASE WHEN l_orderkey % 5 = 0 THEN 'E2' ELSE 'E' || CAST(({_TAX} + 3) % 4 AS STRING) END", located="CASE WHEN true THEN", shift="0", where="l_partkey % 4 = 0"),
        _EVIDENCE.format(prefix="e", level=_LEVEL, located=_SOMEWHERE, shift=_SHIFT, where="l_partkey % 103 = 0 AND l_orderkey % 5 <> 0"),
    ),
    "link": _union(
        f"SELECT l_orderkey AS review_id, 'f-' || {_ID} AS finding_id, CASE WHEN l_partkey % 13 = 0 AND l_orderkey % 5 <> 0 THEN 'e-missing-' || CAST(l_partkey AS STRING) ELSE 'e-' || {_ID} END AS evidence_id FROM lineitem",
        f"SELECT l_orderkey AS review_id, 'f-' || {_ID} AS finding_id, 'e2-' || {_ID} AS evidence_id FROM lineitem WHERE l_partkey % 4 = 0",
    ),
    "verified": _union(
        f"SELECT l_orderkey AS review_id, CASE WHEN l_suppkey % 17 = 0 THEN 'e-gone-' ELSE 'e-' END || {_ID} AS evidence_id FROM lineitem WHERE l_orderkey % 5 <> 0 AND ({_TAX} % 4 = 3 AND l_linenumber % 5 <> 0 OR l_partkey % 29 = 0)",
        f"SELECT l_orderkey AS review_id, 'e2-' || {_ID} AS evidence_id FROM lineitem WHERE l_orderkey % 5 <> 0 AND l_partkey % 4 = 0 AND ({_TAX} + 3) % 4 = 3",
    ),
    "hunk": "SELECT o.o_orderkey AS review_id, 'h' || CAST(i.i AS STRING) AS hunk_id, 'src/m' || CAST(i.i AS STRING) || '.py' AS new_path, CASE WHEN i.i = 3 THEN 'src/old3.py' ELSE 'src/m' || CAST(i.i AS STRING) || '.py' END AS old_path FROM orders o CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) i",
    "route": _union(
        *[
            f"""SELECT o_orderkey AS review_id, 'r-' || CAST(o_orderkey AS STRING) AS route_id, CASE o_orderkey % 6 WHEN 0 THEN 'secret' WHEN 1 THEN 'sql_injection' WHEN 2 THEN 'command_injection' WHEN 3 THEN 'logic' WHEN 4 THEN 'dangerous_call' ELSE 'performance' END AS category,
            {skill} AS skill, o_orderpriority IN ('1-URGENT', '2-HIGH') AS mandatory FROM orders WHERE {where}"""
            for skill, where in (("CASE o_orderkey % 3 WHEN 0 THEN 'detect_injection' WHEN 1 THEN 'review_code_quality' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'detect_injection' ELSE 'detect_dangerous_call' END END", "true"), ("'security_semantic_review'", "o_orderkey % 4 = 0"))
        ],
        *[f"SELECT o_orderkey AS review_id, 'r{n}-' || CAST(o_orderkey AS STRING) AS route_id, '{category}' AS category, '{skill}' AS skill, {mandatory} AS mandatory FROM orders WHERE {where}" for n, category, skill, mandatory, where in _MORE_ROUTES],
    ),
    "route_place": _union(
        *[f"SELECT o_orderkey AS review_id, 'r-' || CAST(o_orderkey AS STRING) AS route_id, 'src/m' || CAST({_ROUTE_FILE} AS STRING) || '.py' AS file_path, o_custkey % 40 + {shift} AS start_line, o_custkey % 40 + {shift + 3} AS end_line, 'new' AS side, 'h' || CAST({_ROUTE_FILE} AS STRING) AS hunk_id, 's-r' AS snippet_hash FROM orders WHERE {where}" for shift, where in ((0, "true"), (9, "o_orderkey % 4 = 1"), (17, "o_orderkey % 8 = 1"))],
        "SELECT o_orderkey AS review_id, 'r-' || CAST(o_orderkey AS STRING) AS route_id, 'src/m1.py' AS file_path, 2 AS start_line, 4 AS end_line, 'new' AS side, CASE WHEN o_orderkey % 55 = 21 THEN 'h7' ELSE 'h1' END AS hunk_id, 's-r' AS snippet_hash FROM orders WHERE o_orderkey % 11 = 10",
        *[f"SELECT o_orderkey AS review_id, 'r{n}-' || CAST(o_orderkey AS STRING) AS route_id, 'src/m{n - 1}.py' AS file_path, o_custkey % 30 AS start_line, o_custkey % 30 + {n} AS end_line, 'new' AS side, 'h{n - 1}' AS hunk_id, 's-r' AS snippet_hash FROM orders WHERE {where}" for n, _, _, _, where in _MORE_ROUTES],
    ),
    "coverage": _union(*[
        f"""SELECT o.o_orderkey AS review_id, 'a-' || CAST(o.o_orderkey AS STRING) || CASE WHEN s.n = 2 THEN '-q' ELSE '-s' END AS artifact_id, 'c-' || CAST(o.o_orderkey AS STRING) || '-' || s.skill AS coverage_id, s.skill,
        CASE WHEN o.o_orderkey % 5 = 0 THEN 'completed' WHEN (o.o_orderkey + s.n) % 7 = 0 THEN 'failed' WHEN (o.o_orderkey + s.n) % 11 = 0 THEN 'skipped' ELSE 'completed' END AS status,
        CASE WHEN (o.o_orderkey + s.n) % 7 = 0 AND o.o_orderkey % 5 <> 0 THEN CASE WHEN o.o_custkey % 2 = 0 THEN 'TIMEOUT' ELSE 'PARSE_ERROR' END END AS error_code,
        s.n < 2 AND o.o_orderkey % 19 <> 4 OR o.o_orderkey % 2 = 0 OR o.o_orderkey % 5 = 0 AS mandatory, (o.o_custkey * 7 + s.n) % 500 AS duration_ms FROM orders o {_SKILL_GRID} WHERE {where}"""
        for where in ("o.o_orderkey % 5 = 0 OR (o.o_orderkey + s.n) % 23 <> 0", "o.o_orderkey % 107 = 6 AND s.n = 1")
    ]),
    "coverage_route": _union(
        f"SELECT {_COVERED}, CASE WHEN o.o_custkey % 19 = 0 AND o.o_orderkey % 5 <> 0 THEN 'r-none' ELSE 'r-' || CAST(o.o_orderkey AS STRING) END AS route_id FROM orders o {_SKILL_GRID}",
        *[f"SELECT {_COVERED}, 'r{n}-' || CAST(o.o_orderkey AS STRING) AS route_id FROM orders o {_SKILL_GRID} WHERE {where.replace('o_orderkey', 'o.o_orderkey')} AND (o.o_orderkey % 5 = 0 OR (o.o_orderkey + s.n) % 17 <> 3)" for n, _, _, _, where in _MORE_ROUTES],
        f"SELECT {_COVERED}, 'r-gone' AS route_id FROM orders o {_SKILL_GRID} WHERE o.o_orderkey % 71 = 12 AND o.o_orderkey % 5 <> 0 AND s.n > 1",
    ),
    "coverage_file": _union(
        f"SELECT {_COVERED}, 'src/m' || CAST(CASE WHEN o.o_orderkey % 5 = 0 OR o.o_custkey % 3 <> 0 THEN (o.o_orderkey + s.n) % 4 ELSE (o.o_orderkey + s.n) % 6 END AS STRING) || '.py' AS file_path FROM orders o {_SKILL_GRID}",
        *[f"SELECT {_COVERED}, 'src/m' || CAST((o.o_orderkey + s.n + {n}) % 4 AS STRING) || '.py' AS file_path FROM orders o {_SKILL_GRID} WHERE o.o_orderkey % {every} = 0" for n, every in ((1, 2), (2, 6), (3, 12))],
        f"SELECT {_COVERED}, 'src/gone.py' AS file_path FROM orders o {_SKILL_GRID} WHERE o.o_orderkey % 79 = 13 AND o.o_orderkey % 5 <> 0 AND s.n = 2",
    ),
    "artifact": _union(*[
        f"""SELECT o_orderkey AS review_id, 'a-' || CAST(o_orderkey AS STRING) || '-{letter}' AS artifact_id, '{schema}' AS schema_name, CASE WHEN o_orderkey % 67 = 3 THEN '0.9.0' ELSE '1.0.0' END AS schema_version, {agent} AS agent_id, '{role}' AS agent_role,
        CASE WHEN o_orderkey % 41 = 6 THEN 'failed' ELSE 'success' END AS status, CASE WHEN o_orderkey % 43 = 8 THEN o_orderkey + 1 ELSE o_orderkey END AS own_review_id FROM orders WHERE {where}"""
        for letter, schema, agent, role, where in (
            ("s", "SecurityReview", "'security-scanner'", "Security Scanner", "true"),
            ("q", "QualityReview", "CASE WHEN o_orderkey % 71 = 9 THEN 'security-scanner' ELSE 'quality-reviewer' END", "Quality Reviewer", "o_orderkey % 37 <> 2"),
            ("x", "SecurityReview", "'quality-reviewer'", "Quality Reviewer", "o_orderkey % 47 = 1"),
            ("s", "DiffReview", "'diff-analyzer'", "Diff Analyzer", "o_orderkey % 53 = 3"),
        )
    ]),
    "lineage": _union(
        "SELECT o_orderkey AS review_id, 'a-' || CAST(o_orderkey AS STRING) || '-q' AS artifact_id, 'a-' || CAST(o_orderkey AS STRING) || '-s' AS parent_id FROM orders WHERE o_orderkey % 37 <> 2",
        "SELECT o_orderkey AS review_id, 'a-' || CAST(o_orderkey AS STRING) || '-s' AS artifact_id, CASE WHEN o_orderkey % 59 = 1 THEN 'a-gone' WHEN o_orderkey % 61 = 2 AND o_orderkey % 37 <> 2 THEN 'a-' || CAST(o_orderkey AS STRING) || '-q' ELSE 'root-' || CAST(o_orderkey AS STRING) END AS parent_id FROM orders",
        *[f"SELECT o.o_orderkey AS review_id, 'b{n}-' || CAST(i.i AS STRING) AS artifact_id, CASE WHEN i.i = {n - 1} AND o.o_orderkey % 2 = 0 THEN 'root-' || CAST(o.o_orderkey AS STRING) ELSE 'b{n}-' || CAST((i.i + 1) % {n} AS STRING) END AS parent_id FROM orders o CROSS JOIN ({' UNION ALL '.join(f'SELECT {i} AS i' for i in range(n))}) i WHERE o.o_orderkey % 173 = {at} AND o.o_orderkey % 5 <> 0" for n, at in ((3, 5), (7, 9))],
    ),
    "root": "SELECT o_orderkey AS review_id, 'root-' || CAST(o_orderkey AS STRING) AS root_id FROM orders",
    "conflict": _union(
        f"SELECT l_orderkey AS review_id, 'x-' || {_ID} AS conflict_id, 1 AS entry, 'contradiction' AS type, l_suppkey % 2 = 0 AS resolved, CASE WHEN l_partkey % 5 = 0 THEN 'f-gone' ELSE 'f-' || {_ID} END AS finding_id, CASE WHEN l_partkey % 7 = 0 THEN 'N999' ELSE 'N003' END AS rule_id FROM lineitem WHERE l_partkey % 23 = 0 AND l_orderkey % 5 <> 0",
        f"SELECT l_orderkey AS review_id, 'x-' || {_ID} AS conflict_id, 2 AS entry, 'contradiction' AS type, l_suppkey % 2 = 0 AS resolved, 'f-' || {_ID} AS finding_id, 'N003' AS rule_id FROM lineitem WHERE l_partkey % 253 = 0 AND l_orderkey % 5 <> 0",
    ),
    "call": """SELECT user_id AS review_id, event_id AS call_id, CASE event_type WHEN 'view' THEN 'diff-analyzer' WHEN 'click' THEN 'security-scanner' ELSE 'quality-reviewer' END AS agent_id, ts AS started_at, (event_id * 31) % 9000 AS latency_ms,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id * 37 % 2000 END AS prompt_tokens, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 37 % 2000 * (event_id % 5) // 5 END AS cache_hit_tokens,
        event_id * 13 % 700 AS completion_tokens, CASE WHEN event_type = 'error' THEN CASE event_id % 6 WHEN 0 THEN 'TimeoutError' WHEN 1 THEN 'APIConnectionError' ELSE 'APIStatusError' END END AS class_name,
        CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 401 WHEN 1 THEN 402 WHEN 2 THEN 429 WHEN 3 THEN 503 END END AS status_code, CASE event_id % 4 WHEN 0 THEN '1.5' WHEN 1 THEN 'soon' WHEN 2 THEN '9' END AS retry_after, CAST(event_id % 3 + 1 AS INT) AS retry_number,
        CASE event_id % 5 WHEN 0 THEN 'length' ELSE 'stop' END AS finish_reason, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '{"a":' WHEN 2 THEN '{"b": 1}' ELSE '{"summary": "x"}' END AS content FROM events""",
    "line": f"""SELECT doc_id AS review_id, doc_id * 100000 + n AS line_key, n AS pos, {_CONTENT} AS content, CASE WHEN n % 5 = 3 THEN 'addition' WHEN n % 5 = 0 THEN 'deletion' ELSE 'context' END AS kind,
        CASE WHEN n % 5 = 0 THEN 'old' ELSE 'new' END AS side, CASE WHEN doc_id % 7 = 0 THEN 'docs/d' ELSE 'src/d' END || CAST(doc_id AS STRING) || CASE WHEN doc_id % 7 = 0 THEN '.md' WHEN doc_id % 9 = 0 THEN '/test_x.py' ELSE '.py' END AS file_path FROM text_line""",
    "draft": "SELECT conv_id AS review_id, turn, role, text, 'line-' || CAST(conv_id AS STRING) || '-' || CAST(turn % 4 AS STRING) AS line_ref FROM conversations WHERE role = 'assistant'",
    "context_line": "SELECT DISTINCT conv_id AS review_id, 'line-' || CAST(conv_id AS STRING) || '-' || CAST(turn % 3 AS STRING) AS line_ref FROM conversations",
}
_SPARK_LINES = "SELECT doc_id, CAST(p.pos AS BIGINT) AS n, p.col AS content FROM documents LATERAL VIEW posexplode(split(text, '\\n')) p AS pos, col"
_DUCK_LINES = "SELECT doc_id, generate_subscripts(parts, 1) - 1 AS n, unnest(parts) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)"
_TABLES = {"review": "orders", "finding": "lineitem", "place": "lineitem", "evidence": "lineitem", "link": "lineitem", "verified": "lineitem", "conflict": "lineitem", "hunk": "orders", "route": "orders", "route_place": "orders", "coverage": "orders", "coverage_route": "orders", "coverage_file": "orders", "artifact": "orders", "lineage": "orders", "root": "orders", "call": "events", "line": "documents", "draft": "conversations", "context_line": "conversations"}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relation as a DataFrame over the tables in sf_dir."""
    table = _TABLES[name]
    sql = RELATIONS[name].replace("//", "div").replace("{", "{{").replace("}", "}}")
    if name == "line":
        sql = sql.replace("FROM text_line", f"FROM ({_SPARK_LINES})")
    return spark.sql(sql.replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def with_relations(*names: str) -> str:
    """The WITH clause of an oracle that reads these relations."""
    parts = [f"text_line AS ({_DUCK_LINES})"] if "line" in names else []
    return "WITH " + ", ".join(parts + [f"{n} AS ({RELATIONS[n]})" for n in names])
