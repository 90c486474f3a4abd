"""Scalar functions as columns: identifiers, paths, redaction, cost and time."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks of the enumerations.
SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
STATUS_RANK = {"dismissed": 0, "unverified": 1, "suspected": 2, "confirmed": 3}
LEVEL_RANK = {"E0": 0, "E1": 1, "E2": 2, "E3": 3}
SKILL_STATUS_RANK = {"success": 0, "skipped": 1, "partial": 1, "failed": 2}
GATE_RANK = {"PASS": 0, "NEEDS_REVIEW": 1, "BLOCK": 2, "FAILED": 3}
EXIT_CODE = {"PASS": 0, "BLOCK": 1, "NEEDS_REVIEW": 2, "FAILED": 3}
# US dollars for a million tokens, by kind of token.
PRICE_HIT, PRICE_MISS, PRICE_OUTPUT = "0.003625", "0.435", "0.87"
# Signs of an output that is kept.
MAX_OUTPUT = 16_000
MAX_RETRY_SECONDS = 2.0
# The redaction patterns of free text, and of error messages.
BEARER = r"(?i)\b(bearer\s+)[A-Za-z0-9._~+/-]+"
CREDENTIAL = r"(?i)\b((?:[a-z0-9]+[_-])*(?:api[_-]?key|secret[_-]?key|access[_-]?key|gateway[_-]?key|token|password)|authorization)(\s*[=:]\s*)(\"[^\"]*\"|'[^']*'|[^\s,;]+)"
KNOWN_TOKEN = r"\b(?:gh[opsu]_[A-Za-z0-9]{8,}|sk-[A-Za-z0-9_-]{8,})\b"
AUTHORIZATION = r"(?i)(authorization\s*:\s*bearer\s+)[^\s,;]+"
SK_TOKEN = r"\bsk-[A-Za-z0-9_-]{8,}\b"
USERINFO = r"(?i)(https?://)[^/\s@]+@"
QUERY_KEY = r"(?i)([?&](?:api[_-]?key|access_token|token|key)=)[^&#\s]+"
IDENTIFIER, LINE_REF, POLICY_VERSION = r"^[a-z0-9][a-z0-9-]*$", r"^[A-Za-z0-9][A-Za-z0-9._:-]*$", r"^[a-z0-9][a-z0-9.-]*$"
REVISION, SHA256 = r"^[0-9a-f]{40}$", r"^[0-9a-f]{64}$"


def rank(value: Column, ranks: dict[str, int]) -> Column:
    """The rank of an enumeration value, null for others."""
    return F.create_map(*map(F.lit, chain.from_iterable(ranks.items())))[value]


def joined_parts(*parts: Column) -> Column:
    """Parts joined by NUL; a null part reads None."""
    return F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def content_hash(*parts: Column) -> Column:
    return F.sha2(joined_parts(*parts), 256)


def stable_id(prefix: str, *parts: Column, digits: int = 20) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(content_hash(*parts), 1, digits))


def is_repository_path(path: Column) -> Column:
    """A relative POSIX path: no backslash, colon, NUL, leading or double slash, no empty or dot segments."""
    return ~path.rlike(r"[\\:\x00]|^/|//|(^|/)\.{0,2}(/|$)")


def is_shared_path(path: Column) -> Column:
    """Below shared/, segments of ASCII letters, digits and -_. that do not start with a dot."""
    return path.rlike(r"^shared(/[A-Za-z0-9_-][A-Za-z0-9_.-]*)+$")


def is_language_python(path: Column) -> Column:
    return F.lower(path).rlike(r"\.pyi?$")


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)tests/|(^|/)test_")


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return (start_a <= end_b) & (start_b <= end_a)


def redact(text: Column) -> Column:
    """Bearer values, credential assignments and known tokens of free text replaced."""
    out = F.regexp_replace(text, BEARER, "$1<redacted>")
    out = F.regexp_replace(out, CREDENTIAL, "$1$2<redacted>")
    return F.regexp_replace(out, KNOWN_TOKEN, "<redacted-token>")


def sanitize_error(text: Column, limit: int = 1000, key: Column | None = None) -> Column:
    """An error's text without credentials: the key in use, wherever it stands, then whatever looks like one; cut last."""
    out = text if key is None else F.when(F.length(key) > 0, F.replace(text, key, F.lit("[REDACTED]"))).otherwise(text)
    out = F.regexp_replace(out, AUTHORIZATION, "$1[REDACTED]")
    out = F.regexp_replace(out, SK_TOKEN, "[REDACTED]")
    out = F.regexp_replace(out, USERINFO, "$1[REDACTED]@")
    return F.substring(F.regexp_replace(out, QUERY_KEY, "$1[REDACTED]"), 1, limit)


def public_origin(url: Column) -> Column:
    """scheme://host[:port] without user information, or [INVALID_URL]."""
    found = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:@\[\]]+|\[[0-9A-Fa-f:.]+\])(?::([0-9]+))?(?:[/?#]|$)"
    scheme, host, port = (F.regexp_extract(url, found, n) for n in (1, 2, 3))
    return F.when((scheme == "") | (host == "") | url.isNull(), "[INVALID_URL]").otherwise(F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.when(port != "", F.concat(F.lit(":"), port)).otherwise("")))


def cost_usd(prompt: Column, hit: Column, miss: Column, completion: Column) -> Column:
    """Decimal cost of a call; null unless prompt and completion tokens are known."""
    hits = F.coalesce(hit, F.lit(0))
    misses = F.coalesce(miss, F.greatest(F.lit(0), prompt - hits))
    price = lambda tokens, usd: tokens.cast("decimal(18,0)") * F.lit(usd).cast("decimal(9,6)")
    total = (price(hits, PRICE_HIT) + price(misses, PRICE_MISS) + price(completion, PRICE_OUTPUT)) / F.lit(1_000_000).cast("decimal(9,0)")
    return F.when(prompt.isNotNull() & completion.isNotNull(), total.cast("decimal(28,12)"))


def cache_split(prompt: Column, hit: Column, miss: Column) -> tuple[Column, Column]:
    """(hit, miss) tokens; where neither is reported all are misses."""
    neither = hit.isNull() & miss.isNull()
    return F.when(neither, 0).otherwise(hit), F.when(neither, prompt).otherwise(miss)


def retry_delay(retry_after: Column, retry_number: Column) -> Column:
    asked = F.coalesce(F.expr("double(null)"), retry_after.try_cast("double"), 0.25 * F.pow(F.lit(2.0), retry_number - 1))
    return F.least(F.greatest(asked, F.lit(0.0)), F.lit(MAX_RETRY_SECONDS))


def duration_ms(start: Column, end: Column) -> Column:
    return F.greatest(F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp")), F.lit(0))


def parse_utc(text: Column) -> Column:
    """A timestamp from ISO text that names UTC, else null."""
    return F.when(text.rlike(r"(Z|\+00:00)$"), F.try_to_timestamp(text))


def is_admissible(deadline: Column, now: Column) -> Column:
    return deadline > now


def bounded_output(text: Column, limit: int = MAX_OUTPUT) -> Column:
    """A command's output, cut to its first signs."""
    return F.substring(text, 1, limit)


def markdown_cell(text: Column, limit: int = 500) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), r"[\r\n]+", " ")
    return F.substring(out, 1, limit)


def error_class(class_name: Column, status: Column) -> Column:
    """(code, retryable) of a provider's exception, by its class name and HTTP status."""
    name = F.lower(class_name)
    code = (
        F.when(name.contains("timeout"), "TIMEOUT").when(status == 401, "AUTHENTICATION_ERROR").when(status == 402, "INSUFFICIENT_BALANCE").when(status == 429, "RATE_LIMIT")
        .when(status >= 500, "PROVIDER_ERROR").when(name.contains("connection") | name.isin("oserror"), "TRANSPORT_ERROR").otherwise("PROVIDER_ERROR")
    )
    retry = code.isin("TIMEOUT", "RATE_LIMIT", "TRANSPORT_ERROR") | ((code == "PROVIDER_ERROR") & F.coalesce(status >= 500, F.lit(False)))
    return F.struct(code.alias("code"), retry.alias("retryable"))


def policy_error(code: Column) -> Column:
    """A provider's code as the policy knows it."""
    known = {"AUTHENTICATION_ERROR": "MODEL_AUTH_ERROR", "INSUFFICIENT_BALANCE": "MODEL_QUOTA_EXCEEDED", "RATE_LIMIT": "RATE_LIMITED", "TIMEOUT": "TIMEOUT"}
    return F.coalesce(rank(code, known), F.lit("MODEL_ERROR"))


def response_validity(finish: Column, content: Column) -> Column:
    """The first fault of a model's response: length, empty, not JSON, not of the schema; else ok."""
    parsed = F.try_parse_json(content)
    return (
        F.when(finish == "length", "OUTPUT_TRUNCATED").when(F.trim(F.coalesce(content, F.lit(""))) == "", "EMPTY_RESPONSE").when(parsed.isNull(), "INVALID_JSON")
        .when(F.get_json_object(content, "$.summary").isNull(), "SCHEMA_ERROR").otherwise("OK")
    )
