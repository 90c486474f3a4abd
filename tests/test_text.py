from pyspark.sql import functions as F

from sievework.functions import constraints, scalars
from sievework.operators import secrets, transport

KEY, AWS = "sk-" + "a1B2" * 8, "AKIA" + "ABCD1234" * 2


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def lines(spark, *rows):
    return spark.createDataFrame([(1, i, i, kind, "old" if kind == "deletion" else "new", "a.py", text) for i, (kind, text) in enumerate(rows)], "review_id long, line_key long, pos long, kind string, side string, file_path string, content string")


def test_redaction(spark):
    assert one(spark, scalars.redact(F.col("t")), t='Authorization: x api_key="a b" Bearer abc.def ghp_abcdefgh1') == "Authorization: <redacted> api_key=<redacted> Bearer <redacted> <redacted-token>"
    assert one(spark, scalars.sanitize_error(F.col("t")), t="authorization: bearer zzz https://u:p@h/x?token=1&a=2 sk-12345678") == "authorization: bearer [REDACTED] https://[REDACTED]@h/x?token=[REDACTED]&a=2 [REDACTED]"


def test_origins(spark):
    origin = lambda u: one(spark, scalars.public_origin(F.col("t")), t=u)
    assert origin("HTTPS://user:pw@Host.example:8443/p?q") == "https://host.example:8443"
    assert origin("https://[::1]:1/x") == "https://[::1]:1" and origin("nohost") == origin("http://") == "[INVALID_URL]"


def test_costs_and_delays(spark):
    cost = lambda p, h, m, c: one(spark, scalars.cost_usd(*[F.col(x).cast("long") for x in "phmc"]), p=p, h=h, m=m, c=c)
    assert float(cost(100, 20, 80, 50)) == round((20 * 0.003625 + 80 * 0.435 + 50 * 0.87) / 1e6, 12) and cost(None, 1, 1, 1) is None
    delay = lambda a, n: one(spark, scalars.retry_delay(F.col("a"), F.col("n")), a=a, n=n)
    assert (delay("1.5", 1), delay("9", 1), delay("-3", 1), delay("soon", 2), delay("", 4)) == (1.5, 2.0, 0.0, 0.5, 2.0)


def test_paths(spark):
    ok = lambda p: one(spark, scalars.is_repository_path(F.col("t")), t=p)
    assert ok("src/a.py") and not any(map(ok, ["/a", "a//b", "a/../b", "./a", "a/.", "C:/x", "a\\b", "", "a/"]))


def test_secrets_are_found_and_masked(spark):
    rows = lines(spark, ("addition", f"a = '{KEY}' b = '{AWS}'"), ("deletion", f"x = {KEY}"), ("addition", "token = some_plain_identifier_name"), ("context", '  password = "Zx9kLm2PqR7tUv4w"'))
    seen = secrets.observations(rows)
    assert {(r.line_key, r.secret_type) for r in secrets.findings(seen).collect()} == {(0, "OPENAI_KEY"), (0, "AWS_ACCESS_KEY")}
    masked = {r.line_key: r for r in secrets.masked_lines(rows, seen).collect()}
    assert all(KEY not in r.content and AWS not in r.content for r in masked.values())
    assert masked[3].content.startswith("  password") and not masked[2].redacted and masked[1].redacted
    proof = secrets.masked_lines(rows, seen).join(rows.select("line_key", F.col("content").alias("source")), "line_key")
    assert all(r.ok for r in proof.select(secrets.is_redaction_only("source", "content").alias("ok")).collect())
    assert not one(spark, secrets.is_redaction_only(F.col("a"), F.col("b")), a="x = 12", b="y = <REDACTED:T:000000000000>")
    assert constraints.violations(secrets.masked_lines(rows, seen), "line_key", "masked").count() == 0


def test_nothing_is_disclosed_unless_the_scan_succeeded(spark):
    rows = lines(spark, ("addition", "a"), ("addition", "b"))
    masked = secrets.masked_lines(rows, secrets.observations(rows))
    for status, limit, shown in (("success", 5, 2), ("failed", 5, 0), ("success", 1, 0)):
        assert secrets.disclosure(masked, spark.createDataFrame([(1, status)], "review_id long, skill_status string"), limit)[0].count() == shown


def test_canonical_json(spark):
    got = lambda t: one(spark, transport.canonical(F.col("t")), t=t)
    assert got('{"b": 1, "a": [1, 2]}') == '{"a":[1,2],"b":1}\n' and got('{"a": 1, "a": 2}') is None and got("{") is None and got('{"a": NaN}') is None


def test_a_redaction_is_proven_by_its_digests(spark):
    import hashlib

    from sievework.operators import secrets

    def mask(text):
        return f"<REDACTED:KEY:{hashlib.sha256(text.encode()).hexdigest()[:12]}>"

    rows = [
        ("k = abc;", f"k = {mask('abc')};", True), ("k = abc;", f"k = {mask('abd')};", False), ("a;b;c;", f"{mask('a;b')};c;", True), ("xay", f"x{mask('a')}z", False), ("abab", f"{mask('ab')}{mask('ab')}", True), ("same", "same", True), ("same", "other", False),
        ("a" * 200_000 + "!", f"{mask('a' * 200_000)}!", True), ("a", f"a{mask('')}", False), (None, None, True), ("x", None, False),
    ]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a string, b string").select("i", secrets.is_redaction_only("a", "b").alias("ok")).orderBy("i").collect()
    assert [r.ok for r in got] == [w for _, _, w in rows]
