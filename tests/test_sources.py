import subprocess

import pytest
from pyspark.sql import functions as F

from sievework.operators import patch
from sievework.sources import readers, sinks
from sievework.streaming import trace


def test_a_work_tree_is_read_and_parsed(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("one\ntwo\n")
    git("add", ".")
    git("commit", "-qm", "base")
    (tmp_path / "a.py").write_text("one\nthree\nfour\n")
    text = readers.git_diff(str(tmp_path))
    rows = patch.files(patch.raw_lines(spark.createDataFrame([(1, text)], "review_id long, raw_diff string"))).collect()
    assert [(r.new_path, r.additions, r.deletions) for r in rows] == [("a.py", 2, 1)]
    assert readers.git_diff(str(tmp_path), unstaged=False) == "" and readers.git_diff(str(tmp_path), staged=False) == text
    git("add", ".")
    assert readers.git_diff(str(tmp_path), unstaged=False) == text and readers.git_diff(str(tmp_path), staged=False) == ""
    row = readers.read_review(spark, 5, str(tmp_path)).first()
    assert (row.review_id, row.raw_diff, row.source, row.target_oid, row.bytes) == (5, text, "worktree", None, len(text)) and len(row.base_oid) == 40 and len(row.diff_hash) == 64
    git("commit", "-qm", "next")
    row = readers.read_review(spark, 5, str(tmp_path), "HEAD~1", "HEAD").first()
    assert row.source == "revision_range" and row.raw_diff == text and row.target_oid == readers.resolve_revision(str(tmp_path), "HEAD")
    (tmp_path / "sub").mkdir()
    for wrong in (lambda: readers.git_diff(str(tmp_path), "--output=x"), lambda: readers.git_diff(str(tmp_path), "nothing"), lambda: readers.worktree_root(str(tmp_path / "sub")), lambda: readers.read_review(spark, 5, str(tmp_path)), lambda: readers.read_review(spark, 5, str(tmp_path), "HEAD~1", "HEAD", max_bytes=10), lambda: readers.git_diff(str(tmp_path), staged=False, unstaged=False)):
        with pytest.raises(ValueError):
            wrong()


def test_documents_are_strict(spark, tmp_path):
    for name, body in {"good": b'{"b":1,"a":2}', "twice": b'{"a":1,"a":2}', "list": b"[1]", "cut": b'{"a"'}.items():
        (tmp_path / f"{name}.json").write_bytes(body)
    good, bad = readers.read_documents(spark, str(tmp_path))
    assert [r.canonical for r in good.collect()] == ['{"a":2,"b":1}\n'] and bad.count() == 3


def test_policy_is_pinned(tmp_path):
    (tmp_path / "p.toml").write_text('policy_version = "x"\n')
    assert readers.load_policy(str(tmp_path / "p.toml"))["policy_version"] == "x"
    with pytest.raises(ValueError):
        readers.load_policy(str(tmp_path / "p.toml"), "0" * 64)


def test_bundles_are_all_or_nothing(spark, tmp_path):
    tables = {"a": spark.range(3), "b": spark.range(2)}
    manifest = sinks.write_bundle(tables, str(tmp_path / "out")).collect()
    assert {r.relation: r["rows"] for r in manifest} == {"a": 3, "b": 2} and not (tmp_path / "out.staging").exists()
    assert all(len(r.sha256) == 64 for r in manifest) and sinks.changed_files(str(tmp_path / "out"), spark).count() == 0
    with pytest.raises(FileExistsError):
        sinks.write_bundle(tables, str(tmp_path / "out"))
    spark.range(9).write.mode("append").parquet(str(tmp_path / "out" / "b"))
    assert {r.relation for r in sinks.changed_files(str(tmp_path / "out"), spark).collect()} == {"b"}
    lines = sinks.bundle_rows({"x": spark.range(2).selectExpr("id AS review_id", "id + 1 AS v"), "y": spark.range(1).selectExpr("id AS review_id", "'t' AS w")})
    assert sorted(map(tuple, lines.collect())) == [(0, "x.jsonl", '{"v":1}'), (0, "y.jsonl", '{"w":"t"}'), (1, "x.jsonl", '{"v":2}')]


def test_output_boundaries(spark, tmp_path):
    (tmp_path / "repo").mkdir()
    (tmp_path / "runs").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "runs")
    assert sinks.preflight("run-1", str(tmp_path / "runs"), str(tmp_path / "repo")) == str(tmp_path / "runs" / "run-1")
    (tmp_path / "runs" / "old").mkdir()
    for name, root in (("../x", "runs"), ("run-1", "repo"), ("run-1", "link"), ("ab", "runs")):
        with pytest.raises(ValueError):
            sinks.preflight(name, str(tmp_path / root), str(tmp_path / "repo"))
    with pytest.raises(FileExistsError):
        sinks.preflight("old", str(tmp_path / "runs"), str(tmp_path / "repo"))
    given = spark.createDataFrame([(1, "shared/tasks/1/d.json", "{}"), (2, "shared/tasks/9/d.json", "{}"), (3, "shared/../d.json", "{}"), (4, "shared/x", "{}")], "task_id long, ref string, text string")
    asked = spark.createDataFrame([(1, "shared/tasks/1/d.json"), (2, "shared/tasks/2/d.json"), (3, "shared/../d.json")], "task_id long, delivery_ref string")
    written, refused = sinks.write_deliveries(given, asked, str(tmp_path / "deliveries"))
    assert [r.task_id for r in written.collect()] == [1] and {r.task_id for r in refused.collect()} == {2, 3, 4}
    assert [p.relative_to(tmp_path / "deliveries").as_posix() for p in (tmp_path / "deliveries").rglob("*") if p.is_file()] == ["shared/tasks/1/d.json"]
    assert (tmp_path / "deliveries" / "shared/tasks/1/d.json").read_text() == "{}"


def test_packages_and_settings(spark, tmp_path):
    import hashlib

    (tmp_path / "p" / "in").mkdir(parents=True)
    (tmp_path / "p" / "in" / "a.py").write_bytes(b"x")
    (tmp_path / "p" / "b.py").write_bytes(b"y")
    assert {tuple(r) for r in readers.package_digests(spark, str(tmp_path / "p")).collect()} == {("in/a.py", hashlib.sha256(b"x").hexdigest()), ("b.py", hashlib.sha256(b"y").hexdigest())}
    (tmp_path / "p" / "c.py").symlink_to(tmp_path / "p" / "b.py")
    with pytest.raises(ValueError):
        readers.package_digests(spark, str(tmp_path / "p"))
    (tmp_path / "env").write_text("# note\nexport A='1'\nB=2\nC\n")
    assert readers.read_settings(str(tmp_path / "env"), environment={"B": "3"}) == {"A": "1", "B": "3"}
    assert readers.read_settings(str(tmp_path / "env"), ("B", "D"), {"D": "4"}) == {"B": "2", "D": "4"}
    with pytest.raises(KeyError):
        readers.read_settings(None, ("A",), {})


def test_sessions_of_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = trace.sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    batch = trace.sessions(events)
    ended = spark.table("sessions").drop("value")
    assert ended.count() > 0 and ended.exceptAll(batch.drop("value")).count() == 0  # what the stream closed is what the batch finds
    assert batch.agg(F.max("end")).first()[0] > ended.agg(F.max("end")).first()[0]  # the last ones are still open


def test_documents_of_roles(spark, tmp_path):
    import json

    for name, fields, read in (("delivery", readers.DELIVERY, readers.read_deliveries), ("assignment", readers.ASSIGNMENT, readers.read_assignments), ("context", readers.CONTEXT, readers.read_role_contexts)):
        folder = tmp_path / name
        folder.mkdir()
        whole = {f: "é" for f in fields}
        canonical = json.dumps(whole, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n"
        for file, text in {"good": canonical, "spaced": json.dumps(whole), "more": json.dumps(whole | {"x": 1}), "less": "{}\n", "list": "[1]\n", "twice": '{"a":1,"a":1}', "deep": "[" * 100_000}.items():
            (folder / file).write_text(text)
        good, bad = read(spark, str(folder))
        assert sorted(r.path.rsplit("/", 1)[1] for r in good.collect()) == (["good", "spaced"] if name == "delivery" else ["good"])
        reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in bad.collect()}
        assert reasons == {"more": "FIELDS", "less": "FIELDS", "list": "NOT_AN_OBJECT", "twice": "NOT_AN_OBJECT", "deep": "NOT_AN_OBJECT"} | ({} if name == "delivery" else {"spaced": "NOT_CANONICAL"})
