"""The Git source, whole files at their paths, and archives that depend on their contents alone."""

import hashlib
import io
import json
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from sievework.sources import files, git


@pytest.fixture(scope="module")
def repositories(tmp_path_factory):
    out = []
    for name in ("one", "two"):
        path = tmp_path_factory.mktemp(name)
        run = lambda *a, path=path: subprocess.run(["git", "-C", str(path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
        run("init", "-q")
        (path / "a.py").write_text(f"{name}\n")
        run("add", ".")
        run("commit", "-qm", "base")
        (path / "a.py").write_text(f"{name}\nmore\n")
        run("commit", "-qam", "next")
        (path / "a.py").write_text(f"{name}\nmore\nopen\n")
        out.append(str(path))
    return out


def test_requests_are_read_on_executors(spark, repositories, tmp_path):
    one, two = repositories
    asked = [
        (1, one, "HEAD~1", "HEAD", None, None), (2, two, None, None, None, None), (3, two, "HEAD", None, True, False), (4, one, "nothing", None, None, None), (5, one, "--output=x", None, None, None),
        (6, str(tmp_path), None, None, None, None), (7, str(tmp_path / "gone"), None, None, None, None), (8, one, None, None, False, False), (9, one, "HEAD", "HEAD", None, None),
    ]
    want = {1: None, 2: None, 3: "EMPTY_DIFF", 4: "NO_SUCH_COMMIT", 5: "UNSAFE_REVISION", 6: "NOT_A_WORK_TREE", 7: "GIT_FAILED", 8: "NOTHING_TO_COMPARE", 9: "EMPTY_DIFF"}
    table = spark.createDataFrame(asked, "review_id long, repository string, base string, target string, staged boolean, unstaged boolean")
    rows = {r.review_id: r for r in git.read_requests(table).collect()}
    assert {n: r.error_code for n, r in rows.items()} == want
    assert "+more" in rows[1].raw_diff and "+open" not in rows[1].raw_diff and rows[1].source == "revision_range" and rows[1].target_oid
    assert "+open" in rows[2].raw_diff and rows[2].diff_hash == hashlib.sha256(rows[2].raw_diff.encode()).hexdigest()
    git.register(spark)
    text = "\n".join(json.dumps(dict(zip(git.REQUEST, a))) for a in asked)
    source = spark.read.format("git_reviews").option("requests", text).load()
    assert source.rdd.getNumPartitions() == len(asked) and sorted(map(tuple, source.collect()), key=str) == sorted(map(tuple, rows.values()), key=str)
    assert git.read_requests(table.where("review_id = 1"), most=10).first().error_code == "DIFF_TOO_LARGE"
    assert git.read_requests(table.limit(0)).count() == 0


def contents(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def test_files_appear_together_or_not_at_all(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("shared/tasks/"), F.col("id").cast("string"), F.lit("/d.json")).alias("path"), F.concat(F.lit("{"), F.col("id").cast("string"), F.lit("}")).alias("content")).repartition(5)
    files.write_files(rows, str(tmp_path / "out"))
    assert contents(tmp_path / "out") == {f"shared/tasks/{i}/d.json": f"{{{i}}}".encode() for i in range(40)}
    files.write_files(rows.repartition(2), str(tmp_path / "again"))
    assert contents(tmp_path / "again") == contents(tmp_path / "out")
    with pytest.raises(FileExistsError):
        files.write_files(rows, str(tmp_path / "out"))
    broken = rows.withColumn("content", F.when(F.col("path").contains("/7/"), F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    twice = rows.unionByName(rows.limit(1))
    unsafe = rows.unionByName(spark.createDataFrame([("../x", "y")], "path string, content string"))
    for wrong in (broken, twice, unsafe):
        with pytest.raises(Exception):  # noqa: B017  whatever the engine wraps it in
            files.write_files(wrong, str(tmp_path / "wrong"))
        assert {p.name for p in tmp_path.iterdir()} == {"out", "again"}


def test_manifests(spark):
    rows = spark.createDataFrame([("r1", "a.json", "1", "BLOCK"), ("r1", "b.md", "2", "BLOCK"), ("r2", "a.json", "3", "PASS")], "folder string, name string, content string, status string")
    out = {r.path: r.content for r in files.at_paths(files.with_manifest(rows, "status")).collect()}
    told = json.loads(out["r1/manifest.json"])
    assert told == {"status": "BLOCK", "files": {"a.json": hashlib.sha256(b"1").hexdigest(), "b.md": hashlib.sha256(b"2").hexdigest()}} and len(out) == 5


def test_archives(spark):
    rows = spark.createDataFrame([("p", "src/b.py", "b" * 5000), ("p", "src/a.py", "a"), ("p", "é.txt", ""), ("q", "x", "1")], "package string, path string, content string")
    first, again = ({r.package: r for r in files.archives(d).collect()} for d in (rows.repartition(4), rows.coalesce(1)))
    assert {p: r.sha256 for p, r in first.items()} == {p: r.sha256 for p, r in again.items()} and set(first) == {"p", "q"}
    assert zipfile.ZipFile(io.BytesIO(first["p"].archive)).namelist() == ["src/a.py", "src/b.py", "é.txt"]
    manifest = rows.select("package", "path", F.sha2("content", 256).alias("sha256"))
    held = spark.createDataFrame([(p, bytes(r.archive)) for p, r in first.items()], "package string, archive binary")
    assert files.archive_faults(held, manifest).count() == 0
    other = manifest.where("path <> 'src/a.py'").withColumn("sha256", F.when(F.col("path") == "src/b.py", "0").otherwise(F.col("sha256"))).unionByName(spark.createDataFrame([("q", "y", "0")], "package string, path string, sha256 string"))
    assert sorted((r.package, r.path, r.fault) for r in files.archive_faults(held, other).collect()) == [("p", "src/a.py", "UNEXPECTED"), ("p", "src/b.py", "CHANGED"), ("q", "y", "MISSING")]
    odd = io.BytesIO()
    with zipfile.ZipFile(odd, "w") as z:
        z.writestr("b", "1")
        z.writestr("../a", "2")
    strange = spark.createDataFrame([("p", odd.getvalue()), ("q", b"PK no")], "package string, archive binary")
    assert sorted((r.package, r.fault) for r in files.archive_entries(strange).collect()) == [("p", "UNSAFE"), ("p", "UNSAFE"), ("q", "UNREADABLE")]
