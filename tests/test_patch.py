from pyspark.sql import functions as F

from sievework.functions import constraints
from sievework.operators import patch

PATCH = """diff --git a/app.py b/app.py
index 1..2 100644
--- a/app.py
+++ b/app.py
@@ -1,3 +1,4 @@ def f():
 a
-b
+c
+d
 e
@@ -10 +11 @@
--- x
+++ y
\\ No newline at end of file
diff --git a/old_name.py b/renamed.py
similarity index 90%
rename from old_name.py
rename to renamed.py
diff --git a/new.py b/new.py
new file mode 100644
--- /dev/null
+++ b/new.py
@@ -0,0 +1,2 @@
+x
+y
diff --git a/gone.md b/gone.md
deleted file mode 100644
--- a/gone.md
+++ /dev/null
@@ -1 +0,0 @@
-z
diff --git a/pic.bin b/pic.bin
Binary files a/pic.bin and b/pic.bin differ"""


def lines(spark, text=PATCH):
    return patch.raw_lines(spark.createDataFrame([(1, text)], "review_id long, raw_diff string"))


def test_sections_classify_files(spark):
    got = {(r.old_path, r.new_path): (r.change_type, r.is_binary) for r in patch.sections(lines(spark)).collect()}
    assert got == {("app.py", "app.py"): ("modified", False), ("old_name.py", "renamed.py"): ("renamed", False), (None, "new.py"): ("added", False), ("gone.md", None): ("deleted", False), ("pic.bin", "pic.bin"): ("modified", True)}


def test_lines_are_numbered_on_their_sides(spark):
    rows = patch.numbered(lines(spark)).where("section = 1").orderBy("hunk", "ordinal").collect()
    assert [(r.kind, r.content, r.old_line, r.new_line) for r in rows] == [
        ("context", "a", 1, 1), ("deletion", "b", 2, None), ("addition", "c", None, 2), ("addition", "d", None, 3), ("context", "e", 3, 4), ("deletion", "-- x", 10, None), ("addition", "++ y", None, 11),
    ]


def test_a_removed_line_that_looks_like_a_header_keeps_the_path(spark):
    assert patch.sections(lines(spark)).where("section = 1").first().old_path == "app.py"


def test_counts_and_exclusions(spark):
    got = {r.new_path or r.old_path: (r.additions, r.deletions, r.exclusion_reason) for r in patch.files(lines(spark), 100).collect()}
    assert got == {"app.py": (3, 2, None), "renamed.py": (0, 0, None), "new.py": (2, 0, None), "gone.md": (0, 1, "unsupported_language"), "pic.bin": (0, 0, "binary")}
    assert patch.files(lines(spark), 3).where("exclusion_reason = 'changed_line_limit'").count() == 3


def test_broken_hunks(spark):
    assert patch.broken_hunks(lines(spark)).count() == 0
    assert patch.broken_hunks(lines(spark, PATCH.replace("-1,3 +1,4", "-1,9 +1,4"))).count() == 1
    assert patch.broken_hunks(lines(spark, PATCH.replace("\n e\n", "\n?e\n"))).first().invalid == 1


def test_records_keep_their_constraints(spark):
    body = patch.numbered(lines(spark)).withColumn("key", F.col("ordinal"))
    assert constraints.violations(body, "key", "line").count() == 0
    assert constraints.violations(patch.files(lines(spark)), "file_id", "file").count() == 0
    bad = patch.files(lines(spark)).withColumn("old_path", F.lit(None).cast("string"))
    assert constraints.violations(bad, "file_id", "file").where("rule = 'paths'").count() == 4


def test_one_and_many_partitions_agree(spark):
    many = spark.createDataFrame([(i, PATCH) for i in range(20)], "review_id long, raw_diff string")
    key = lambda d: sorted(map(str, patch.numbered(patch.raw_lines(d)).collect()))
    assert key(many.repartition(8)) == key(many.coalesce(1))


def test_quoted_names_are_decoded(spark):
    text = '''diff --git "a/caf\\303\\251.py" "b/caf\\303\\251.py"
--- "a/caf\\303\\251.py"
+++ "b/caf\\303\\251.py"
@@ -1 +1 @@
-a
+b
diff --git "a/tab\\there \\"x\\" \\\\y.py" "b/tab\\there \\"x\\" \\\\y.py"
new file mode 100644
Binary files differ
diff --git "a/old \\346\\274\\242.txt" b/new name.txt
similarity index 100%
rename from "old \\346\\274\\242.txt"
rename to new name.txt
diff --git a/with space.py b/with space.py
--- a/with space.py\t
+++ b/with space.py\t
@@ -1 +1 @@
-a
+b'''
    got = {r.section: (r.old_path, r.new_path) for r in patch.sections(lines(spark, text)).collect()}
    assert got == {1: ("café.py", "café.py"), 2: (None, 'tab\there "x" \\y.py'), 3: ("old 漢.txt", "new name.txt"), 4: ("with space.py", "with space.py")}
