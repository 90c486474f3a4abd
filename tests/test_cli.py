import json

from sievework import cli

CLEAN = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1 +1 @@\n-x\n+y"


def test_exit_codes(spark, tmp_path):
    secret = CLEAN.replace("+y", "+k = '" + "sk-" + "a1B2" * 8 + "'")
    for name, text, code in (("pass", CLEAN, 0), ("block", secret, 1), ("scope", CLEAN.replace("a.py", "a.md"), 2), ("broken", CLEAN.replace("+1 @@", "+1,7 @@"), 3)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "p.patch").write_text(text)
        assert cli.main([str(tmp_path / name), str(tmp_path / f"{name}.out")]) == code
    shown = spark.read.parquet(str(tmp_path / "block.out/lines")).collect()
    assert all("sk-a1B2" not in r.content for r in shown)


def test_whole_runs_with_outcomes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n a\n+"
    (tmp_path / "in" / "clean.diff").write_text(head + "total = 1")
    (tmp_path / "in" / "shell.diff").write_text(head + 'os.system("x " + y)')
    told = [json.dumps({"path": f"{p}.diff", "agent_id": a, "status": "success"}) for p in ("clean", "shell") for a in ("security-scanner", "quality-reviewer")]
    (tmp_path / "outcomes.jsonl").write_text("\n".join(told))
    assert cli.main([str(tmp_path / "in"), str(tmp_path / "out"), "--outcomes", str(tmp_path / "outcomes.jsonl")]) == 1
    rules = sorted(json.loads(p.read_text())["rule_ids"] for p in (tmp_path / "out").glob("*/gate-decision.json"))
    assert rules == [["B002"], ["P001"]] and len(list((tmp_path / "out").glob("*/*"))) == 26
