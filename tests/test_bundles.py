"""Files of reviews, twice the same; model calls by a made-up client against what recorded calls come to."""

import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import agents, models
from sievework.operators.run import ReviewRun
from sievework.sources import bundles, files

PATCHES = [(1, 'diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1,3 @@\n a\n+total = "1"\n+key = "AKIA' + 'IOSFODNN7EXAMPLE"'), (2, "diff --git a/y.txt b/y.txt\n--- a/y.txt\n+++ b/y.txt\n@@ -1 +1 @@\n-a\n+b")]


@pytest.fixture(scope="module")
def run(spark):
    told = [(n, a, "success", None, False) for n in (1, 2) for a in ("security-scanner", "quality-reviewer")]
    return ReviewRun(spark.createDataFrame(PATCHES, "review_id long, raw_diff string"), spark.createDataFrame(told, "review_id long, agent_id string, status string, error_code string, repair_exhausted boolean"))


def test_a_review_has_twelve_files_and_a_manifest(spark, run, tmp_path):
    rows = bundles.review_files(run)
    files.write_files(files.at_paths(rows), str(tmp_path / "runs"))
    held = {str(p.relative_to(tmp_path / "runs")): p.read_text() for p in (tmp_path / "runs").rglob("*") if p.is_file()}
    assert set(held) == {f"{n}/{name}" for n in (1, 2) for name in [*bundles.NAMES, "manifest.json"]}
    parsed = {name: json.loads(text) for name, text in held.items() if name.endswith(".json")}
    assert parsed["1/gate-decision.json"]["status"] == "BLOCK" and parsed["1/gate-decision.json"]["rule_ids"] == ["B001"]
    assert parsed["2/gate-decision.json"]["rule_ids"] == ["N002"] and parsed["2/security-review.json"]["findings"] == []
    assert "AKIA" not in "".join(held.values()) and "<REDACTED:AWS_ACCESS_KEY:" in held["1/sanitized-diff.json"]
    assert [f["finding_id"] for f in parsed["1/security-review.json"]["findings"]] == [f["finding_id"] for f in parsed["1/review.json"]["findings"]] != []
    assert parsed["1/manifest.json"]["status"] == "BLOCK" and parsed["1/manifest.json"]["cloud_safe"] and len(parsed["1/manifest.json"]["files"]) == 12
    assert [json.loads(line)["sequence"] for line in held["1/trace.jsonl"].splitlines()] == list(range(1, 11)) and held["1/report.md"].startswith("# Review 1\n")
    again = {r.path: r.content for r in files.at_paths(bundles.review_files(run)).collect()}
    assert again == held


def test_what_came_in(run):
    held = {r.path: r.content for r in files.at_paths(bundles.ingest_files(run)).collect()}
    assert set(held) == {f"{n}/{name}" for n in (1, 2) for name in ("git-diff.json", "trace.jsonl", "manifest.json")}
    events = [json.loads(line) for line in held["1/trace.jsonl"].splitlines()]
    assert [e["event_type"] for e in events] == ["review_created", "diff_parsed", "artifact_persisted"] and events[1]["details"] == {"files": 1, "changed_lines": 2}
    assert events[2]["details"]["artifact_sha256"] == json.loads(held["1/manifest.json"])["files"]["git-diff.json"]


def clients():
    # a local function travels to the workers by value
    def fake():
        class TimeoutFailure(Exception):
            pass

        class Refusal(Exception):
            status_code = 401

        class Fake:
            """Does what the context says, one word a call; an exhausted script goes on with its last word."""

            def __init__(self):
                self.script = {}

            def complete(self, system, prompt, repair):
                left = self.script.setdefault(prompt, prompt.split())
                word = left.pop(0) if len(left) > 1 else left[0]
                if word == "late":
                    raise TimeoutFailure
                if word == "refused":
                    raise Refusal
                content = {"good": '{"summary": "s"}', "empty": "", "cut": '{"summary"', "other": '{"x": 1}', "long": '{"summary": "s"}'}[word]
                return models.Reply(content, "length" if word == "long" else "stop", 100, 20, 50)

        return Fake()

    return fake


def test_calls_come_to_what_recorded_calls_come_to(spark):
    scripts = {1: ["good", "good"], 2: ["late good", "empty good"], 3: ["late", "good"], 4: ["refused", "good"], 5: ["cut", "other good"], 6: ["long long", "late empty good"], 7: ["late empty good", "good"]}
    rows = [(n, f"agent-{i}", f"{s}") for n, both in scripts.items() for i, s in enumerate(both)]
    dimension = spark.createDataFrame([("agent-0", "1.2.0", "p0", "old"), ("agent-0", "1.10.0", "p0", "new"), ("agent-1", "1.0.0", "p1", "one")], "agent_id string, version string, prompt_id string, system string")
    prompts = models.versioned(spark.createDataFrame(rows, "review_id long, agent_id string, context string"), dimension)
    assert {(r.agent_id, r.version) for r in prompts.collect()} == {("agent-0", "1.10.0"), ("agent-1", "1.0.0")}
    assert {r.version for r in models.versioned(prompts.select("review_id", "agent_id", "context"), dimension, "1.2.0").collect()} == {"1.2.0"}
    calls = models.call_models(prompts, clients()).cache()
    assert calls.groupBy("review_id").count().agg(F.max("count")).first()[0] <= agents.CALL_BUDGET and calls.where("prompt_version is null").count() == 0
    out = {(r.review_id, r.agent_id): (r.status, r.failure, r.calls) for r in agents.agent_outcomes(calls).collect()}
    assert out[1, "agent-0"] == ("success", None, 1) and out[2, "agent-0"] == ("success", None, 2) and out[2, "agent-1"] == ("success", None, 2)
    assert out[3, "agent-0"] == ("failed", "TIMEOUT", 2) and out[4, "agent-0"] == ("failed", "AUTHENTICATION_ERROR", 1) and out[5, "agent-0"] == ("failed", "INVALID_JSON", 2)
    assert out[6, "agent-0"] == ("failed", "OUTPUT_TRUNCATED", 2) and out[6, "agent-1"] == ("failed", "EMPTY_RESPONSE", 2) and out[7, "agent-0"] == ("success", None, 3)
    made = {(r.review_id, r.agent_id): r["count"] for r in calls.groupBy("review_id", "agent_id").count().collect()}
    assert made == {k: v[2] for k, v in out.items()}  # the loop makes no call that the record would not have
