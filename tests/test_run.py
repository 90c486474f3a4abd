"""One recheck with the real gate; scanners of a user's own; a whole run's scope and core."""

import pytest
from test_policy import BASE, CONFLICT, EVIDENCE, FINDING, ONE, world

from sievework.operators import recheck
from sievework.operators.gate import Gate
from sievework.operators.run import ReviewRun
from sievework.operators.scanners import FAILED, Registry, with_errors

WEAK = ONE | {"finding": [FINDING | dict(status="suspected")], "evidence": [EVIDENCE | dict(level="E2")], "verified": []}
#: What the executor of each review does, and what comes of it.
RESULTS = [
    ("proves the finding", WEAK, "confirmed", dict(level="E3"), "BLOCK", ["B001"], False),
    ("dismisses it with a tool's word", WEAK, "dismissed", dict(level="E2", source="static_tool"), "PASS", ["P001"], False),
    ("dismisses it with a model's word", WEAK, "dismissed", dict(level="E1", source="llm"), "NEEDS_REVIEW", ["N004", "N008"], True),
    ("proves it elsewhere", WEAK, "confirmed", dict(level="E3", start_line=40, end_line=40), "NEEDS_REVIEW", ["N004", "N008"], True),
    ("fails", WEAK, None, None, "NEEDS_REVIEW", ["N004", "N008"], True),
    ("has nothing to add", WEAK, None, dict(), "NEEDS_REVIEW", ["N004", "N008"], True),
    ("is not asked", {}, None, dict(), "PASS", ["P001"], False),
    ("is not asked about a block", ONE, None, dict(), "BLOCK", ["B001"], False),
    ("has no target", {"review": [BASE["review"][0] | dict(truncated=True)]}, None, dict(), "NEEDS_REVIEW", ["N002"], False),
    ("resolves a conflict", ONE | {"conflict": [CONFLICT, CONFLICT | dict(finding_id=None, rule_id="N003")]}, "conflict", dict(), "BLOCK", ["B001"], False),
]


@pytest.fixture(scope="module")
def final(spark):
    relations = world(spark, *[r[1] for r in RESULTS])

    def execute(target):
        rows = {name: [] for name in recheck.RESULT}
        columns = {name: [c.split()[0] for c in schema.split(", ")] for name, schema in recheck.RESULT.items()}

        def put(name, review, **values):
            rows[name].append((review, *[values.get(c) for c in columns[name]]))

        ids = {r.review_id: r.request_id for r in recheck.requests(target).collect()}
        for n, (_, _, status, proof, *_) in enumerate(RESULTS, 1):
            if n not in ids:
                continue
            put("result", n, given_request_id=ids[n], given_review_id=n, attempt=1, status="failed" if proof is None else "success")
            if status == "conflict":
                put("conflict_resolution", n, conflict_id="x1")
            elif status:
                made = EVIDENCE | dict(evidence_id="new", finding_id="f1") | proof
                put("added", n, **made)
                put("added_link", n, finding_id="f1", evidence_id="new")
                put("finding_resolution", n, finding_id="f1", status=status)
                if made["level"] == "E3":
                    put("added_verified", n, evidence_id="new")
        return {name: spark.createDataFrame(rows[name], f"review_id long, {schema}") for name, schema in recheck.RESULT.items()}

    return {r.review_id: r for r in recheck.run_once(Gate(**relations), execute).collect()}


@pytest.mark.parametrize("n", range(1, len(RESULTS) + 1), ids=[r[0] for r in RESULTS])
def test_one_recheck(final, n):
    *_, status, rules, exhausted = RESULTS[n - 1]
    assert (final[n].status, final[n].rule_ids, final[n].exhausted) == (status, rules, exhausted)


def words():
    # a local class travels to the workers by value
    class Words:
        """Keeps state over a file and raises, claims too much or tells at the end, as the lines say."""

        def __init__(self):
            self.seen = 0

        def eval(self, line):
            self.seen += 1
            if "raise" in line["content"]:
                raise RuntimeError("broken")
            if "boast" in line["content"]:
                yield line["line_key"], "WORD", "boast", "E3", "confirmed"
            if "word" in line["content"]:
                yield line["line_key"], "WORD", f"word{self.seen}", "E2", "suspected"

    return Words


def test_scanners_see_a_file_in_order_and_fail_alone(spark):
    lines = [(1, "a.py", 1, 10, "word"), (1, "a.py", 2, 11, "x"), (1, "a.py", 3, 12, "word"), (1, "b.py", 1, 13, "word"), (1, "b.py", 2, 14, "raise"), (2, "a.py", 1, 15, "boast"), (3, "a.py", 1, 16, "none")]
    extra = Registry()
    extra.add("words", "detect_secret", words())
    hits, errors = with_errors(extra.scan(spark.createDataFrame(lines, "review_id long, file_path string, pos int, line_key long, content string").repartition(3), "detect_secret"))
    assert sorted((r.review_id, r.line_key, r.value) for r in hits.collect()) == [(1, 10, "word1"), (1, 12, "word3")]
    assert sorted(map(tuple, errors.collect())) == [(1, FAILED), (2, FAILED)]
    with pytest.raises(ValueError, match="registered"):
        extra.add("words", "detect_secret", words())
    with pytest.raises(ValueError, match="may join"):
        extra.add("other", "detect_nothing", words())


def test_a_run_without_outcomes_or_lines(spark):
    patches = spark.createDataFrame([(1, "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n a\n+total = 1"), (2, ""), (3, None)], "review_id long, raw_diff string")
    none = spark.createDataFrame([], "review_id long, agent_id string, status string, error_code string, repair_exhausted boolean")
    got = {r.review_id: (r.status, r.rule_ids) for r in ReviewRun(patches, none).decisions.collect()}
    assert set(got) == {1, 2, 3} and all(s == "NEEDS_REVIEW" for s, _ in got.values())
    assert ReviewRun(patches.limit(0), none).decisions.count() == 0
