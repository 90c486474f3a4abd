"""Scanners of a user's own beside the built-in rules: Python table functions over the lines of one file at a time.

A scanner is a class with ``eval(line)`` (and ``terminate()``, if it keeps something to the end of the file) that yields
hits; ``line`` has the columns of a source line. It is registered under a name and a skill, runs on executors over the
lines partitioned by file and ordered, and whatever it raises becomes an error row of its file: the skill failed there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut

#: Fields of a hit, by skill: a value on a line to be masked, or a finding at a line.
HITS = {"detect_secret": ("line_key", "secret_type", "value", "level", "status"), "detect_dangerous_call": ("line_key", "rule", "category", "level", "status", "severity")}
#: What a scanner may claim: no more than a suspicion backed by a tool.
LEVELS, CLAIMS = ("E0", "E1", "E2"), ("suspected", "unverified")
FAILED = "TOOL_ERROR"


@dataclass
class Registry:
    """Scanners by name: (skill, class)."""

    scanners: dict[str, tuple[str, type]] = field(default_factory=dict)

    def add(self, name: str, skill: str, scanner: type) -> None:
        if skill not in HITS:
            raise ValueError(f"scanners may join {', '.join(HITS)}")
        if name in self.scanners:
            raise ValueError(f"{name} is registered")
        self.scanners[name] = (skill, scanner)

    def scan(self, lines: DataFrame, skill: str) -> DataFrame:
        """(review_id, file_path, scanner, the skill's fields, error_code) of all scanners of a skill. Written, if there are any."""
        own = [_run(lines, name, skill, kind) for name, (joined, kind) in self.scanners.items() if joined == skill]
        return cut(reduce(DataFrame.unionByName, own), "scanned") if own else lines.sparkSession.createDataFrame([], _schema(skill))


def _schema(skill: str) -> str:
    texts = ", ".join(f"{c} {'long' if c == 'line_key' else 'string'}" for c in HITS[skill])
    return f"review_id long, file_path string, scanner string, {texts}, error_code string"


def _run(lines: DataFrame, name: str, skill: str, kind: type) -> DataFrame:
    fields = HITS[skill]
    level, status = fields.index("level"), fields.index("status")

    class Guarded:
        """The scanner over one file: hits that it may claim, and one error row if it fails."""

        def __init__(self) -> None:
            self.inner, self.at, self.code = None, None, None

        def _hits(self, method: str, *given: object) -> Iterator[tuple]:
            if self.code:
                return
            try:
                self.inner = self.inner or kind()
                for hit in (getattr(self.inner, method)(*given) if hasattr(self.inner, method) else None) or ():
                    if len(hit) != len(fields) or hit[level] not in LEVELS or hit[status] not in CLAIMS:
                        raise ValueError("not a hit that a scanner may claim")
                    yield (*self.at, name, *hit, None)
            except Exception:  # noqa: BLE001  a scanner's failure is its file's, not the job's
                self.code = FAILED

        def eval(self, line) -> Iterator[tuple]:  # noqa: ANN001
            self.at = (line["review_id"], line["file_path"])
            yield from self._hits("eval", line)

        def terminate(self) -> Iterator[tuple]:
            if self.at:
                yield from self._hits("terminate")
                if self.code:
                    yield (*self.at, name, *[None] * len(fields), self.code)

    run = F.udtf(Guarded, returnType=_schema(skill))
    return run(lines.asTable().partitionBy("review_id", "file_path").orderBy("pos", "line_key"))


def with_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, errors): hits of files that no scanner failed on, and (review_id, error_code) of those that one did."""
    errors = rows.where("error_code is not null").select("review_id", "file_path", "error_code").distinct()
    hits = rows.where("error_code is null").join(errors.select("review_id", "file_path"), ["review_id", "file_path"], "left_anti").drop("error_code")
    return hits, errors.select("review_id", "error_code").distinct()
