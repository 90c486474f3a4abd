"""Model calls by a client that the caller brings: a budget a review, one retry, one repair, every call a row.

Prompts are rows (review_id, agent_id, prompt_id, version, content); a review's agents are called in their order, one
review in one task, and what the loop makes of the calls is read off the recorded rows by ``agents.agent_outcomes``, as
for recorded calls. The client is made once a task by the function given and gets (system, prompt, repair) texts.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .agents import CALL_BUDGET

CALLS = "review_id long, call_id long, agent_id string, started_at timestamp, latency_ms long, status string, prompt_tokens long, cache_hit_tokens long, completion_tokens long, class_name string, status_code int, retry_after string, retry_number int, finish_reason string, content string, prompt_version string"
#: HTTP codes and class names after which a call may be tried again.
AGAIN, AGAIN_NAMES = (408, 429), ("timeout", "connection")


@dataclass
class Reply:
    content: str
    finish_reason: str = "stop"
    prompt_tokens: int | None = None
    cache_hit_tokens: int | None = None
    completion_tokens: int | None = None


class Client(Protocol):
    def complete(self, system: str, prompt: str, repair: str | None) -> Reply: ...


def versioned(prompts: DataFrame, dimension: DataFrame, at: str | None = None) -> DataFrame:
    """prompts (review_id, agent_id, context) with the text of their agent's prompt of a version, or the last.

    dimension: (agent_id, version, prompt_id, system); an agent without one has no row in the result.
    """
    told = dimension.where(F.col("version") == at) if at else dimension.groupBy("agent_id").agg(F.max_by(F.struct("version", "prompt_id", "system"), F.transform(F.split("version", "[.]"), lambda v: v.cast("int"))).alias("p")).select("agent_id", "p.*")
    return prompts.join(told.select("agent_id", "version", "prompt_id", "system"), "agent_id")


def _valid(reply: Reply) -> bool:
    try:
        return reply.finish_reason != "length" and isinstance(json.loads(reply.content)["summary"], str)
    except (ValueError, TypeError, KeyError, RecursionError):
        return False


def call_models(prompts: DataFrame, client: Callable[[], Client], budget: int = CALL_BUDGET, pause: Callable[[float], None] | None = None) -> DataFrame:
    """The calls (as the relation of recorded calls) that prompts (review_id, agent_id, version, system, context) lead to.

    An agent's loop ends with a valid reply, with a failure that can't be retried, after one retry and one repair, or with
    the review's budget. pause: waits between tries; none by default.
    """
    schema = T.StructType.fromDDL(CALLS)
    arrow = to_arrow_schema(schema)

    def one(of: Client, row: dict, number: int, tries: int, repair: str | None) -> tuple[dict, str]:
        start = time.time()
        told = {"review_id": row["review_id"], "call_id": row["review_id"] * (budget + 1) + number, "agent_id": row["agent_id"], "started_at": pa.scalar(int(start * 1e6) + number, pa.timestamp("us", "UTC")).as_py(), "retry_number": tries, "prompt_version": row["version"]}
        try:
            reply = of.complete(row["system"], row["context"], repair)
        except Exception as e:  # noqa: BLE001  a failed call is a row
            code, name = getattr(e, "status_code", None), type(e).__name__
            again = code in AGAIN or (code or 0) >= 500 or any(n in name.lower() for n in AGAIN_NAMES)
            return told | {"status": "failed", "class_name": name, "status_code": code, "retry_after": getattr(e, "retry_after", None), "latency_ms": int((time.time() - start) * 1000)}, "retry" if again else "end"
        kept = {"status": "success", "finish_reason": reply.finish_reason, "content": reply.content, "prompt_tokens": reply.prompt_tokens, "cache_hit_tokens": reply.cache_hit_tokens, "completion_tokens": reply.completion_tokens, "latency_ms": int((time.time() - start) * 1000)}
        return told | kept, "end" if _valid(reply) else "repair"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        rows = (r for batch in batches for r in batch.to_pylist())
        for _, asked in groupby(rows, key=lambda r: r["review_id"]):
            calls: list[dict] = []
            for row in asked:
                tried = {"retry": 0, "repair": 0}
                repair, next_ = None, "first"
                while next_ != "end" and len(calls) < budget and max(tried.values()) <= 1:
                    of = of or client()
                    made, next_ = one(of, row, len(calls) + 1, tried["retry"] + 1, repair)
                    calls.append(made)
                    if next_ in tried:
                        tried[next_] += 1
                    repair = made.get("content") if next_ == "repair" else repair
                    if next_ == "retry" and pause and tried["retry"] == 1:
                        pause(0.25)
            if calls:
                yield pa.RecordBatch.from_pylist([{c: call.get(c) for c in arrow.names} for call in calls], arrow)

    dealt = prompts.select("review_id", "agent_id", "version", "system", "context").repartition("review_id").sortWithinPartitions("review_id", "agent_id", "context")
    return dealt.mapInArrow(run, schema)
