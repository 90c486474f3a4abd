"""Conversation structure repair: the cheapest edits that give system?, then user and assistant in turns.

Turns with the same key, turn, role and text are counted together, so that copies of a turn cost one row; turns are
dealt in order by a range sort, so a conversation of any length spreads over tasks. Each task cuts its stretch into
segments of bounded rows and bytes and runs A* over the lattice (turns done, phase of the pattern): keep, re-role,
delete, or insert before the next turn. The heuristic is the suffix sum of the deletions that must come and the charge
that every truncated turn costs at least; nodes are taken by (cost plus heuristic, audit), so the first that reaches
the end is the cheapest, and of these the one of the least audit. A conversation that lies in one segment is done then.
Of others each segment gives the best edits from every phase to every phase; a pass over the segments from the last to
the first (a few numbers each) finds the phases that all of them go through. Edits that differ between phases differ
before either ends, so the least audit of the whole is decided segment by segment.

Defined cases: a null key is a conversation; null turns come first; turns that share a number are ordered by role, then
text, nulls as one space; a null or blank text is a blank turn; an empty role has no initial and can't be kept; a role
counts by its first character; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import crc32_sql, cut

#: Costs of keeping, giving another role, deleting, inserting, and of a truncated turn that stays.
PRICES = {"K": 0, "R": 3, "D": 4, "I": 3, "T": 3}
MUST_GO, LEGAL = ("blank", "duplicate"), ("su", "ua", "au")
#: Phases: nothing yet, after the system turn, after a user turn, after an assistant turn. What a kept initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ENDS = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
BLANKS = r"\x20\x09-\x0D"
#: Rows and characters of a segment, and characters of a text that order the range sort.
ROWS, CHARS, ORDERED = 128, 1 << 20, 100
#: Segments in an Arrow batch.
SEGMENTS = 32
#: A turn to the search: its initial, whether it must go, whether it is truncated.
Turn = tuple[str, bool, bool]


def next_role(phase: int) -> int:
    """The phase after a turn that is given the role the pattern asks for."""
    return ASSISTANT if phase == USER else USER


def search(turns: list[Turn], phase: int, whole: bool, prices: dict[str, int]) -> Iterator[tuple[int, int, str]]:
    """A* from a phase: (phase, cost, audit) at the end, the best of each phase, cheapest first.

    whole: inserts may follow the last turn, and only ends of the pattern count; the first is the answer. prices: the costs.
    """
    n = len(turns)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        _, goes, short = turns[i]
        ahead[i] = ahead[i + 1] + (prices["D"] if goes else min(prices["T"], prices["D"]) if short else 0)
    heap, closed = [(ahead[0], "", 0, phase)], set()
    while heap:
        key, audit, i, at = heapq.heappop(heap)
        if (i, at) in closed:
            continue
        closed.add((i, at))
        if i == n and not (whole and ENDS[at]):
            yield at, key, audit
        cost = key - ahead[i]
        steps = []
        if i < n:
            initial, goes, short = turns[i]
            steps.append((prices["D"], "D", i + 1, at))
            if not goes:
                charge = prices["T"] if short else 0
                steps.append((prices["R"] + charge, "R", i + 1, next_role(at)))
                if (at, initial) in KEPT:
                    steps.append((prices["K"] + charge, "K", i + 1, KEPT[at, initial]))
        if i < n or whole:
            steps.append((prices["I"], "I", i, next_role(at)))
        for price, edit, j, to in steps:
            if (j, to) not in closed:
                heapq.heappush(heap, (cost + price + ahead[j], audit + edit, j, to))


def played(audit: str, phase: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that the edits leave."""
    i = 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        phase = KEPT[phase, roles[i][:1]] if edit == "K" else next_role(phase)
        role = "assistant" if phase == ASSISTANT else "user"
        yield edit, roles[i] if edit == "K" else role, "" if edit == "I" else texts[i]
        i += edit != "I"


def faults(rows: DataFrame) -> DataFrame:
    """Distinct turns of rows (key, turn, role, text, copies): n, how often each is there, and its first fault.

    The fault is that of the first of the n; the other n - 1 are blank or duplicates. Written.
    """
    turns = cut(rows.groupBy("key", "turn", "role", "text").agg(F.sum("copies").alias("n")).withColumn("digest", F.sha2("text", 256)), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    firsts = turns.groupBy("key", "role", "digest").agg(F.min(order).alias("o")).select("key", "role", "digest", F.col("o.turn").alias("turn"))
    body = F.regexp_replace("text", f"[{BLANKS}]+$", "")
    fault = F.when(body == "", "blank").when(F.col("f_digest").isNull(), "duplicate").when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated")
    joined = turns.join(firsts.withColumnsRenamed({c: f"f_{c}" for c in firsts.columns}), _same(firsts.columns, "f_"), "left")
    return cut(joined.select("key", "turn", "role", "text", "n", fault.alias("fault")), "faults")


def _same(columns: list[str], prefix: str) -> Column:
    """All columns equal to those of the prefix, nulls too."""
    pairs = [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in columns]
    return functools.reduce(lambda a, b: a & b, pairs)


def _unlike(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _segment(held: list[dict], opens: bool, closes: bool, prices: dict[str, int]) -> dict:
    """A stretch of a conversation with its best edits. Turns that follow each other and must go are one step."""
    turns, times, roles, texts = [], [], [], []
    for r in held:
        stays = r["fault"] not in MUST_GO
        for goes, n in ((False, int(stays)), (True, r["n"] - stays)):
            if n:
                turns.append((r["role"][:1], goes, not goes and r["fault"] == "truncated"))
                times.append(n)
                roles.append(r["role"])
                texts.append("" if goes else r["text"])
    whole = opens and closes
    options = []
    for phase in (START,) if opens else range(4):
        found = search(turns, phase, whole, prices)
        options += [(phase, to, cost, audit) for to, cost, audit in (itertools.islice(found, 1) if whole else found)]
    more = sum(n - 1 for n in times) * prices["D"]
    options = [{"start": a, "end": b, "cost": c + more, "audit": x, "rank": i} for i, (a, b, c, x) in enumerate(sorted(options, key=lambda o: (o[0], o[3])))]
    initials = [r["role"][:1] for r in held]
    illegal = _unlike(initials) + sum((r["n"] - 1) * _unlike([r["role"][:1]] * 2) for r in held)
    return {"key": held[0]["key"], "whole": whole, "options": options, "times": times, "roles": roles, "texts": texts, "illegal": illegal, "head": initials[0], "tail": initials[-1]}


def _cut_up(prices: dict[str, int], most: int, schema: pa.Schema):
    """Segments of a task's sorted turns. A task's first conversation may have begun, its last may go on elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size, opens = TaskContext.get().partitionId(), 0, [], 0, False
        for row in (r for batch in batches for r in batch.to_pylist()):
            other = bool(held) and row["key"] != held[0]["key"]
            if other or len(held) == most or size > CHARS:
                yield pa.RecordBatch.from_pylist([{"part": part, "seq": seq, **_segment(held, opens, other, prices)}], schema)
                seq, held, size, opens = seq + 1, [], 0, other
            held.append(row)
            size += len(row["text"])
        if held:
            yield pa.RecordBatch.from_pylist([{"part": part, "seq": seq, **_segment(held, opens, False, prices)}], schema)

    return run


def _by_key(start: Callable[[], object], step: Callable[[object, dict], dict], schema: pa.Schema):
    """A state a conversation, carried over its rows as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state is None or row["key"] != at:
                    at, state = row["key"], start()
                out.append(step(state, row))
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _backward(state: dict, row: dict) -> dict:
    """From the last segment to the first: the end to take from each phase, given the least cost of all that follows."""
    last = not state
    to_go = state or {p: len(rest) * row["insert"] for p, rest in ENDS.items()}
    ends, least = [-1] * 4, {}
    for phase in range(4):
        ways = [(o["cost"] + to_go[o["end"]], o["rank"], o["end"]) for o in row["options"] if o["start"] == phase and o["end"] in to_go]
        if ways:
            least[phase], _, ends[phase] = min(ways)
    state.clear()
    state.update(least)
    return {"key": row["key"], "part": row["part"], "seq": row["seq"], "ends": ends, "last": last}


def _forward(state: list, row: dict) -> dict:
    """From the first segment to the last: the phases that the edits go through."""
    phase = state[0]
    state[0] = row["ends"][phase]
    return {"part": row["part"], "seq": row["seq"], "start": phase, "end": state[0], "last": row["last"]}


def _play(insert: int, schema: pa.Schema):
    """Each segment's edits and what they leave."""

    def one(row: dict) -> dict:
        option = next(o for o in row["options"] if row["whole"] or (o["start"], o["end"]) == (row["start"], row["end"]))
        more = "" if row["whole"] or not row["last"] else ENDS[option["end"]]
        turns = list(played(option["audit"] + more, option["start"], row["roles"], row["texts"]))
        times, i, audit = row["times"], 0, []
        for edit in option["audit"]:
            audit.append(edit if edit == "I" else edit * times[i])
            i += edit != "I"
        return {**{c: row[c] for c in ("key", "part", "seq", "illegal", "head", "tail")}, "cost": option["cost"] + len(more) * insert, "audit": "".join(audit) + more, "turns": [{"edit": e, "role": r, "text": t} for e, r, t in turns]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(r) for r in batch.to_pylist()], schema)

    return run


def repair(found: DataFrame, prices: dict[str, int] | None = None, most: int = ROWS) -> DataFrame:
    """The cheapest repair of the conversations of ``faults``: segments (key, part, seq, cost, audit, turns, illegal, head, tail).

    A conversation is its segments in order of (part, seq); turns: (edit, role, text) of what is left; illegal: neighbours
    within the segment that the pattern forbids; head, tail: the first and last initial. prices: by K, R, D, I, and T for a
    truncated turn that stays; most: rows of a segment. Written.
    """
    prices = PRICES | (prices or {})
    key = T.StructField("key", found.schema["key"].dataType)
    place = "part long, seq long"

    def mapped(df: DataFrame, work: Callable, ddl: str, keyed: bool = True) -> DataFrame:
        schema = T.StructType([*([key] if keyed else []), *T.StructType.fromDDL(ddl)])
        return df.mapInArrow(work(to_arrow_schema(schema)), schema)

    def streamed(df: DataFrame, *order: Column | str) -> DataFrame:
        return df.repartition("key").sortWithinPartitions(F.asc_nulls_first("key"), *order)

    by = [F.asc_nulls_first(c) for c in ("key", "turn", "role")]
    dealt = found.repartitionByRange(*by, F.substring("text", 1, ORDERED)).sortWithinPartitions(*by, "text").drop("turn")
    about = f"{place}, whole boolean, options array<struct<start int, end int, cost long, audit string, rank int>>, times array<long>, roles array<string>, texts array<string>, illegal long, head string, tail string"
    segments = cut(mapped(dealt, lambda s: _cut_up(prices, most, s), about), "segments")
    parted = segments.where("NOT whole").select("key", "part", "seq", F.lit(prices["I"]).alias("insert"), F.transform("options", lambda o: o.dropFields("audit")).alias("options"))
    back = cut(mapped(streamed(parted, F.desc("part"), F.desc("seq")), lambda s: _by_key(dict, _backward, s), f"{place}, ends array<int>, last boolean"), "back")
    ways = cut(mapped(streamed(back, "part", "seq"), lambda s: _by_key(lambda: [START], _forward, s), f"{place}, start int, end int, last boolean", keyed=False), "ways")
    chosen = segments.join(ways, ["part", "seq"], "left")
    left = f"{place}, cost long, audit string, turns array<struct<edit string, role string, text string>>, illegal long, head string, tail string"
    return cut(mapped(chosen, lambda s: _play(prices["I"], s), left), "repaired", batch=SEGMENTS)


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """(key, part, seq, place, edit, role, text): what ``repair`` leaves, one row a turn, in order of (part, seq, place)."""
    return repaired.select("key", "part", "seq", F.posexplode("turns").alias("place", "turn")).select("key", "part", "seq", "place", "turn.*")


def _digest(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A conversation's cost, audit and SHA-256, which is a chain by nature: its text streams through one task."""
    at, state = None, None

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"key": at, "cost": state["cost"], "audit": "".join(state["audit"]), "illegal": state["illegal"], "repaired_sha256": state["hash"].hexdigest()}], schema)

    for row in (r for batch in batches for r in batch.to_pylist()):
        if state is None or row["key"] != at:
            if state is not None:
                yield given()
            at, state = row["key"], {"cost": 0, "audit": [], "illegal": 0, "hash": hashlib.sha256(), "tail": None, "begun": False}
        state["cost"] += row["cost"]
        state["audit"].append(row["audit"])
        state["illegal"] += row["illegal"] + (0 if state["tail"] is None else _unlike([state["tail"], row["head"]]))
        state["tail"] = row["tail"]
        for turn in row["turns"]:
            state["hash"].update(f"{chr(10) if state['begun'] else ''}{turn['role']}:{turn['text']}".encode())
            state["begun"] = True
    if state is not None:
        yield given()


def damaged(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, role, text, copies): turns dropped, emptied, cut, repeated or re-roled by the checksum of key:turn."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (key, turn, role, text)]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    told = conversations.select(F.col(key).alias("key"), F.col(turn).alias("turn"), shown[2].alias("role"), shown[3].alias("text"), kind.alias("kind")).where("kind <> 0")
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return told.select("key", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def op11_repair(conversations: DataFrame, most: int = ROWS) -> DataFrame:
    found = faults(damaged(conversations))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    stays = (~F.col("fault").isin(*MUST_GO) | F.col("fault").isNull()).cast("int")
    sums = {"blank": F.when(F.col("fault") == "blank", F.col("n")), "duplicate": F.when(F.col("fault") == "blank", 0).otherwise(F.col("n") - stays), "truncated": F.when(F.col("fault") == "truncated", 1)}
    counts = found.groupBy("key").agg(gaps.alias("gaps"), *[F.coalesce(F.sum(v), F.lit(0)).alias(c) for c, v in sums.items()])
    schema = T.StructType([T.StructField("key", found.schema["key"].dataType), *T.StructType.fromDDL("cost long, audit string, illegal long, repaired_sha256 string")])
    arrow = to_arrow_schema(schema)
    ordered = repair(found, most=most).repartition("key").sortWithinPartitions(F.asc_nulls_first("key"), "part", "seq")
    digests = cut(ordered.mapInArrow(lambda batches: _digest(batches, arrow), schema), "digests", batch=SEGMENTS)
    out = conversations.select(F.col("conv_id")).distinct()
    for part, prefix in ((counts, "c_"), (digests, "d_")):
        out = out.join(part.withColumnRenamed("key", f"{prefix}conv_id"), _same(["conv_id"], prefix), "left").drop(f"{prefix}conv_id")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def oracle() -> str:
    """DuckDB SQL for op11: one step a turn, the best edits of every phase kept; an insert at most before a turn, two at the end."""
    blank = f"[{BLANKS}]"
    kept = " ".join(f"WHEN b.phase = {phase} AND r.initial = '{initial}' THEN {to}" for (phase, initial), to in KEPT.items())
    after = f"CASE WHEN phase = {USER} THEN {ASSISTANT} ELSE {USER} END"
    name = lambda phase: f"CASE WHEN {phase} = {ASSISTANT} THEN 'assistant' ELSE 'user' END"
    grow = lambda role, text: f"list_append(b.left_, {role} || ':' || {text})"
    ins = lambda rows: f"SELECT key, n, phase, cost, audit, left_ FROM {rows} UNION ALL SELECT key, n, {after}, cost + {PRICES['I']}, audit || 'I', list_append(left_, {name(after)} || ':') FROM {rows}"
    return rf"""WITH RECURSIVE told AS (SELECT conv_id AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
    hurt AS (SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM told WHERE kind <> 0),
    placed AS (SELECT key, turn, role, text, left(role, 1) AS initial, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text, copy) AS n, regexp_replace(text, '{blank}+$', '') AS body FROM hurt),
    row_ AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
    best AS (SELECT DISTINCT key, 0::BIGINT AS n, {START} AS phase, 0 AS cost, '' AS audit, []::VARCHAR[] AS left_ FROM row_
        UNION ALL SELECT key, n, phase, cost, audit, left_ FROM (SELECT *, row_number() OVER (PARTITION BY key, phase ORDER BY cost, audit) AS place FROM (
            SELECT b.key, r.n, b.phase, b.cost + {PRICES['D']} AS cost, b.audit || 'D' AS audit, b.left_ FROM ({ins('best')}) b JOIN row_ r ON r.key IS NOT DISTINCT FROM b.key AND r.n = b.n + 1
            UNION ALL SELECT b.key, r.n, {after.replace('phase', 'b.phase')}, b.cost + {PRICES['R']} + CASE WHEN fault = 'truncated' THEN {PRICES['T']} ELSE 0 END, b.audit || 'R', {grow(name(f"({after.replace('phase', 'b.phase')})"), 'r.text')} FROM ({ins('best')}) b JOIN row_ r ON r.key IS NOT DISTINCT FROM b.key AND r.n = b.n + 1 WHERE fault NOT IN ('blank', 'duplicate')
            UNION ALL SELECT b.key, r.n, CASE {kept} END, b.cost + CASE WHEN fault = 'truncated' THEN {PRICES['T']} ELSE 0 END, b.audit || 'K', {grow('r.role', 'r.text')} FROM ({ins('best')}) b JOIN row_ r ON r.key IS NOT DISTINCT FROM b.key AND r.n = b.n + 1 WHERE fault NOT IN ('blank', 'duplicate') AND CASE {kept} END IS NOT NULL)) WHERE place = 1),
    size AS (SELECT key, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM row_ GROUP BY key),
    near AS (SELECT key, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT key, lag(initial) OVER (PARTITION BY key ORDER BY n) || initial AS pair FROM row_) WHERE pair IS NOT NULL GROUP BY key),
    last AS (SELECT b.* FROM best b JOIN size s ON s.key IS NOT DISTINCT FROM b.key AND s.n = b.n), one AS ({ins('last')}), two AS ({ins('one')}),
    done AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cost, audit) AS place FROM two WHERE phase IN ({START}, {ASSISTANT}))
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(left_, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN size s ON s.key IS NOT DISTINCT FROM c.conv_id LEFT JOIN near i ON i.key IS NOT DISTINCT FROM c.conv_id LEFT JOIN done e ON e.key IS NOT DISTINCT FROM c.conv_id AND e.place = 1"""
