"""Repairs against a search over all edits, row by row; in one segment and in segments of two rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from sievework.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, key string, n int, fault string, part long, cost string, kind int"
LEADS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def spoilt(rows):
    out = {}
    for key, turn, role, text, *_ in rows:
        told = out.setdefault(key, [])
        shown = [" " if v is None else str(v) for v in (key, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", shown[3]) if kind == 2 else shown[3]
        told += [(turn, "user" if kind == 4 else shown[2], text)] * {0: 0, 3: 2}.get(kind, 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in out.items()}


def plain(rows):
    out = []
    for key, told in spoilt(rows).items():
        numbers, seen, faults = [r[0] for r in told if r[0] is not None], set(), []
        for _, role, text in told:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {0: (0, "", ())}

        def reach(to, phase, value):
            if phase not in to or value[:2] < to[phase][:2]:
                to[phase] = value

        def inserted(to):
            for _ in range(4):
                for phase, (cost, audit, left) in list(to.items()):
                    after = 3 if phase == 2 else 2
                    reach(to, after, (cost + 3, audit + "I", (*left, "assistant:" if after == 3 else "user:")))
            return to

        for (_, role, text), fault in zip(told, faults):
            after = {}
            for phase, (cost, audit, left) in inserted(best).items():
                reach(after, phase, (cost + 4, audit + "D", left))
                if fault in ("blank", "duplicate"):
                    continue
                charge, to = 3 * (fault == "truncated"), 3 if phase == 2 else 2
                reach(after, to, (cost + 3 + charge, audit + "R", (*left, f"{'assistant' if to == 3 else 'user'}:{text}")))
                if (phase, role[:1]) in LEADS:
                    reach(after, LEADS[phase, role[:1]], (cost + charge, audit + "K", (*left, f"{role}:{text}")))
            best = after
        cost, audit, left = min((v for p, v in inserted(best).items() if p in (0, 3)), key=lambda v: v[:2])
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        out.append((key, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return Counter(out)


def odd_rows():
    draw = random.Random(3)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "ass"], ["Yes.", "no", "What?", "", " \t", None, "Go!", "So. "]
    out = [(c, None if draw.random() < 0.1 else t + draw.choice([0, 0, 0, 2]), draw.choice(roles[:5] if c % 2 else roles), draw.choice(texts)) for c in range(120) for t in range(draw.randint(1, 12))]
    out += [(500, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.") for t in range(700)]
    out += [(501, t, "user", "Again.") for t in range(300)] + [(502, 1, "user", "Same.")] * 50 + [(None, t, "user", "Key?") for t in (None, None, 1)] + [(503, None, "assistant", "word " * 60_000)]
    return [(*r, *[None] * 6) for r in out]


@pytest.mark.parametrize("most", [2, 128])
def test_against_plain(spark, most):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    assert Counter(tuple(r) for r in repair.op11_repair(df, most).collect()) == plain(odd_rows())


def test_empty_and_all_dropped(spark):
    assert repair.op11_repair(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next((c, t) for c in range(100) for t in range(100) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    r = repair.op11_repair(spark.createDataFrame([(*gone, "user", "Hi.", *[None] * 6)], SCHEMA)).collect()
    assert [tuple(x) for x in r] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_search_is_the_cheapest_and_least():
    turns = [("a", False, False), ("u", False, True), ("u", True, False), ("s", False, False), ("a", False, False)]
    first = next(repair.search(turns, repair.START, True, repair.PRICES))
    assert first == (repair.ASSISTANT, 3 + 4 + 4 + 3, "IKDDRK")


def test_repaired_turns_follow_the_pattern(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    left = repair.repaired_turns(repair.repair(repair.faults(repair.damaged(df)), most=3)).orderBy("key", "part", "seq", "place").collect()
    shapes = {}
    for r in left:
        shapes[r.key] = shapes.get(r.key, "") + r.role[0]
    assert shapes and all(re.fullmatch("s?(ua)+", x) for x in shapes.values())


def test_real_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in repair.op11_repair(df).collect()) == plain(rows)
