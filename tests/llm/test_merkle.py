"""The manifest against a tree built in one place, with one and with several rounds below the driver's tree."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, key int, tree string, at long, n int, path string, total int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    trees = []
    for lang in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        told = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees.append((told, climb([leaf(r, r["text"]) for r in told])))
    above, out = climb([levels[-1][0] for _, levels in trees]), []
    for place, (told, levels) in enumerate(trees):
        for i, r in enumerate(told):
            claim, key = levels[0][i], r["doc_id"]
            if key is not None and zlib.crc32(str(key).encode()) % 3 == 0 and r["text"] is not None:
                claim = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]))
            others = []
            for side, at in ((levels, i), (above, place)):
                for level in side[:-1]:
                    start = at - at % 8
                    run = level[start : start + 8]
                    others += run[: at - start] + run[at - start + 1 :]
                    claim = sha("".join([*run[: at - start], claim, *run[at - start + 1 :]]))
                    at //= 8
            out.append((key, levels[0][i], levels[-1][0], above[-1][0], sha("".join(others)), claim, claim == above[-1][0]))
    return Counter(out)


def rows(n, langs=3):
    out = [(i, None if i % 13 == 0 else f"Text Nummer {i} É", None if i % (langs + 1) == langs else f"l{i % (langs + 1)}", "s", i, *[None] * 7) for i in range(n)]
    out += [(None, "null key", "l0", None, None, *[None] * 7), (None, "null key", "l0", None, None, *[None] * 7), (5, "same key", "l0", "s", 1, *[None] * 7), (9, "Word " * 50_000, "", "s", 1, *[None] * 7)]
    return [*out, out[1], out[1], out[1]]


@pytest.mark.parametrize("n", [0, 1, 9, 700])
def test_against_plain(spark, n):
    df = spark.createDataFrame(rows(n)[: n or None], SCHEMA).repartition(3)
    assert Counter(tuple(r) for r in merkle.op12_merkle(df).collect()) == plain([r.asDict() for r in df.collect()])


def test_empty(spark):
    assert merkle.op12_merkle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_row_is_its_root(spark):
    r = merkle.op12_merkle(spark.createDataFrame(rows(1)[:1], SCHEMA)).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha("") and r.verified


@pytest.mark.parametrize("langs", [2, 40])
def test_rounds_of_blocks(spark, langs):
    """Blocks of 8 and a driver's tree of 5 nodes: several rounds, and with 40 groups one more tree over the subroots."""
    df = spark.createDataFrame(rows(900, langs), SCHEMA)
    told = merkle.manifest(df, merkle.leaf_of(*map(F.col, merkle.FIELDS)), "lang", "doc_id", rounds=1, top=5).collect()
    expected = plain([r.asDict() for r in df.collect()])
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in told) == Counter(x[:5] for x in expected.elements())
    assert all(r.folded_root == r.root for r in told)


def test_real_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = Counter(tuple(r) for r in merkle.op12_merkle(df).collect())
    assert out == plain([r.asDict() for r in df.collect()])
    assert 0 < sum(not r[-1] for r in out) < len(out)
