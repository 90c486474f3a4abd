"""The pipeline's near-dedup against brute force over shingle sets."""

import itertools
import random

import corpus_pipeline
import pytest

from sievework.llm import copies

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def check(rows, left):
    """No two texts that stay are near copies; each that goes equals one that stays, or has a near copy."""
    sets = {t: shingles(t) for _, t in rows}

    def near(a, b):
        both = len(sets[a] & sets[b])
        return both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)

    texts = sorted({t for _, t in left}, key=str)
    assert not [p for p in itertools.combinations(texts, 2) if near(*p)]
    assert all(any(t != o and near(t, o) for o in sets) for _, t in rows if t not in texts)


def family(seed, changes, words=300):
    """A text, and it with single words changed far from each other."""
    draw = random.Random(seed)
    text = [f"w{draw.randrange(10**6)}" for _ in range(words)]
    other = list(text)
    for n in range(changes):
        other[(n + 1) * words // (changes + 1)] = f"x{n}"
    return " ".join(text), " ".join(other)


def kept(spark, rows):
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    out = corpus_pipeline.drop_copies(spark, docs, SF)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_copies_of_similarity_0_8_go_and_others_stay(spark):
    near, far = [family(s, 6) for s in range(30)], [family(s, 9) for s in range(30, 40)]
    assert all(0.8 <= similarity(*p) < 0.83 for p in near) and all(0.7 < similarity(*p) < 0.8 for p in far)
    rows = [(2 * n + i, t) for n, p in enumerate(near + far) for i, t in enumerate(p)]
    left = kept(spark, rows)
    check(rows, left)
    assert [k for k, _ in left] == [k for k, _ in sorted([r for r in rows if r[0] >= 60 or r[0] % 2 == 0], key=str)]


def test_a_large_group_of_near_copies_leaves_one(spark):
    draw = random.Random(9)
    base = [f"w{n}" for n in range(400)]
    rows = [(1000, " ".join(base))]
    for n in range(600):  # each near the base only: any two of them differ in twice as many words
        text = list(base)
        for at in draw.sample(range(400), 8):
            text[at] = f"x{draw.randrange(10**6)}"
        rows.append((n, " ".join(text)))
    assert sum(similarity(rows[i][1], rows[j][1]) >= 0.8 for i, j in itertools.combinations(range(1, 60), 2)) < 60
    assert kept(spark, rows) == [rows[0]]


def test_unlinked_texts_of_shared_passages_all_stay(spark):
    draw = random.Random(4)
    shared = [f"w{n}" for n in range(300)]
    rows = [(n, " ".join(shared + [f"y{draw.randrange(10**6)}" for _ in range(100)])) for n in range(60)]
    assert 0.5 < similarity(rows[0][1], rows[1][1]) < 0.7
    assert kept(spark, rows) == sorted(rows, key=str)


def test_of_a_chain_of_near_copies_no_neighbours_stay(spark):
    texts, words = [], [f"w{n}" for n in range(300)]
    for step in range(12):
        texts.append(" ".join(words))
        for at in range(5 * step, 300, 60):
            words[at] = f"c{step}-{at}"
    rows = [(50 - n, t) for n, t in enumerate(texts)]
    assert similarity(texts[0], texts[1]) >= 0.8 and similarity(texts[0], texts[-1]) < 0.5
    left = kept(spark, rows)
    check(rows, left)
    assert 2 <= len(left) <= 6


def test_rows_without_a_key_or_with_a_shared_one_stay(spark):
    one, two = family(50, 1)
    rows = [(None, "clean text of its own"), (None, "another clean text"), (7, "first text of seven"), (7, "second text of seven"), (None, two), (3, one), (None, None), (4, "")]
    assert kept(spark, rows) == sorted([(None, "clean text of its own"), (None, "another clean text"), (7, "first text of seven"), (7, "second text of seven"), (3, one), (4, "")], key=str)
    assert kept(spark, []) == []


@pytest.mark.parametrize("sf", [SF])
def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    left = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, docs, sf).collect())
    check(rows, left)
    assert len(left) < len(rows)


def test_the_bound_never_rules_out_near_copies(spark):
    import numpy as np
    from pyspark.sql import functions as F

    draw = np.random.default_rng(5)
    rows, truth = [], []
    for n in range(400):
        size = int(draw.integers(1, 1500))
        one = draw.integers(0, 1 << 63, size, np.int64).astype(np.uint64)
        two = np.concatenate([one[: int(size * draw.random())], draw.integers(0, 1 << 63, int(draw.integers(0, 300)), np.int64).astype(np.uint64)])
        both = len(np.intersect1d(one, two))
        truth.append(both / (len(one) + len(two) - both))
        rows.append((n, copies.bit_map(one), copies.bit_map(two), len(one), len(two)))
    frame = spark.createDataFrame(rows, "n int, x array<long>, y array<long>, a long, b long")
    got = {r.n: r.may for r in frame.select("n", copies._may_be_near(F.col("x"), F.col("y"), F.col("a"), F.col("b"), 0.8).alias("may")).collect()}
    assert all(got[n] for n, t in enumerate(truth) if t >= 0.8) and sum(got.values()) < 1.6 * sum(t >= 0.8 for t in truth) + 40
