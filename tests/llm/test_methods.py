"""The methods against brute force and held-out accuracy."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.llm import audio, common, graph, mixing, pii, quality, simhash, toxicity, urls

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def classes(n, pairs):
    head = list(range(n))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        head[b] = a
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_covering_masks_meet_every_pair_within_the_radius(radius):
    masks = [m % (1 << 64) for m in simhash.covering_masks(radius)]
    rng = np.random.default_rng(radius)
    for _ in range(300):
        bits = rng.choice(64, radius, replace=False).tolist()
        flipped = sum(1 << b for b in bits)
        assert any(flipped & m == 0 for m in masks)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_connect_what_brute_force_connects(spark, radius):
    rng = np.random.default_rng(3)
    seeds = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 20)]
    prints = sorted({s ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for s in seeds for _ in range(25)})
    want = classes(len(prints), [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if ((prints[i] ^ prints[j]) % (1 << 64)).bit_count() <= radius])
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), radius)
    got = {r.id: r.component for r in common.components(edges).collect()}
    assert [got.get(p, p) for p in prints] == [prints[w] for w in want]


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(5, 5)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(200, 300)) and 5 not in got


def test_near_duplicates_against_brute_force(spark, documents):
    rows = documents.orderBy("doc_id").collect()
    prints = [simhash.simhash64(r.text) for r in rows]
    want = classes(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents).collect()}
    assert [got[r.doc_id] for r in rows] == [rows[w].doc_id for w in want]


def test_graph_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    x = np.concatenate([c + 0.05 * rng.normal(size=(40, 32)) for c in centres] + [rng.normal(size=(600, 32))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}))
    got = graph.near_vectors(frame).toPandas().set_index("vec_id").loc[range(len(x)), "n_links"].to_numpy()
    assert (got <= true).all() and got.sum() >= 0.98 * true.sum()


def test_toxicity_on_held_out_rows(spark):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    out = toxicity.op2_toxicity(spark.read.parquet(f"{path}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.toxic).mean() >= 0.9 and out.toxic[out.predicted == 1].mean() >= 0.9


def test_toxicity_finds_what_is_held_out(spark):
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    out = toxicity.op2_toxicity(spark.read.parquet(f"{path}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    hits = ((out.predicted == 1) & (out.toxic == 1)).sum()
    assert hits >= 0.85 * (out.toxic == 1).sum() and hits >= 0.97 * (out.predicted == 1).sum()


def test_stems_are_dense():
    words = ["abcdefgh", "abcdefgi", "abcdefgj", "other", "abc"] + ["x"] * 50
    assert set(toxicity.dense_stems(words)) == {"abcde*", "abcdefg*"} and toxicity.dense_stems(words, {"abcde"}) == ["abcde*"]
    assert toxicity.dense_stems(words * 1 + ["y"] * 1000) == []


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    votes = [np.where(rng.random(4000) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in (0.85, 0.8, 0.75)]
    posterior, tables, rho = toxicity.label_model(np.stack([*votes, votes[0]], axis=1), np.where(votes[1] > 0, 0.8, 0.2))
    assert ((posterior > 0.5) == y).mean() > 0.8 and rho[0, 3] > 0.9 and tables[1, 0, 2] > tables[0, 0, 2]


def test_quality_on_held_out_rows(spark):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    out = quality.op8_quality(spark.read.parquet(f"{path}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() >= 0.95


def test_ordinal_thresholds_are_ordered_and_recovered():
    rng = np.random.default_rng(2)
    z = rng.normal(size=3000) * 2
    grades = (z[:, None] + rng.logistic(size=(3000, 1)) > np.array([-1.0, 1.5])).sum(axis=1)
    rows = [(np.array([0, 1]), np.array([1.0, v])) for v in z]
    model = quality.fit_ordinal(rows, grades, 3)
    assert np.all(np.diff(model.thresholds) > 0) and abs(np.diff(model.thresholds)[0] - 2.5) < 0.5
    assert np.corrcoef([model.weights[1] * v for v in z], z)[0, 1] > 0.99


def test_url_model_on_names_it_has_not_seen(spark):
    urls_ = ["https://cheap-slots.example.org/de/1", "http://www.casino-slots.example.net/de/2", "https://spam-pills.example.org/de/3", "https://m.ththen.example.org/de/4", "https://blog.gardening.example.net/de/5", "http://historians.example.org/about"]
    frame = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    assert [r.verdict for r in urls.op6_urls(frame).orderBy("page_id").collect()] == ["block"] * 3 + ["allow"] * 3


def test_water_filling_by_rounds(spark):
    sizes = {"a": 10, "b": 500, "c": 2000, "d": 1, None: 300}
    weights = {"a": 1.0, "b": 2.0, "c": 3.0, "d": 1.0, None: 2.0}
    frame = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.water_fill(frame).collect()}
    left, fixed = float(sum(sizes.values())), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in fixed}
        share = {s: (left - sum(fixed.values())) * w / sum(free.values()) for s, w in free.items()}
        over = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        fixed |= over
    assert {s: round(t, 6) for s, t in got.items()} == {s: round(t, 6) for s, t in (fixed | share).items()}


def test_mix_comes_near_its_targets(spark, documents):
    out = mixing.mix(documents, documents.select("source").distinct().select("source", F.lit(1.0).alias("weight"))).join(documents.select("doc_id", "source"), "doc_id")
    rows = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= r.most for r in rows)


def test_polyphase_keeps_a_tone_and_its_pitch():
    t = np.arange(12_000) / 12_000
    y = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    peak = np.argmax(np.abs(np.fft.rfft(y))) * 8000 / len(y)
    assert abs(len(y) - 8000) <= 1 and abs(peak - 440) < 2 and 0.9 < np.abs(y[100:-100]).max() < 1.1


def test_hysteresis_holds_through_small_dips():
    energy = np.array([0.0] * 20 + [3.0, 1.0, 1.0, 3.0, 0.0, 0.0, 1.0, 0.0])
    assert audio.segments(energy) == [(20, 24)]


def test_span_model_trusts_labelers_that_agree(spark, documents):
    found = documents.select(pii.candidates(F.col("text")).alias("spans"))
    model = pii.fit_spans(found)
    assert (model.right > 0.6).all() and model.chance.shape == (len(pii.KINDS), 32)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
        assert name == "packing" or docs.columns == columns
    assert seen[0] >= seen[1] >= seen[2] == seen[3] and corpus_pipeline.run(spark, SF).count() == seen[5]
