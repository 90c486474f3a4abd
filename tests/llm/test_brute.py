"""Operators against plain versions that share no code with them."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sievework.llm import audio, common, pii, quality, sharding, simhash, toxicity, urls

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return sorted(documents.collect(), key=lambda r: r.doc_id)


# ---- sharding -------------------------------------------------------------------------------------------------------


def test_shards_are_the_leaves_of_a_kd_tree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in sharding.op1_sharding(docs).collect()}
    points = []
    for r in docs.collect():
        size = len((r.text or "").encode()) + 1
        code = lambda t: zlib.crc32(t.encode())
        points.append((out[r.doc_id].shard, size, [math.log2(size), r.n_chars, code(r.lang), code(r.source), r.doc_id]))
    low, high = [[f(p[2][i] for p in points) for i in range(5)] for f in (min, max)]
    points = [(s, size, [int((x - a) / (b - a) * (2**31 - 1)) if b > a else 0 for x, a, b in zip(at, low, high, strict=True)]) for s, size, at in points]

    def check(first, count):
        """Shards first .. first + count - 1: halves that the widest dimension parts, of near equal bytes."""
        if count == 1:
            return
        own = [p for p in points if first <= p[0] < first + count]
        spread = [max(p[2][i] for p in own) - min(p[2][i] for p in own) for i in range(5)]
        dim, half = spread.index(max(spread)), count // 2
        left, right = [p for p in own if p[0] < first + half], [p for p in own if p[0] >= first + half]
        assert max(p[2][dim] for p in left) <= min(p[2][dim] for p in right)
        assert abs(sum(p[1] for p in left) - sum(p[1] for p in own) * half / count) <= max(p[1] for p in own)
        check(first, half)
        check(first + half, count - half)

    check(0, 16)


# ---- toxicity -------------------------------------------------------------------------------------------------------


def plain_em(votes, start, rounds=30):
    """Expectation-maximisation one row, voter and vote at a time."""
    post = list(start)
    for _ in range(rounds):
        prior = min(max((sum(post) + 1) / (len(post) + 2), 0.001), 0.999)
        tables = []
        for y in (0, 1):
            weight = [p if y else 1 - p for p in post]
            usual = toxicity.USUAL[y]
            tables.append([[(sum(w for w, v in zip(weight, votes, strict=True) if v[j] == value) + toxicity.WEIGHT * usual[value + 1]) / (sum(weight) + toxicity.WEIGHT) for value in (-1, 0, 1)] for j in range(len(votes[0]))])
        after = []
        for v in votes:
            odds = math.log(prior / (1 - prior)) + sum(math.log(tables[1][j][x + 1] / tables[0][j][x + 1]) for j, x in enumerate(v))
            after.append(1 / (1 + math.exp(-odds)))
        if max(abs(a - b) for a, b in zip(after, post, strict=True)) < 1e-6:
            return after
        post = after
    return post


def test_posterior_equals_plain_estimation():
    rng = np.random.default_rng(7)
    y = rng.random(400) < 0.3
    votes = np.stack([np.where(rng.random(400) < a, np.where(y, 1, -1), rng.integers(-1, 2, 400)) for a in (0.8, 0.7, 0.6, 0.5)], axis=1)
    start = np.where(votes[:, 0] > 0, 0.6, 0.03)
    posterior, _, rho = toxicity.label_model(votes, start)
    assert (np.abs(rho - np.eye(4)) < 0.2).all()  # voters that repeat nobody are not discounted
    assert np.allclose(posterior, plain_em(votes.tolist(), plain_em(votes.tolist(), start.tolist())), atol=1e-4)
    assert ((posterior > 0.5) == y).mean() > 0.85


def test_posterior_is_not_the_label():
    """A wrong label among agreeing voters is outvoted; a right one without any hit stands alone and is doubted."""
    rng = np.random.default_rng(3)
    n = 600
    y = rng.random(n) < 0.3
    votes = np.stack([*(np.where(rng.random(n) < 0.9, np.where(y, 1, -1), -np.where(y, 1, -1)) for _ in range(4)), np.where(rng.random(n) < 0.85, np.where(y, 1, -1), -np.where(y, 1, -1))], axis=1)
    posterior, _, _ = toxicity.label_model(votes, np.where(votes[:, 0] > 0, 0.6, 0.03))
    label = votes[:, 4] > 0
    assert (label != y).sum() > 60 and ((posterior > 0.5) == y).mean() > 0.97 and ((posterior > 0.5) == label).mean() < 0.92


def test_scores_are_the_classifiers(spark, documents, rows):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_toxicity(documents, labels)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(documents, model).collect()}
    weights, shared = dict(zip(model.terms, model.weights[len(toxicity.SHARED) :], strict=True)), model.weights[: len(toxicity.SHARED)]
    for r in rows:
        low = (r.text or "").lower()
        found = set(re.findall(r"\w+", low)) & set(weights)
        seeds = len(found & set(toxicity.SEEDS))
        marks = [bool(toxicity.PATTERNS[n].search(low)) and (seeds > 0 or n == "command") for n in toxicity.PATTERNS]
        z = sum(w * x for w, x in zip(shared, [1, seeds > 0, math.log1p(seeds), *marks], strict=True)) + sum(weights[w] for w in found)
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-9


# ---- personal data --------------------------------------------------------------------------------------------------


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    digits = lambda t: re.sub("[^0-9]", "", t)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= len(digits(t)) <= 19 and luhn(digits(t))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits(t)) <= 15),
    ]
    found = [(m.start(), n, m.end(), name) for n, (name, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text or "") if ok(m.group())]
    return [f"{name}:{a}:{b}" for a, _, b, name in sorted(found)]


ODD = [None, "", "a@b.c" * 300, "1.2.3.4 " * 700, "+1 (578) 555-6437, x@y.z/1.2.3.4", "4012-8888-8888-1881 4012888888881881", "…é 10.0.0.1 é a.b@c-d.org.", "1" * 5000, "+" * 3000, "a" * 20_000 + "@x.de", ("x" * 9000 + " me@here.org ") * 5]


def test_base_spans_equal_plain_patterns(spark, rows):
    texts = [r.text for r in rows] + ODD
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.op3_pii(docs).collect():
        base = plain_spans(texts[r.doc_id])
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("email", "ip", "card", "phone")] == base
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(f"{k}:") for s in base) for k in ("email", "ip", "card", "phone")]


def test_masks_replace_exactly_the_spans(spark, rows):
    texts = [r.text for r in rows] + ODD
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    masked = {r.doc_id: r.text for r in pii.mask_documents(docs).collect()}
    for r in pii.op3_pii(docs).collect():
        text, out, at = texts[r.doc_id], "", 0
        for kind, a, b in (s.split(":") for s in r.spans.split(",") if s):
            if int(a) >= at:
                out += text[at : int(a)] + f"<{kind.upper()}>"
            at = max(at, int(b))
        assert masked[r.doc_id] == (None if text is None else out + text[at:])


# ---- urls -----------------------------------------------------------------------------------------------------------


def test_url_scores_and_rules_equal_plain_ones(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    model = urls.fit_urls(spark)
    got = {r.page_id: r for r in urls.filter_urls(pages, model).collect()}
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    for page, url in pages.collect():
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        grams = {mark + s[i : i + n] for mark, s in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in (3, 4, 5) for i in range(max(1, len(s) - n + 1))}
        buckets = {xxhash.xxh64_intdigest(g.encode(), 42) % urls.BUCKETS for g in grams}
        score = 1 / (1 + math.exp(-(sum(model.weights[b] for b in buckets) / math.sqrt(len(buckets)) + model.bias)))
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        r = got[page]
        assert (r.host, r.path, r.rule) == (host, path, best and best[0] + best[1])
        assert r.verdict == (best[2] if best else "block" if score >= 0.5 else "allow") and (r.score is None if best else abs(r.score - score) < 1e-9)


def test_url_model_on_held_out_names(spark):
    """Every fifth name is kept from the fit; the model must still judge its urls."""
    names = [(n, 1) for n in urls.BLOCKED] + [(n, 0) for n in urls.ALLOWED]
    held = {n for i, (n, _) in enumerate(names) if i % 5 == 0}
    table = lambda part: [(u, y) for u, y in urls.LABELLED if (u.split("://")[1].split("/")[0].split(".")[-3] in held) == part]
    model = urls.fit_urls(spark, table(False))
    frame = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(table(True))], "page_id long, url string, y int")
    out = urls.filter_urls(frame, model, rules=[]).join(frame.select("page_id", "y"), "page_id").collect()
    assert len(out) > 30 and sum((r.verdict == "block") == (r.y == 1) for r in out) / len(out) >= 0.7


# ---- quality --------------------------------------------------------------------------------------------------------


def test_grades_and_tails_are_the_models(spark, documents, rows):
    labels = quality.grades_of(spark.read.parquet(f"{SF}/labels.parquet"))
    model = quality.fit_quality(documents, labels)
    got = {r.doc_id: r for r in quality.score_quality(documents, model).collect()}
    for r in rows:
        at, values = quality.features(r.text)
        z = sum(model.weights[i] * v for i, v in zip(at.tolist(), values.tolist(), strict=True))
        tails = [1 / (1 + math.exp(t - z)) for t in model.thresholds.tolist()]
        assert abs(got[r.doc_id].expected_grade - sum(tails)) < 1e-9 and abs(got[r.doc_id].score - tails[0]) < 1e-9
    assert list(model.thresholds) == sorted(model.thresholds)


def test_contradicting_ratings_of_equal_texts_give_one_model(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} and some more of it {i % 3}") for i in range(60)], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(60)], "doc_id long, grade int")
    first = quality.fit_quality(docs, ratings)
    for n in (1, 5):
        again = quality.fit_quality(docs.repartition(n), ratings.repartition(n))
        assert np.array_equal(first.weights, again.weights) and np.array_equal(first.thresholds, again.thresholds)


# ---- fingerprints ---------------------------------------------------------------------------------------------------


def plain_simhash(text, n=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_a_plain_majority(spark, documents, rows):
    got = {r.doc_id: r.fingerprint for r in simhash.op9_simhash(documents).collect()}
    assert all(got[r.doc_id] == f"{plain_simhash(r.text):016x}" for r in rows if len(r.text or "") < 20_000)
    assert all(simhash.simhash64(t, 5) == plain_simhash(t, 5) for t in ["", "one", "a b c d e f", "ÀÉ A\x0bb\x0cC", "x " * 3000])


# ---- audio ----------------------------------------------------------------------------------------------------------


def test_mel_energies_and_spans_equal_plain_ones():
    payload = bytes((b"some words of a text, " * 200)[:4032])
    _, frames, active, tensor, times = audio.features(audio.encode_wav(payload))
    x = [(b - 128) / 128 for b in payload]
    taps = 2 * 16
    h = [math.sin(math.pi * t / 3) / (math.pi * t / 3) * (0.54 - 0.46 * math.cos(2 * math.pi * n / (taps - 1))) for n in range(taps) for t in [n - (taps - 1) / 2]]
    h = [v / sum(h) * 2 for v in h]
    # zero-stuffed to twice the rate, filtered, every third sample kept
    y = [sum(h[k] * x[(m - k) // 2] for k in range(taps) if m - k >= 0 and (m - k) % 2 == 0 and (m - k) // 2 < len(x)) for m in range(0, 2 * len(x), 3)]
    assert frames == 1 + (len(y) - 256) // 128
    window = [0.5 - 0.5 * math.cos(2 * math.pi * n / 255) for n in range(256)]
    power = np.abs(np.fft.rfft([[y[f * 128 + n] * window[n] for n in range(256)] for f in range(frames)], axis=1)) ** 2
    mel = lambda hz: 2595 * math.log10(1 + hz / 700)
    edges = [700 * (10 ** (mel(4000) * i / 25 / 2595) - 1) for i in range(26)]
    bins = [i * 8000 / 256 for i in range(129)]
    filters = np.array([[max(0.0, min((b - edges[k]) / (edges[k + 1] - edges[k]), (edges[k + 2] - b) / (edges[k + 2] - edges[k + 1]))) for k in range(24)] for b in bins])
    energy = np.log(power @ filters + 1e-6)
    got = audio.tensor_array([tensor]).to_numpy_ndarray()[0]
    for span in range(32):
        first = min(span * frames // 32, frames - 1)
        last = max((span + 1) * frames // 32, first + 1)
        assert np.allclose(got[span], energy[first:last].mean(axis=0), atol=2e-2)
        assert np.allclose(audio.tensor_array([times]).to_numpy_ndarray()[0][span], [first * 128 / 8000, (last * 128 + 128) / 8000], atol=1e-4)
    level = 10 * np.log10(np.exp(energy).sum(axis=1))
    held, on = [], False
    for e in level - np.median(level):
        on = e >= 1.5 or on and e >= 0.5
        held.append(on)
    starts = [i for i, a in enumerate(held) if a and (i == 0 or not held[i - 1])]
    assert [round(a * 8000 / 128) for a, _ in active] == starts


def test_components_equal_plain_ones(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))]
    head = {v: v for p in pairs for v in p}
    for _ in range(400):
        for a, b in pairs:
            head[a] = head[b] = min(head[a], head[b])
    got = {r.id: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: h for v, h in head.items() if any(v in p and p[0] != p[1] for p in pairs)}


def test_held_out_rows_are_a_fifth(spark):
    out = spark.range(1000).select(common.held_out_rows("id").alias("h"), F.col("id")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in out)
