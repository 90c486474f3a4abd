"""Every operator over null, empty, very long and repeated rows, empty tables, and extra columns with clashing names."""

import hashlib
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sievework.llm import audio, graph, mixing, packing, pii, quality, sharding, simhash, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size string, key int, id string, v double, k string, t string, y string, s string, spans string, shard string, node string, draw string, tie string, score string, count long"
LONG = "word " * 60_000 + "idiot"
RUN = "a" * 300_000
TEXTS = [None, "", "   \n\t", "one", "Two words", "The same text with a mail a.b@c.example.com in it", "the SAME text with a mail A.B@C.example.com in it", LONG, RUN, "1" * 100_000, "😀 é 漢字 \u0301x +1 (578) 555-6437", "you are a stupid idiot and a moron, worthless scum", "1.2.3.4.5.6.7.8x4012-8888-8888-1881", "null source"]


def rows():
    out = [(i, t, "en", None if t == "null source" else f"s{i % 3}", len(t or ""), *[None] * 16) for i, t in enumerate(TEXTS)]
    return [*out, out[3], out[3], (None, "null key", None, None, None, *[None] * 16)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(11, 1, 1), (11, 1, 0), (5, 1, 0), (0, 0, 0), (7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


N = len(TEXTS) + 3


def test_sharding(spark, docs):
    out = sharding.op1_sharding(docs).collect()
    assert len(out) == N
    for r in out:
        text = dict(enumerate(TEXTS)).get(r.doc_id, "null key")
        body = (text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 1, zlib.crc32(body), "bytes")
        assert 0 <= r.shard < 16
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.op1_sharding(empty(spark)).count() == 0
    assert sharding.kd_shards(docs, target_bytes=100_000).agg(F.max("shard")).first()[0] >= 6


def test_sharding_balances_ties(spark):
    same = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 99).alias("text"), F.lit("en").alias("lang"), F.lit("one").alias("source"))
    sizes = [r.b for r in sharding.op1_sharding(same).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 600


def test_toxicity(spark, docs, labels):
    out = toxicity.op2_toxicity(docs, labels).collect()
    assert len(out) == N and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    by = {r.doc_id: r for r in out}
    assert by[11].predicted == 1 and by[7].predicted == 1 and by[5].predicted == 0 and by[0].score == by[1].score
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert toxicity.op2_toxicity(empty(spark), labels).count() == 0
    kept = toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, labels.limit(0)))
    assert kept.columns == docs.columns and kept.where("doc_id in (7, 11)").count() == 0 and kept.count() == N - 2


def test_sound_documents_are_written_off_few_rows_at_once(spark, docs, labels, capsys):
    """What is read later holds no worker that gets batches of ten thousand whole documents."""
    kept = toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, labels))
    kept.explain()
    assert "MapInArrow" not in capsys.readouterr().out
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {*range(len(TEXTS)), None} - {7, 11}


def test_pii(spark, docs):
    out = {r.doc_id: r for r in pii.op3_pii(docs).collect()}
    assert out[0].spans == "" and out[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[5].spans == "email:26:43" and out[10].spans == "phone:10:27"
    assert out[12].spans == "ip:0:7,ip:8:15,card:16:35"
    assert pii.op3_pii(empty(spark)).count() == 0
    masked = {r.doc_id: r for r in pii.mask_documents(docs).collect()}
    assert masked[5].text == "The same text with a mail <EMAIL> in it" and masked[12].text == "<IP>.<IP>x<CARD>" and masked[0].text is None and masked[7].text == LONG
    assert pii.mask_documents(docs).columns == docs.columns


def test_audio(spark, docs):
    out = audio.audio_columns(docs).collect()
    assert len(out) == N
    for r in out:
        text = dict(enumerate(TEXTS)).get(r.doc_id, "null key")
        body = (text or "").encode()
        payload = body + b"\xff" * (-len(body) % 576 if body else 576)
        assert audio.decode_wav(bytes(r.media)) == (audio.STORED_RATE, payload)
        assert (r.payload_sha256, r.payload_bytes, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), len(payload), zlib.crc32(payload[-32:]))
    tensors, times = (audio.tensor_array([bytes(r[c]) for r in out]) for c in ("tensor", "times"))
    assert tensors.type.shape == [audio.SPANS, audio.BANDS] and times.type.shape == [audio.SPANS, 2] and tensors.type.dim_names == ["span", "band"] and len(tensors) == N
    spans = times.to_numpy_ndarray()
    assert (spans[:, :, 1] > spans[:, :, 0]).all() and (spans[:, 0, 0] == 0).all() and (spans[:, 1:, 0] >= spans[:, :-1, 0]).all()
    assert len({r.feature for r in audio.op4_audio(docs.where("doc_id = 3")).collect()}) == 1
    assert audio.op4_audio(empty(spark)).count() == 0


def test_mixing(spark, docs):
    out = mixing.op5_mixing(docs).collect()
    assert len(out) == N and all(r.taken % r.size == 0 and r.taken <= 3 * r.size for r in out if r.size)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.op5_mixing(docs).collect()), key=str)
    assert mixing.op5_mixing(empty(spark)).count() == 0
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    taken = {(r.doc_id, r.size): r.taken for r in out}
    assert {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}[8] == taken[8, 1]


def test_urls(spark):
    table = [None, "", "no scheme", "https://EXAMPLE.com/en/x?y#z", "http://www.example.com/en/1", "ftp://a.net/es/q", "x://h?en", "http://a://b/c", "https://" + "a" * 5000 + ".org/" + "b" * 50_000]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(table)], "page_id long, url string, host string, score int")
    out = {r.page_id: r for r in urls.op6_urls(pages).collect()}
    assert [(out[i].host, out[i].path, out[i].rule) for i in range(8)] == [("", "", None)] * 3 + [("example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/1", "www.example.com/en/"), ("a.net", "/es/q", "net/es/"), ("h", "", None), ("a:", "//b/c", None)]
    assert out[3].verdict == "block" and out[4].verdict == "allow" and out[0].verdict == "allow" and len(out) == len(table)
    assert urls.op6_urls(pages.limit(0)).count() == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    out = packing.pack_documents(docs, path, with_ids=True).collect()
    for i, text in enumerate(TEXTS):
        want = [*coder.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: (r.start, r.sequence_id, r.offset))
        copies = 3 if i == 3 else 1
        assert sum(r.length for r in mine) == copies * len(want) and all(r.doc_tokens == len(want) for r in mine)
        data = b"".join(x.to_bytes(4, "little") for x in want)
        assert all(bytes(r.ids) == data[4 * r.start : 4 * (r.start + r.length)] and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in mine)
    for s in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.LENGTH
    assert packing.op7_packing(empty(spark)).count() == 0


def test_quality(spark, docs, labels):
    out = quality.op8_quality(docs, labels).collect()
    assert len(out) == N and all(0 <= r.score <= 1 and 0 <= r.expected_grade <= 2 for r in out)
    assert quality.op8_quality(docs, labels.limit(0)).count() == N
    assert quality.op8_quality(empty(spark), labels).count() == 0


def test_simhash(spark, docs):
    out = {r.doc_id: r for r in simhash.op9_simhash(docs).collect()}
    assert out[0].fingerprint == out[1].fingerprint == out[2].fingerprint == "0" * 16 and {out[i].component_id for i in range(3)} == {0}
    assert out[6].component_id == 5 and all(out[i].fingerprint == f"{simhash.simhash64(TEXTS[i]):016x}" for i in out if i is not None)
    assert simhash.op9_simhash(empty(spark)).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 3").count() == 1 and kept.where("doc_id in (1, 2, 6)").count() == 0 and kept.where("doc_id in (0, 5, 7)").count() == 3


def test_graph(spark):
    nan, inf = float("nan"), float("inf")
    base = [1.0, 0.2, 0.0]
    table = [(0, None), (1, []), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 0.0]), (4, [nan, 1.0, 0.0]), (5, [inf, 1.0, 0.0]), (6, base), (7, base), (8, [2.0, 0.4, 0.0]), (9, [1.0, 0.25, 0.02]), (10, [-1.0, 0.0, 0.0]), (11, [1.0, 0.2])]
    vectors = spark.createDataFrame([(i, v, "x", 1) for i, v in table], "vec_id long, embedding array<double>, id string, n int")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in graph.op10_graph(vectors).collect()}
    assert {i: out[i] for i in (0, 1, 2, 3, 4, 5, 10, 11)} == {i: (0, i, True) for i in (0, 1, 2, 3, 4, 5, 10, 11)}
    assert out[6] == (3, 6, True) and out[7] == out[8] == out[9] == (3, 6, False)
    assert graph.op10_graph(vectors.limit(0)).count() == 0
