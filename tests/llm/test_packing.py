"""Ids of the packing operator against the tokenizer itself, and the bounds of its cache."""

import json

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievework.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]


def test_ids_equal_the_tokenizer(texts):
    want = whole(PATH)
    odd = [None, "", " \t\n\r ", "İstanbul Ä ö ŉ's 'S it's --'s", "a'llb 'LL ''s", "½ ² x²y ſt µ ª º", "é ́x é", "\x85 \xa0 q \x1c r \x0b s", "<|endoftext|> </w> a</w>", "漢字 😀 مرحبا", "x" * 70_000, "1" * 5000, "tab\tnew\r\nline " * 200_000]
    for some in (texts, odd, texts[:50] + odd + texts[50:90]):
        assert list(packing.WordCoder(PATH).encode(some)) == [want(t) for t in some]


def test_cache_is_bounded_in_bytes(texts):
    coder = packing.WordCoder(PATH, cache_bytes=200_000)
    want = whole(PATH)
    long = [chr(97 + i % 26) * 20_000 + str(i) for i in range(50)]
    assert list(coder.encode(texts[:300] + long + texts[:300])) == [want(t) for t in texts[:300] + long + texts[:300]]
    assert coder.held() <= 200_000 and max(map(len, coder.words.to_pylist())) <= packing.CACHE_CHARS and len(coder.words) > 100
    coder = packing.WordCoder(PATH, cache_bytes=1 << 30)
    assert list(coder.encode(texts[:300] + long + texts[:300])) == [want(t) for t in texts[:300] + long + texts[:300]] and len(set(coder.words.to_pylist())) == len(coder.words)


def test_other_tokenizers_take_whole_texts(tmp_path):
    told = json.load(open(PATH))
    told["normalizer"]["normalizers"].pop()  # no lower case
    path = str(tmp_path / "cased.json")
    json.dump(told, open(path, "w"))
    some = ["Mixed Case it's", "ÄÖ x"]
    for own in (path, public_tokenizers.path("byte_bpe_50k.json")):
        coder = packing.WordCoder(own)
        assert not coder.by_word and list(coder.encode(some)) == [whole(own)(t) for t in some]
