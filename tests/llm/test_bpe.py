import os
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from codequarry.llm import bpe

PATH = f"{bpe.TOKENIZERS}/{bpe.RANKS}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def both():
    m = bpe.transducer(PATH)
    return m, tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=m.ranks, special_tokens={})


def test_against_the_merges(both):
    m, other = both
    rng = random.Random(8)
    texts = ["", " ", " " * 4000, "a" * 3000, "ab" * 2000, "\n" * 300, "<|endoftext|>", "=-" * 900, "🚀🧪" * 50, "don't they’re 12345 x86_64\r\n\tfoo(bar)", "日本語のテスト。", "ﬀ\u0301e\u0301", "\x00\x7f\x80"]
    texts += ["".join(rng.choices("abcdeéñ 日本\n\t123!?<>_-'’", k=rng.randint(1, 80))) for _ in range(1500)]
    for t in texts:
        assert m.encode(t) == other.encode_ordinary(t)
        assert m.decode(m.encode(t)) == t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    m = bpe.transducer(PATH)
    assert m.decode(m.encode(text)) == text


def test_small_caches_change_nothing(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    m = bpe.Transducer(both[0].ranks)
    text = "The quick brown fox jumps over 13 lazy dogs; naïve façade, 東京。" * 3
    for _ in range(3):
        assert m.encode(text) == both[1].encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=12))
def test_utf8_machine_like_the_codec(data):
    m = bpe.Utf8Machine()
    got = "".join(m.feed(bytes([b])) for b in data) + m.close()
    assert got == data.decode("utf-8", "replace") or got.replace("�", "") == data.decode("utf-8", "ignore")


def test_rows(spark):
    df = spark.createDataFrame([(1, "hello world", "k"), (1, "hello world", "k"), (2, None, None), (3, "", None), (None, "x", None)], "doc_id long, text string, key string")
    enc = bpe.encode_corpus(df)
    got = sorted(((r.doc_id, tuple(r.ids)) for r in enc.collect()), key=str)
    assert got == sorted([(1, (31373, 995)), (1, (31373, 995)), (2, ()), (3, ()), (None, (87,))], key=str)
    assert dict(enc.dtypes)["ids"] == "array<int>"
    assert sorted((r.text for r in bpe.decode_corpus(enc).collect())) == ["", "", "hello world", "hello world", "x"]
    assert bpe.encode_corpus(df.limit(0)).count() == 0
