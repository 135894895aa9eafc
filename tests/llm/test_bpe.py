import base64
import hashlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from riskspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.Ranks(PATH)
KNOWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS.ids, special_tokens={})
TEXTS = ["", " ", "  \n\t x ", "don't I'LL we've 12345 ½ ²", "日本語🙂🙂", "\x00\x01", "a" * 3000, "é" * 700, "<|endoftext|>", "x\r\n\r\n y", " nbsp　wide", "word " * 20_000]


def test_batches_equal_the_library():
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    assert [x.tolist() for x in encoder.encode(TEXTS)] == [KNOWN.encode_ordinary(t) for t in TEXTS]
    assert encoder.encode([]) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_texts_equal_the_library(texts):
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    assert [x.tolist() for x in encoder.encode(texts)] == [KNOWN.encode_ordinary(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdehilnorst", min_size=1, max_size=80))
def test_long_words_fold_alike(word):
    assert RANKS._fold_long(word.encode()).tolist() == KNOWN.encode_ordinary(word)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 2)
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for t in TEXTS:
        assert encoder.encode([t])[0].tolist() == KNOWN.encode_ordinary(t)


def test_round_trip(spark, docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (1, " "), (1, " "), (None, "null id")]
    frame = docs(rows, ids="clash", decoded="clash")
    got = bpe.decode(bpe.encode(frame, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == sorted((str(d), KNOWN.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows)
    assert bpe.encode(docs([]), PATH, public_tokenizers.PATTERN).collect() == []


def test_higher_order_fold_of_distinct_words(spark):
    words = ["hello", " world", "thandor", "é", " unhappiness", "x"]
    got = bpe.fold_words(spark.createDataFrame([(w,) for w in words], "word string"), PATH).collect()
    assert {r.word: r.ids for r in got} == {w: KNOWN.encode_ordinary(w) for w in words}


def test_rank_file_is_read_whole():
    with open(PATH, "rb") as lines:
        assert len(RANKS.ids) == sum(1 for _ in lines)
    assert RANKS.ids[base64.b64decode(base64.b64encode(b"a"))] == KNOWN.encode_ordinary("a")[0]
    assert hashlib.sha256(b"".join(RANKS.pieces)).hexdigest()
