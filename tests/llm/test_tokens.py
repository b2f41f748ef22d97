import random

import pytest

from inkwell.llm import tokens as T

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(T.read_ranks(T.tokenizer_path()))


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def samples():
    rnd = random.Random(1)
    alphabet = "abcdefghij EDth  '中国人。，はがé😀́\n\t 0123<|endoftext|>ขุนวารีकखगоеа"
    out = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 80))) for _ in range(4000)]
    return out + ["<|endoftext|>", "a" * 5000, " " * 300, "1" * 700, "ab" * 2000, "é" * 400, "中" * 3000, "endoftext", "don't can't we'll", "\r\n\r\n", "x y"]


def test_ids_equal_an_independent_encoder(encoder, reference):
    texts = samples()
    assert [encoder.encode(t) for t in texts] == reference(texts)


def test_transducer_equals_the_merges_by_definition(encoder):
    rnd = random.Random(2)
    t = encoder.transducer
    words = [bytes(rnd.choice(b"abenorstd\xe4\xb8\xad\xe5\x9b\xbd") for _ in range(rnd.randrange(1, 18))) for _ in range(3000)]
    for w in words:
        assert t.encode_word(w) == [t.ranks[p] for p in t._merge(w)], w


def test_table_that_overflows_is_started_afresh(encoder):
    small = T.PairTransducer(encoder.transducer.ranks, most_states=40)
    for w in (b"endoftextendoftext", "中国人民大学的图书馆".encode(), b"zxqjkwvbnm"):
        assert small.encode_word(w) == [small.ranks[p] for p in small._merge(w)]


def test_round_trip_and_decoding_over_token_borders(encoder):
    for t in samples():
        assert encoder.decode(encoder.encode(t)) == t
    ids = encoder.encode("𠮷")
    assert len(ids) > 1 and encoder.decode(ids[:-1]) != "𠮷"


def test_word_memory_is_bounded(encoder):
    e = T.Encoder(T.read_ranks(T.tokenizer_path()), most_words=10)
    texts = samples()[:200]
    assert [e.encode(t) for t in texts] == [encoder.encode(t) for t in texts] and len(e._words) <= 10


def test_null_and_empty(encoder):
    assert encoder.encode(None) == [] and encoder.encode("") == []


def test_frames(spark, encoder):
    rows = [(1, "Hello 中国", 9), (2, None, 9), (3, "", 9), (1, "Hello 中国", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in T.token_ids(df, "doc_id", "text").collect())
    want = encoder.encode("Hello 中国")
    assert got == [(1, want), (1, want), (2, []), (3, [])]
    back = {r.doc_id: r.text for r in T.decoded(T.token_ids(df, "doc_id", "text"), "doc_id").collect()}
    assert back == {1: "Hello 中国", 2: "", 3: ""}
    assert sorted((r.doc_id, r.n_tokens) for r in T.token_counts(df, ["doc_id"], "text").collect()) == [(1, len(want)), (1, len(want)), (2, 0), (3, 0)]


def test_empty_table(spark):
    assert T.token_ids(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0
