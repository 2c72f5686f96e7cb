import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.vocabulary())


@pytest.fixture(scope="module")
def plain(enc):
    return tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=enc.words.transducer.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_as_the_merges(enc, plain, s):
    assert enc.encode(s) == plain.encode_ordinary(s)
    assert enc.decode(enc.encode(s)) == s
    assert enc.size(s) == len(enc.encode(s))


def test_odd_bytes_and_long_words(enc, plain):
    rng = random.Random(1)
    for _ in range(3000):
        w = bytes(rng.choice(b"aaabbe  ntho\xc3\xa9\xe2\x80\x99=-_1") for _ in range(rng.randint(1, 40)))
        assert list(enc.words.transducer.encode(w)) == plain._core_bpe.encode_single_piece(w)
    text = "<|endoftext|> " + "a" * 5000 + " " * 300 + "=" * 900 + "\n\n\n x"
    assert enc.encode(text) == plain.encode_ordinary(text)


def test_forgetting_states_changes_nothing(enc, plain, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 50)
    monkeypatch.setattr(bpe, "WORDS", 5)
    fresh = bpe.Encoder(bpe.vocabulary())
    text = "The steamer left the harbour; Grüße aus Köln, 1903. " * 20
    assert fresh.encode(text) == plain.encode_ordinary(text)


def test_small_vocabulary_with_ties():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257, b"ab": 258}
    t = bpe.Transducer(ranks)
    for n in range(1, 12):
        w = b"a" * n + b"b"
        parts = [bytes([c]) for c in w]
        while True:
            best = min(((ranks.get(parts[i] + parts[i + 1], 10**9), i) for i in range(len(parts) - 1)), default=(10**9, 0))
            if best[0] == 10**9:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert list(t.encode(w)) == [ranks[p] for p in parts]


def test_decoding_keeps_characters_across_pieces(enc):
    text = "é€😀" * 3000
    assert enc.decode(enc.encode(text), chunk=7) == text
    assert enc.decode([enc.words.transducer.ranks[b"\xc3"]]) == "�"


def test_encode_frame(spark, enc):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Hello, world", 0), (3, "Hello, world", 0)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode(df).collect())
    assert got == [(1, []), (2, []), (3, enc.encode("Hello, world")), (3, enc.encode("Hello, world"))]
    assert sorted((r.doc_id, r.n_tokens) for r in bpe.sizes(df).collect())[:2] == [(1, 0), (2, 0)]
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()} == {1: "", 2: "", 3: "Hello, world"}
    assert bpe.encode(df.limit(0)).count() == 0


def test_vocabulary_must_have_all_bytes(tmp_path):
    p = tmp_path / "v.tiktoken"
    p.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        bpe.Encoder(str(p))
