import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from paywarden.llm.piece_merge import PieceEncoder, decode_pieces, encode_pieces, round_trip_digests
from tests.llm.helpers import ODD_TEXTS, documents, empty

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENCODER = PieceEncoder(PATH)


@given(st.lists(st.text(alphabet=st.sampled_from(list("aabeinothrs  \n▁éß漢字𝄞\x00\t$.1")), max_size=60) | st.text(max_size=20), max_size=8))
@settings(max_examples=200, deadline=None)
def test_ids_and_texts_equal_the_library(texts):
    ids, n, decimal = ENCODER.encode(texts)
    want = LIB.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n))[: len(texts)]] == want
    assert decimal == [",".join(map(str, w)) for w in want]
    assert ENCODER.model.decode_many(ids, n) == [LIB.decode(w) for w in want]


@given(st.lists(st.lists(st.integers(0, 31_999) | st.integers(0, 300), max_size=12), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_any_ids_decode_as_in_the_library(lists):
    flat = np.array([i for x in lists for i in x], np.int64)
    assert ENCODER.model.decode_many(flat, np.array([len(x) for x in lists])) == [LIB.decode(x) for x in lists]


def test_runs_that_take_many_rounds():
    for t in ("a" * 900, "ab" * 500, "the" * 340, " " * 700, "aab" * 5000, " " * 20_000):
        ids, _, _ = ENCODER.encode([t])
        assert ids.tolist() == LIB.encode(t)


def test_cache_that_overflows(monkeypatch):
    monkeypatch.setattr(PieceEncoder, "LIMIT", 3)
    e = PieceEncoder(PATH)
    for k in range(5):
        assert e.encode([f"some words {k} again"])[0].tolist() == LIB.encode(f"some words {k} again")


def test_frames(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r[0]: tuple(r[1:]) for r in round_trip_digests(documents(spark), PATH).collect()}
    for k, t in enumerate(ODD_TEXTS):
        ids = LIB.encode(t or "")
        assert got[k] == (len(ids), sha(",".join(map(str, ids))), sha(LIB.decode(ids)))
    back = {r["doc_id"]: r["text"] for r in decode_pieces(encode_pieces(documents(spark), PATH), PATH).collect()}
    assert back == {k: LIB.decode(LIB.encode(t or "")) for k, t in enumerate(ODD_TEXTS)}
    assert round_trip_digests(empty(spark), PATH).count() == 0


def test_counter_equals_the_encoder():
    import random

    import pyarrow as pa

    from paywarden.llm.piece_merge import PieceCounter, PieceEncoder

    path = public_tokenizers.path("piece_bpe_32k.model")
    r = random.Random(1)
    bits = ["a", "the", "\n", " ", "  ", "▁", "\r", "é", ".", "\t", "\n\n", "漢"]
    texts = ["", " ", "\n"] + ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(4000)]
    want = PieceEncoder(path).encode(texts)[1].tolist()
    counter = PieceCounter(path)
    assert counter.count(texts).tolist() == want == counter.count(pa.array(texts)).tolist()
    # A model whose pieces reach across words takes whole texts as one part.
    counter.clear()
    counter.model.across = True
    assert counter.count(texts[:300]).tolist() == want[:300]
