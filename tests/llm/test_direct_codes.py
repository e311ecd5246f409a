import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paywarden.llm.common import shared_folder
from paywarden.llm.direct_codes import Codes, WordCache, encode_codes, encoded_documents, token_at, token_digests, write_token_codes
from tests.llm.helpers import ODD_TEXTS, documents, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 600), max_size=1500))
@settings(max_examples=40, deadline=None)
def test_codes_round_trip_and_give_any_id(ids):
    codes = Codes(encode_codes(np.array(ids, np.uint32)))
    assert codes.ids().tolist() == ids
    assert [codes[i] for i in range(len(ids))] == ids
    with pytest.raises(IndexError):
        codes[len(ids)]


@given(st.lists(st.text(alphabet=st.sampled_from(list("aAbBéÉßİΣσς'.,!&| \n\t\x01\x1c\xa0́漢1")), max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_word_cache_equals_the_library(texts):
    tok = Tokenizer.from_file(PATH)
    cache = test_word_cache_equals_the_library.__dict__.setdefault("cache", WordCache(PATH))
    ids, n = cache.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n))[: len(texts)]] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_cache_that_overflows(monkeypatch):
    monkeypatch.setattr(WordCache, "LIMIT", 20)
    cache, tok = WordCache(PATH), Tokenizer.from_file(PATH)
    for k in range(30):
        text = f"the common words the the the {'abcdefgh'[k % 8]}{'xyz'[k % 3]}{'mn' * k} <|endoftext|> it's"
        ids, n = cache.encode([text])
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids)]


def brute(texts):
    tok, start, out = Tokenizer.from_file(PATH), 0, {}
    for k, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        out[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_documents_in_id_order(spark):
    docs = documents(spark).repartition(3)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in encoded_documents(docs, PATH).collect()}
    assert got == brute(ODD_TEXTS)


def test_small_segments_and_single_ids(spark):
    folder = shared_folder(spark)
    write_token_codes(documents(spark), PATH, 1, folder, segment_tokens=16)
    rows = sorted(token_digests(spark, folder).collect())
    assert rows == sorted((k, *v) for k, v in brute(ODD_TEXTS).items())
    tok = Tokenizer.from_file(PATH)
    flat = [i for t in ODD_TEXTS for i in [*tok.encode(t or "", add_special_tokens=False).ids, 1]]
    for at in (0, 1, len(flat) // 2, len(flat) - 1):
        assert token_at(spark, folder, at) == flat[at]


def test_empty_table(spark):
    assert encoded_documents(empty(spark), PATH).count() == 0
