import hashlib

import pytest
from tokenizers import Tokenizer

from calibrant.llm.bpe import PairIndexBPE, decode_bpe, encode_bpe
from calibrant.llm.queries import BYTE_BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def test_ids_and_text_as_the_library_has_them(messy, library):
    out = encode_bpe(messy, BYTE_BPE, outputs=("token_ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"), keys=("doc_id", "value")).collect()
    texts = {r["value"]: r["text"] or "" for r in messy.collect()}
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(texts[r["value"]], add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False) == texts[r["value"]]
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_decode_is_the_inverse(messy):
    out = decode_bpe(encode_bpe(messy, BYTE_BPE, keys=("value",)), BYTE_BPE, keys=("value",))
    assert {r["value"]: r["decoded"] for r in out.collect()} == {r["value"]: r["text"] or "" for r in messy.collect()}


def test_small_blocks_and_a_small_memory_change_nothing(monkeypatch, library):
    from calibrant.llm import bpe

    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    monkeypatch.setattr(bpe, "LONG_PIECES", 7)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    own = PairIndexBPE(BYTE_BPE)
    for text in ("aaaa aaaaaaa aaa", "the quick brown fox " * 20, "", "<|endoftext|>" * 9 + "ab"):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_decoded_text_comes_from_the_ids(spark, library):
    """With another vocabulary for the way back, other text comes out; very long texts pass in runs."""
    own = PairIndexBPE(BYTE_BPE)
    a, b = library.token_to_id("a"), library.token_to_id("b")
    own.raw[str(a)], own.raw[str(b)] = own.raw[str(b)], own.raw[str(a)]
    assert b"".join(raw for run in own.blocks(["a b"]) for raw, _ in run).startswith(b"b ")
    long = [" " * 5_000_000, "\n" * 5_000_000, "word " * 1_000_000]
    rows = encode_bpe(spark.createDataFrame([*enumerate(long)], "doc_id bigint, text string"), BYTE_BPE, outputs=("n_tokens", "decoded_sha256")).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in rows} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in enumerate(long)}


def test_empty_table(empty):
    assert encode_bpe(empty, BYTE_BPE).count() == 0
