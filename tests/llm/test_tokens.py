"""The array path of the word tokenizer against the tokenizer itself."""

import random

import numpy as np
import public_tokenizers
import pytest
from loom.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
CONTEXTS = ("{}", "a{},", "{}'s{}", ".{}1", "Zé{}'ll{}É")


@pytest.fixture(scope="module")
def cache():
    return tokens.UnitCache(PATH, most=1 << 14)


def agree(cache, texts):
    got = cache.encode(texts)
    want = cache.tok.encode_batch_fast(texts, add_special_tokens=False)
    bad = [t for t, a, b in zip(texts, got, want) if a.tolist() != b.ids]
    assert not bad, ascii(bad[:5])


@pytest.mark.parametrize("context", CONTEXTS)
def test_every_code_point(cache, context):
    points = [c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    chunks = [context.replace("{}", chr(c)) for c in points]
    for a in range(0, len(chunks), 1 << 14):
        some = chunks[a : a + (1 << 14)]
        texts = [" ".join(some[k : k + 16]) for k in range(0, len(some), 16)]
        got, want = cache.encode(texts), cache.tok.encode_batch_fast(texts, add_special_tokens=False)
        for k, (x, y) in enumerate(zip(got, want)):
            if x.tolist() != y.ids:
                agree(cache, some[16 * k : 16 * k + 16])


def test_random_mixtures(cache):
    r = random.Random(4)
    alphabet = [*"aAbBeElLrRsStTvVmMdD''''..,!09 \n\t", "'s", "'RE", "ß", "É", "×", "÷", "²", "½", "\x85", "\xa0", "\x1c", "́", "İ", "Σ", "ς", "ﬁ", "क़", "中", "🙂", "<|", "|>", "<|endoftext|>", " ", "aaaa", "\x00", "ÿ", "Þ"]
    agree(cache, ["".join(r.choices(alphabet, k=r.randrange(40))) for _ in range(20_000)])


def test_long_units_and_texts(cache, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 1000)
    r = random.Random(5)
    word = lambda n: "".join(r.choices("abcdeé", k=n))
    agree(cache, [word(255), word(5000), "x" * 4000, " ".join(word(r.randrange(1, 90)) for _ in range(900)), "", " \n ", "İ" * 3000])


def test_a_small_table_forgets_and_stays_right():
    small = tokens.UnitCache(PATH, most=50)
    r = random.Random(6)
    for _ in range(20):
        agree(small, [" ".join(str(r.randrange(3000)) + "abc"[: r.randrange(3)] for _ in range(60)) for _ in range(10)])
    assert len(small.hashes) <= 50


def test_other_tokenizers_are_used_as_they_are():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two words,  and\n more é", "", "İ,", "x" * 500]
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tokens.tokenizer(path).encode(texts)] == want


def test_table_finds_what_was_added():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(1, 1 << 62, 3000).astype(np.uint64))
    t = tokens.Table(13)
    t.add(keys[:2000], np.arange(2000, dtype=np.int32))
    t.add(keys[2000:], np.arange(2000, len(keys), dtype=np.int32))
    assert (t.find(keys) == np.arange(len(keys))).all()
    assert (t.find(keys + np.uint64(1 << 63)) == -1).all()
