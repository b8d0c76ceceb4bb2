import random

import brute
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from quillspark.llm import tokens  # noqa: E402


def test_counts_equal_the_library(spark):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = tokens.PairCounter(public_tokenizers.path("byte_bpe_50k.json")).count
    rnd = random.Random(1)
    letters = "ab cde'streLL  \n\t 　\x1c\x85\x0b12½٣.,!<|endoftext|>éñ日本😀́​ thing of"
    for _ in range(4000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        if rnd.random() < 0.1:
            text = text[:5] + "<|endoftext|>" + text[5:]
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), text
    docs = brute.corpus(61) + [(999, "z" * 20_000)]
    got = brute.by_id(tokens.count_tokens(brute.frame(spark, docs)))
    for i, text in docs:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 1024)


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 5)
    one = tokens.PairCounter(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(tokens, "CACHE_UNITS", 10**6)
    two = tokens.PairCounter(public_tokenizers.path("byte_bpe_50k.json"))
    for _, text in brute.corpus(62, 20):
        assert one.count(text) == two.count(text)


def test_empty_table(spark):
    assert tokens.count_tokens(brute.frame(spark, [])).collect() == []
