import random
from collections import Counter

import brute
import numpy as np
import pytest

from pyspark.sql import functions as F

from quillspark.llm import _blocks, suffixes
from quillspark.llm._words import STEP_BYTES


def expected(docs, length):
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = {}
    for (i, _), b in zip(docs, raw):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        out[i] = (len(b), int(gone.sum()), int((gone[1:] > gone[:-1]).sum() + gone[0]), brute.sha(bytes(x for x, y in zip(b, gone) if not y)))
    return out


def told(df):
    return {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in brute.by_id(df).items()}


def test_suffix_array_sorts_suffixes():
    rnd = random.Random(3)
    for _ in range(600):
        text = np.array([rnd.randint(0, rnd.choice([1, 2, 200])) for _ in range(rnd.randint(0, 50))], np.int64)
        assert list(suffixes.suffix_array(text)) == sorted(range(len(text)), key=lambda i: tuple(text[i:]))


def test_suffix_array_of_large_symbols_and_long_repeats():
    text = np.concatenate([np.full(400, 1 << 22), np.arange(300) << 14, np.full(400, 1 << 22)]).astype(np.int64)
    assert list(suffixes.suffix_array(text)) == sorted(range(len(text)), key=lambda i: tuple(text[i:]))


def test_repeated_places_do_not_cross_strings():
    rnd = random.Random(4)
    for _ in range(200):
        length = rnd.choice([3, 8, 9, 17])
        parts = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(1, 5))]
        seen = Counter(x[i : i + length] for x in parts for i in range(len(x) - length + 1))
        assert [list(p) for p in suffixes.repeated_places(parts, length)] == [[i for i in range(len(x) - length + 1) if seen[x[i : i + length]] > 1] for x in parts]


@pytest.mark.parametrize("share", [suffixes.SHARE_BYTES, 1500, 1])
def test_against_brute_force(spark, share):
    """With 1500 bytes a share frequent grams are divided; with 1 all are, down to single windows."""
    docs = brute.corpus(11)
    docs += [(1000 + k, docs[0][1]) for k in range(40)]
    assert told(suffixes.repeats(brute.frame(spark, docs), 100, 40, share)) == expected(docs, 100)


def test_a_text_beyond_a_step(spark):
    """A text longer than the scan's steps is one document, and meets others in any place of it."""
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(STEP_BYTES + 200_000))
    docs = [(1, long), (2, long[:900] + "x"), (3, "y" + long[-700:]), (4, long[STEP_BYTES - 300 : STEP_BYTES + 300]), (5, long[50:449])]
    got = told(suffixes.repeats(brute.frame(spark, docs)))
    assert [got[i][1:3] for i in (1, 2, 3, 4, 5)] == [(900 + 700 + 600, 3), (900, 1), (700, 1), (600, 1), (0, 0)]


def test_a_filter_misses_no_key(spark):
    keys = spark.range(0, 3000, 3).select(F.col("id").alias("k"))
    told_ = _blocks.perhaps(spark.range(3000).select(F.col("id").alias("k")), "k", _blocks.bits_of(keys, "k"))
    rows = {r["k"]: r["_maybe"] for r in told_.collect()}
    assert len(rows) == 3000 and all(rows[k] for k in range(0, 3000, 3)) and sum(rows.values()) < 1100
    assert _blocks.within(spark.range(3000).select(F.col("id").alias("k")), keys, "k").count() == 1000


def test_contract_length(spark):
    docs = brute.corpus(12)
    assert told(suffixes.repeats(brute.frame(spark, docs))) == expected(docs, 400)


def test_empty_null_ids_and_shared_ids(spark):
    assert suffixes.repeats(brute.frame(spark, [])).collect() == []
    text = "y" * 50 + "z" * 500
    rows = suffixes.repeats(spark.createDataFrame([(None, text), (1, text), (1, "q" * 399)], "doc_id long, text string")).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in rows) == [(399, 0, 0), (550, 550, 1), (550, 550, 1)]


def test_passages_are_judged_by_bytes_not_by_words(spark):
    """A passage of 60 words stays with 399 bytes; with 400 it goes from every text, the first included."""
    rnd = random.Random(6)
    passage = lambda size: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5 + (k < size - 359))) for k in range(60))
    short, long = passage(399), passage(400)
    assert (len(short), len(long), len(short.split()), len(long.split())) == (399, 400, 60, 60)
    docs = [(1, f"1{short}1"), (2, f"2{short}2"), (3, f"3{long}3"), (4, f"4{long}4")]
    got = told(suffixes.repeats(brute.frame(spark, docs)))
    assert got == expected(docs, 400)
    assert [got[i][1:3] for i in (1, 2, 3, 4)] == [(0, 0), (0, 0), (400, 1), (400, 1)]
