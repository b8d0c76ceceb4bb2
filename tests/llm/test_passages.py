import random

import brute
import pytest

from quillspark.llm import passages
from quillspark.llm._words import STEP_BYTES


def expected(docs, window=50):
    first, out = {}, {}
    for i, text in sorted(docs):
        w = brute.WORD.findall(text or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if first.get(tuple(w[k : k + window]), i) < i:
                gone |= set(range(k, k + window))
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
        out[i] = (len(w), len(gone), brute.sha(" ".join(x for k, x in enumerate(w) if k not in gone).encode()))
    return out


def told(df):
    return {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in brute.by_id(df).items()}


def test_against_brute_force(spark):
    for seed in (21, 22):
        docs = brute.corpus(seed)
        assert told(passages.removals(brute.frame(spark, docs))) == expected(docs)


@pytest.mark.parametrize("share", [2000, 1])
def test_divided_anchors(spark, share):
    """With 2000 words a share frequent anchors are divided; with 1 all are, down to single windows."""
    docs = brute.corpus(21)
    docs += [(1000 + k, docs[0][1]) for k in range(40)]
    assert told(passages.removals(brute.frame(spark, docs), share=share)) == expected(docs)


def test_a_text_beyond_a_step(spark):
    rnd = random.Random(6)
    words = [f"w{rnd.randrange(10**7)}" for _ in range(STEP_BYTES // 5)]
    docs = [(1, " ".join(words)), (2, "new " + "\n".join(words[-80:])), (3, " ".join(words[1000:1049])), (4, " ".join(words))]
    assert {i: n[1] for i, n in told(passages.removals(brute.frame(spark, docs))).items()} == {1: 0, 2: 80, 3: 0, 4: len(words)}


def test_short_windows(spark):
    docs = brute.corpus(23)
    assert told(passages.removals(brute.frame(spark, docs), gram=4, window=10)) == expected(docs, 10)


def test_empty_null_and_shared_ids(spark):
    assert passages.removals(brute.frame(spark, [])).collect() == []
    text = " ".join(f"w{i}" for i in range(60))
    rows = passages.removals(spark.createDataFrame([(None, text), (4, text), (4, text), (9, text + " more")], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in rows) == [("4", 0), ("4", 0), ("9", 60), ("None", 0)]
