import re
from collections import Counter

import brute
import numpy as np

from quillspark.llm import lines


def expected(text):
    text = text or ""
    w = brute.WORD.findall(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    earlier, dups = set(), 0
    for line in text.split("\n"):
        if brute.WORD.search(line):
            dups += line in earlier
            earlier.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(again)


def test_counts_and_base_rules(spark):
    docs = brute.corpus(51) + [(500 + i, t) for i, t in enumerate(["a\na\n", "a\r\na\r\n", "x y z w v x y z w v", " \n é", "\n\n", "### | <>\n### | <>\n", "a b c d e\x0ba b c d e\n\n"])]
    got = brute.by_id(lines.judge(brute.frame(spark, docs).select("doc_id", "text"), lines.LineField()))
    for i, text in docs:
        n, chars, symbols, dups, again = expected(text)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dups, again)
        assert r["base_failed"] == (n < 10 or 100 * again > 20 * n)
        assert r["kept"] == (not r["base_failed"] and 2 * r["content_words"] >= n)


def test_viterbi_finds_the_best_path():
    rnd = np.random.default_rng(2)
    model = lines.LineField(rnd.normal(size=len(lines.FEATURES)), rnd.normal(size=(2, 2)))
    for _ in range(100):
        n = int(rnd.integers(1, 9))
        x = rnd.normal(size=(n, len(lines.FEATURES)))
        gain = x @ model.emission

        def value(path, gain=gain):
            return sum(g for g, y in zip(gain, path) if y) + sum(model.transition[a][b] for a, b in zip(path, path[1:]))

        best = max(([k >> i & 1 for i in range(n)] for k in range(2**n)), key=value)
        assert model.decode(x, np.zeros(n, int)).tolist() == [bool(y) for y in best]


def test_held_out_accuracy(spark):
    """Fitted on one half of the labelled documents, most of the other half is told apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = lines.fit_field(docs, labels.where("doc_id % 2 = 0"))
    rows = lines.judge(docs.select("doc_id", "text"), model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in rows)
    assert len(rows) > 100 and right >= 0.95 * len(rows)


def test_no_labels_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = brute.frame(spark, [(1, "The first line has some ordinary words in it.\nAnd so has the second line of this text."), (2, None)])
    model = lines.fit_field(docs, none)
    kept = lines.keep_content(docs, model)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1]
    assert lines.keep_content(brute.frame(spark, []), model).collect() == []
