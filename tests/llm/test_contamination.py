import re

import brute

from quillspark.llm import contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(brute.fold(t or ""))


def expected(docs, items):
    wins = []
    for item, text in items:
        w = words(text)
        k = min(8, len(w))
        wins += [(item, tuple(w[i : i + k])) for i in range(len(w) - k + 1)] if w and item is not None else []
    out = {}
    for i, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for item, g in wins:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    ids.add(str(item))
        out[i] = (len(w), len(hit), len(ids), brute.sha(",".join(sorted(ids)).encode()), len(ids) >= 2)
    return out


def fixture():
    docs = brute.corpus(41, 30)
    text = [t for _, t in docs if t and len(t) > 300]
    items = [(1, text[0][40:260]), (2, text[1][10:200]), (10, text[0][100:330]), (3, "one"), (4, "One, two!"), (5, ""), (6, None), (None, text[2]), (7, "three words never-seen"), (1, text[3][:90]), (8, "日本語 😀")]
    docs += [(900, re.sub("[a-z]", lambda m: m[0].upper(), text[0][40:260])), (901, "so one--two; " + text[1][10:200].replace(" ", "_-")), (902, "one one one")]
    return docs, items


def check(spark, **how):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = brute.by_id(contamination.contamination(brute.frame(spark, docs), bench)) if not how else how["run"](brute.frame(spark, docs), bench)
    assert {i: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for i, r in got.items()} == expected(docs, items)


def test_against_brute_force(spark):
    check(spark)


def test_patterns_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(contamination.annotate, "__defaults__", (contamination.WINDOW, 150))
    check(spark)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.contamination(brute.frame(spark, []), none).collect() == []
    rows = contamination.contamination(brute.frame(spark, [(1, "a b"), (2, None)]), none).collect()
    assert sorted((r["n_words"], r["n_hit"], r["n_items"]) for r in rows) == [(0, 0, 0), (2, 0, 0)]


def test_clean_of_drops_a_window_of_one_item(spark):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = brute.frame(spark, docs)
    kept = contamination.clean_of(frame, bench)
    assert kept.columns == frame.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 900 not in ids and 902 in ids
