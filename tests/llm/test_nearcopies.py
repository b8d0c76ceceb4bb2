import random

import brute
import pytest

from quillspark.llm import nearcopies
from quillspark.llm.graph import components


def check(spark, docs, k):
    sets, to = brute.near(docs, k)
    got = brute.by_id(nearcopies.link_components(brute.frame(spark, docs), shingle=k))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), to[i], to[i] == i) for i in sets}


def test_against_brute_force(spark):
    check(spark, brute.corpus(31), 4)


def test_chains_of_borderline_copies(spark):
    """A family in which most pairs are near 0.8 and the smallest id is not linked to all."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(160)]
    docs = []
    for i in range(60):
        words = list(base)
        for _ in range(rnd.randint(0, 9)):
            words[rnd.randrange(len(words))] = f"v{rnd.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    check(spark, docs, 4)


def test_blocks_of_an_entry(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", 4)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(40):
        words = list(base)
        for _ in range(rnd.randint(3, 12)):
            words[rnd.randrange(len(words))] = f"v{rnd.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    check(spark, docs, 5)


def test_blanks_link_with_nothing_and_repeated_rows_stay_one(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = brute.frame(spark, [(1, None), (2, ""), (3, " "), (7, text), (7, text), (8, text), (9, "same"), (10, "Same")])
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in nearcopies.link_components(docs).collect())
    assert got == [(1, 1, True), (2, 2, True), (3, 3, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 9, True), (10, 9, False)]
    one = nearcopies.one_of_each(docs)
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.collect()) == [1, 2, 3, 7, 9]


def test_rows_without_an_id_or_with_a_shared_one_are_kept_by_their_texts(spark):
    text = [" ".join(f"{a}{i}" for i in range(40)) for a in "abcd"]
    docs = [(None, text[0]), (None, text[1]), (5, text[1] + " more"), (6, text[2]), (6, text[3]), (6, text[3]), (9, text[2]), (None, None), (None, None), (7, ""), (None, text[0])]
    odd = "doc_id long, text string, _maybe string, rid string, `a.b` string"
    frame = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], odd)
    one = nearcopies.one_of_each(frame)
    assert one.columns == frame.columns
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in one.collect())
    # the copy with an id stays; of the two texts of 6 one is that of 9, and of two numberless copies one stays
    want = [("None", text[0]), ("5", text[1] + " more"), ("9", text[2]), ("6", text[3]), ("None", ""), ("None", ""), ("7", "")]
    assert got == sorted(want)


def test_empty_table(spark):
    assert nearcopies.link_components(brute.frame(spark, [])).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    links = [(i, i + 1) for i in range(0, 40)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)] + [(300, 300 + i) for i in range(1, 80)]
    links = [x for x in links if x[0] != x[1]]
    rnd.shuffle(links)
    want = brute.components({x for e in links for x in e}, links)
    rows = components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in rows} == want and len(rows) == len(want)
