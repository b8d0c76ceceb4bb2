"""Steps that must stay bounded as tables grow: what passes the driver, what a worker holds, what is shuffled."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import graphs
from quillspark.session import attach

EDGES = [(0, 1, 2, 3.0), (1, 2, 3, 4.0), (2, 1, 3, 10.0), (3, 5, 6, 1.0), (4, 3, 4, 1.0), (5, 6, 4, 2.0), (6, 4, 7, 1.0)]


@pytest.fixture(autouse=True)
def attached(spark):
    attach(spark)


@pytest.fixture
def plans(monkeypatch):
    """The plans of all that is checkpointed; no front is short enough to be broadcast."""
    seen, keep = [], graphs.checkpointed
    monkeypatch.setattr(graphs, "checkpointed", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    monkeypatch.setattr(graphs, "NARROW", 0, raising=False)
    return seen


@pytest.fixture
def edges(spark, tmp_path):
    # a file's size is known, so that an edge table of a few MB would be broadcast
    spark.createDataFrame(EDGES, "edge_id int, src long, dst long, weight double").write.parquet(f"{tmp_path}/edges")
    return spark.read.parquet(f"{tmp_path}/edges")


def pairs(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("longest, want", [(True, {(1, 0.0), (2, 3.0), (3, 10.0), (4, 11.0), (7, 12.0)}), (False, {(1, 0.0), (2, 3.0), (3, 7.0), (4, 8.0), (7, 9.0)})])
def test_paths_broadcast_no_edges(plans, edges, longest, want):
    assert pairs(graphs.Digraph(edges).paths(1, longest).select("vertex", "distance")) == want
    assert len(plans) > 4 and not any("BroadcastExchange" in p for p in plans)


def test_short_fronts_go_to_the_edges(edges, monkeypatch):
    seen, keep = [], graphs._sent
    monkeypatch.setattr(graphs, "_sent", lambda f: seen.append(keep(f)[1]) or keep(f))
    assert pairs(graphs.Digraph(edges).paths(1).select("vertex", "distance")) == {(1, 0.0), (2, 3.0), (3, 7.0), (4, 8.0), (7, 9.0)}
    assert seen[0] == 1 and seen[-1] == 0


def test_levels_and_order_broadcast_no_vertices(plans, edges, monkeypatch):
    want = [(1, 0), (5, 0), (2, 1), (6, 1), (3, 2), (4, 3), (7, 4)]
    g = graphs.Digraph(edges)
    assert [(r["vertex"], r["level"]) for r in g.topological().orderBy("place").collect()] == want
    assert not any("BroadcastExchange" in p for p in plans)
    # by ranges, with the starts of ranges broadcast alone
    monkeypatch.setattr(graphs, "ONE_TASK", 0)
    assert [(r["vertex"], r["level"], r["place"]) for r in g.topological().orderBy("place").collect()] == [(*w, i) for i, w in enumerate(want)]


def test_closure_broadcasts_no_edges(plans, spark, edges):
    got = graphs.closure(edges, spark.createDataFrame([(1,), (5,)], "node long"))
    assert pairs(got) == {(1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 7, 3), (5, 6, 1), (5, 4, 2), (5, 7, 3)}
    assert not any("BroadcastExchange" in p for p in plans)


@pytest.fixture
def body(monkeypatch):
    """The function that a worker runs on a batch, and the peak of its Python objects in MB."""
    import tracemalloc

    import pandas as pd
    import pyarrow as pa

    from quillspark.functions import words

    kept = {}

    class Fake:
        pandas_udf = staticmethod(lambda f, kind: lambda *c: kept.update(run=lambda x: list(f(x)), batch=lambda v: pd.Series(v, dtype=object)))
        arrow_udf = staticmethod(lambda f, kind: lambda *c: kept.update(run=f, batch=pa.array))

    monkeypatch.setattr(words, "F", Fake)

    def measured(make, values):
        make(None)
        values = kept["batch"](values)
        tracemalloc.start()
        out = kept["run"](values)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return out if isinstance(out, list) else out.to_pylist(), peak

    return measured


def test_segments_of_many_texts_are_no_objects_at_once(body):
    from quillspark.functions import text

    batch = [f"{k} " + "ab cd. " * 5000 for k in range(100)]
    out, peak = body(text.segment_tokens, batch)
    assert len(out) == 100 and len(out[0]) == 25002
    assert peak < 60


def test_plain_texts_are_not_kept(body):
    from quillspark.functions import text

    batch = [f"{k} " + "né à " * 20000 for k in range(300)]
    out, peak = body(text.remove_diacritics, batch)
    assert out[1] == "1 " + "ne a " * 20000
    assert peak < 20


def test_stems_of_arrays_are_no_objects_at_once(body):
    from quillspark.functions import stemming

    batch = [["w%d" % (k % 7), None, "x" * 70] * 8000 for k in range(40)] + [None, []]
    out, peak = body(lambda c: stemming.stems(c, "fa"), batch)
    assert out[8] == batch[8] and out[40] is None and out[41] == []
    assert peak < 4


def test_texts_and_arrays_with_nulls(spark):
    from quillspark.functions import stemming, text

    rows = spark.createDataFrame([(0, "né. à", ["running", None]), (1, None, None), (2, "", [])], "id int, t string, w array<string>").coalesce(1)
    got = rows.select(text.remove_diacritics(F.col("t")), text.segment_tokens(F.col("t")), text.word_tokens(F.col("t")), stemming.stems(F.col("w"), "en")).collect()
    assert [tuple(r) for r in got] == [("ne. a", ["né", ".", " ", "à"], ["né", "à"], ["run", None]), (None,) * 4, ("", [], [], [])]


def corpus(spark):
    rows = [(k, " ".join(f"w{(k * j) % 11}" for j in range(k % 5 + 2))) for k in range(60)] + [(3, "w1 w2 w2"), (None, "w1"), (90, None)]
    return rows, spark.createDataFrame(rows, "doc long, text string").repartition(3)


def test_scores_of_few_queries_leave_the_postings_where_they_are(spark, monkeypatch):
    import math
    from collections import Counter

    from quillspark.operators import retrieval

    rows, docs = corpus(spark)
    asked = [("a", "w1 w1 w2 zz"), ("b", "w3"), ("c", "zz"), ("a", "w5")]
    queries = spark.createDataFrame(asked, "q string, t string")
    tf, times = Counter(), Counter((q, w) for q, t in asked for w in t.split())
    for d, t in rows:
        tf.update((d, w) for w in (t or "").split())
    df = Counter(w for _, w in tf)
    want = {}
    for (d, w), n in tf.items():
        for q in "abc":
            if times[q, w]:
                want[q, d] = want.get((q, d), 0) + n * times[q, w] * (1 + math.log(len(rows) / (1 + df[w])))
    c = retrieval.TfIdf(docs, "doc", "text")
    for most, cells in ((200_000, 1 << 20), (200_000, 1), (0, 1)):
        monkeypatch.setattr(retrieval, "ASKED", most)
        monkeypatch.setattr(retrieval, "CELLS", cells)
        got = c.scores(queries, "q", "t")
        assert {(r["query"], r["doc"]): round(r["score"], 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
        assert ("MapInArrow" in got._jdf.queryExecution().executedPlan().toString()) == (most > 0)


def test_postings_are_counted_where_the_texts_of_a_document_meet(spark):
    from quillspark.operators import retrieval

    c = retrieval.TfIdf(corpus(spark)[1], "doc", "text")
    plan = c.postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(doc" in plan and not any("term" in x for x in plan.split("Exchange hashpartitioning(")[1].split(")")[:1])
    plan = c.list_terms().select("doc", "term", "tfidf")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert c.postings.where("doc = 3 and term = 'w2'").select("tf").first()[0] >= 2


def test_many_substrings_are_searched_in_step(monkeypatch):
    import random

    from quillspark.functions import distance

    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcé\0😀") for _ in range(rnd.choice([0, 1, 3, 9, 14, 40]))) for _ in range(300)]
    for costs, transpose in ((distance.UNIT, False), (distance.UNIT, True), (distance.Costs(0.7, 1.1, 0.3, 0.25), True), (distance.Costs(0.0, 1.0, 2.0), False)):
        for source in ("", "b", "abé", "😀bca\0"):
            want = [distance.search(source, t, costs, transpose) for t in texts]
            for together in (1, 200, 1 << 20):
                monkeypatch.setattr(distance, "TOGETHER", together, raising=False)
                assert distance.search_all(source, texts, costs, transpose) == want
    calls = []
    monkeypatch.setattr(distance, "search", lambda *a: calls.append(a))
    distance.search_all("abc", texts[:0] + ["name %04d" % k for k in range(1000)])
    assert not calls


def test_best_substring_of_columns(spark):
    from quillspark.functions import distance

    rows = [(s, f"x{k} Zürich, Berlin") for k in range(40) for s in ("Berlin", "urich")] + [(None, "a"), ("a", None)]
    got = spark.createDataFrame(rows, "s string, t string").select("s", "t", distance.best_substring(F.col("s"), F.col("t")).alias("m")).collect()
    for r in got:
        assert tuple(r["m"]) == distance.search(r["s"] or "", r["t"] or "")


def test_descent_holds_narrow_places_and_spreads_a_step(monkeypatch):
    import tracemalloc

    import numpy as np

    from quillspark.operators import classify

    def batches(n):
        for k in range(n):
            yield np.array([np.arange(200, dtype=np.int64) * 7 + (k + j) % 50 for j in range(500)], dtype=object), np.arange(500) % 3 == 0

    tracemalloc.start()
    slots, column, sizes, y = classify._columns(batches(20))
    theta = classify._descent(column, sizes, y, len(slots), 2)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    # two million ones: 8 MB as places, 16 of each that a round makes for all rows
    assert len(column) == 2_000_000 and len(theta) == len(slots) + 1 and peak < 70
    assert (slots[column[:200]] == np.arange(200) * 7).all()
    whole = classify._descent(column, sizes, y, len(slots), 5)
    monkeypatch.setattr(classify, "_ONES", 1000)
    assert np.allclose(classify._descent(column, sizes, y, len(slots), 5), whole, atol=1e-12)


def test_logistic_reads_its_rows_in_batches(spark):
    from quillspark.operators import classify

    rows = [(k, "ab"[k % 2], [("left", "right")[k % 2], f"w{k % 9}"]) for k in range(200)] + [(999, "a", [])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        model = classify.Logistic.fit(spark.createDataFrame(rows, "doc int, label string, tokens array<string>"), 50)
        got = {(r["label"], r["feature"]): r["weight"] for r in model.theta.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 22 and got["a", "left"] > 1 > -1 > got["a", "right"]
    assert abs(got["a", "left"] - got["b", "right"]) < 0.5
