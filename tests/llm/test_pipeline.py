import brute

import corpus_pipeline
from quillspark.llm import lines, mixing


def test_run_against_brute_force(spark, tmp_path):
    """Every stage's decision recomputed plainly from the rows its predecessor kept."""
    from test_contamination import expected as leaks
    from test_secrets import base, entropy

    docs = brute.corpus(81)
    benchmark = [(1, docs[0][1] or "nothing at all to see here in this one item"), (2, "one")]
    long = next(t for _, t in docs if t and len(brute.WORD.findall(t)) > 60)
    benchmark.append((3, " ".join(brute.WORD.findall(long)[5:40])))
    docs += [(700, "Some words with a token = abcdef0123456789abcdef0123456789 in a line that is otherwise quite plain."), (701, "junk ### $$$ *** &&& %%% ### | | | ### junk ### $$$ *** ###")]
    where = str(tmp_path)
    frame = brute.frame(spark, docs)
    frame.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    got = {r["doc_id"]: r.asDict() for r in corpus_pipeline.run(spark, where).collect()}

    judged = brute.by_id(lines.judge(frame.select("doc_id", "text"), lines.LineField()))
    left = [(i, t) for i, t in docs if judged[i]["kept"]]
    _, to = brute.near(left, 5)
    left = [(i, t) for i, t in left if to[i] == i]
    hits = leaks(left, benchmark)
    left = [(i, t) for i, t in left if hits[i][2] < 2 and hits[i][1] < 8]
    assert set(got) == {i for i, _ in left} and 0 < len(left) < len(docs)
    for i, text in left:
        spans = sorted((a, b) for _, a, b in base(text) + entropy(text))
        out, at = "", 0
        for a, b in spans:
            out += (text[at:a] + "[SECRET]") if a >= at else ""
            at = max(at, b)
        assert got[i]["size"] == len(brute.WORD.findall(out + text[at:]))
    again = mixing.mix(spark.createDataFrame([(i, f"src{i % 3}", "w " * got[i]["size"]) for i in got], "doc_id long, source string, text string"))
    assert {r["doc_id"]: r["taken"] for r in again.collect()} == {i: r["taken"] for i, r in got.items()}


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, apply in corpus_pipeline.STAGES[:-1]:
        out = apply(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()


def test_empty_table(spark, tmp_path):
    brute.frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
