"""Every registered query against its SQL on the smallest tables, or at least for rows."""

import glob
import os

import duckdb
import pytest

from quillspark.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


def rows(frame, columns):
    x = frame[columns].astype(object)
    return sorted(map(tuple, x.where(x.notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got)
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name]).df()
        assert sorted(got) == sorted(want)
        assert rows(got, sorted(got)) == rows(want, sorted(want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query", "doc", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_classifiers_fit_whole_turns_to_the_default_end(spark, monkeypatch):
    fitted, rounds = [], []
    logistic, maxent = catalogue.classify.Logistic.fit, catalogue.classify.MaxEnt.fit
    monkeypatch.setattr(catalogue.classify.Logistic, "fit", lambda x, *a, **k: fitted.append(x) or logistic(x, *a, **k))
    catalogue.logistic_classify(spark, FOLDER)
    whole = catalogue._talk(spark, FOLDER)
    assert fitted[0].selectExpr("sum(size(tokens))").first() == whole.selectExpr("sum(size(tokens))").first()
    assert whole.where("size(tokens) > 20").limit(1).count()
    monkeypatch.setattr(catalogue.classify.MaxEnt, "fit", lambda x, *a, **k: rounds.append((a, k)) or maxent(x.limit(0), *a, **k))
    catalogue.maxent_distribution(spark, FOLDER)
    assert rounds == [((), {})]
