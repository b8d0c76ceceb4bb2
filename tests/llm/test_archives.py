import base64
import hashlib
import random
import re

from pyspark.sql import functions as F

from quillspark.llm import archives


def expected(pages):
    first = {}
    for i, _, html in pages:
        h = html or ""
        if i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        revisit = i is not None and first[html or ""] != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return sorted(out, key=str)


def round_trip(spark, tmp_path, pages, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        where = str(tmp_path / "in")
        spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("type", F.lit("clash")).repartition(2).write.parquet(f"{where}/pages.parquet")
        return sorted((tuple(r) for r in archives.op1_warc(spark, where).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def hostile():
    """Payloads that hold version lines, whole records, blank lines and non-ASCII text."""
    rnd = random.Random(5)
    fake = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 999\r\nContent-Length: 7\r\n\r\npayload\r\n\r\n"
    parts = ["WARC/1.1\r\n", fake, "\r\n\r\n", "é日本", "<p>text</p>\n", "WARC/1.1\r\nContent-Length: 100000\r\n\r\n", "WARC/1.1", "W"]
    pages = [(i, f"http://h/{i}", "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))) for i in range(120)]
    pages += [(200, None, None), (201, "u", ""), (202, "a\r\nb", pages[3][2]), (203, "u", pages[3][2]), (None, "u", "x"), (None, None, None), (5, "again", pages[5][2])]
    return pages + [(300 + i, "u", "copy") for i in range(50)]


def test_round_trip_one_split_a_file(spark, tmp_path):
    pages = hostile()
    assert round_trip(spark, tmp_path, pages, "128m") == expected(pages)


def test_round_trip_over_many_splits(spark, tmp_path):
    pages = hostile()
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert round_trip(spark, tmp_path, pages, "3k") == expected(pages)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_every_record_has_an_id_and_revisits_name_their_response(spark, tmp_path):
    pages = [(4, "http://b", "same"), (2, "http://a", "same"), (2, "http://a", "same"), (9, "http://c", "same"), (7, "http://d", "other")]
    where = str(tmp_path / "out")
    archives.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), where)
    records = [r["value"] for r in spark.read.text(where, wholetext=True).collect()]
    told = "".join(records)
    ids = re.findall("WARC-Record-ID: (.*)\r\n", told)
    assert len(ids) == len(set(ids)) == 5 and told.count("WARC-Type: revisit") == 2
    assert told.count("WARC-Refers-To-Target-URI: http://a\r\n") == told.count(f"WARC-Profile: {archives.PROFILE}\r\n") == told.count("WARC-Refers-To-Date: ") == 2


def test_empty_table(spark, tmp_path):
    assert round_trip(spark, tmp_path, [], "128m") == []


def test_least_payload_keeps_small_ones_as_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    roles = {r["page_id"]: r["_refers"] for r in archives.with_roles(pages, least=3).collect()}
    assert roles == {1: None, 2: None, 3: None, 4: 3}
