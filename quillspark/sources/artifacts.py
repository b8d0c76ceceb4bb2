"""Saved models and indexes: Parquet or JSON beside a stamp that must match when they are read."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import SparkSession

SCHEMA = 1


class StampError(ValueError):
    """The artifact was made under other rules than those in force."""


def stamp(kind: str, settings: dict) -> dict:
    return {"schema": SCHEMA, "kind": kind, "unicode": unicodedata.unidata_version, "settings": settings}


def write_stamp(spark: SparkSession, path: str, kind: str, settings: dict) -> None:
    spark.createDataFrame([(json.dumps(stamp(kind, settings), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/stamp")


def check_stamp(spark: SparkSession, path: str, kind: str, settings: dict) -> None:
    found = json.loads(spark.read.text(f"{path}/stamp").first()["value"])
    if found != stamp(kind, settings):
        raise StampError(f"{path}: {found} is not {stamp(kind, settings)}")


def save_json(spark: SparkSession, path: str, kind: str, model: dict) -> None:
    write_stamp(spark, path, kind, {})
    spark.createDataFrame([(json.dumps(model, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load_json(spark: SparkSession, path: str, kind: str) -> dict:
    check_stamp(spark, path, kind, {})
    return json.loads(spark.read.text(f"{path}/model").first()["value"])


def read_document(spark: SparkSession, path: str):
    """(path, text): every file whole, as one document."""
    from pyspark.sql import functions as F

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def dynamic(text):
    """JSON text as a dynamic value (null, boolean, number, string, array or object); null where it is no JSON."""
    from pyspark.sql import functions as F

    return F.try_parse_json(text)


def dynamic_field(value, path: str, kind: str):
    """The value at a path such as ``$.a[0]``, cast to ``kind``; null where it is absent or of another kind."""
    from pyspark.sql import functions as F

    return F.try_variant_get(value, path, kind)
