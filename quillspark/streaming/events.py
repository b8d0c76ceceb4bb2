"""Structured Streaming: windowed event counts with late data, running term and class counts, stateless scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_a_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    return reader.parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and values by window and type; the same plan over a batch and a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_frequency(docs: DataFrame, terms) -> DataFrame:
    """Document frequency of every term so far: a streaming aggregate in complete or update mode."""
    return docs.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def running_classes(examples: DataFrame) -> DataFrame:
    """Class and feature counts of naive Bayes so far."""
    return examples.select("label", F.explode(F.array_distinct("tokens")).alias("feature")).groupBy("label", "feature").agg(F.count("*").alias("docs"))


def drain(query_of, name: str, mode: str = "append"):
    """Run a stream over what is there now into a table in memory; for tests and small checks."""
    query = query_of.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query_of.sparkSession.table(name)
