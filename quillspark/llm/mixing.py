"""Mixing sources to target weights, with DataFrame functions only.

Each row gets a hash-random key.  Within a source, rows are dealt by key range
into buckets of about the square root of the source's rows; bucket totals are
summed first (source x bucket rows), then rows inside a bucket.  The two
prefix sums together are the row's place in its source, and the source's exact
budget cuts there.  A hot source is spread over its buckets, so no task sees
all of it.

Edge cases: a null or blank text has size 0 and takes 0; a null source is a
source of its own, last in order; a null id is no key, the text is one then; an empty
table gives an empty result; repeated rows are separate rows (ties in the key are
broken by id and size, and rows that still tie are alike); texts of any length are
counted whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._cluster import stage, table

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(skey, source, source_size, n_rows) -> with weight, target and budget.

    Targets are min(most * size, level * weight); the level that spends the
    total is found by one pass over the sources in the order in which they
    reach their limit.  Rows here are sources, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    limits = Window.orderBy("_reach", "_rank")
    upto = limits.rowsBetween(Window.unboundedPreceding, -1)
    onward = limits.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(every)
    return (
        sizes.withColumn("_rank", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_reach", F.col("_cap") / F.col("weight"))
        .withColumn("_level", (total - F.coalesce(F.sum("_cap").over(upto), F.lit(0))) / F.sum("weight").over(onward))
        .withColumn("_level", F.min(F.when(F.col("_level") < F.col("_reach"), F.struct("_reach", "_rank", "_level"))).over(every)["_level"])
        .withColumn("target", F.when(F.col("_level").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("weight"))))
        .withColumn("budget", F.round("target").cast("long"))
        .select("skey", "source_size", "n_rows", "weight", "target", "budget")
    )


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs``."""
    # a row without an id is keyed by its text, so that such rows do not meet in one bucket
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"),
            F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
            key.alias("key"),
        ),
        "mix-rows",
    )
    sizes = rows.groupBy("skey").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    sources = stage(source_targets(sizes, weights, most), "mix-sources")
    largest = sources.agg(F.max("n_rows")).first()[0] or 1
    bits = min(28, max(1, math.ceil(math.log2(math.sqrt(largest)))))
    dealt = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("skey", "bucket")
        .agg(F.sum("size").alias("_in"))
        .withColumn("_offset", F.coalesce(F.sum("_in").over(before), F.lit(0)))
        .join(sources.select("skey", "source_size", "target", "budget"), "skey")
        .select("skey", "bucket", "_offset", "source_size", "target", "budget")
    )
    inside = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.col("budget") - epochs * F.col("source_size")
    place = F.col("_offset") + F.col("_before")
    return (
        dealt.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, ["skey", "bucket"])
        .withColumn("taken", epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - place)))
        .select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
    )


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3 * source_size AS cap FROM r),
l AS (SELECT *, cap / weight AS reach,
        ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size,
        least(cap::DOUBLE, coalesce((SELECT level FROM l x WHERE x.level < x.reach ORDER BY x.reach, x.rk LIMIT 1) * weight, cap::DOUBLE)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN (budget // source_size) * size
     + greatest(0, least(size, budget - (budget // source_size) * source_size - place)) ELSE 0 END)::BIGINT AS taken
FROM p
"""
