"""Text classifiers: naive Bayes with presence features, logistic regression, maximum entropy by iterative scaling."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import attach
from ..sources.artifacts import load_json, save_json


class Bayes:
    """Counts of documents per class and of classes per feature; examples (label, tokens).

    A class starts at one document and a feature at ``smoothing``; only present features count.
    """

    def __init__(self, examples: DataFrame | None = None, smoothing: float = 1.0, classes: DataFrame | None = None, features: DataFrame | None = None):
        self.smoothing = smoothing
        if examples is not None:
            kept = examples.where("size(tokens) > 0")
            classes = kept.groupBy("label").agg(F.count("*").alias("docs"))
            features = kept.select("label", F.explode(F.array_distinct("tokens")).alias("feature")).groupBy("label", "feature").agg(F.count("*").alias("docs"))
        self.classes, self.features = classes, features

    def plus(self, examples: DataFrame) -> Bayes:
        """Counts are sums, so more examples are added without the old ones."""
        more = Bayes(examples, self.smoothing)
        add = lambda a, b, *k: a.unionByName(b).groupBy(*k).agg(F.sum("docs").alias("docs"))
        return Bayes(None, self.smoothing, add(self.classes, more.classes, "label"), add(self.features, more.features, "label", "feature"))

    def minus(self, examples: DataFrame) -> Bayes:
        """Counts without those of examples given before."""
        less = Bayes(examples, self.smoothing)
        take = lambda a, b, *k: a.unionByName(b.withColumn("docs", -F.col("docs"))).groupBy(*k).agg(F.sum("docs").alias("docs")).where("docs > 0")
        return Bayes(None, self.smoothing, take(self.classes, less.classes, "label"), take(self.features, less.features, "label", "feature"))

    def scores(self, docs: DataFrame, key: str = "doc") -> DataFrame:
        """(doc, label, score): class share times the product of feature shares, as a logarithm."""
        totals = self.classes.select("label", (F.col("docs") + 1.0).alias("total"))
        everything = F.broadcast(self.classes.agg((F.sum("docs") + 1.0).alias("all")))
        present = docs.select(F.col(key).alias("doc"), F.explode(F.array_distinct("tokens")).alias("feature"))
        # only features that some class knows have a count; the others add the smoothing share of each class
        known = present.join(self.features, "feature").groupBy("doc", "label").agg(F.sum(F.log(F.col("docs") + self.smoothing)).alias("logs"), F.count("*").alias("hits"))
        sizes = docs.select(F.col(key).alias("doc"), F.size(F.array_distinct("tokens")).alias("n"))
        # the classes are few and the plan names every one for every document, as the scores ask for
        wide = sizes.join(F.broadcast(totals), how="cross").join(everything, how="cross")
        joined = wide.join(known, ["doc", "label"], "left")
        log = F.coalesce("logs", F.lit(0.0)) + (F.col("n") - F.coalesce("hits", F.lit(0))) * math.log(self.smoothing) - F.col("n") * F.log("total") + F.log(F.col("total") / F.col("all"))
        return joined.select("doc", "label", log.alias("score"))

    def classify(self, docs: DataFrame, key: str = "doc") -> DataFrame:
        best = Window.partitionBy("doc").orderBy(F.desc("score"), "label")
        return self.scores(docs, key).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")

    def save(self, path: str) -> None:
        self.classes.write.mode("overwrite").parquet(f"{path}/classes")
        self.features.write.mode("overwrite").parquet(f"{path}/features")

    @classmethod
    def load(cls, spark, path: str, smoothing: float = 1.0) -> Bayes:
        return cls(None, smoothing, spark.read.parquet(f"{path}/classes"), spark.read.parquet(f"{path}/features"))


#: Ones of sparse rows that a step of descent spreads out at a time, and rows of weights in a batch.
_ONES, _ROWS = 1 << 20, 100_000


def _columns(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots in order, and as narrow arrays each one's place in them, the ones of each row and whether it has the label."""
    slots, parts, sizes, y = np.empty(0, np.int64), [], [], []
    for lists, told in batches:
        sizes.append(np.fromiter(map(len, lists), np.int32, len(lists)))
        y.append(told)
        flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else slots[:0]
        here, where = np.unique(flat, return_inverse=True)
        # a batch keeps its own places until all slots are known
        parts.append((here, where.astype(np.int32)))
        slots = np.union1d(slots, here)
    for k, (here, where) in enumerate(parts):
        parts[k] = np.searchsorted(slots, here).astype(np.int32)[where]
    none = np.empty(0, np.int32)
    return slots, np.concatenate(parts or [none]), np.concatenate(sizes or [none]), np.concatenate(y or [none.astype(bool)])


def _descent(column: np.ndarray, sizes: np.ndarray, y: np.ndarray, width: int, rounds: int) -> np.ndarray:
    """The intercept and a weight for each of ``width`` columns."""
    m = len(sizes)
    ends = np.cumsum(sizes, dtype=np.int64)
    cuts = [0]
    while cuts[-1] < m:
        base = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(int(np.searchsorted(ends, base + _ONES, "right")), cuts[-1] + 1))
    theta, rate, last = np.zeros(width + 1), 3.0, math.inf
    for _ in range(rounds):
        cost, slope = 0.0, np.zeros(width + 1)
        for i, j in zip(cuts, cuts[1:]):
            ones = column[(ends[i - 1] if i else 0) : ends[j - 1]]
            row = np.repeat(np.arange(j - i), sizes[i:j])
            p = 1 / (1 + np.exp(-np.clip(theta[0] + np.bincount(row, theta[1:][ones], j - i), -500, 500)))
            t = y[i:j].astype(float)
            cost -= np.sum(t * np.log(np.maximum(p, 1e-300)) + (1 - t) * np.log(np.maximum(1 - p, 1e-300)))
            off = p - t
            slope[0] += np.sum(off)
            # only the columns of these rows are touched
            np.add.at(slope, ones + 1, off[row])
        cost /= m
        if cost > last:
            rate /= 3
        elif last - cost < 1e-4:
            break
        last = cost
        theta = theta - rate / m * slope
    return theta


class Logistic:
    """One against the rest, by batch gradient descent; the intercept is trained and then left out.

    A class is fitted in a task of its own from its sparse rows; features are told by a 64-bit hash.  The task reads
    batches and keeps four bytes for each feature of a row; what a round computes from them exists for some rows at a time.
    """

    def __init__(self, theta: DataFrame):
        self.theta = theta

    @classmethod
    def fit(cls, examples: DataFrame, rounds: int = 500) -> Logistic:
        attach(examples.sparkSession)
        vocabulary = examples.select(F.explode("tokens").alias("feature")).distinct().withColumn("slot", F.xxhash64("feature"))
        rows = examples.where("size(tokens) > 0").select("label", F.transform(F.array_distinct("tokens"), lambda t: F.xxhash64(t)).alias("slots"))
        labels = examples.select(F.col("label").alias("target")).distinct()

        def descend(key, batches):
            slots, column, sizes, y = _columns((b["slots"].to_numpy(), (b["label"] == key[0]).to_numpy(bool)) for b in batches)
            theta = _descent(column, sizes, y, len(slots), rounds)
            for at in range(0, len(slots), _ROWS):
                yield pd.DataFrame({"label": key[0], "slot": slots[at : at + _ROWS], "weight": theta[1 + at : 1 + at + _ROWS]})

        descend.__annotations__ = {"key": tuple[Any, ...], "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
        both = labels.crossJoin(rows)
        theta = both.groupBy("target").applyInPandas(descend, "label string, slot long, weight double")
        return cls(theta.join(vocabulary, "slot").select("label", "feature", "weight"))

    def scores(self, docs: DataFrame, key: str = "doc") -> DataFrame:
        present = docs.select(F.col(key).alias("doc"), F.explode(F.array_distinct("tokens")).alias("feature"))
        return present.join(self.theta, "feature").groupBy("doc", "label").agg((1 / (1 + F.exp(-F.sum("weight")))).alias("score"))

    def classify(self, docs: DataFrame, key: str = "doc") -> DataFrame:
        best = Window.partitionBy("doc").orderBy(F.desc("score"), "label")
        return self.scores(docs, key).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


    def save(self, path: str) -> None:
        from ..sources.artifacts import write_stamp

        self.theta.write.mode("overwrite").parquet(f"{path}/theta")
        write_stamp(self.theta.sparkSession, path, "logistic", {})

    @classmethod
    def load(cls, spark, path: str) -> Logistic:
        from ..sources.artifacts import check_stamp

        check_stamp(spark, path, "logistic", {})
        return cls(spark.read.parquet(f"{path}/theta"))


class MaxEnt:
    """Conditional maximum entropy over (outcome, predicate) weights, by generalised iterative scaling."""

    def __init__(self, weights: DataFrame, outcomes: DataFrame):
        self.weights, self.outcomes = weights, outcomes

    @classmethod
    def fit(cls, events: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> MaxEnt:
        """events (event, outcome, predicates); equal events are folded first, and one round is two aggregations."""
        from .graphs import checkpointed

        attach(events.sparkSession)
        folded = checkpointed(events.select("outcome", F.array_sort(F.array_distinct("predicates")).alias("predicates")).groupBy("outcome", "predicates").agg(F.count("*").alias("n")).withColumn("event", F.xxhash64("predicates")))
        outcomes = checkpointed(folded.select("outcome").distinct())
        contexts = checkpointed(folded.groupBy("event").agg(F.first("predicates").alias("predicates"), F.sum("n").alias("n")))
        total, constant = folded.agg(F.sum("n"), F.max(F.size("predicates"))).first()
        if not constant:
            return cls(folded.select(F.lit("").alias("predicate"), "outcome", F.lit(0.0).alias("weight")).limit(0), outcomes)
        empirical = checkpointed(folded.select("outcome", "n", F.explode("predicates").alias("predicate")).groupBy("predicate", "outcome").agg(F.sum("n").alias("seen")))
        weights = empirical.select("predicate", "outcome", F.lit(0.0).alias("weight"))
        last = -math.inf
        for _ in range(rounds):
            weights = checkpointed(weights)
            p = cls(weights, outcomes)._distribution(contexts)
            gain = folded.join(p, ["event", "outcome"]).agg(F.sum(F.col("n") * F.log("p")) / total).first()[0]
            if gain - last <= tolerance:
                break
            last = gain
            expected = contexts.select("event", "n", F.explode("predicates").alias("predicate")).join(p, "event").groupBy("predicate", "outcome").agg(F.sum(F.col("n") * F.col("p")).alias("expected"))
            weights = weights.join(empirical, ["predicate", "outcome"]).join(expected, ["predicate", "outcome"]).select("predicate", "outcome", (F.col("weight") + F.log(F.col("seen") / F.col("expected")) / constant).alias("weight"))
        return cls(weights, outcomes)

    def _distribution(self, contexts: DataFrame) -> DataFrame:
        """(event, outcome, p): softmax of the weights of an event's predicates; unknown ones count nothing."""
        sums = contexts.select("event", F.explode(F.array_distinct("predicates")).alias("predicate")).join(self.weights, "predicate").groupBy("event", "outcome").agg(F.sum("weight").alias("s"))
        # outcomes are the classes of the model
        every = contexts.select("event").distinct().join(F.broadcast(self.outcomes), how="cross").join(sums, ["event", "outcome"], "left").withColumn("s", F.exp(F.coalesce("s", F.lit(0.0))))
        return every.select("event", "outcome", (F.col("s") / F.sum("s").over(Window.partitionBy("event"))).alias("p"))

    def log_likelihood(self, events: DataFrame) -> float:
        """Sum of the log probabilities of (event, outcome, predicates) rows; an outcome the model lacks makes it minus infinity."""
        p = self._distribution(events.select("event", "predicates"))
        joined = events.select("event", "outcome").join(p, ["event", "outcome"], "left")
        return joined.agg(F.sum(F.log(F.col("p"))).alias("s"), F.max(F.col("p").isNull()).alias("lost")).select(F.when(F.col("lost"), float("-inf")).otherwise(F.coalesce("s", F.lit(0.0)))).first()[0]

    def distribution(self, events: DataFrame) -> DataFrame:
        return self._distribution(events.select("event", "predicates"))

    def save(self, path: str) -> None:
        rows = [r.asDict() for r in self.weights.collect()]
        save_json(self.weights.sparkSession, path, "maxent", {"weights": rows, "outcomes": [r["outcome"] for r in self.outcomes.collect()]})

    @classmethod
    def load(cls, spark, path: str) -> MaxEnt:
        told = load_json(spark, path, "maxent")
        return cls(spark.createDataFrame([(w["predicate"], w["outcome"], w["weight"]) for w in told["weights"]], "predicate string, outcome string, weight double"), spark.createDataFrame([(o,) for o in told["outcomes"]], "outcome string"))
