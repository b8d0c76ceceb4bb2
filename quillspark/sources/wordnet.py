"""Lexical database files (index.* and data.*) as tables of lemmas, synsets and pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import closure

POS = ("noun", "verb", "adj", "adv")
_LETTER = {"noun": "n", "verb": "v", "adj": "a", "adv": "r"}
ORDER = {"n": 0, "v": 1, "a": 2, "r": 3}


def index_key(lemma: Column) -> Column:
    """Trimmed, runs of white space as one underscore, A-Z lower-cased."""
    return F.translate(F.regexp_replace(F.trim(lemma), r"\s+", "_"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class RecordError(ValueError):
    """A line does not have the fields it announces."""


class WordNet:
    """Parsed once into three tables: index (lemma, pos, sense, offset), synsets and pointers."""

    def __init__(self, index: DataFrame, synsets: DataFrame, pointers: DataFrame):
        self.index, self.synsets, self.pointers = index, synsets, pointers

    @classmethod
    def open(cls, spark: SparkSession, path: str, check: bool = True) -> WordNet:
        lines = lambda kind: [spark.read.text(f"{path}/{kind}.{p}").where(~F.col("value").startswith(" ") & (F.length("value") > 0)).select(F.lit(_LETTER[p]).alias("pos"), "value") for p in POS]

        def union(frames):
            out = frames[0]
            for f in frames[1:]:
                out = out.unionByName(f)
            return out

        f = F.split(F.trim("value"), r"\s+")
        index = union(lines("index")).withColumn("f", f).withColumn("n", F.get("f", F.lit(2)).cast("int")).withColumn("p", F.get("f", F.lit(3)).cast("int"))
        index = index.select(F.get("f", F.lit(0)).alias("lemma"), "pos", F.posexplode(F.expr("slice(f, p + 7, n)")).alias("sense", "_o")).select("lemma", "pos", (F.col("sense") + 1).alias("sense"), F.col("_o").cast("long").alias("offset"))
        data = union(lines("data")).withColumn("gloss", F.trim(F.regexp_extract("value", r"\|(.*)$", 1))).withColumn("f", F.split(F.trim(F.regexp_extract("value", r"^([^|]*)", 1)), r"\s+"))
        data = data.withColumn("w", F.conv(F.get("f", F.lit(3)), 16, 10).cast("int")).withColumn("at", 4 + 2 * F.col("w")).withColumn("p", F.expr("cast(f[at] as int)"))
        if check and data.where("w is null or p is null or size(f) < at + 1 + 4 * p").limit(1).count():
            raise RecordError("a data line is shorter than it says")
        base = data.select(
            F.get("f", F.lit(0)).cast("long").alias("offset"), "pos", F.get("f", F.lit(2)).alias("type"), "gloss",
            F.expr("transform(sequence(0, w - 1), i -> regexp_replace(f[4 + 2 * i], '\\\\((a|p|ip)\\\\)$', ''))").alias("words"),
            F.expr("case when p > 0 then transform(sequence(0, p - 1), i -> struct(f[at + 1 + 4 * i] as symbol, cast(f[at + 2 + 4 * i] as bigint) as target, f[at + 3 + 4 * i] as target_pos, f[at + 4 + 4 * i] as scope)) else array() end").alias("pointers"),
        )
        pointers = base.select("pos", "offset", F.explode("pointers").alias("x")).select("pos", "offset", "x.symbol", "x.target", F.when(F.col("x.target_pos") == "s", "a").otherwise(F.col("x.target_pos")).alias("target_pos"), "x.scope")
        return cls(index, base.drop("pointers"), pointers)

    def senses(self, lemmas: DataFrame, column: str) -> DataFrame:
        """(lemma, pos, sense, offset, type, words, gloss, rank): nouns, verbs, adjectives, adverbs, each in index order."""
        asked = lemmas.select(index_key(F.col(column)).alias("lemma")).distinct()
        order = F.create_map(*[F.lit(x) for k, v in ORDER.items() for x in (k, v)])
        return asked.join(self.index, "lemma").join(self.synsets, ["pos", "offset"]).select("lemma", "pos", "sense", "offset", "type", "words", "gloss", (order[F.col("pos")] * 1000 + F.col("sense")).alias("rank"))

    def sense(self, name: str) -> DataFrame:
        """The synset of lemma#p#n."""
        lemma, pos, n = name.rsplit("#", 2)
        key = index_key(F.lit(lemma))
        return self.index.where((F.col("lemma") == key) & (F.col("pos") == pos) & (F.col("sense") == int(n))).join(self.synsets, ["pos", "offset"])

    def related(self, synsets: DataFrame, symbol: str | None = None) -> DataFrame:
        """(pos, offset, symbol, target, target_pos) of the pointers of the given (pos, offset)."""
        edges = self.pointers if symbol is None else self.pointers.where(F.col("symbol") == symbol)
        return synsets.select("pos", "offset").join(edges, ["pos", "offset"])

    def closure(self, synsets: DataFrame, symbol: str) -> DataFrame:
        """(root, node, depth) of everything reached by one relation; nodes are pos:offset."""
        name = lambda p, o: F.concat_ws(":", p, F.col(o).cast("string"))
        edges = self.pointers.where(F.col("symbol") == symbol).select(name("pos", "offset").alias("src"), name("target_pos", "target").alias("dst"))
        return closure(edges, synsets.select(name("pos", "offset").alias("node")))
