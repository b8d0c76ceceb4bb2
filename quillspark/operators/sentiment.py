"""Lexicon sentiment over token rows, and over token arrays where lexicon entries may be phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the vocabulary families.
KINDS = ("afinn", "afinn-financial-market-news", "senticon", "pattern")


class UnsupportedPair(ValueError):
    """No vocabulary of that kind was given for that language."""


class UnknownName(ValueError):
    """No vocabulary family has that name."""


def kind_from_name(name: str) -> str:
    """The family of exactly that name."""
    if name not in KINDS:
        raise UnknownName(name)
    return name


class SentimentAnalyzer:
    """Scores for one language and vocabulary kind out of a table of lexicons (kind, language, form, polarity, ord).

    Lexicons are data of their own projects and given as a table.  With a stemmer, entries are filed under the stems of
    their words, the later one winning, and a token is looked up as it is, then by its stem.
    """

    def __init__(self, lexicons: DataFrame, language: str, kind: str, negations: frozenset[str] = frozenset(), stem=None):
        self.language, self.kind, self.negations, self.stem = language, kind_from_name(kind), negations, stem
        own = lexicons.where((F.col("language") == language) & (F.col("kind") == kind))
        # a lexicon is bounded by its language; the driver holds one, as the workers do
        rows = own.orderBy("ord").select(F.lower("form").alias("form"), "polarity").collect()
        if not rows:
            raise UnsupportedPair(f"{kind} for {language}")
        key = lambda form: " ".join(map(stem, form.split())) if stem else form
        self.entries = {key(r["form"]): float(r["polarity"]) for r in rows}

    @staticmethod
    def supported_pairs(lexicons: DataFrame) -> DataFrame:
        return lexicons.select("kind", "language").distinct()

    @staticmethod
    def languages(lexicons: DataFrame, kind: str) -> DataFrame:
        return lexicons.where(F.col("kind") == kind_from_name(kind)).select("language").distinct()

    def score(self, tokens: Column) -> Column:
        """struct(total, units, mean); mean is null where nothing was scored."""
        return score_tokens(tokens, self.entries, self.negations, self.stem)


def vocabulary(lexicon: DataFrame) -> DataFrame:
    """(form, polarity): of several entries of a lower-cased form the last by ord holds."""
    return lexicon.select(F.lower("form").alias("form"), "polarity", "ord").groupBy("form").agg(F.max_by("polarity", "ord").alias("polarity"))


def score_rows(tokens: DataFrame, words: DataFrame, negations: list[str]) -> DataFrame:
    """(doc, total, units, mean) for rows (doc, pos, token): a negation turns all that follows, and scores 0 itself."""
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = tokens.select("doc", "pos", F.lower("token").alias("form")).join(words, "form", "left")
    negation = F.col("form").isin(*negations) & F.col("polarity").isNull()
    sign = F.when(F.coalesce(F.max(negation.cast("int")).over(before), F.lit(0)) == 1, -1.0).otherwise(1.0)
    return rows.withColumn("unit", F.when(negation, 0.0).otherwise(F.coalesce("polarity", F.lit(0.0)) * sign)).groupBy("doc").agg(F.sum("unit").alias("total"), F.count("*").alias("units")).withColumn("mean", F.try_divide("total", F.col("units")))


def score_tokens(tokens: Column, entries: dict[str, float], negations: frozenset[str], stem=None) -> Column:
    """struct(total, units, mean) of an array: the longest phrase of the lexicon first, then negations, the token, its stem."""
    longest = max((len(k.split()) for k in entries), default=1)

    def run(words) -> dict:
        low, i, sign, total, units = [w.lower() for w in words], 0, 1.0, 0.0, 0
        while i < len(low):
            units += 1
            for k in range(min(longest, len(low) - i), 1, -1):
                if " ".join(low[i : i + k]) in entries:
                    total += sign * entries[" ".join(low[i : i + k])]
                    i += k
                    break
            else:
                w = low[i]
                i += 1
                if w in entries:
                    total += sign * entries[w]
                elif w in negations:
                    sign = -1.0
                elif stem and stem(w) in entries:
                    total += sign * entries[stem(w)]
        return {"total": total, "units": units, "mean": total / units if units else None}

    from collections.abc import Iterator

    import pandas as pd

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([run([] if x is None else list(x)) for x in s], columns=["total", "units", "mean"])

    each.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(each, "total double, units int, mean double")(tokens)
