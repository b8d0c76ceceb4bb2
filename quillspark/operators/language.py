"""Script and language detection, and the phonetic encoder that suits a language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kana
from ..session import attach

#: The Unicode blocks whose letters vote for a script.
SCRIPTS = {
    "Latin": r"A-Za-z\x{C0}-\x{2AF}\x{1E00}-\x{1EFF}",
    "Cyrillic": r"\x{400}-\x{52F}",
    "Greek": r"\x{370}-\x{3FF}\x{1F00}-\x{1FFF}",
    "Arabic": r"\x{600}-\x{6FF}\x{750}-\x{77F}",
    "Hebrew": r"\x{590}-\x{5FF}",
    "Han": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}",
    "Hiragana": r"\x{3040}-\x{309F}",
    "Katakana": r"\x{30A0}-\x{30FF}",
    "Hangul": r"\x{AC00}-\x{D7AF}",
    "Devanagari": r"\x{900}-\x{97F}",
}
NAMES = {"ar": "Arabic", "de": "German", "el": "Greek", "en": "English", "es": "Spanish", "fa": "Persian", "fr": "French", "hi": "Hindi", "id": "Indonesian", "it": "Italian", "ja": "Japanese", "ko": "Korean", "nl": "Dutch", "no": "Norwegian", "pl": "Polish", "pt": "Portuguese", "ru": "Russian", "sv": "Swedish", "th": "Thai", "tr": "Turkish", "uk": "Ukrainian", "zh": "Chinese"}


def _only(text: Column, inside: str) -> Column:
    """The alphabetic symbols of ``text`` in a character class."""
    return F.regexp_replace(text, rf"[^{inside}]+|\P{{IsAlphabetic}}+", "")


def detect_script(text: Column) -> Column:
    """The script of most letters; null without a letter.

    A tie goes to the tied script the text opens with.  Letters of no named script
    are ``Other``, which wins by a strict majority only.  Texts in which letters
    of ASCII outnumber all other symbols, the common case, take two passes.
    """
    ascii_letters = F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))
    beyond = F.length(F.regexp_replace(text, r"[\x00-\x7F]+", ""))
    votes = F.array(*(F.struct(F.length(_only(text, inside)).alias("n"), F.lit(name).alias("script"), F.lit(f"^(?:[^{inside}]|\\P{{IsAlphabetic}})*+").alias("before")) for name, inside in SCRIPTS.items()))
    named = "".join(SCRIPTS.values())
    other = F.length(F.regexp_replace(text, rf"[{named}]+|\P{{IsAlphabetic}}+", ""))

    def decided(x: Column) -> Column:
        tied = F.filter(x["votes"], lambda v: v["n"] == F.array_max(F.transform(x["votes"], lambda w: w["n"])))
        first = F.array_min(F.transform(tied, lambda v: F.struct(F.length(F.call_function("regexp_extract", text, v["before"], F.lit(0))).alias("at"), v["script"].alias("script"))))
        named_wins = F.when(F.size(tied) == 1, F.get(tied, F.lit(0))["script"]).otherwise(first["script"])
        return F.when((F.get(tied, F.lit(0))["n"] == 0) & (x["other"] == 0), F.lit(None)).when(x["other"] > F.get(tied, F.lit(0))["n"], F.lit("Other")).otherwise(named_wins)

    slow = F.transform(F.array(F.struct(votes.alias("votes"), other.alias("other"))), decided)[0]
    return F.when(text.isNull(), F.lit(None)).when(ascii_letters > beyond, F.lit("Latin")).otherwise(slow)


BUCKETS = 4096


def hashed_features(text: str) -> np.ndarray:
    """Shares of hashed 2-, 3- and 4-letter grams of the lower-cased words."""
    x = np.zeros(BUCKETS)
    raw = np.frombuffer(("\x20" + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + "\x20").encode("utf-32-le"), np.uint32).astype(np.uint64)
    for n in (2, 3, 4):
        if len(raw) >= n:
            h = np.full(len(raw) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ raw[k : len(raw) - n + 1 + k]) * np.uint64(0x5BD1E995_97F4A7C1)
                h ^= h >> np.uint64(29)
            np.add.at(x, (h % np.uint64(BUCKETS)).astype(int), 1)
    return x / max(x.sum(), 1)


class LanguageDetector:
    """Mean gram shares of every language, compared by cosine; fitted on a bounded sample of labelled texts."""

    def __init__(self, labels: list[str], means: np.ndarray):
        self.labels, self.means = labels, means

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text", label: str = "lang", sample: int = 300) -> LanguageDetector:
        """Fitted on whole texts: at most ``sample`` of every language, those with the smallest hash."""
        from pyspark.sql import Window

        attach(docs.sparkSession)
        order = Window.partitionBy(label).orderBy(F.xxhash64(text), text)
        rows = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample).select(F.col(label).alias("label"), F.col(text).alias("text"))

        def mean(key, pdf):
            return pd.DataFrame({"label": [key[0]], "mean": [np.mean([hashed_features(t) for t in pdf["text"]], axis=0).tolist()]})

        got = sorted(rows.groupBy("label").applyInPandas(mean, "label string, mean array<double>").collect(), key=lambda r: r["label"])
        return cls([r["label"] for r in got], np.array([r["mean"] for r in got]))

    def rank(self, text: str) -> list[tuple[str, float]]:
        x = hashed_features(text)
        if not x.any():
            return []
        cosine = self.means @ x / (np.linalg.norm(self.means, axis=1) * np.linalg.norm(x))
        weight = np.exp(20 * (cosine - cosine.max()))
        share = weight / weight.sum()
        return sorted(((k, round(float(s), 6)) for k, s in zip(self.labels, share)), key=lambda p: (-p[1], p[0]))

    def detect(self, docs: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
        """``docs`` with language and confidence, null below ``least``."""
        attach(docs.sparkSession)
        rank = self.rank

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for s in batches:
                best = [(rank(t) or [(None, None)])[0] if t else (None, None) for t in s]
                yield pd.DataFrame(best, columns=["language", "confidence"])

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        out = docs.withColumn("_d", F.pandas_udf(run, "language string, confidence double")(F.col(text)))
        sure = F.col("_d.confidence") >= least
        return out.withColumn("language", F.when(sure, F.col("_d.language"))).withColumn("confidence", F.when(sure, F.col("_d.confidence"))).drop("_d")


#: The encoder of a language or script, other choices, how firmly it is grounded, and whether romanisation comes first.
_LATIN = ("double_metaphone", ("metaphone", "soundex"), "script", "not_needed")
_ROMANISED = (*_LATIN[:3], "recommended")
_NO_FIT = (None, (), "no_fit", "unsupported")
_native = lambda tag: (f"beider_morse:{tag}", (), "script", "not_needed")
_named = lambda tag: (f"beider_morse:{tag}", ("double_metaphone", "soundex"), "named", "not_needed")
STRATEGY = {
    "en": ("double_metaphone", ("metaphone", "soundex", "beider_morse:english"), "named", "not_needed"),
    "de": ("cologne", ("daitch_mokotoff", "beider_morse:german", "double_metaphone"), "named", "not_needed"),
    "pl": ("daitch_mokotoff", ("beider_morse:polish", "double_metaphone"), "named", "not_needed"),
    "nl": _named("dutch"), "fr": _named("french"), "it": _named("italian"), "es": _named("spanish"), "pt": _named("portuguese"),
    "ru": _native("cyrillic"), "uk": _native("cyrillic"), "fa": _native("arabic"),
    "no": _LATIN, "sv": _LATIN, "fi": _LATIN, "gl": _LATIN, "ca": _LATIN, "eu": _LATIN, "id": _LATIN, "vi": _LATIN,
    "ja": _ROMANISED, "hi": _NO_FIT, "zh": _NO_FIT,
}
SCRIPT_STRATEGY = {
    "Latin": _LATIN, "Cyrillic": _native("cyrillic"), "Greek": _native("greek"), "Hebrew": _native("hebrew"), "Arabic": _native("arabic"),
    "Hiragana": _ROMANISED, "Katakana": _ROMANISED, "Han": _NO_FIT, "Hangul": _NO_FIT, "Devanagari": _NO_FIT, "Other": _NO_FIT,
}


def _looked_up(key: Column, table: dict) -> Column:
    none = F.array().cast("array<string>")
    row = lambda v: F.struct(F.lit(v[0]).cast("string").alias("encoder"), (F.array(*map(F.lit, v[1])) if v[1] else none).alias("alternatives"), F.lit(v[2]).alias("basis"), F.lit(v[3]).alias("transliteration"))
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), row(v))]), key)


def recommend(language: Column) -> Column:
    """struct(encoder, alternatives, basis, transliteration) for a language code; null for an unknown code."""
    return _looked_up(language, STRATEGY)


def recommend_for_script(script: Column) -> Column:
    """The same for a script's name."""
    return _looked_up(script, SCRIPT_STRATEGY)


def apply_transliteration(advice: Column, text: Column) -> Column:
    """Kana romanised where that is recommended; other texts as they are."""
    return F.when(advice == "recommended", kana.transliterate(text)).otherwise(text)


class AutoPhoneticStrategy:
    """Detection, and a strategy only where its confidence reaches ``threshold``."""

    def __init__(self, detector: LanguageDetector, threshold: float):
        self.detector, self.threshold = detector, threshold

    def detect_and_recommend(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with language, confidence and strategy (null below the threshold)."""
        told = self.detector.detect(docs, text)
        return told.withColumn("strategy", F.when(F.col("confidence") >= self.threshold, recommend(F.col("language"))))


def first_detection(*detections: Column) -> Column:
    """The first detector that did not abstain."""
    return F.coalesce(*detections)
