"""Segmentation, Unicode normalisation, windows over sequences and stop words."""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import per_text

_SEGMENT = regex.compile(r"(?w)\b", regex.V1)
_WORDLIKE = regex.compile(r"[\p{Alphabetic}\p{Nd}\p{Nl}\p{No}]")


def unicode_version() -> str:
    """Version of the normalisation data; segmentation follows the ``regex`` package."""
    return unicodedata.unidata_version


def segments(text: str) -> list[str]:
    """Every word segment of UAX #29; joined, they are the input."""
    return [s for s in _SEGMENT.split(text) if s]


def words(text: str) -> list[str]:
    """Segments with a letter or a number; nothing is folded or trimmed."""
    return [s for s in segments(text) if _WORDLIKE.search(s)]


class AbbreviationError(ValueError):
    """An abbreviation is empty; ``index`` tells which."""

    def __init__(self, index: int):
        super().__init__(f"abbreviation {index} is empty")
        self.index = index


_BREAK = {
    "sep": regex.compile(r"[\u0085  \n\r]"),
    "end": regex.compile(r"[.!?․‼-‽⁇-⁉。﹒．！？｡]"),
    "close": regex.compile(r"[\"'()\[\]{}\p{Ps}\p{Pe}\p{Pi}\p{Pf}]"),
    "blank": regex.compile(r"[\p{White_Space}--[\u0085  \n\r]]", regex.V1),
}


_FULL_STOPS = ".\u2024\ufe52\uff0e"


def sentences(text: str, abbreviations: tuple[str, ...] = ()) -> list[str]:
    """Sentences of UAX #29, untrimmed; no break behind a configured abbreviation."""
    out, start, i, n = [], 0, 0, len(text)
    while i < n:
        c = text[i]
        if _BREAK["sep"].match(c):
            i += 2 if text[i : i + 2] == "\r\n" else 1
            out.append(text[start:i])
            start = i
            continue
        if not _BREAK["end"].match(c):
            i += 1
            continue
        full = c in _FULL_STOPS
        before = text[i - 1] if i else ""
        j = i + 1
        while j < n and (_BREAK["end"].match(text[j]) or unicodedata.combining(text[j])):
            full = full and text[j] in _FULL_STOPS
            j += 1
        if full and j < n and text[j].isdigit() or full and j == i + 1 and before.isupper() and j < n and text[j].isupper():
            i = j
            continue
        while j < n and _BREAK["close"].match(text[j]):
            j += 1
        while j < n and _BREAK["blank"].match(text[j]):
            j += 1
        if j < n and _BREAK["sep"].match(text[j]):
            j += 2 if text[j : j + 2] == "\r\n" else 1
        elif full:
            k = j
            while k < n and not (text[k].isalpha() or _BREAK["sep"].match(text[k]) or _BREAK["end"].match(text[k])):
                k += 1
            if k < n and text[k].islower() or j < n and text[j] in ",;:-–—":
                i = j
                continue
        if any(text[start:j].rstrip().endswith(a) for a in abbreviations):
            i = j
            continue
        out.append(text[start:j])
        start = i = j
    if start < n:
        out.append(text[start:])
    return out


def segment_tokens(text: Column) -> Column:
    return per_text(segments, "array<string>")(text)


def word_tokens(text: Column) -> Column:
    return per_text(words, "array<string>")(text)


def ascii_words(text: Column) -> Column:
    """Runs of ASCII letters and digits; built-in, for ASCII text the same as ``word_tokens`` but for marks inside words."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))


def sentence_tokens(text: Column, abbreviations: tuple[str, ...] = ()) -> Column:
    for k, a in enumerate(abbreviations):
        if not a:
            raise AbbreviationError(k)
    return per_text(lambda t: sentences(t, tuple(abbreviations)), "array<string>")(text)


def normalized(text: Column, form: str = "NFC") -> Column:
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(form)
    return per_text(lambda t: unicodedata.normalize(form, t), "string")(text)


def without_marks(text: str) -> str:
    """Canonical decomposition, combining marks dropped, composed again; letters such as ø or ß stay."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)))


def remove_diacritics(text: Column) -> Column:
    return per_text(without_marks, "string")(text)


def ngrams(tokens: Column, n: int) -> Column:
    """All windows of ``n`` consecutive elements, left to right; pass a plain column, as each window reads it again."""
    if n < 1:
        raise ValueError("n is at least 1")
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.when(F.size(tokens) >= n, F.transform(starts, lambda i: F.slice(tokens, i, n))).otherwise(F.array().cast("array<array<string>>"))


def padded(tokens: Column, n: int, start: str | None = None, end: str | None = None) -> Column:
    """The sequence with ``n - 1`` copies of the symbols that are given."""
    parts = [F.array_repeat(F.lit(start), n - 1)] if start is not None else []
    parts.append(tokens)
    parts += [F.array_repeat(F.lit(end), n - 1)] if end is not None else []
    return F.concat(*parts)


def char_ngrams(text: Column, n: int) -> Column:
    """Windows of ``n`` code points."""
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


#: Frequent function words, a list of this project's own for each language; pass another to replace it.
STOP_WORDS: dict[str, frozenset[str]] = {
    k: frozenset(v.split())
    for k, v in {
        "en": "the of and to in is it was for on that with as be by at from this are or an have not they which you were their a i he she we his her its but has had been will would there what when who if so no do does did can could our your my me him them us than then also into only other some such these those very more most any each few all both own same too just over under again further once here why how where while during before after above below between through about against until because out off up down",
        "de": "der die das und in zu den von mit ist des nicht ein eine auf für dem sich im es auch an als er so dass wie bei aus nach sie werden sind war hat oder aber nur noch wenn kann über einen einer einem um am zum zur wird ich du wir ihr mein dein sein unser durch vor bis ohne gegen",
        "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos uno ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro",
        "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son lui nous comme mais aux leur bien où même si sans tu elle on je mon ton notre votre cette ces entre",
        "it": "di e il la che in un a per è una sono con non del si da al le dei nel alla più i lo gli come ma anche ha o se della delle questo su ci mi ti noi voi loro",
        "nl": "de van een het en in is dat op te zijn voor met die niet aan er om ook als dan maar bij of uit nog naar heeft hij ze wij ik je wordt door over",
        "no": "og i det er på en til som av for at med har de ikke den han var jeg et fra vi om men så seg hun etter kan ut opp",
        "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também",
        "ru": "и в не на я что он с как это по но из у за то она так от все его для же бы мы к ты вы о до",
        "sv": "och i att det som en på är av för med till den har de inte om ett han men var jag från vi så kan när hon",
        "pl": "i w na z się nie do to że jest o jak po co tak za od ale dla czy przez przy oraz już",
        "uk": "і в не на що я з як це та до за у він але по від ми ти ви про",
        "fa": "و در به از که این را با است برای آن یک خود تا بر هم",
        "id": "yang dan di dengan untuk ini itu dari pada adalah ke tidak akan dalam",
        "ja": "の に は を た が で て と し れ さ ある いる も する から",
        "zh": "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也",
    }.items()
}


#: Abbreviations behind which no sentence ends, a list of this project's own for each language; pass another to replace it.
ABBREVIATIONS: dict[str, tuple[str, ...]] = {
    "en": ("Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "Sr.", "Jr.", "St.", "vs.", "etc.", "e.g.", "i.e.", "cf.", "No.", "Inc.", "Ltd.", "Co.", "Fig.", "p.", "pp.", "approx.", "dept.", "est."),
    "es": ("Sr.", "Sra.", "Srta.", "Dr.", "Dra.", "Prof.", "Ud.", "Uds.", "etc.", "p.ej.", "pág.", "págs.", "núm.", "av.", "depto.", "aprox.", "Lic.", "Ing."),
}

STOP_SETTING = "quillspark.stopwords"


def set_global_stop_words(spark, words_: StopWords) -> None:
    """The list ``is_global_stop_word`` asks; kept in the session's configuration."""
    spark.conf.set(STOP_SETTING, "\n".join(words_.words))


def global_stop_words(spark) -> StopWords:
    """The session's list, the English one where none was set."""
    told = spark.conf.get(STOP_SETTING, None)
    return StopWords.for_language("en") if told is None else StopWords(told.split("\n") if told else ())


def is_global_stop_word(spark, word: Column) -> Column:
    return word.isin(*global_stop_words(spark).words)


class StopWords:
    """An immutable list of stop words; membership is exact, without folding."""

    def __init__(self, words_=(), order: tuple[str, ...] | None = None):
        self.words = tuple(dict.fromkeys(words_ if order is None else order))
        self._set = frozenset(self.words)

    @classmethod
    def for_language(cls, code: str) -> StopWords:
        return cls(sorted(STOP_WORDS[code]))

    def __contains__(self, word: str) -> bool:
        return word in self._set

    def add(self, *more: str) -> StopWords:
        return StopWords((*self.words, *more))

    def remove(self, *gone: str) -> StopWords:
        return StopWords(w for w in self.words if w not in gone)

    def keep(self, tokens: Column) -> Column:
        """Tokens that are no stop words."""
        listed = F.array(*map(F.lit, self.words)) if self.words else F.array().cast("array<string>")
        return F.filter(tokens, lambda t: ~F.array_contains(listed, t))

    def holds(self, token: Column) -> Column:
        return F.array_contains(F.array(*map(F.lit, self.words)), token) if self.words else F.lit(False)

    def table(self, spark):
        return spark.createDataFrame([(w,) for w in self.words], "word string")
