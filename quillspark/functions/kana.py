"""Kana to Hepburn romanisation: longest mora first, doubled consonants, n before vowels, long vowels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column

from .words import per_word

_ROWS = {"": "あいうえお", "k": "かきくけこ", "g": "がぎぐげご", "s": "さしすせそ", "z": "ざじずぜぞ", "t": "たちつてと", "d": "だぢづでど", "n": "なにぬねの", "h": "はひふへほ", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "m": "まみむめも", "r": "らりるれろ"}
_ODD = {"し": "shi", "じ": "ji", "ち": "chi", "ぢ": "ji", "つ": "tsu", "づ": "zu", "ふ": "fu", "や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "ゐ": "i", "ゑ": "e", "を": "o", "ゔ": "vu", "ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o", "ゃ": "ya", "ゅ": "yu", "ょ": "yo", "ゎ": "wa"}
MORAE = {k: row + v for row, line in _ROWS.items() for k, v in zip(line, "aiueo")} | _ODD
for _k, _base in {"き": "ky", "ぎ": "gy", "し": "sh", "じ": "j", "ち": "ch", "ぢ": "j", "に": "ny", "ひ": "hy", "び": "by", "ぴ": "py", "み": "my", "り": "ry"}.items():
    MORAE |= {_k + s: _base + v for s, v in zip("ゃゅょ", "auo")}
MORAE |= {"しぇ": "she", "じぇ": "je", "ちぇ": "che", "てぃ": "ti", "でぃ": "di", "とぅ": "tu", "どぅ": "du", "でゅ": "dyu", "ふぁ": "fa", "ふぃ": "fi", "ふぇ": "fe", "ふぉ": "fo", "うぃ": "wi", "うぇ": "we", "うぉ": "wo", "ゔぁ": "va", "ゔぃ": "vi", "ゔぇ": "ve", "ゔぉ": "vo", "つぁ": "tsa", "つぇ": "tse", "つぉ": "tso"}
_LONG = dict(zip("aiueo", "āīūēō"))


def _hiragana(c: str) -> str:
    return chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" or c in "ヽヾ" else c


def rewrites(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kana, roman) of every piece that changes, in code points."""
    h = "".join(map(_hiragana, text))
    out, i, double = [], 0, -1
    while i < len(h):
        c = h[i]
        if c == "っ" and double < 0:
            double, i = i, i + 1
            continue
        start = double if double >= 0 else i
        size = next((k for k in (2, 1) if h[i : i + k] in MORAE and len(h[i : i + k]) == k), 0)
        if size:
            roman = MORAE[h[i : i + size]]
            if double >= 0:
                roman = ("t" if roman.startswith("ch") else roman[0] if roman[0] not in "aiueo" else "'") + roman
            i += size
        elif c == "ん":
            after = MORAE.get(h[i + 1 : i + 3]) or MORAE.get(h[i + 1 : i + 2]) or ""
            roman = "m" if after[:1] and after[0] in "bmp" else "n'" if after[:1] and after[0] in "aiueoy" else "n"
            i += 1
        elif c == "ー" and out and out[-1][1] == i and out[-1][3][-1:] in _LONG:
            a, _, k, r = out.pop()
            out.append((a, i + 1, text[a : i + 1], r[:-1] + _LONG[r[-1]]))
            i += 1
            continue
        elif c == "・":
            roman, i = " ", i + 1
        else:
            double, i = -1, i + 1
            continue
        double = -1
        last = out[-1] if out and out[-1][1] == start else None
        tail = last[3][-1:] if last else ""
        if last and (roman, tail) in {("a", "a"), ("u", "u"), ("e", "e"), ("o", "o"), ("u", "o")} and size == 1:
            out[-1] = (last[0], i, text[last[0] : i], last[3][:-1] + _LONG[tail])
        else:
            out.append((start, i, text[start:i], roman))
    return out


def romanize(text: str) -> str:
    out, at = [], 0
    for a, b, _, roman in rewrites(text):
        out += [text[at:a], roman]
        at = b
    return "".join(out) + text[at:]


def romanize_normalized(text: str) -> str:
    """Width and marks normalised first."""
    return romanize(unicodedata.normalize("NFKC", text))


transliterate = per_word(romanize, "string")
transliterate_normalized = per_word(romanize_normalized, "string")


def rewrite_rows(text: Column) -> Column:
    return per_word(lambda t: [dict(zip(("start", "end", "kana", "roman"), r)) for r in rewrites(t)], "array<struct<start:int,end:int,kana:string,roman:string>>")(text)
