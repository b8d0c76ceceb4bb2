"""Phonetic encoders, written from the published descriptions of each algorithm."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import per_word


def _letters(word: str) -> str:
    """ASCII capitals of a word, marks removed."""
    plain = "".join(c for c in unicodedata.normalize("NFD", word.replace("ß", "ss")) if not unicodedata.combining(c))
    return re.sub("[^A-Z]", "", plain.upper())


# --- Soundex family: built-in expressions


def soundex(word: Column) -> Column:
    """Russell Soundex of the ASCII letters; empty without one."""
    letters = F.regexp_replace(word, "[^A-Za-z]", "")
    return F.when(letters == "", "").otherwise(F.soundex(letters))


_REFINED = "01360240043788015936020505"


def refined_soundex(word: Column) -> Column:
    """First letter, then the digit of every letter with runs of one digit collapsed."""
    letters = F.upper(F.regexp_replace(word, "[^A-Za-z]", ""))
    digits = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _REFINED)
    return F.when(letters == "", "").otherwise(F.concat(F.substring(letters, 1, 1), F.regexp_replace(digits, r"(\d)\1+", "$1")))


def same_code(a: Column, b: Column) -> Column:
    """Equal and not empty."""
    return (a == b) & (a != "")


# --- Caverphone: an ordered cascade of replacements

_CAVER_COMMON = [("^cough", "cou2f"), ("^rough", "rou2f"), ("^tough", "tou2f"), ("^enough", "enou2f")]
_CAVER_1 = [*_CAVER_COMMON, ("^gn", "2n"), ("mb$", "m2"), ("cq", "2q"), ("c(?=[iey])", "s"), ("tch", "2ch"), ("[cqx]", "k"), ("v", "f"), ("dg", "2g"), ("ti(?=[oa])", "si"), ("d", "t"), ("ph", "fh"), ("b", "p"), ("sh", "s2"), ("z", "s"), ("^[aeiou]", "A"), ("[aeiou]", "3"), ("3gh3", "3kh3"), ("gh", "22"), ("g", "k"), ("s+", "S"), ("t+", "T"), ("p+", "P"), ("k+", "K"), ("f+", "F"), ("m+", "M"), ("n+", "N"), ("w3", "W3"), ("wy", "Wy"), ("wh3", "Wh3"), ("why", "Why"), ("w", "2"), ("^h", "A"), ("h", "2"), ("r3", "R3"), ("ry", "Ry"), ("r", "2"), ("l3", "L3"), ("ly", "Ly"), ("l", "2"), ("j", "y"), ("y3", "Y3"), ("y", "2"), ("[23]", "")]
_CAVER_2 = [("e$", ""), *_CAVER_COMMON, ("^trough", "trou2f"), ("^gn", "2n"), ("mb$", "m2"), ("cq", "2q"), ("c(?=[iey])", "s"), ("tch", "2ch"), ("[cqx]", "k"), ("v", "f"), ("dg", "2g"), ("ti(?=[oa])", "si"), ("d", "t"), ("ph", "fh"), ("b", "p"), ("sh", "s2"), ("z", "s"), ("^[aeiou]", "A"), ("[aeiou]", "3"), ("j", "y"), ("^y3", "Y3"), ("^y", "A"), ("y", "3"), ("3gh3", "3kh3"), ("gh", "22"), ("g", "k"), ("s+", "S"), ("t+", "T"), ("p+", "P"), ("k+", "K"), ("f+", "F"), ("m+", "M"), ("n+", "N"), ("w3", "W3"), ("wh3", "Wh3"), ("w$", "3"), ("w", "2"), ("^h", "A"), ("h", "2"), ("r3", "R3"), ("r$", "3"), ("r", "2"), ("l3", "L3"), ("l$", "3"), ("l", "2"), ("2", ""), ("3$", "A"), ("3", "")]


def _cascade(word: Column, steps, size: int) -> Column:
    out = F.regexp_replace(F.lower(word), "[^a-z]", "")
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return F.substring(F.concat(out, F.lit("1" * size)), 1, size)


def caverphone1(word: Column) -> Column:
    return _cascade(word, _CAVER_1, 6)


def caverphone2(word: Column) -> Column:
    return _cascade(word, _CAVER_2, 10)


def caverphone_steps(version: int) -> list[tuple[str, str]]:
    return _CAVER_1 if version == 1 else _CAVER_2


# --- the others work letter by letter


def metaphone_code(word: str) -> str:
    """Lawrence Philips' Metaphone of 1990, untruncated."""
    w = _letters(word)
    if not w:
        return ""
    if w[:2] in ("KN", "GN", "PN", "AE", "WR"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    vowel = lambda i: 0 <= i < len(w) and w[i] in "AEIOU"
    at = lambda i: w[i] if 0 <= i < len(w) else ""
    out, i = "", 0
    while i < len(w):
        c, n = w[i], at(i + 1)
        if c == at(i - 1) and c != "C":
            i += 1
            continue
        if c in "AEIOU":
            out += c if i == 0 else ""
        elif c == "B":
            out += "" if at(i - 1) == "M" and i == len(w) - 1 else "B"
        elif c == "C":
            if n == "I" and at(i + 2) == "A":
                out += "X"
            elif n == "H":
                out += "K" if at(i - 1) == "S" else "X"
                i += 1
            elif n and n in "IEY":
                out += "" if at(i - 1) == "S" else "S"
            else:
                out += "K"
        elif c == "D":
            if n == "G" and at(i + 2) and at(i + 2) in "EIY":
                out += "J"
                i += 1
            else:
                out += "T"
        elif c == "G":
            if n == "H" and not (i + 2 == len(w) or vowel(i + 2)):
                pass
            elif n == "H" and i > 0 and not vowel(i + 2):
                pass
            elif n == "N" and (i + 2 == len(w) or w[i + 2 :] == "ED"):
                pass
            elif n and n in "IEY" and at(i - 1) != "G":
                out += "J"
            else:
                out += "K"
        elif c == "H":
            if vowel(i + 1) and not (at(i - 1) and at(i - 1) in "CSPTG"):
                out += "H"
        elif c == "K":
            out += "" if at(i - 1) == "C" else "K"
        elif c == "P":
            out += "F" if n == "H" else "P"
            i += n == "H"
        elif c == "Q":
            out += "K"
        elif c == "S":
            if n == "H":
                out += "X"
                i += 1
            elif n == "I" and at(i + 2) and at(i + 2) in "OA":
                out += "X"
            else:
                out += "S"
        elif c == "T":
            if n == "I" and at(i + 2) and at(i + 2) in "OA":
                out += "X"
            elif n == "H":
                out += "0"
                i += 1
            elif not (n == "C" and at(i + 2) == "H"):
                out += "T"
        elif c == "V":
            out += "F"
        elif c in "WY":
            out += c if vowel(i + 1) else ""
        elif c == "X":
            out += "KS"
        elif c == "Z":
            out += "S"
        else:
            out += c
        i += 1
    return out


def double_metaphone_code(word: str, size: int = 4) -> tuple[str, str | None]:
    """Philips' Double Metaphone of 2000: a primary key and, where it differs, an alternate."""
    plain = unicodedata.normalize("NFC", word).upper()
    w = "".join(c for c in unicodedata.normalize("NFD", plain.replace("Ç", "\x01").replace("Ñ", "\x02")) if not unicodedata.combining(c))
    w = re.sub("[^A-Z\x01\x02 ]", "", w).strip().replace("\x01", "Ç").replace("\x02", "Ñ")
    if not w:
        return "", None
    n, last = len(w), len(w) - 1
    s = w + "     "
    a: list[str] = []
    b: list[str] = []
    slavic = bool(re.search("W|K|CZ|WITZ", w))
    germanic = w[:4] in ("VAN ", "VON ") or w[:3] == "SCH"
    vowel = lambda i: 0 <= i < n and s[i] in "AEIOUY"

    def has(i: int, size: int, *options: str) -> bool:
        return i >= 0 and s[i : i + size] in options

    def add(p: str, q: str | None = None) -> None:
        a.append(p)
        b.append(p if q is None else q)

    i = 1 if w[:2] in ("GN", "KN", "PN", "WR", "PS") else 0
    if w[0] == "X":
        add("S")
        i = 1
    while i < n and (len("".join(a)) < size or len("".join(b)) < size):
        c = s[i]
        step = 1
        if c in "AEIOUY":
            if i == 0:
                add("A")
        elif c == "B":
            add("P")
            step = 2 if s[i + 1] == "B" else 1
        elif c == "Ç":
            add("S")
        elif c == "C":
            if i > 1 and not vowel(i - 2) and has(i - 1, 3, "ACH") and s[i + 2] != "I" and (s[i + 2] != "E" or has(i - 2, 6, "BACHER", "MACHER")):
                add("K")
                step = 2
            elif i == 0 and has(i, 6, "CAESAR"):
                add("S")
                step = 2
            elif has(i, 4, "CHIA"):
                add("K")
                step = 2
            elif has(i, 2, "CH"):
                step = 2
                if i > 0 and has(i, 4, "CHAE"):
                    add("K", "X")
                elif i == 0 and (has(1, 4, "HARA", "HARE", "HARI", "HARY") or has(1, 5, "HARAC", "HARIS") or has(1, 2, "HY") or has(1, 3, "HOR", "HYM", "HIA", "HEM")) and not has(0, 5, "CHORE"):
                    add("K")
                elif germanic or has(i - 2, 6, "ORCHES", "ARCHIT", "ORCHID") or s[i + 2] in "TS" or ((i == 0 or s[i - 1] in "AOUE") and s[i + 2] in "LRNMBHFVW "):
                    add("K")
                elif i > 0:
                    add("K") if has(0, 2, "MC") else add("X", "K")
                else:
                    add("X")
            elif has(i, 2, "CZ") and not has(i - 2, 4, "WICZ"):
                add("S", "X")
                step = 2
            elif has(i + 1, 3, "CIA"):
                add("X")
                step = 3
            elif has(i, 2, "CC") and not (i == 1 and s[0] == "M"):
                if s[i + 2] in "IEH" and not has(i + 2, 2, "HU"):
                    add("KS") if (i == 1 and s[0] == "A") or has(i - 1, 5, "UCCEE", "UCCES") else add("X")
                    step = 3
                else:
                    add("K")
                    step = 2
            elif has(i, 2, "CK", "CG", "CQ"):
                add("K")
                step = 2
            elif has(i, 2, "CI", "CE", "CY"):
                add("S", "X") if has(i, 3, "CIO", "CIE", "CIA") else add("S")
                step = 2
            else:
                add("K")
                step = 3 if has(i + 1, 2, " C", " Q", " G") else 2 if s[i + 1] in "CKQ" and not has(i + 1, 2, "CE", "CI") else 1
        elif c == "D":
            if has(i, 2, "DG"):
                if s[i + 2] in "IEY":
                    add("J")
                    step = 3
                else:
                    add("TK")
                    step = 2
            else:
                add("T")
                step = 2 if has(i, 2, "DT", "DD") else 1
        elif c == "G":
            if s[i + 1] == "H":
                step = 2
                if i > 0 and not vowel(i - 1):
                    add("K")
                elif i == 0:
                    add("J") if s[i + 2] == "I" else add("K")
                elif (i > 1 and s[i - 2] in "BHD") or (i > 2 and s[i - 3] in "BHD") or (i > 3 and s[i - 4] in "BH"):
                    pass
                elif i > 2 and s[i - 1] == "U" and s[i - 3] in "CGLRT":
                    add("F")
                elif s[i - 1] != "I":
                    add("K")
            elif s[i + 1] == "N":
                step = 2
                if i == 1 and vowel(0) and not slavic:
                    add("KN", "N")
                elif not has(i + 2, 2, "EY") and s[i + 1] != "Y" and not slavic:
                    add("N", "KN")
                else:
                    add("KN")
            elif has(i + 1, 2, "LI") and not slavic:
                add("KL", "L")
                step = 2
            elif i == 0 and (s[1] == "Y" or has(1, 2, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
                add("K", "J")
                step = 2
            elif (has(i + 1, 2, "ER") or s[i + 1] == "Y") and not has(0, 6, "DANGER", "RANGER", "MANGER") and not (i > 0 and s[i - 1] in "EI") and not has(i - 1, 3, "RGY", "OGY"):
                add("K", "J")
                step = 2
            elif s[i + 1] in "EIY" or has(i - 1, 4, "AGGI", "OGGI"):
                if germanic or has(i + 1, 2, "ET"):
                    add("K")
                elif has(i + 1, 4, "IER "):
                    add("J")
                else:
                    add("J", "K")
                step = 2
            else:
                add("K")
                step = 2 if s[i + 1] == "G" else 1
        elif c == "H":
            if (i == 0 or vowel(i - 1)) and vowel(i + 1):
                add("H")
                step = 2
        elif c == "J":
            if has(i, 4, "JOSE") or has(0, 4, "SAN "):
                add("H") if (i == 0 and s[i + 4] == " ") or has(0, 4, "SAN ") else add("J", "H")
            elif i == 0:
                add("J", "A")
            elif vowel(i - 1) and not slavic and s[i + 1] in "AO":
                add("J", "H")
            elif i == last:
                add("J", "")
            elif s[i + 1] not in "LTKSNMBZ" and s[i - 1] not in "SKL":
                add("J")
            step = 2 if s[i + 1] == "J" else 1
        elif c == "L":
            if s[i + 1] == "L":
                step = 2
                if (i == n - 3 and has(i - 1, 4, "ILLO", "ILLA", "ALLE")) or ((has(last - 1, 2, "AS", "OS") or s[last] in "AO") and has(i - 1, 4, "ALLE")):
                    add("L", "")
                else:
                    add("L")
            else:
                add("L")
        elif c == "M":
            add("M")
            step = 2 if s[i + 1] == "M" or (has(i - 1, 3, "UMB") and (i + 1 == last or has(i + 2, 2, "ER"))) else 1
        elif c == "Ñ":
            add("N")
        elif c == "P":
            add("F" if s[i + 1] == "H" else "P")
            step = 2 if s[i + 1] in "HPB" else 1
        elif c == "R":
            if i == last and not slavic and has(i - 2, 2, "IE") and not has(i - 4, 2, "ME", "MA"):
                add("", "R")
            else:
                add("R")
            step = 2 if s[i + 1] == "R" else 1
        elif c == "S":
            if has(i - 1, 3, "ISL", "YSL"):
                pass
            elif i == 0 and has(i, 5, "SUGAR"):
                add("X", "S")
            elif has(i, 2, "SH"):
                add("S") if has(i + 1, 4, "HEIM", "HOEK", "HOLM", "HOLZ") else add("X")
                step = 2
            elif has(i, 3, "SIO", "SIA") or has(i, 4, "SIAN"):
                add("S") if slavic else add("S", "X")
                step = 3
            elif (i == 0 and s[i + 1] in "MNLW") or s[i + 1] == "Z":
                add("S", "X")
                step = 2 if s[i + 1] == "Z" else 1
            elif has(i, 2, "SC"):
                step = 3
                if s[i + 2] == "H":
                    if has(i + 3, 2, "OO", "ER", "EN", "UY", "ED", "EM"):
                        add("X", "SK") if has(i + 3, 2, "ER", "EN") else add("SK")
                    elif i == 0 and not vowel(3) and s[3] != "W":
                        add("X", "S")
                    else:
                        add("X")
                else:
                    add("S" if s[i + 2] in "IEY" else "SK")
            else:
                add("", "S") if i == last and has(i - 2, 2, "AI", "OI") else add("S")
                step = 2 if s[i + 1] in "SZ" else 1
        elif c == "T":
            if has(i, 4, "TION") or has(i, 3, "TIA", "TCH"):
                add("X")
                step = 3
            elif has(i, 2, "TH") or has(i, 3, "TTH"):
                add("T") if has(i + 2, 2, "OM", "AM") or germanic else add("0", "T")
                step = 2
            else:
                add("T")
                step = 2 if s[i + 1] in "TD" else 1
        elif c in "KFNQV":
            add({"V": "F", "Q": "K"}.get(c, c))
            step = 2 if s[i + 1] == c else 1
        elif c == "W":
            if has(i, 2, "WR"):
                add("R")
                step = 2
            else:
                if i == 0 and (vowel(i + 1) or has(i, 2, "WH")):
                    add("A", "F") if vowel(i + 1) else add("A")
                if (i == last and vowel(i - 1)) or has(i - 1, 5, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or has(0, 3, "SCH"):
                    add("", "F")
                elif has(i, 4, "WICZ", "WITZ"):
                    add("TS", "FX")
                    step = 4
        elif c == "X":
            if not (i == last and (has(i - 3, 3, "IAU", "EAU") or has(i - 2, 2, "AU", "OU"))):
                add("KS")
            step = 2 if s[i + 1] in "CX" else 1
        elif c == "Z":
            if s[i + 1] == "H":
                add("J")
                step = 2
            else:
                if has(i + 1, 2, "ZO", "ZI", "ZA") or (slavic and i > 0 and s[i - 1] != "T"):
                    add("S", "TS")
                else:
                    add("S")
                step = 2 if s[i + 1] == "Z" else 1
        i += step
    p, q = "".join(a)[:size], "".join(b)[:size]
    return p, q if q != p else None


def nysiis_code(word: str, strict: bool = True) -> str:
    """New York State Identification and Intelligence System code of 1970; strict keeps six letters."""
    w = _letters(word)
    if not w:
        return ""
    for old, new in (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")):
        if w.startswith(old):
            w = new + w[len(old) :]
            break
    for old, new in (("EE", "Y"), ("IE", "Y"), ("DT", "D"), ("RT", "D"), ("RD", "D"), ("NT", "D"), ("ND", "D")):
        if w.endswith(old):
            w = w[: -len(old)] + new
            break
    out, s = [w[0]], list(w)
    i = 1
    while i < len(s):
        c = s[i]
        rest = "".join(s[i:])
        if rest.startswith("EV"):
            s[i : i + 2] = "AF"
        elif c in "AEIOU":
            s[i] = "A"
        elif c in "QZM":
            s[i] = {"Q": "G", "Z": "S", "M": "N"}[c]
        elif rest.startswith("KN"):
            s[i : i + 2] = "NN"
        elif c == "K":
            s[i] = "C"
        elif rest.startswith("SCH"):
            s[i : i + 3] = "SSS"
        elif rest.startswith("PH"):
            s[i : i + 2] = "FF"
        elif c == "H" and (s[i - 1] not in "AEIOU" or i + 1 >= len(s) or s[i + 1] not in "AEIOU"):
            s[i] = s[i - 1]
        elif c == "W" and s[i - 1] in "AEIOU":
            s[i] = s[i - 1]
        if s[i] != out[-1]:
            out.append(s[i])
        i += 1
    code = "".join(out)
    if len(code) > 1 and code.endswith("S"):
        code = code[:-1]
    if code.endswith("AY"):
        code = code[:-2] + "Y"
    if len(code) > 1 and code.endswith("A"):
        code = code[:-1]
    return code[:6] if strict else code


def cologne_code(word: str) -> str:
    """Postel's Koelner Phonetik of 1969."""
    w = word.upper().replace("ß", "S").replace("ẞ", "S").replace("Ä", "A").replace("Ö", "O").replace("Ü", "U")
    w = _letters(w)
    digits = []
    for i, c in enumerate(w):
        before, after = w[i - 1 : i] if i else "", w[i + 1 : i + 2]
        if c in "AEIJOUY":
            d = "0"
        elif c == "H":
            continue
        elif c == "B" or c == "P" and after != "H":
            d = "1"
        elif c in "DT":
            d = "8" if after and after in "CSZ" else "2"
        elif c in "FVWP":
            d = "3"
        elif c in "GKQ":
            d = "4"
        elif c == "C":
            if i == 0:
                d = "4" if after and after in "AHKLOQRUX" else "8"
            else:
                d = "4" if after and after in "AHKOQUX" and before not in "SZ" else "8"
        elif c == "X":
            d = "8" if before and before in "CKQ" else "48"
        elif c == "L":
            d = "5"
        elif c in "MN":
            d = "6"
        elif c == "R":
            d = "7"
        else:
            d = "8"
        digits.append(d)
    joined = re.sub(r"(\d)\1+", r"\1", "".join(digits))
    return joined[:1] + joined[1:].replace("0", "")


def phonex_code(word: str, size: int = 4) -> str:
    """Lait and Randell's Phonex of 1996, padded with zeros."""
    w = re.sub("S+$", "", _letters(word))
    for old, new in (("KN", "N"), ("PH", "F"), ("WR", "R")):
        if w.startswith(old):
            w = new + w[2:]
    if w.startswith("H"):
        w = w[1:]
    if not w:
        return "0" * size
    first = w[0]
    first = "A" if first in "AEIOUY" else {"P": "B", "V": "F", "K": "C", "Q": "C", "J": "G", "Z": "S"}.get(first, first)
    w = first + w[1:]
    code, last = first, _phonex_digit(w, 0)
    i = 1
    while i < len(w) and len(code) < size:
        d = _phonex_digit(w, i)
        if w[i] in "MN" and i + 1 < len(w) and w[i + 1] in "DG":
            w = w[: i + 1] + w[i] + w[i + 2 :]
        if d != "0" and d != last:
            code += d
        last = d if i or d != "0" else last
        i += 1
    return code.ljust(size, "0")


def _phonex_digit(w: str, i: int) -> str:
    c, after = w[i], w[i + 1 : i + 2]
    vowel = bool(after) and after in "AEIOUY"
    if c in "BPFV":
        return "1"
    if c in "CSKGJQXZ":
        return "2"
    if c in "DT":
        return "0" if after == "C" else "3"
    if c == "L":
        return "4" if vowel or not after else "0"
    if c in "MN":
        return "5"
    if c == "R":
        return "6" if vowel or not after else "0"
    return "0"


def match_rating_code(word: str) -> str:
    """Moore's match rating codex of 1977: no vowels but the first, no doubles, first and last three letters."""
    w = _letters(word)
    if not w:
        return ""
    w = w[0] + re.sub("[AEIOU]", "", w[1:])
    w = re.sub(r"(.)\1+", r"\1", w)
    return w if len(w) <= 6 else w[:3] + w[-3:]


def match_rating_alike(a: str, b: str) -> bool:
    if len(a.strip()) < 2 or len(b.strip()) < 2:
        return False
    x, y = match_rating_code(a), match_rating_code(b)
    if not x or not y or abs(len(x) - len(y)) >= 3:
        return False
    total = len(x) + len(y)
    least = 5 if total <= 4 else 4 if total <= 7 else 3 if total <= 11 else 2 if total == 12 else 1
    for _ in range(2):  # left to right, then right to left
        left = [(p, q) for p, q in zip(x, y) if p != q]
        size = min(len(x), len(y))
        x, y = ("".join(p for p, _ in left) + x[size:])[::-1], ("".join(q for _, q in left) + y[size:])[::-1]
    return 6 - max(len(x), len(y)) >= least


#: The chart of R. Mokotoff and G. Daitch (1985). Letters, and their codes at the start of a word,
#: before a vowel, and elsewhere; | separates branches.
_DM_CHART = (
    ("AI AJ AY", "0", "1", ""),
    ("AU", "0", "7", ""),
    ("A", "0", "", ""),
    ("B", "7", "7", "7"),
    ("CHS", "5", "54", "54"),
    ("CH", "5|4", "5|4", "5|4"),
    ("CK", "5|45", "5|45", "5|45"),
    ("CZ CS CSZ CZS", "4", "4", "4"),
    ("C", "5|4", "5|4", "5|4"),
    ("DRZ DRS", "4", "4", "4"),
    ("DS DSH DSZ DZ DZH DZS", "4", "4", "4"),
    ("D DT", "3", "3", "3"),
    ("EI EJ EY", "0", "1", ""),
    ("EU", "1", "1", ""),
    ("E", "0", "", ""),
    ("FB", "7", "7", "7"),
    ("F", "7", "7", "7"),
    ("G", "5", "5", "5"),
    ("H", "5", "5", ""),
    ("IA IE IO IU", "1", "", ""),
    ("I", "0", "", ""),
    ("J", "1|4", "|4", "|4"),
    ("KS", "5", "54", "54"),
    ("KH", "5", "5", "5"),
    ("K", "5", "5", "5"),
    ("L", "8", "8", "8"),
    ("MN", "66", "66", "66"),
    ("M", "6", "6", "6"),
    ("NM", "66", "66", "66"),
    ("N", "6", "6", "6"),
    ("OI OJ OY", "0", "1", ""),
    ("O", "0", "", ""),
    ("P PF PH", "7", "7", "7"),
    ("Q", "5", "5", "5"),
    ("RZ RS", "94|4", "94|4", "94|4"),
    ("R", "9", "9", "9"),
    ("SCHTSCH SCHTSH SCHTCH", "2", "4", "4"),
    ("SCH", "4", "4", "4"),
    ("SHTCH SHCH SHTSH", "2", "4", "4"),
    ("SHT SCHT SCHD", "2", "43", "43"),
    ("SH", "4", "4", "4"),
    ("STCH STSCH SC", "2", "4", "4"),
    ("STRZ STRS STSH", "2", "4", "4"),
    ("ST", "2", "43", "43"),
    ("SZCZ SZCS", "2", "4", "4"),
    ("SZT SHD SZD SD", "2", "43", "43"),
    ("SZ", "4", "4", "4"),
    ("S", "4", "4", "4"),
    ("TCH TTCH TTSCH", "4", "4", "4"),
    ("TH", "3", "3", "3"),
    ("TRZ TRS", "4", "4", "4"),
    ("TSCH TSH", "4", "4", "4"),
    ("TS TTS TTSZ TC TZ TTZ TZS TSZ", "4", "4", "4"),
    ("T", "3", "3", "3"),
    ("UI UJ UY", "0", "1", ""),
    ("UE U", "0", "", ""),
    ("V", "7", "7", "7"),
    ("W", "7", "7", "7"),
    ("X", "5", "54", "54"),
    ("Y", "1", "", ""),
    ("ZDZ ZDZH ZHDZH", "2", "4", "4"),
    ("ZD ZHD", "2", "43", "43"),
    ("ZH ZS ZSCH ZSH", "4", "4", "4"),
    ("Z", "4", "4", "4"),
)
_DM = {letters: codes for keys, *codes in _DM_CHART for letters in keys.split()}


def daitch_mokotoff_codes(word: str) -> list[str]:
    """All six-digit codes of the Daitch-Mokotoff system, branches included, in order."""
    w = _letters(word)
    if not w:
        return []
    branches: list[tuple[str, str]] = [("", "")]
    i = 0
    while i < len(w):
        size = next((k for k in range(min(7, len(w) - i), 0, -1) if w[i : i + k] in _DM), 0)
        if not size:
            i += 1
            continue
        start, vowel, other = _DM[w[i : i + size]]
        after = w[i + size : i + size + 1]
        codes = (start if i == 0 else vowel if after and after in "AEIOUJY" else other).split("|")
        new: dict[tuple[str, str], None] = {}
        for code, last in branches:
            for c in codes:
                new[(code + ("" if c and c == last else c), c)] = None
        branches = list(new)
        i += size
    return list(dict.fromkeys(code[:6].ljust(6, "0") for code, _ in branches))


metaphone = per_word(metaphone_code, "string")
cologne = per_word(cologne_code, "string")
match_rating = per_word(match_rating_code, "string")
match_rating_compare = per_word(match_rating_alike, "boolean")
daitch_mokotoff = per_word(daitch_mokotoff_codes, "array<string>")


def nysiis(word: Column, strict: bool = True) -> Column:
    return per_word(lambda w: nysiis_code(w, strict), "string")(word)


def phonex(word: Column, size: int = 4) -> Column:
    return per_word(lambda w: phonex_code(w, size), "string")(word)


def double_metaphone(word: Column) -> Column:
    """array of one or two keys; two words are alike if their arrays overlap."""
    return per_word(lambda w: [x for x in double_metaphone_code(w) if x], "array<string>")(word)


def difference(a: Column, b: Column) -> Column:
    """Places at which two refined Soundex codes agree."""
    x, y = refined_soundex(a), refined_soundex(b)
    places = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.coalesce((p == q) & (p != ""), F.lit(False)).cast("int"))
    return F.aggregate(places, F.lit(0), lambda s, v: s + v)


def tokenize_and_phoneticize(text: Column, encode, stop_words=None, keep_stops: bool = False) -> Column:
    """Codes of a text's words, lower-cased; stop words go unless kept."""
    from .text import StopWords, word_tokens
    from .words import per_array

    tokens = F.transform(word_tokens(text), F.lower)
    return per_array(encode, "string")(tokens if keep_stops else (stop_words or StopWords.for_language("en")).keep(tokens))


def phoneticize_tokens(tokens: Column, encode, stop_words) -> Column:
    """Codes of the tokens that are no stop words; nothing is folded before the test."""
    from .words import per_array

    return per_array(encode, "string")(stop_words.keep(tokens))
