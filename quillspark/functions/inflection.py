"""Ordinals, noun and verb inflection, letter-case transfer."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import per_word


def ordinal(n: Column) -> Column:
    """English ordinal; the sign is kept and plays no part."""
    tens, ones = F.abs(n) % 100, F.abs(n) % 10
    suffix = F.when(tens.between(11, 13), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def ordinal_fr(n: Column, feminine: bool = False) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, "re" if feminine else "er").otherwise("e"))


def with_case(model: str, word: str) -> str:
    """``word`` in the case of ``model``: all capitals, a leading capital, or as it is."""
    if len(model) > 1 and model.isupper():
        return word.upper()
    if model[:1].isupper():
        return word[:1].upper() + word[1:]
    return word


class Rule:
    """A pattern and what a match becomes; without a replacement the word is kept as it is."""

    def __init__(self, pattern: str, replacement: str | None = None):
        try:
            self.pattern = re.compile(pattern, re.I)
        except re.error as e:
            raise ValueError(f"{pattern}: {e}") from e
        self.replacement = replacement

    @classmethod
    def keep(cls, pattern: str) -> Rule:
        return cls(pattern)

    def apply(self, word: str) -> str | None:
        if not self.pattern.search(word):
            return None
        return word if self.replacement is None else self.pattern.sub(self.replacement, word, count=1) or None


class Inflector:
    """The caller's rules, then words without a change, then irregular pairs, then regular rules."""

    def __init__(self, invariant=(), irregular=(), plural=(), singular=()):
        self.invariant = frozenset(invariant)
        self.to_plural, self.to_singular = dict(irregular), {b: a for a, b in irregular}
        self.plural, self.singular = [Rule(*r) for r in plural], [Rule(*r) for r in singular]
        self.own_plural: tuple[Rule, ...] = ()
        self.own_singular: tuple[Rule, ...] = ()

    def with_rules(self, plural=(), singular=(), irregular=()) -> Inflector:
        """A copy with rules tried before all others; the newest first."""
        out = object.__new__(Inflector)
        out.__dict__ |= self.__dict__
        out.own_plural = (*reversed([Rule(*r) for r in plural]), *self.own_plural)
        out.own_singular = (*reversed([Rule(*r) for r in singular]), *self.own_singular)
        out.to_plural = self.to_plural | dict(irregular)
        out.to_singular = self.to_singular | {b: a for a, b in irregular}
        return out

    def _inflect(self, word: str, own, table, rules) -> str:
        low = word.lower()
        form = next((x for r in own if (x := r.apply(low)) is not None), None)
        if form is None:
            if low in self.invariant:
                return word
            form = table.get(low) or next((x for r in rules if (x := r.apply(low)) is not None), None)
        return word if form is None or form == low else with_case(word, form)

    def pluralize(self, word: str) -> str:
        return self._inflect(word, self.own_plural, self.to_plural, self.plural)

    def singularize(self, word: str) -> str:
        return self._inflect(word, self.own_singular, self.to_singular, self.singular)

    def plural_of(self, word: Column) -> Column:
        return per_word(self.pluralize, "string")(word)

    def singular_of(self, word: Column) -> Column:
        return per_word(self.singularize, "string")(word)


NOUNS = Inflector(
    "sheep deer fish moose series species money rice information equipment news bison salmon trout swine offspring aircraft headquarters".split(),
    [x.split("/") for x in "man/men woman/women child/children person/people tooth/teeth foot/feet goose/geese mouse/mice louse/lice ox/oxen die/dice quiz/quizzes criterion/criteria phenomenon/phenomena datum/data index/indices matrix/matrices vertex/vertices axis/axes".split()],
    [(r"(analy|ba|cri|diagno|paraly|parenthe|synop|the)sis$", r"\1ses"), (r"([^aeiou]|qu)y$", r"\1ies"), (r"(x|ch|ss|sh|zz)$", r"\1es"), (r"(hero|potato|tomato|echo|veto)$", r"\1es"), (r"(ar|l|ea|eo|oa|hoo)f$", r"\1ves"), (r"(li|wi|kni)fe$", r"\1ves"), (r"(alumn|cact|foc|fung|nucle|radi|stimul|syllab)us$", r"\1i"), (r"us$", "uses"), (r"s$", "ses"), (r"$", "s")],
    [(r"(analy|ba|cri|diagno|paraly|parenthe|synop|the)ses$", r"\1sis"), (r"([^aeiou]|qu)ies$", r"\1y"), (r"(x|ch|ss|sh|zz)es$", r"\1"), (r"(hero|potato|tomato|echo|veto)es$", r"\1"), (r"(ar|l|ea|eo|oa|hoo)ves$", r"\1f"), (r"(li|wi|kni)ves$", r"\1fe"), (r"(alumn|cact|foc|fung|nucle|radi|stimul|syllab)i$", r"\1us"), (r"(us)es$", r"\1"), (r"ss$", "ss"), (r"s$", "")],
)
NOUNS_FR = Inflector(
    "bois bras corps cours dos fils gaz nez noix os pays prix puits repas souris temps tapis voix".split(),
    [x.split("/") for x in "œil/yeux ciel/cieux monsieur/messieurs madame/mesdames bonhomme/bonshommes bal/bals carnaval/carnavals festival/festivals bijou/bijoux caillou/cailloux chou/choux genou/genoux hibou/hiboux joujou/joujoux pou/poux bail/baux corail/coraux travail/travaux vitrail/vitraux pneu/pneus bleu/bleus landau/landaus".split()],
    [(r"(s|x|z)$", r"\1"), (r"al$", "aux"), (r"(au|eu|eau|œu)$", r"\1x"), (r"$", "s")],
    [(r"eaux$", "eau"), (r"(journ|chev|anim|can|capit|génér|hôpit|métau?|roy|sign|tot)aux$", r"\1al"), (r"(eu)x$", r"\1"), (r"s$", "")],
)
NOUNS_JA = Inflector((), [("人", "人々"), ("神", "神々"), ("国", "国々"), ("山", "山々"), ("我", "我々")], [(r"$", "たち")], [(r"(たち|達|ども|がた|ら)$", "")])
#: Third person singular against the other forms of the present.
VERBS = Inflector(
    "can may must ought shall will".split(), [("is", "are"), ("has", "have"), ("does", "do"), ("goes", "go"), ("am", "are")],
    [(r"([^aeiou])ies$", r"\1y"), (r"(x|ch|ss|sh|zz|o)es$", r"\1"), (r"s$", "")], [(r"([^aeiou])y$", r"\1ies"), (r"(x|ch|ss|sh|zz|o)$", r"\1es"), (r"$", "s")],
)
