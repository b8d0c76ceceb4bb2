"""Transformation-based part-of-speech tagging and clause analysis over (sent, pos, token) rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sentence():
    return Window.partitionBy("sent").orderBy("pos")


def parse_brown(lines: DataFrame, key: str = "sent", text: str = "value") -> DataFrame:
    """(sent, pos, token, tag) from lines of token_TAG."""
    pieces = F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda p: p.contains("_"))
    return lines.select(F.col(key).alias("sent"), F.posexplode(pieces).alias("pos", "_p")).select("sent", "pos", F.regexp_extract("_p", r"^(.*)_([^_]*)$", 1).alias("token"), F.regexp_extract("_p", r"^(.*)_([^_]*)$", 2).alias("tag"))


def split_corpus(tagged: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Whole sentences, the first part with about ``percent`` of them, the same at every run."""
    part = F.conv(F.substring(F.md5(F.col("sent").cast("string")), 1, 8), 16, 10).cast("long") % 100
    return tagged.where(part < percent), tagged.where(part >= percent)


class Lexicon:
    """Most frequent tag of a token; ties go to the smaller tag."""

    def __init__(self, entries: DataFrame, default: str = "NN", capitalized: str | None = "NNP", lower_retry: bool = False):
        self.entries, self.default, self.capitalized, self.lower_retry = entries, default, capitalized, lower_retry

    @classmethod
    def build(cls, tagged: DataFrame, **how) -> Lexicon:
        counts = tagged.groupBy("token", "tag").agg(F.count("*").alias("n"))
        best = counts.groupBy("token").agg(F.min(F.struct((-F.col("n")).alias("n"), "tag")).alias("b"))
        return cls(best.select("token", F.col("b.tag").alias("tag")), **how)

    def annotate(self, tokens: DataFrame) -> DataFrame:
        """``tokens`` (sent, pos, token, ...) with tag: exact entry, lower-cased entry if asked, capitalised default, default."""
        out = tokens.join(self.entries.select("token", F.col("tag").alias("_a")), "token", "left")
        choices = [F.col("_a")]
        if self.lower_retry:
            out = out.join(self.entries.select(F.col("token").alias("_l"), F.col("tag").alias("_b")), F.lower("token") == F.col("_l"), "left")
            choices.append(F.col("_b"))
        if self.capitalized:
            choices.append(F.when(F.col("token").rlike(r"^\p{Lu}"), F.lit(self.capitalized)))
        return out.withColumn("tag", F.coalesce(*choices, F.lit(self.default))).drop("_a", "_b", "_l")


def _near(column: str, offsets: tuple[int, ...], value: str) -> Column:
    hits = [F.coalesce(F.lead(column, k).over(_sentence()) == value if k > 0 else F.lag(column, -k).over(_sentence()) == value, F.lit(False)) for k in offsets]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


_AT = {"PREV": (-1,), "NEXT": (1,), "PREV1OR2": (-1, -2), "NEXT1OR2": (1, 2), "PREV1OR2OR3": (-1, -2, -3), "NEXT1OR2OR3": (1, 2, 3), "PREV2": (-2,), "NEXT2": (2,), "CURRENT": (0,)}


def condition(name: str, *args: str) -> Column:
    """One contextual, lexical or shape test as a Column; a missing neighbour fails it."""
    here = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    name = name.upper().replace("_", "-")
    yes = (args[0].upper() == "YES") if args else True
    if name == "CURRENT-WORD-IS-CAP":
        return F.col("token").rlike(r"^\p{Lu}") == yes
    if name == "PREV-WORD-IS-CAP":
        return F.coalesce(F.lag("token").over(_sentence()).rlike(r"^\p{Lu}"), F.lit(False)) == yes
    if name == "NEXT-WORD-IS-CAP":
        return F.coalesce(F.lead("token").over(_sentence()).rlike(r"^\p{Lu}"), F.lit(False)) == yes
    if name == "CURRENT-WORD-IS-NUMBER":
        return F.col("token").rlike(r"^[+-]?[0-9]+([.,][0-9]+)*$") == yes
    if name == "CURRENT-WORD-IS-URL":
        return F.col("token").rlike(r"(?i)^(https?://|www\.)\S+$|^[\w-]+(\.[\w-]+)*\.(com|org|net|edu|gov|io)$") == yes
    if name == "CURRENT-WORD-ENDS-WITH":
        return F.col("token").endswith(args[0])
    if name in ("SURROUND-TAG", "WDAND-SURROUND-TAG"):
        return _near("tag", (-1,), args[0]) & _near("tag", (1,), args[1])
    two = {"PREV-TWO-TAGS": ((-2, -1), "tag"), "NEXT-TWO-TAGS": ((1, 2), "tag"), "PREV-BIGRAM": ((-2, -1), "tag"), "NEXT-BIGRAM": ((1, 2), "tag"), "WDAND2BFR": ((-2, 0), "token"), "WDAND2AFT": ((0, 2), "token")}
    if name in two:
        (a, b), c = two[name]
        test = lambda k, v: here(c, v) if k == 0 else _near(c, (k,), v)
        return test(a, args[0]) & test(b, args[1])
    pair = re.fullmatch(r"(?:CURRENT-WORD-AND|WDAND)-?(PREV|NEXT)-?(WORD|TAG)", name)
    if pair:
        return here("token", args[0]) & _near("token" if pair[2] == "WORD" else "tag", _AT[pair[1]], args[1])
    m = re.fullmatch(r"(PREV|NEXT|CURRENT)(?:-?(1-OR-2-OR-3|1-OR-2|1OR2OR3|1OR2|2))?-(TAG|WORD)", name)
    if not m:
        raise ValueError(f"unknown condition {name}")
    at, column = _AT[m[1] + (m[2] or "").replace("-", "")], "tag" if m[3] == "TAG" else "token"
    return here(column, args[0]) if at == (0,) else _near(column, at, args[0])


@dataclass(frozen=True)
class Rule:
    """FROM TO CONDITION args; * as FROM matches every tag."""

    source: str
    to: str
    name: str
    args: tuple[str, ...] = ()

    @classmethod
    def parse(cls, line: str) -> Rule:
        source, to, name, *args = line.split()
        return cls(source, to, name, tuple(args))

    def where(self) -> Column:
        test = condition(self.name, *self.args)
        return test if self.source == "*" else (F.col("tag") == self.source) & test


#: The ten transformations of E. Brill, A Simple Rule-Based Part of Speech Tagger (1992), over Brown tags.
BRILL_1992 = (
    "TO IN NEXT-TAG AT",
    "VBN VBD PREV-WORD-IS-CAP YES",
    "VBD VBN PREV-1-OR-2-OR-3-TAG HVD",
    "VB NN PREV-1-OR-2-TAG AT",
    "NN VB PREV-TAG TO",
    "TO IN NEXT-WORD-IS-CAP YES",
    "NN VB PREV-TAG MD",
    "PPS PPO NEXT-TAG .",
    "VBN VBD PREV-TAG PPS",
    "NP NN CURRENT-WORD-IS-CAP NO",
)


def brill_1992() -> list[Rule]:
    return [Rule.parse(line) for line in BRILL_1992]


def apply_rules(tagged: DataFrame, rules: list[Rule]) -> DataFrame:
    """Each rule rewrites all its sites together, reading the tags as they stood before it; all share one partitioning."""
    for r in rules:
        tagged = tagged.withColumn("_hit", r.where()).withColumn("tag", F.when(F.col("_hit"), r.to).otherwise(F.col("tag"))).drop("_hit")
    return tagged


def evaluate(gold: DataFrame, lexicon: Lexicon, rules: list[Rule]) -> DataFrame:
    """Accuracy before and after the rules; gold has (sent, pos, token, gold)."""
    first = lexicon.annotate(gold)
    before = first.withColumn("before", F.col("tag"))
    return apply_rules(before, rules).agg(F.avg((F.col("before") == F.col("gold")).cast("double")).alias("accuracy_before"), F.avg((F.col("tag") == F.col("gold")).cast("double")).alias("accuracy"))


#: Shapes a learner may propose: one value near the site, or two values at two places (0 is the site itself).
ONE_VALUE = {f"{side}-{reach}{what}": (what.lower().replace("word", "token"), tuple(sign * k for k in places)) for side, sign in (("PREV", -1), ("NEXT", 1)) for reach, places in (("", (1,)), ("2-", (2,)), ("1-OR-2-", (1, 2)), ("1-OR-2-OR-3-", (1, 2, 3))) for what in ("TAG", "WORD")} | {"CURRENT-WORD": ("token", (0,))}
TWO_VALUES = {
    "SURROUND-TAG": (("tag", -1), ("tag", 1)), "PREV-BIGRAM": (("tag", -2), ("tag", -1)), "NEXT-BIGRAM": (("tag", 1), ("tag", 2)),
    "CURRENT-WORD-AND-PREV-TAG": (("token", 0), ("tag", -1)), "CURRENT-WORD-AND-NEXT-TAG": (("token", 0), ("tag", 1)),
    "CURRENT-WORD-AND-PREV-WORD": (("token", 0), ("token", -1)), "CURRENT-WORD-AND-NEXT-WORD": (("token", 0), ("token", 1)),
    "WDAND2BFR": (("token", -2), ("token", 0)), "WDAND2AFT": (("token", 0), ("token", 2)),
}
SHAPES = ("CURRENT-WORD-IS-CAP", "PREV-WORD-IS-CAP", "NEXT-WORD-IS-CAP", "CURRENT-WORD-IS-NUMBER", "CURRENT-WORD-IS-URL")
TEMPLATES = (*ONE_VALUE, *TWO_VALUES, *SHAPES)


def proposals(template: str) -> Column:
    """array<struct(name, args)>: the conditions of a template that hold at a row of (sent, pos, token, tag)."""
    at = lambda c, k: F.col(c) if k == 0 else F.lead(c, k).over(_sentence()) if k > 0 else F.lag(c, -k).over(_sentence())
    if template in ONE_VALUE:
        column, places = ONE_VALUE[template]
        args = F.transform(F.array_distinct(F.array_compact(F.array(*(at(column, k) for k in places)))), lambda v: F.array(v))
    elif template in TWO_VALUES:
        first, second = (at(*x) for x in TWO_VALUES[template])
        args = F.when(first.isNotNull() & second.isNotNull(), F.array(F.array(first, second))).otherwise(F.array().cast("array<array<string>>"))
    elif template in SHAPES:
        args = F.array(F.array(F.when(condition(template, "YES"), F.lit("YES")).otherwise(F.lit("NO"))))
    else:
        raise ValueError(f"unknown template {template}")
    return F.transform(args, lambda v: F.struct(F.lit(template).alias("name"), v.alias("args")))


def train_rules(gold: DataFrame, lexicon: Lexicon, templates=("PREV-TAG", "NEXT-TAG", "PREV-1-OR-2-TAG", "NEXT-1-OR-2-TAG", "PREV-WORD", "NEXT-WORD"), most: int = 10, least: int = 2) -> list[Rule]:
    """Propose a rule at every error, score what it mends less what it breaks, accept the best, repeat."""
    from .graphs import checkpointed

    state = checkpointed(lexicon.annotate(gold).select("sent", "pos", "token", "gold", "tag"))
    rules: list[Rule] = []
    while len(rules) < most:
        seen = state
        sites = seen.withColumn("_c", F.concat(*map(proposals, templates))).select("tag", "gold", F.explode("_c").alias("c"))
        counts = sites.groupBy("tag", "c", "gold").agg(F.count("*").alias("n"))
        fixes = counts.where("tag <> gold").select("tag", "c", F.col("gold").alias("to"), F.col("n").alias("fixed"))
        breaks = counts.where("tag = gold").select("tag", "c", F.col("n").alias("broken"))
        best = fixes.join(breaks, ["tag", "c"], "left").withColumn("score", F.col("fixed") - F.coalesce("broken", F.lit(0))).orderBy(F.desc("score"), "tag", "to", "c.name", "c.args").first()
        if best is None or best["score"] < least:
            break
        rules.append(Rule(best["tag"], best["to"], best["c"]["name"], tuple(best["c"]["args"])))
        state = checkpointed(apply_rules(state, rules[-1:]))
    return rules


# --- clauses

_CLASS = {"noun": "NN NNS NNP NNPS PRP WP".split(), "verb": "VB VBD VBG VBN VBP VBZ MD".split(), "adverb": "RB RBR RBS".split(), "interjection": ["UH"], "preposition": ["IN"], "wh": "WDT WP WP$ WRB".split()}


def tag_class(tag: Column) -> Column:
    out = F.lit("other")
    for name, tags in reversed(_CLASS.items()):
        out = F.when(tag.isin(*tags), name).otherwise(out)
    return out


def analyze(tagged: DataFrame) -> DataFrame:
    """(sent, pos, token, tag, in_phrase, role, sentence_type) by running flags over each sentence.

    IN opens a phrase and the first noun closes it; the predicate starts at the first verb outside a phrase;
    a sentence whose first word but adverbs and interjections is VB is a command.
    """
    upto = _sentence().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = _sentence().rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("sent")
    kind = tag_class(F.col("tag"))
    out = tagged.withColumn("_stop", F.col("token").rlike(r"^[.!?]+$")).withColumn("_k", kind)
    last_in = F.max(F.when(F.col("_k") == "preposition", F.col("pos"))).over(upto)
    last_noun = F.max(F.when(F.col("_k") == "noun", F.col("pos"))).over(before)
    out = out.withColumn("in_phrase", ~F.col("_stop") & F.coalesce(last_in.isNotNull() & (last_noun.isNull() | (last_noun < last_in)), F.lit(False)))
    out = out.withColumn("_verb", F.min(F.when((F.col("_k") == "verb") & ~F.col("in_phrase"), F.col("pos"))).over(whole))
    opening = F.min(F.when(~F.col("_k").isin("adverb", "interjection") & ~F.col("_stop"), F.struct("pos", "tag", "_k"))).over(whole)
    out = out.withColumn("_first", opening).withColumn("_end", F.max(F.when(F.col("_stop"), F.struct("pos", "token"))).over(whole)["token"])
    command = F.col("_first.tag") == "VB"
    role = F.when(F.col("_stop"), F.lit(None).cast("string")).when(F.col("in_phrase"), "prepositional").when(F.col("_verb").isNull() | (~command & (F.col("pos") < F.col("_verb"))), "subject").otherwise("predicate")
    kind_of = F.when(F.col("_end").contains("?"), "Interrogative").when(F.col("_end").contains("!"), "Exclamatory").when(command, "Command").when(F.col("_end").contains("."), "Declarative").when(F.col("_first.tag").isin(*_CLASS["wh"]), "Interrogative")
    return out.withColumn("role", role).withColumn("sentence_type", kind_of).select("sent", "pos", "token", "tag", "in_phrase", "role", "sentence_type")


def words_with_role(analyzed: DataFrame, role: str) -> DataFrame:
    chosen = analyzed.where(F.col("role") == role).groupBy("sent").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("w"))
    return chosen.select("sent", F.array_join(F.transform("w", lambda x: x["token"]), " ").alias("words"))
