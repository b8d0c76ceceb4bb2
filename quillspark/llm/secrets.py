"""Secret scans with DataFrame functions only.

Base spans are leftmost matches of three patterns.  The entropy scan adds spans.
Candidate strings hold letters and digits; base spans are blanked before they are
sought.  A window slides over a candidate: the counts of its symbols are kept,
five bits each, and every step adds the symbol that enters, takes off the one
that leaves, and changes the sum of n * log2(n) by these two counts.  Windows at
or over the threshold of the candidate's character class merge to spans.  Windows
inside a stretch of the allow-list (identifiers of words and numbers, UUIDs,
alphabets) are suppressed; the rest of such a candidate is not.

Edge cases: null and empty texts have no span; offsets are code points; very
long texts are scanned whole; repeated rows are reported each; an empty table
gives an empty result; other columns are ignored (``find_secrets``) or kept,
whatever their names (``redact``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import table


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
ASSIGN = rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run shorter than asked for cannot hold a longer one, so the length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
WINDOW = 20
_CLASS = "[A-Za-z0-9+/_=-]"
#: Strings worth a window: as many symbols or more, with a digit and a letter.
CANDIDATE = rf"(?<!{_CLASS})(?={_CLASS}{{{WINDOW}}})(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z]){_CLASS}++"
#: Character classes, the first that fits a whole candidate, and the bits a symbol needs in a window: of random
#: strings of 24 symbols or more about 99 in 100 have a window over them.
CLASSES = (("hex", "^[0-9A-Fa-f]+$", 3.0), ("upper", "^[A-Z0-9+/_=-]+$", 3.4), ("lower", "^[a-z0-9+/_=-]+$", 3.4), ("mixed", "", 3.6))
#: Stretches that are no secrets; possessive, as a loop over groups would take a stack frame for each.
_WORD = "(?:[A-Za-z]++[0-9]{0,4}+|[0-9]++)(?![A-Za-z0-9])"
ALLOWED = "|".join((
    r"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])",
    rf"(?<![A-Za-z0-9]){_WORD}(?:[-_/=+]++{_WORD})*+[-_/=+]*+",
    r"(?:[Aa][Bb][Cc][Dd][Ee][Ff][Gg][Hh][Ii][Jj][Kk][Ll][Mm][Nn][Oo][Pp][Qq][Rr][Ss][Tt][Uu][Vv][Ww][Xx][Yy][Zz]|0123456789|1234567890)++",
))
#: Symbols of a candidate whose windows are scanned together; a longer one is cut into overlapping pieces.
PIECE = 256
#: Counts are kept in 64-bit words, so many to a word.
SYMBOLS, COUNT_BITS, PER_WORD = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 5, 12
#: n * log2(n) is summed in whole millionths, so that sums do not depend on their order.
UNIT = 10**6


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of a pattern's matches, in code points."""
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    empty = F.from_json(F.lit("[]"), "array<struct<start:long,end:long,value:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), x["value"].alias("value")))).alias("out"))

    zipped = F.filter(found, lambda x: x["value"].isNotNull())
    walked = F.aggregate(zipped, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def _kind(found: Column, order: int, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _hot_windows(chars: Column, window: int, most: Column) -> Column:
    """1-based end positions of the windows of the bound array ``chars`` whose sum of n * log2(n) is at most ``most`` units."""
    gain = [round(UNIT * ((n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0))) for n in range(window)]
    gains = F.array(*(F.lit(g).cast("long") for g in gain))
    code = lambda c: F.instr(F.lit(SYMBOLS), c) - 1
    codes = F.transform(chars, code)
    none = F.array(*[F.lit(0).cast("long")] * -(-len(SYMBOLS) // PER_WORD))

    def held(counts: Column, k: Column) -> Column:
        word = F.get(counts, F.floor(k / PER_WORD).cast("int"))
        return F.call_function("shiftright", word, (k % PER_WORD * COUNT_BITS).cast("int")).bitwiseAND((1 << COUNT_BITS) - 1).cast("int")

    def added(counts: Column, k: Column, by: int) -> Column:
        one = F.call_function("shiftleft", F.lit(by).cast("long"), (k % PER_WORD * COUNT_BITS).cast("int"))
        return F.transform(counts, lambda w, j: F.when(j == F.floor(k / PER_WORD), w + one).otherwise(w))

    def slide(acc: Column, x: Column) -> Column:
        # the leaving symbol goes first, so no count exceeds the window
        leaves = x["out"].isNotNull()
        fewer = F.when(leaves, added(acc["counts"], x["out"], -1)).otherwise(acc["counts"])
        less = F.when(leaves, F.get(gains, held(acc["counts"], x["out"]) - 1)).otherwise(F.lit(0).cast("long"))
        # bound as lambda variables, since an expression in a lambda is evaluated wherever it stands
        now = F.transform(F.array(F.struct(fewer.alias("counts"), (acc["sum"] - less).alias("sum"))), lambda y: F.struct(added(y["counts"], x["in"], 1).alias("counts"), (y["sum"] + F.get(gains, held(y["counts"], x["in"]))).alias("sum")))
        hot = lambda y: (x["i"] >= window) & (y["sum"] <= most)
        return F.transform(now, lambda y: F.struct(y["counts"].alias("counts"), y["sum"].alias("sum"), F.when(hot(y), F.concat(acc["hot"], F.array(x["i"]))).otherwise(acc["hot"]).alias("hot")))[0]

    moves = lambda c: F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.struct(i.alias("i"), F.get(c, i - 1).alias("in"), F.when(i > window, F.get(c, i - 1 - window)).alias("out")))
    start = F.struct(none.alias("counts"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("hot"))
    return F.flatten(F.transform(F.array(codes), lambda c: F.aggregate(moves(c), start, slide, lambda acc: acc["hot"])))


def _hot_ends(value: Column, window: int, most: Column) -> Column:
    """``_hot_windows`` of a whole string, piece by piece: linear in its length."""

    def of_string(x: Column) -> Column:
        begins = F.sequence(F.lit(0), F.greatest(F.size(x["chars"]) - window, F.lit(0)), F.lit(PIECE))
        pieces = F.transform(begins, lambda at: F.struct(at.alias("at"), F.slice(x["chars"], at + 1, F.lit(PIECE + window - 1)).alias("chars")))
        return F.flatten(F.transform(pieces, lambda p: F.transform(_hot_windows(p["chars"], window, x["most"]), lambda i: i + p["at"])))

    return F.flatten(F.transform(F.array(F.struct(F.split(value, "").alias("chars"), most.alias("most"))), of_string))


def _blanked(text: Column, base: Column) -> Column:
    """``text`` with blanks in place of the spans, sorted by start; as long as before."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(acc: Column, x: Column) -> Column:
        kept = F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        gap = F.repeat(F.lit(" "), F.greatest(x["end"] - F.greatest(acc["at"], x["start"]), F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], F.array(kept, gap)).alias("out"))

    whole = F.aggregate(base, start, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(base) > 0, whole).otherwise(text)


def _entropy_spans(text: Column, window: int) -> Column:
    empty = F.from_json(F.lit("[]"), "array<struct<start:long,end:long>>")
    limit = lambda bits: F.lit(round(UNIT * window * (math.log2(window) - bits))).cast("long")

    def merge(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = (F.size(acc) > 0) & (last["end"] >= x["start"])
        return F.when(joined, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), x["end"].alias("end"))))).otherwise(F.concat(acc, F.array(x)))

    def spans(x: Column) -> Column:
        most = limit(CLASSES[-1][2])
        for _, pattern, bits in reversed(CLASSES[:-1]):
            most = F.when(x["value"].rlike(pattern), limit(bits)).otherwise(most)
        ends = _hot_ends(x["value"], window, most)
        allowed = F.filter(_matches(x["value"], ALLOWED), lambda y: y["end"] - y["start"] >= window)
        hot = F.flatten(F.transform(F.array(F.struct(ends.alias("ends"), allowed.alias("allowed"))), lambda y: F.filter(y["ends"], lambda i: ~F.exists(y["allowed"], lambda z: (z["start"] <= i - window) & (i <= z["end"])))))
        return F.aggregate(F.transform(hot, lambda i: F.struct((x["start"] + i - window).alias("start"), (x["start"] + i).alias("end"))), empty, merge)

    return F.flatten(F.transform(_matches(text, CANDIDATE), spans))


def _free(docs: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until ``docs`` has no such columns."""
    taken = {c.lower() for c in docs.columns}
    while taken & set(names):
        names = tuple(f"{n}_" for n in names)
    return list(names)


def with_spans(docs: DataFrame, text: str = "text", window: int = WINDOW, names: tuple[str, str] = ("base", "spans")) -> DataFrame:
    """``docs`` with two columns more: base spans, and all spans, as arrays of (start, order, end, kind), sorted."""
    base, spans = names
    (masked,) = _free(docs, "masked")
    body = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(_matches(body, ASSIGN), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= 12)
    found = F.array_sort(F.concat(_kind(assign, 0, "assign"), _kind(_matches(body, ACCESS), 1, "access"), _kind(_matches(body, HEX), 2, "hex")))
    rows = docs.withColumn(base, found).withColumn(masked, _blanked(body, F.col(base)))
    return rows.withColumn(spans, F.array_sort(F.concat(F.col(base), _kind(_entropy_spans(F.col(masked), window), 3, "entropy")))).drop(masked)


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of ``docs``."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return with_spans(docs.select("doc_id", "text")).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Every span replaced by ``mark`` (overlapping ones by one), n_chars, where there is one, set anew where texts changed."""
    base, spans, new = _free(docs, "base", "spans", "new")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(acc: Column, x: Column) -> Column:
        overlaps = (x["start"] < acc["at"]) & (acc["at"] > 0)
        kept = F.substr(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(overlaps, acc["out"]).otherwise(F.concat(acc["out"], F.array(kept, F.lit(mark)))).alias("out"))

    done = F.aggregate(spans, start, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    hit = F.size(spans) > 0
    out = with_spans(docs, names=(base, spans)).withColumn(new, F.when(hit, done).otherwise(F.col("text")))
    changed = {"text": F.col(new).alias("text"), "n_chars": F.when(hit, F.length(new).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")}
    return out.select(*[changed[c] if c in changed else F.col(f"`{c}`") for c in docs.columns])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
