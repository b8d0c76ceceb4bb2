"""String distances, similarities and best-substring search.

Lengths are in code points.  Levenshtein, Hamming and Dice are built-in
expressions; the others run in Arrow batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import per_word


class CostError(ValueError):
    """A cost is negative or not finite, or the costs do not fit together."""


@dataclass(frozen=True)
class Costs:
    insertion: float = 1.0
    deletion: float = 1.0
    substitution: float = 1.0
    transposition: float | None = None

    def __post_init__(self):
        for name in ("insertion", "deletion", "substitution", "transposition"):
            v = getattr(self, name)
            if v is not None and not (math.isfinite(v) and v >= 0):
                raise CostError(f"{name} cost {v}")

    def for_damerau(self) -> Costs:
        if self.transposition is not None and 2 * self.transposition < self.insertion + self.deletion:
            raise CostError("two transpositions cost less than an insertion and a deletion")
        return self


UNIT = Costs(transposition=1.0)


def restricted(a: str, b: str, c: Costs = UNIT, transpose: bool = True) -> float:
    """Optimal string alignment; without ``transpose``, Levenshtein."""
    before, last = None, [j * c.insertion for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [i * c.deletion]
        for j, y in enumerate(b, 1):
            best = min(last[j] + c.deletion, row[j - 1] + c.insertion, last[j - 1] + (x != y) * c.substitution)
            if transpose and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, before[j - 2] + c.transposition)
            row.append(best)
        before, last = last, row
    return last[-1]


def unrestricted(a: str, b: str, c: Costs = UNIT) -> float:
    """Damerau-Levenshtein with edits between transposed symbols (Lowrance and Wagner)."""
    far = (len(a) + len(b) + 1) * max(c.insertion, c.deletion, c.substitution, c.transposition or 0, 1)
    seen: dict[str, int] = {}
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i * c.deletion
    for j in range(len(b) + 1):
        d[1][j + 1] = j * c.insertion
    for i in range(1, len(a) + 1):
        at = 0
        for j in range(1, len(b) + 1):
            k, m = seen.get(b[j - 1], 0), at
            same = a[i - 1] == b[j - 1]
            if same:
                at = j
            d[i + 1][j + 1] = min(
                d[i][j] + (0 if same else c.substitution),
                d[i + 1][j] + c.insertion,
                d[i][j + 1] + c.deletion,
                d[k][m] + (i - k - 1) * c.deletion + c.transposition + (j - m - 1) * c.insertion,
            )
        seen[a[i - 1]] = i
    return d[-1][-1]


def search(source: str, target: str, c: Costs = UNIT, transpose: bool = False) -> tuple[str, int, int, int, int, float]:
    """The substring of ``target`` nearest to ``source``: text, code point range, byte range, distance.

    Ties go to the earliest end, then to an insertion before a deletion before a substitution.
    """
    n = len(target)
    before, last = None, [(0.0, j) for j in range(n + 1)]
    for i, x in enumerate(source, 1):
        row = [(i * c.deletion, 0)]
        for j, y in enumerate(target, 1):
            best = (row[j - 1][0] + c.insertion, row[j - 1][1])
            for cost, start in ((last[j][0] + c.deletion, last[j][1]), (last[j - 1][0] + (x != y) * c.substitution, last[j - 1][1])):
                if cost < best[0]:
                    best = (cost, start)
            if transpose and i > 1 and j > 1 and x == target[j - 2] and source[i - 2] == y and before[j - 2][0] + c.transposition < best[0]:
                best = (before[j - 2][0] + c.transposition, before[j - 2][1])
            row.append(best)
        before, last = last, row
    end = min(range(n + 1), key=lambda j: (last[j][0], j))
    start = last[end][1]
    size = lambda k: len(target[:k].encode())
    return target[start:end], start, end, size(start), size(end), last[end][0]


#: Code points of targets that are searched in step, and the least number of pairs for which that pays.
TOGETHER, FEW = 1 << 20, 16


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points by place and text; places behind a text's end hold zeros."""
    flat = "".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass")
    return np.ascontiguousarray(np.frombuffer(flat, np.uint32).reshape(len(texts), width).T)


def _told(target: str, start: int, end: int, cost: float) -> tuple[str, int, int, int, int, float]:
    size = (lambda k: k) if target.isascii() else (lambda k: len(target[:k].encode()))
    return target[start:end], start, end, size(start), size(end), cost


def search_all(source: str, targets: list[str], c: Costs = UNIT, transpose: bool = False) -> list[tuple[str, int, int, int, int, float]]:
    """``search`` of one source in many targets; each cell of the table is taken for all of them at once."""
    out: list = [None] * len(targets)
    order = sorted(range(len(targets)), key=lambda k: len(targets[k]))
    at = 0
    while at < len(order):
        # texts of about one length, by less than a half, share a table
        width, end = len(targets[order[at]]), at
        while end < len(order) and len(targets[order[end]]) <= width * 3 // 2 + 8 and (end - at + 1) * (len(targets[order[end]]) + 1) <= max(TOGETHER, len(targets[order[at]]) + 1):
            end += 1
        picked = order[at:end]
        if len(picked) < FEW:
            for k in picked:
                out[k] = search(source, targets[k], c, transpose)
        else:
            texts = [targets[k] for k in picked]
            for k, t, row in zip(picked, texts, _in_step(source, texts, c, transpose)):
                out[k] = _told(t, *row)
        at = end
    return out


def _in_step(source: str, texts: list[str], c: Costs, transpose: bool) -> list[tuple[int, int, float]]:
    """(start, end, distance) in each text, by the rules of ``search``."""
    n, m = max(map(len, texts)), len(texts)
    codes = _codes(texts, n)
    costs, starts = np.zeros((n + 1, m)), np.repeat(np.arange(n + 1, dtype=np.int32)[:, None], m, 1)
    before = None
    for i, x in enumerate(source, 1):
        row, begun = np.empty_like(costs), np.empty_like(starts)
        row[0], begun[0] = i * c.deletion, 0
        for j in range(1, n + 1):
            best, start = row[j - 1] + c.insertion, begun[j - 1]
            options = [(costs[j] + c.deletion, starts[j]), (costs[j - 1] + (codes[j - 1] != ord(x)) * c.substitution, starts[j - 1])]
            for cost, s in options:
                less = cost < best
                best, start = np.where(less, cost, best), np.where(less, s, start)
            if transpose and i > 1 and j > 1:
                cost = before[0][j - 2] + c.transposition
                less = (codes[j - 2] == ord(x)) & (codes[j - 1] == ord(source[i - 2])) & (cost < best)
                best, start = np.where(less, cost, best), np.where(less, before[1][j - 2], start)
            row[j], begun[j] = best, start
        before, costs, starts = (costs, starts), row, begun
    costs = np.where(np.arange(n + 1)[:, None] <= np.fromiter(map(len, texts), np.int64, m), costs, np.inf)
    end = costs.argmin(0)
    which = np.arange(m)
    return list(zip(starts[end, which].tolist(), end.tolist(), costs[end, which].tolist()))


def jaro_value(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, mine = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                mine.append(x)
                break
    m = len(mine)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(mine, (y for j, y in enumerate(b) if used[j]))) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def jaro_winkler_value(a: str, b: str) -> float:
    j, same = jaro_value(a, b), 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j)


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def levenshtein_weighted(a: Column, b: Column, costs: Costs) -> Column:
    return per_word(lambda x, y: float(restricted(x, y, costs, False)), "double")(a, b)


def damerau_levenshtein(a: Column, b: Column) -> Column:
    return per_word(lambda x, y: int(unrestricted(x, y)), "int")(a, b)


def damerau_levenshtein_weighted(a: Column, b: Column, costs: Costs) -> Column:
    costs.for_damerau()
    return per_word(lambda x, y: float(unrestricted(x, y, costs)), "double")(a, b)


def osa(a: Column, b: Column) -> Column:
    return per_word(lambda x, y: int(restricted(x, y)), "int")(a, b)


def osa_weighted(a: Column, b: Column, costs: Costs) -> Column:
    return per_word(lambda x, y: float(restricted(x, y, costs)), "double")(a, b)


def best_substring(source: Column, target: Column, costs: Costs = UNIT, transpose: bool = False) -> Column:
    kind = "struct<substring:string,start:int,end:int,start_byte:int,end_byte:int,distance:double>"
    names = ("substring", "start", "end", "start_byte", "end_byte", "distance")

    def run(a, b):
        import pandas as pd

        found: list = [None] * len(a)
        places: dict[str, list[int]] = {}
        for k, x in enumerate(a):
            places.setdefault(x, []).append(k)
        targets = b.tolist()
        for x, at in places.items():
            for k, row in zip(at, search_all(x, [targets[k] for k in at], costs, transpose)):
                found[k] = row
        return pd.DataFrame(found, columns=list(names))

    import pandas as pd

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, kind)(F.coalesce(source, F.lit("")), F.coalesce(target, F.lit("")))


class PreparedPattern:
    """A pattern measured against a column: its bits are laid out once, and a text takes a step a symbol (Myers' bit vectors)."""

    def __init__(self, pattern: str):
        self.pattern, self.n, self.masks = pattern, len(pattern), {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance_to(self, text: str) -> int:
        """Levenshtein distance, in code points."""
        if not self.n:
            return len(text)
        full, top = (1 << self.n) - 1, 1 << (self.n - 1)
        up, down, score = full, 0, self.n
        for c in text:
            same = self.masks.get(c, 0)
            x = (((same & up) + up) ^ up) | same | down
            plus, minus = down | (full & ~(x | up)), up & x
            score += bool(plus & top) - bool(minus & top)
            plus = plus << 1 | 1
            up, down = (minus << 1 | ~((same | down) | plus)) & full, plus & (same | down)
        return score

    def levenshtein(self, text: Column) -> Column:
        return per_word(self.distance_to, "int")(text)

    def within(self, text: Column, k: int) -> Column:
        """The distance, or null beyond ``k``."""
        d = self.levenshtein(text)
        return F.when(d <= k, d)


def hamming(a: Column, b: Column) -> Column:
    """Places that differ; null unless both have as many code points."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, 0).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x)))


def jaro(a: Column, b: Column) -> Column:
    return per_word(jaro_value, "double")(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return per_word(jaro_winkler_value, "double")(a, b)


def dice_coefficient(a: Column, b: Column) -> Column:
    """Twice the shared distinct bigrams over the sum of both; texts without a bigram are alike only if equal."""
    from .text import char_ngrams

    x, y = F.array_distinct(char_ngrams(a, 2)), F.array_distinct(char_ngrams(b, 2))
    total = F.size(x) + F.size(y)
    return F.when(total == 0, (a == b).cast("double")).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)
