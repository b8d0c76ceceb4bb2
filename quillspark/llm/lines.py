"""Line sequence labelling: a linear-chain conditional random field marks content
or boilerplate, decoded by Viterbi; the share of words in content lines decides.

The field has one emission weight per line feature and four transition weights.
It is fitted by gradient ascent on labelled documents (all lines of a document
carry its label), from a bounded sample: the ``SAMPLE_DOCS`` labelled documents
of either class with the smallest md5 of their id, ``SAMPLE_LINES`` lines each.
Everything else covers every line of every document.

Edge cases: a null or wordless text has no words and fails the base rules; lines
without a word are not labelled; no labels at all leaves the built-in weights;
long texts are judged whole; repeated rows are judged each; an empty table gives an
empty result; other columns are ignored, or kept as they are (``keep_content``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import prepare, table
from ._words import Words, mixed, prefix_hash, range_hash, steps, window_hashes, window_starts

SAMPLE_DOCS = 400
SAMPLE_LINES = 60
LEAST_WORDS = 10
WINDOW = 5
LEAST_CONTENT = 0.5
FEATURES = ("bias", "short", "symbols", "pipes", "capitals", "digits", "shouts", "repeats", "seen", "blank_end", "link")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[192:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[list(b".!?:;\"')")] = True


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


@dataclass
class Lines:
    """Counts of a slice's documents and features of its lines that have a word."""

    words: Words
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_doc: np.ndarray
    line_words: np.ndarray
    features: np.ndarray


def measure(column: pa.Array) -> Lines:
    w = Words(column, fold=False)
    raw, off, docs = w.raw, w.off, len(w.count)
    leads = _sums((raw & 0xC0) != 0x80)
    per_word = leads[w.end] - leads[w.start]
    in_words = _sums(per_word) if len(per_word) else np.zeros(1, np.int64)
    symbols = _sums(_SYMBOL[raw])
    # words in windows found twice or more in their document
    h = w.hashes()
    starts = window_starts(w.first, WINDOW)
    repeated = np.zeros(len(h) + 1, np.int64)
    if len(starts):
        g = mixed(window_hashes(h, starts, WINDOW) + w.doc[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(g, kind="stable")
        same = g[order][1:] == g[order][:-1]
        twice = np.zeros(len(g), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        np.add.at(repeated, starts[twice], 1)
        np.add.at(repeated, starts[twice] + WINDOW, -1)
    covered = _sums(np.cumsum(repeated[:-1]) > 0) if len(h) else np.zeros(1, np.int64)
    # lines: between newlines and the ends of documents
    breaks = np.flatnonzero(raw == 10)
    begin = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    doc = np.concatenate([np.arange(docs), np.searchsorted(off, breaks, "right") - 1])
    at = np.concatenate([off[:-1], breaks + 1])
    order = np.lexsort((at, doc))
    begin, doc = at[order], doc[order]
    end = np.concatenate([begin[1:] - 1, off[-1:]]) if len(begin) else begin
    last = np.concatenate([doc[1:] != doc[:-1], [True]]) if len(doc) else np.zeros(0, bool)
    end[last] = off[doc[last] + 1]
    a, b = np.searchsorted(w.start, begin), np.searchsorted(w.start, end)
    some = b > a
    begin, end, doc, a, b = begin[some], end[some], doc[some], a[some], b[some]
    key = mixed(range_hash(prefix_hash(_byte_hash(raw)), begin, end) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(begin) else np.zeros(0, np.uint64)
    order = np.argsort(key, kind="stable")
    seen = np.zeros(len(key), bool)
    seen[order[1:]] = key[order][1:] == key[order][:-1]
    dups = np.bincount(doc[seen], minlength=docs)
    # features
    n = (b - a).astype(float)
    size = np.maximum(end - begin, 1).astype(float)
    share = lambda mask: (s := _sums(mask[raw]))[end] - s[begin]
    letters = np.maximum(share(_LETTER), 1)
    same_as_last = np.zeros(len(h), bool)
    if len(h):
        same_as_last[1:] = h[1:] == h[:-1]
    again = _sums(same_as_last)
    bangs, pipes = share(raw_is(33)), share(raw_is(124))
    final = w.end[b - 1] - 1 if len(b) else np.zeros(0, np.int64)
    slashes = share(raw_is(47))
    x = np.stack(
        [np.ones(len(n)), n < 4, np.minimum((symbols[end] - symbols[begin]) / n, 4), np.minimum(pipes / n, 1), share(_UPPER) / letters, share(_DIGIT) / size, np.minimum(bangs / n, 2), (again[b] - again[np.minimum(a + 1, b)]) / n, seen, ~_END[raw[final]] if len(final) else np.zeros(0), np.minimum(slashes / n, 1)],
        axis=1,
    ).astype(float) if len(n) else np.zeros((0, len(FEATURES)))
    return Lines(w, w.count, in_words[w.first[1:]] - in_words[w.first[:-1]], symbols[off[1:]] - symbols[off[:-1]], dups, covered[w.first[1:]] - covered[w.first[:-1]], doc, b - a, x)


def raw_is(byte: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[byte] = True
    return out


def _byte_hash(raw: np.ndarray) -> np.ndarray:
    from ._words import _BYTE

    return _BYTE[raw]


@dataclass
class LineField:
    """Weights of the chain: emission (content against boilerplate) and transitions [from][to], 1 = content."""

    emission: np.ndarray = field(default_factory=lambda: np.array([3.0, -0.3, -2.5, -4.0, -3.0, -3.0, -2.0, -4.0, -1.0, -0.5, -1.5]))
    transition: np.ndarray = field(default_factory=lambda: np.array([[0.5, -0.5], [-0.5, 0.5]]))

    def decode(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Viterbi path of every document's lines; True marks content."""
        n = len(doc)
        out = np.zeros(n, bool)
        if not n:
            return out
        gain = (x @ self.emission).tolist()
        fresh = np.concatenate(([True], doc[1:] != doc[:-1])).tolist()
        (t00, t01), (t10, t11) = self.transition.tolist()
        from0, from1 = bytearray(n), bytearray(n)
        best = bytearray(n)
        s0 = s1 = 0.0
        for i in range(n):
            if fresh[i]:
                if i:
                    best[i - 1] = s1 >= s0
                s0, s1 = 0.0, gain[i]
            else:
                a, b, c, d = s0 + t00, s1 + t10, s0 + t01, s1 + t11
                from0[i] = b > a
                from1[i] = d >= c
                s0, s1 = (b if b > a else a), (d if d >= c else c) + gain[i]
        best[n - 1] = s1 >= s0
        path = bytearray(n)
        state = 0
        for i in range(n - 1, -1, -1):
            if i == n - 1 or fresh[i + 1]:
                state = best[i]
            path[i] = state
            state = from1[i] if state else from0[i]
        return np.frombuffer(bytes(path), np.uint8).astype(bool)

    def fit(self, sequences: list[tuple[np.ndarray, int]], rounds: int = 150, rate: float = 0.5, ridge: float = 1e-3) -> LineField:
        """Maximise the conditional likelihood; each sequence has one label for all its lines."""
        if not sequences or len({y for _, y in sequences}) < 2:
            return self
        longest = max(len(x) for x, _ in sequences)
        k, f = len(sequences), len(FEATURES)
        x = np.zeros((k, longest, f))
        size = np.array([len(a) for a, _ in sequences])
        for i, (a, _) in enumerate(sequences):
            x[i, : len(a)] = a
        y = np.array([b for _, b in sequences])
        here = np.arange(longest) < size[:, None]
        # classes count alike, and so do long and short documents
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) / size
        e, t = np.zeros(f), np.zeros((2, 2))
        for step in range(rounds):
            g = np.where(here, x @ e, 0.0)
            unary = np.stack([np.zeros_like(g), g], axis=2)
            forward, backward = np.zeros((k, longest, 2)), np.zeros((k, longest, 2))
            forward[:, 0] = unary[:, 0]
            for i in range(1, longest):
                forward[:, i] = np.logaddexp(forward[:, i - 1, 0, None] + t[0], forward[:, i - 1, 1, None] + t[1]) + unary[:, i]
            for i in range(longest - 2, -1, -1):
                ahead = unary[:, i + 1] + backward[:, i + 1]
                new = np.logaddexp(t[None, :, 0] + ahead[:, 0, None], t[None, :, 1] + ahead[:, 1, None])
                backward[:, i] = np.where(here[:, i + 1, None], new, 0.0)
            total = np.logaddexp(*np.moveaxis(forward[np.arange(k), size - 1], 1, 0))
            p1 = np.where(here, np.exp(forward[..., 1] + backward[..., 1] - total[:, None]), 0.0)
            de = np.einsum("k,kl,klf->f", weight, np.where(here, y[:, None] - p1, 0.0), x)
            dt = np.zeros((2, 2))
            pairs = here[:, 1:]
            for a in (0, 1):
                for b in (0, 1):
                    p = np.exp(forward[:, :-1, a] + t[a, b] + unary[:, 1:, b] + backward[:, 1:, b] - total[:, None, None][..., 0])
                    dt[a, b] = (weight[:, None] * np.where(pairs, ((y == a) & (y == b))[:, None] - p, 0.0)).sum()
            pace = rate * 20 / (1 + step / 50)
            e += pace * (de - ridge * e)
            t += pace * 0.2 * (dt - ridge * 20 * t)
        return LineField(e, t)


def fit_field(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES) -> LineField:
    """Fit on the documented sample; the driver receives at most 2 * sample * lines feature rows."""
    prepare(docs.sparkSession)
    order = F.struct(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = None
    for y in (0, 1):
        one = known.where(F.col("quality") == y).orderBy(order).limit(sample)
        chosen = one if chosen is None else chosen.unionByName(one)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            m = measure(part.column("text"))
            at = np.searchsorted(m.line_doc, np.arange(part.num_rows + 1))
            x = [m.features[a : min(b, a + lines)].ravel() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array([v.tolist() for v in x], pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    got = rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, x array<double>").collect()
    sequences = [(np.array(r["x"]).reshape(-1, len(FEATURES)), int(r["quality"])) for r in sorted(got, key=lambda r: r["doc_id"]) if r["x"]]
    return LineField().fit(sequences)


_MADE = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("content_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"))


def judge(docs: DataFrame, model: LineField, prefix: str = "", least_content: float = LEAST_CONTENT) -> DataFrame:
    """``docs`` with the counts, the words in content lines, base_failed and kept, named with ``prefix``."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            m = measure(part.column("text"))
            content = model.decode(m.features, m.line_doc)
            good = np.bincount(m.line_doc, weights=m.line_words * content, minlength=part.num_rows).astype(np.int64)
            failed = (m.n_words < LEAST_WORDS) | (100 * m.n_repeat_words > 20 * m.n_words)
            made = [m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, good]
            arrays = [pa.array(a.astype(np.int64)) for a in made] + [pa.array(failed), pa.array(~failed & (good >= least_content * m.n_words))]
            yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *(prefix + k for k, _ in _MADE)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"`{prefix}{k}` {t}" for k, t in _MADE)])
    return docs.mapInArrow(run, schema)


def keep_content(docs: DataFrame, model: LineField, least_content: float = LEAST_CONTENT) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged."""
    prefix = "ql_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return judge(docs, model, prefix, least_content).where(f"{prefix}kept").select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_field(docs, table(spark, sf_dir, "labels"))
    return judge(docs, model).drop("text")
