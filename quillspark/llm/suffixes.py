"""Suffix-array deduplication of byte strings by the difference-cover algorithm.

Suffixes need sorting only where texts share some of their content, so texts are
first cut into winnowed blocks (runs of windows with one smallest gram; equal
windows lie in blocks of one gram).  Blocks with equal content are settled as a
whole.  The contents of the others are dealt out by key and each task sorts its
share: triples at places not divisible by three are sorted and named, names that
tie are sorted by recursion on the string of names, the remaining suffixes are
sorted by their first byte and the rank behind it and merged, and adjacent
suffixes are compared over ``LENGTH`` bytes.  All places of a string share its
key, so no task misses a match.  A key with more than ``SHARE_BYTES`` of content
is first divided by longer common content, as ``_blocks`` tells, until it fits.

Edge cases: null and empty texts have no byte; texts under ``LENGTH`` bytes keep
all; equal texts are one class (all of it goes if it is long enough); repeats
inside one text count; rows with a null or shared id are rows of their own; a
text of any length is scanned as one; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import bits_of, contents, covered, divided, in_shares, listed, node_of, perhaps, scan, texts_of, unpack, widths, within
from ._cluster import prepare, stage, table
from ._words import steps

LENGTH, GRAM = 400, 128
#: Bytes of content that one key may bring to a sort; keys are sorted together from so many bytes on.
SHARE_BYTES = 1 << 20


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers by difference cover modulo 3; a shorter suffix sorts before its extensions."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(text[i:])), np.int64)
    s = np.zeros(n + 3, np.int64)
    s[:n] = text + 1
    # sort the sampled triples, at places 1 and 2 modulo 3 (and n, if it is such a place, to end the first string)
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    top = int(s.max()) + 1
    if top <= 1 << 21:
        key = (s[sampled] * top + s[sampled + 1]) * top + s[np.minimum(sampled + 2, n + 2)]
        order = np.argsort(key)
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
    else:
        cols = [s[np.minimum(sampled + k, n + 2)] for k in (2, 1, 0)]
        order = np.lexsort(cols)
        new = np.ones(len(order), bool)
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in cols], axis=0)
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new) - 1
    if not new.all():
        # recurse on the names
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sampled[order]] = np.arange(1, len(order) + 1)
    first = sampled[order]
    first = first[first < n]
    # the remaining suffixes by first symbol and the rank behind it
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(s[rest] * (len(first) + 2) + rank[rest + 1])]
    # merge: a sampled place p counts the remaining suffixes before it
    return _merge(s, rank, first, rest)


def _merge(s: np.ndarray, rank: np.ndarray, first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Every sampled suffix searched among the remaining ones: by (symbol, rank) at places 1, by (symbol, symbol, rank) at places 2 modulo 3."""
    top, ranks = int(s.max()) + 1, len(first) + 2
    place = np.empty(len(first), np.int64)
    for kind in (1, 2):
        own = first % 3 == kind
        p = first[own]
        if kind == 1:
            hay, needle = s[rest] * ranks + rank[rest + 1], s[p] * ranks + rank[p + 1]
        else:
            low = lambda q: s[q + 1] * ranks + rank[q + 2]
            if top * top * ranks < 1 << 62:
                hay, needle = s[rest] * (top * ranks) + low(rest), s[p] * (top * ranks) + low(p)
            else:  # one dense rank for both
                _, dense = np.unique(np.concatenate([low(rest), low(p)]), return_inverse=True)
                hay, needle = s[rest] * (len(dense) + 1) + dense[: len(rest)], s[p] * (len(dense) + 1) + dense[len(rest) :]
        place[own] = np.searchsorted(hay, needle)
    out = np.empty(len(first) + len(rest), np.int64)
    place += np.arange(len(first))
    taken = np.zeros(len(out), bool)
    taken[place] = True
    out[place] = first
    out[~taken] = rest
    return out


def repeated_places(contents: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, the places whose ``length`` bytes start at another place of any of the strings."""
    sizes = np.array([len(c) for c in contents])
    joined = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    symbols = joined.astype(np.int64) + 1
    symbols[ends] = 0
    order = suffix_array(symbols)
    room = np.repeat(ends, sizes + 1) - np.arange(len(joined))
    order = order[room[order] >= length]
    # adjacent prefixes, eight bytes at a time, as long as they agree
    padded = np.concatenate([joined, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(joined),), np.dtype("<u8"), padded.tobytes(), 0, (1,))
    same = np.arange(max(len(order) - 1, 0))
    steps_ = [*range(0, length - 7, 8), length - 8] if length >= 8 else None
    if steps_ is None:
        same = same[[joined[a : a + length].tobytes() == joined[b : b + length].tobytes() for a, b in zip(order[:-1], order[1:])]] if len(same) else same
    else:
        for k in reversed(steps_):
            same = same[eights[order[same] + k] == eights[order[same + 1] + k]]
    hit = np.zeros(len(joined), bool)
    hit[order[same]] = True
    hit[order[same + 1]] = True
    begin = ends - sizes
    return [np.flatnonzero(hit[a : a + n]) for a, n in zip(begin.tolist(), sizes.tolist())]


def _one_a_class(base: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows of ``base`` with one for each text: copies are alike, so any of them will do."""
    told = perhaps(base, "node", bits_of(copies, "node"))
    placed = told.where("_maybe").join(copies.select("node", F.lit(True).alias("_copied")), "node", "left")
    met = placed.where("_copied").groupBy("node").agg(*(F.min(c).alias(c) for c in base.columns if c != "node"))
    return told.where("not _maybe").select(*base.columns).unionByName(placed.where("_copied is null").select(*base.columns)).unionByName(met.select(*base.columns))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, share: int = SHARE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    base = stage(scan(docs, False, gram, length).withColumn("node", node_of(F.col("sha"))).drop("sha"), "suffix-scan")
    copies = stage(base.groupBy("node").agg(F.count("*").alias("_n")).where("_n > 1").select("node"), "suffix-copies")
    blocks = unpack(_one_a_class(base, copies))
    shared = stage(blocks.groupBy("gram").agg(F.count("*").alias("_n"), F.max("inside").alias("_in")).where("_n > 1 or _in").select("gram"), "suffix-grams")
    met = stage(within(blocks, shared, "gram"), "suffix-met")
    flagged = []
    for width in [*widths(gram, length), None]:
        bodies = stage(met.groupBy("key", "body").agg(F.count("*").alias("n"), F.min(F.struct("node", "lo", "hi")).alias("p"), F.max("inside").alias("inside"), F.max("gram").alias("gram")), "suffix-bodies")
        keys = bodies.groupBy("key").agg(F.count("*").alias("_n"), F.max("inside").alias("_in"), F.sum(F.col("p.hi") - F.col("p.lo") + 1 + length).alias("bytes")).where("_n > 1 or _in").select("key", "bytes")
        flagged.append(met.join(bodies.where("n > 1").select("key", "body"), ["key", "body"], "left_semi").select("node", "lo", "hi"))
        # one place of every content whose key has others
        todo = stage(bodies.join(keys, "key").select("gram", "key", "p.node", F.lit(0).cast("long").alias("doc"), "p.lo", "p.hi", "bytes"), "suffix-todo")
        dealt = contents(texts_of(docs, listed(todo.where(F.col("bytes") <= share)), "suffix-open"), False, length)
        flagged.append(stage(in_shares(dealt, lambda held: repeated_places([data for *_, data in held], length), share), "suffix-flagged").select("node", "lo", "hi"))
        large = todo.where(F.col("bytes") > share)
        if not large.limit(1).count():
            break
        parts = stage(divided(texts_of(docs, listed(large), "suffix-large"), False, gram, length, width), "suffix-parts")
        met = stage(parts.join(parts.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"), "key", "left_semi"), "suffix-met")
    spans = flagged[0]
    for more in flagged[1:]:
        spans = spans.unionByName(more)
    spans = spans.join(copies, "node", "left_anti").groupBy("node").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            removed, runs, shas = [], [], []
            for text, spans in zip(part.column("text"), part.column("spans")):
                raw = (text.as_py() or "").encode()
                lo, hi = (np.asarray(spans.values.field(k)).astype(np.int64) for k in ("lo", "hi"))
                starts, ends = covered(lo, hi, length, len(raw))
                sha, at = hashlib.sha256(), 0
                for a, b in zip(starts.tolist(), ends.tolist()):
                    sha.update(raw[at:a])
                    at = b
                sha.update(raw[at:])
                removed.append(int((ends - starts).sum()))
                runs.append(len(starts))
                shas.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas)], names=["node", "_removed", "_runs", "_sha"])

    cuts = stage(texts_of(docs, spans, "suffix-spans").mapInArrow(cut, "node binary, _removed long, _runs long, _sha string"), "suffix-cuts")
    rows = base.select("doc_id", "node", "n", "kept_sha").join(cuts.unionByName(copies.select("node", F.lit(True).alias("_copied")), allowMissingColumns=True), "node", "left")
    gone = F.col("_copied").isNotNull() & (F.col("n") >= length)
    return rows.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(gone, F.col("n")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("_runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("_sha", "kept_sha")).alias("kept_sha256"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
