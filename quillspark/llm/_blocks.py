"""Winnowed blocks: runs of windows that share their smallest gram.

Equal windows have the same smallest gram, so all places of a window lie in
blocks with one ``gram``.  Blocks with equal content are settled as a whole;
blocks that share a gram but differ in content are compared on their bytes, in
shares of one key each.  A key with more content than a share holds is split by
longer common content: the windows of a block are divided by the place of their
smallest gram, and each division is keyed by all that its windows have in
common.  The last division is a window by itself, so every key fits in the end.

Contents are told apart by 64 bits of BLAKE2b beside the key; what a share
compares are bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import stage
from ._words import _BYTE, Words, mixed, inverse_powers, prefix_hash, steps, text_buffers, window_starts

NODE_BYTES = 12
#: A filter is so many rows of eight 64-bit words: its size, and so what is broadcast, is fixed.
FILTER_ROWS, FILTER_WORDS = 1 << 17, 8
#: Parts into which the offsets of a key's windows are divided at each split.
DIVISIONS = 8


class Symbols:
    """A slice's documents as symbols: bytes, or the hashes of its words."""

    def __init__(self, column: pa.Array, words: bool):
        self.words = words
        if words:
            w = Words(column, fold=False)
            self.first, hashes = w.first, w.hashes()
            self.place = np.concatenate(([0], np.cumsum(w.end - w.start + 1)))
            whole = w.raw.tobytes()
            self.data = b" ".join(b"\n".join(whole[a:b] for a, b in zip(w.off[:-1].tolist(), w.off[1:].tolist())).split())
        else:
            raw, self.first = text_buffers(column)
            hashes, self.place, self.data = _BYTE[raw], None, raw.tobytes()
        self.prefix = prefix_hash(hashes)

    def content(self, lo: int, hi: int) -> bytes:
        """Symbols lo..hi - 1 of the slice; words are joined by one blank."""
        return self.data[self.place[lo] : self.place[hi] - 1] if self.words else self.data[lo:hi]


def digest(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)


def _all_hashes(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` symbols from every place; those that cross documents are not used."""
    n = len(prefix) - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mixed((prefix[size:] - prefix[:-size]) * inverse_powers(n)[:n] + np.uint64(size))


def find_blocks(s: Symbols, gram: int, window: int):
    """(document, lo, hi, gram hash, inside): windows lo..hi in places of the slice.

    ``inside`` tells that the smallest gram stands in the block twice, so that windows of the block may be equal.
    """
    starts = window_starts(s.first, window)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    grams = _all_hashes(s.prefix, gram)
    least, size, span = grams, 1, window - gram + 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    least = least[starts]
    doc = np.repeat(np.arange(len(s.first) - 1), np.maximum(np.diff(s.first) - window + 1, 0))
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    lo, hi, least = starts[at], starts[np.append(at[1:], len(starts)) - 1], least[at]
    inside = np.zeros(len(at), bool)
    if not s.words:
        for a in range(0, len(at), 8192):  # bounds the places looked at together
            l, sizes = lo[a : a + 8192], (hi - lo)[a : a + 8192] + span
            begin = np.cumsum(sizes) - sizes
            places = np.arange(int(sizes.sum())) + np.repeat(l - begin, sizes)
            inside[a : a + 8192] = np.add.reduceat((grams[places] == np.repeat(least[a : a + 8192], sizes)).astype(np.int64), begin) > 1
    return doc[at], lo, hi, least, inside


_PACKED = "sha binary, n long, kept_sha string, gram binary, body binary, lo binary, hi binary"


def scan(docs: DataFrame, words: bool, gram: int, window: int) -> DataFrame:
    """doc_id with the text's SHA-256, its length in symbols, the hash of what stays if nothing goes, and packed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            s = Symbols(part.column("text"), words)
            doc, lo, hi, g, inside = find_blocks(s, gram, window)
            at = np.searchsorted(doc, np.arange(part.num_rows + 1))
            h = np.fromiter((digest(s.content(a, b)) for a, b in zip(lo.tolist(), (hi + window).tolist())), np.int64, len(lo))
            lo, hi = (lo - s.first[doc]).astype(np.uint32), (hi - s.first[doc]).astype(np.uint32) | (inside.astype(np.uint32) << 31)
            rows = [[] for _ in range(6)]
            for i, (a, b, text) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), part.column("text").to_pylist())):
                sha = hashlib.sha256((text or "").encode())
                rows[0].append(sha.digest())
                rows[1].append(hashlib.sha256(s.content(*s.first[i : i + 2]) if s.first[i] < s.first[i + 1] else b"").hexdigest() if words else sha.hexdigest())
                for k, x in enumerate((g, h, lo, hi)):
                    rows[2 + k].append(x[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(rows[0], pa.binary()), pa.array(np.diff(s.first), pa.int64()), pa.array(rows[1], pa.string()), *(pa.array(x, pa.binary()) for x in rows[2:])],
                names=["doc_id", "sha", "n", "kept_sha", "gram", "body", "lo", "hi"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + _PACKED)


_BLOCK = "gram long, key long, body long, node binary, doc long, lo int, hi int, inside boolean"


def unpack(rows: DataFrame) -> DataFrame:
    """A row per block: gram, key (the gram), body, node, doc, lo, hi, inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lo = [np.frombuffer(x.as_py(), np.uint32) for x in part.column("lo")]
                sizes = np.array([len(x) for x in lo])
                if not sizes.sum():
                    continue
                whole = lambda name, kind: np.frombuffer(b"".join(part.column(name).to_pylist()), kind)
                take = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                hi, gram = whole("hi", np.uint32), pa.array(whole("gram", np.int64))
                yield pa.RecordBatch.from_arrays(
                    [gram, gram, pa.array(whole("body", np.int64)), part.column("node").take(take), part.column("doc_id").take(take), pa.array(np.concatenate(lo).astype(np.int32)), pa.array((hi & 0x7FFFFFFF).astype(np.int32)), pa.array(hi >> 31 == 1)],
                    names=["gram", "key", "body", "node", "doc", "lo", "hi", "inside"],
                )

    return rows.select("node", "doc_id", "gram", "body", "lo", "hi").mapInArrow(run, _BLOCK)


def _spot(column: str) -> tuple[str, str, str]:
    """SQL of the row, the word and the bit of a value in a filter."""
    h = f"xxhash64(`{column}`)"
    return f"{h} & {FILTER_ROWS - 1}L", f"cast(shiftright({h}, 17) & {FILTER_WORDS - 1}L as int)", f"cast(shiftright({h}, 20) & 63L as int)"


def bits_of(keys: DataFrame, column: str) -> DataFrame:
    """A one-hash Bloom filter of ``column``: at most ``FILTER_ROWS`` rows, 9 MB, whatever the number of keys."""
    row, word, bit = _spot(column)
    spots = keys.selectExpr(f"{row} as _row", f"{word} as _word", f"shiftleft(1L, {bit}) as _set")
    return stage(spots.groupBy("_row").agg(*(F.bit_or(F.expr(f"if(_word = {k}, _set, 0L)")).alias(f"_w{k}") for k in range(FILTER_WORDS))), "filter")


def perhaps(rows: DataFrame, column: str, bits: DataFrame, told: str = "_maybe") -> DataFrame:
    """``rows`` with a column ``told``: false where ``column`` is surely none of the filter's keys."""
    row, word, bit = _spot(column)
    own = "_f"
    while any(c.lower().startswith(own) for c in rows.columns):
        own += "_"
    held = f"element_at(array({', '.join(f'{own}w{k}' for k in range(FILTER_WORDS))}), {word} + 1)"
    joined = rows.withColumn(f"{own}row", F.expr(row)).join(F.broadcast(bits.select(*(F.col(c).alias(own + c[1:]) for c in bits.columns))), f"{own}row", "left")
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), F.expr(f"coalesce(shiftright({held}, {bit}) & 1L = 1L, false)").alias(told))


def within(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` joined with the rows of ``keys``; only rows that the filter lets through are shuffled."""
    return perhaps(rows, column, bits_of(keys, column)).where("_maybe").drop("_maybe").join(keys.hint("merge"), column)


def node_of(sha) -> F.Column:
    return F.substring(sha, 1, NODE_BYTES)


def texts_of(docs: DataFrame, per_node: DataFrame, name: str) -> DataFrame:
    """One row a node of ``per_node`` with its text; ``per_node`` has binary columns a worker reads."""
    told = stage(per_node, name)
    keyed = docs.select(node_of(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))).alias("node"), "text")
    asked = perhaps(keyed, "node", bits_of(told, "node")).where("_maybe").drop("_maybe")
    # a text's copies are dropped by the tasks that read them, so that they do not meet in one
    return asked.dropDuplicates(["node"]).join(told.hint("merge"), "node")


def contents(joined: DataFrame, words: bool, window: int) -> DataFrame:
    """(key, node, doc, at, data) for the blocks listed in ``blocks`` of each row (node, text, blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            s = Symbols(part.column("text"), words)
            rows = [[] for _ in range(5)]
            for first, node, blocks in zip(s.first.tolist(), part.column("node").to_pylist(), part.column("blocks").to_pylist()):
                for b in blocks:
                    for out, x in zip(rows, (b["key"], node, b["doc"], b["lo"], s.content(first + b["lo"], first + b["hi"] + window))):
                        out.append(x)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names=["key", "node", "doc", "at", "data"])

    return joined.mapInArrow(run, "key long, node binary, doc long, at int, data binary")


def widths(gram: int, window: int) -> list[int]:
    """Offsets of the smallest gram that a division holds, split by split, down to one."""
    out, width = [], window - gram + 1
    while width > 1:
        width = -(-width // DIVISIONS)
        out.append(width)
    return out


def divided(joined: DataFrame, words: bool, gram: int, window: int, width: int) -> DataFrame:
    """Blocks of the rows (node, text, blocks), divided: windows with one place of the smallest gram, give or take ``width``."""
    span = window - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            s = Symbols(part.column("text"), words)
            grams = _all_hashes(s.prefix, gram).view(np.int64)
            rows = [[] for _ in range(8)]
            for first, node, blocks in zip(s.first.tolist(), part.column("node").to_pylist(), part.column("blocks").to_pylist()):
                for b in blocks:
                    start = np.arange(b["lo"], b["hi"] + 1) + first
                    places = np.flatnonzero(grams[start[0] : start[-1] + span] == b["gram"]) + start[0]
                    anchor = places[np.searchsorted(places, start)]  # the first in the window
                    cell = (anchor - start) // width
                    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(cell) != 0))
                    for i, j in zip([0, *(cut + 1).tolist()], [*cut.tolist(), len(start) - 1]):
                        a, c = int(anchor[i]), int(cell[i])
                        common = s.content(a - c * width, a - min((c + 1) * width - 1, span - 1) + window)
                        key, body = digest(b"%d:%d:" % (width, c) + common), digest(s.content(int(start[i]), int(start[j]) + window))
                        for out, x in zip(rows, (b["gram"], key, body, node, b["doc"], int(start[i]) - first, int(start[j]) - first, False)):
                            out.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names=["gram", "key", "body", "node", "doc", "lo", "hi", "inside"])

    return joined.mapInArrow(run, _BLOCK)


def listed(rows: DataFrame) -> DataFrame:
    """(node, blocks): what is to be read of each text."""
    return rows.groupBy("node").agg(F.collect_list(F.struct("gram", "key", "doc", "lo", "hi")).alias("blocks"))


def runs(places: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive places."""
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.concatenate(([0], cut + 1))].tolist(), places[np.append(cut, len(places) - 1)].tolist())) if len(places) else []


def in_shares(rows: DataFrame, compare, least: int) -> DataFrame:
    """(node, doc, lo, hi) that ``compare`` flags in the contents of whole keys, at least ``least`` bytes at a time.

    ``compare`` takes a list of (key, node, doc, data) and returns an array of flagged places for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def settle() -> pa.RecordBatch:
            flagged = compare([(key, node, doc, data) for key, node, doc, _, data in held])
            out = [(node, doc, at + a, at + b) for (_, node, doc, at, _), places in zip(held, flagged) for a, b in runs(places)]
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["node", "doc", "lo", "hi"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("key", "node", "doc", "at", "data"))):
                if row[0] != last and size >= least:
                    yield settle()
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
                last = row[0]
        if held:
            yield settle()

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "node binary, doc long, lo int, hi int")


def covered(lo: np.ndarray, hi: np.ndarray, window: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of the windows lo..hi."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi + window, -1)
    inside = np.concatenate(([0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
