"""Language-model scoring by online logistic context mixing.

A text is coded token by token.  A token is a unit: the white space before a word
and the word, behind a byte for the class of the symbol before it; the last unit
ends in an end symbol.  First comes a flag: has this unit followed the unit before
it in the training texts?  The flag is a bit predicted by four hashed contexts (the
last three flags of the text, how often the unit before it occurs, and both
together), mixed with gated weights and refined by an adaptive map.  All of these
learn online, in the order of the text, and start anew with every text.  A known
successor is then told among the successors of the unit before it, by exact counts
over all training texts.

Any other unit is spelled.  Every bit of its symbols is predicted by ``ORDERS``
hashed contexts (0 to 4 symbols back, and the unit so far), whose exact counts come
from all training texts.  Their stretched probabilities are mixed with weights
gated by bit position and by how much the longest context has seen; the mix is
refined by an adaptive probability map and squashed.  These weights and this map
learn online over the units, each as often as it occurs, predicted as if one
occurrence had not been counted; tasks learn apart and are averaged by evidence.
The score is the log10 probability of all bits; a training text's own occurrence
of a pair is not counted for it.

Spelling depends on the unit alone, so units are gathered once: every slice of
documents sends its distinct units to buckets of the word, where counts of words
and units meet, are spelled once, and are sent back.  Counts of contexts meet the
same way: a bucket sends each distinct pair of context and symbol to the share of
the context, and gets the counts along the symbol's bits back.  Pairs of units meet
by a hash of 32 bits in a share told by both units' buckets, so that neither a
frequent unit nor its successors load one share; as shares grow in number with the
text, about one pair in a thousand meets the count of another as well.  All that is gathered grows with
the text, and so do buckets; how the rows are dealt to partitions changes nothing.

Edge cases: null and empty texts are an end alone; a null id counts as training
text with the id ""; equal texts in one fold are scored alike; texts of any length
are one document; an empty table gives an empty result; without training text every
count is 0; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import free, prepare, stage, stage_parts, table
from ._words import _BYTE, FOLD, Words, mixed, prefix_hash, range_hash, steps, text_buffers

FOLDS, HELD = 5, 1
#: Text of one slice; its distinct units and pairs of units travel together.
SLICE_BYTES = 2 << 20
#: Text for each bucket of units, and buckets at least.
BUCKET_BYTES, BUCKETS = 16 << 20, 24
#: Hashed slots of one order, for ``Bits`` without counted pairs.
SLOTS = 1 << 20
ORDERS = 6
#: Tasks that learn are at least so many, and one for every so many buckets.
TASKS, TASK_BUCKETS = 12, 8
#: Units mixed between two updates of the weights.
BLOCK_UNITS = 512
GATES = 8 * 4
MAP_STEPS = 33
RATE = 0.02
#: Flags: tokens between two updates, pseudo-counts of a context, and the pace of weights and map.
FLAG_BLOCK, FLAG_PRIOR, FLAG_RATE, FLAG_PACE = 32, 4.0, 0.02, 0.02
FLAG_CONTEXTS = (8, 16, 32, 128)
FLAG_STEPS = 17

_END, _STOP = 0xFE, 0xFF
_CLASS = np.full(256, 2, np.uint8)
_CLASS[list(b".!?")] = 3
_CLASS[list(b",;:()[]{}\"'`-_/\\|*#$%&@^~<>=+")] = 4


def _pack(x: np.ndarray) -> bytes:
    """Byte planes, compressed: small numbers cost little."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return pa.compress(np.ascontiguousarray(raw).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpack(data: bytes, n: int, kind) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).reshape(-1).view(kind)


def unit_pairs(places: np.ndarray, first: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a unit and the one before it: places of both, their share, and the pair of every token.

    ``places`` are the units of a slice's tokens, ``first`` the first token of each document, whose unit before is the
    place behind all units, and ``cuts`` where the units of each bucket end.  Pairs are ascending by share.
    """
    none = int(cuts[-1])
    before = np.empty(len(places), np.int64)
    before[1:] = places[:-1]
    before[first] = none
    code, at = np.unique(before * (none + 1) + places, return_inverse=True)
    old, new = code // (none + 1), code % (none + 1)
    bucket = lambda x: np.searchsorted(cuts, x, "right")
    share = (bucket(old) + bucket(new)) % len(cuts)
    order = np.argsort(share, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return old[order], new[order], share[order], rank[at]


def laid_out(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class, bytes and a stop of every unit, one behind the other, and where each ends."""
    sizes = end - begin + 2
    ends = np.cumsum(sizes)
    data = raw[np.clip(np.repeat(begin - 1 - (ends - sizes), sizes) + np.arange(ends[-1]), 0, len(raw) - 1)]
    data[ends - sizes] = kind
    data[ends - 1] = _STOP
    return data, ends


_SLICE = "slice string, bucket int, n int, size long, data binary, counts binary, places binary, docs binary, held binary, tokens binary, missing binary, bytes binary"
_SLICE_ARROW = pa.schema([("slice", pa.string()), ("bucket", pa.int32()), ("n", pa.int32()), ("size", pa.int64()), *((k, pa.binary()) for k in ("data", "counts", "places", "docs", "held", "tokens", "missing", "bytes"))])


def _slices(docs: DataFrame, buckets: int) -> DataFrame:
    """Per slice: a row of its documents (bucket -1: ids, fold, bytes, tokens as places in the slice's units), of distinct units per bucket, and of pairs of units per share (bucket -2 - share)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, size=SLICE_BYTES):
            ids = part.column("doc_id")
            missing = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
            numbers = np.asarray(ids.fill_null(0), np.int64)
            held = np.array([not m and zlib.crc32(str(i).encode()) % FOLDS == HELD for i, m in zip(numbers.tolist(), missing.tolist())])
            w = Words(part.column("text"), fold=True)
            k = len(w.count)
            # an end symbol behind every document
            raw = np.insert(text_buffers(part.column("text"))[0], w.off[1:], _END)
            start = np.insert(w.start + w.doc, w.first[1:], w.off[1:] + np.arange(k))
            end = np.insert(w.end + w.doc, w.first[1:], w.off[1:] + np.arange(k) + 1)
            first = w.first[:-1] + np.arange(k)
            begin = np.empty(len(end), np.int64)
            begin[1:] = end[:-1]
            begin[first] = w.off[:-1] + np.arange(k)
            kind = np.empty(len(end), np.uint8)
            kind[1:] = _CLASS[raw[end[:-1] - 1]]
            kind[first] = 1
            prefix = prefix_hash(_BYTE[raw])
            key = mixed(range_hash(prefix, begin, end) + kind.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            at, inverse = _grouped(key)
            train = np.repeat(~held, np.diff(np.append(first, len(end))))
            counts = np.bincount(inverse[train], minlength=len(at))
            data, ends = laid_out(raw, begin[at], end[at], kind[at])
            word = range_hash(prefix_hash(_BYTE[FOLD[data]]), ends - 1 - (end - start)[at], ends - 1)
            bucket = (word % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((-counts, bucket))
            place = np.empty(len(at), np.uint32)
            place[order] = np.arange(len(at))
            data, ends = laid_out(raw, begin[at][order], end[at][order], kind[at][order])
            bounds = np.append(0, ends)
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            name, rows = uuid.uuid4().hex, []
            old, new, share, pair = unit_pairs(place[inverse].astype(np.int64), first, np.array(cut[1:]))
            own = np.append(key[at][order], np.uint64(0x5851F42D4C957F2D))
            hashes = mixed(own[old] * np.uint64(0x9E3779B97F4A7C15) + own[new]) & np.uint64(0xFFFFFFFF)
            times = np.bincount(pair[train], minlength=len(old)).astype(np.uint32)
            for i, (a, b) in enumerate(zip(*(np.searchsorted(share, np.arange(buckets) + k).tolist() for k in (0, 1)))):
                if b > a:
                    rows.append({"slice": name, "bucket": -2 - i, "n": b - a, "data": _pack(hashes[a:b].astype(np.uint32)), "counts": _pack(times[a:b])})
            tokens = np.diff(np.append(first, len(end))).astype(np.uint32)
            rows.append({"slice": name, "bucket": -1, "n": k, "size": len(end), "places": _pack(place[inverse]), "docs": _pack(numbers), "held": _pack(held.astype(np.uint8)), "tokens": _pack(tokens), "missing": _pack(missing.astype(np.uint8)), "bytes": _pack(np.diff(w.off).astype(np.uint32))})
            for i in range(buckets):
                if cut[i + 1] > cut[i]:
                    joined = data[bounds[cut[i]] : bounds[cut[i + 1]] - 1].tobytes()
                    rows.append({"slice": name, "bucket": i, "n": cut[i + 1] - cut[i], "size": len(joined), "data": pa.compress(joined, codec="zstd", asbytes=True), "counts": _pack(counts[order[cut[i] : cut[i + 1]]].astype(np.uint32))})
            yield pa.RecordBatch.from_pylist(rows, schema=_SLICE_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SLICE)


_BUCKET = "bucket int, slice string, n int, size long, units binary, tf binary, c binary, places binary, words long, total long"
_BUCKET_ARROW = pa.schema([("bucket", pa.int32()), ("slice", pa.string()), ("n", pa.int32()), ("size", pa.int64()), *((k, pa.binary()) for k in ("units", "tf", "c", "places")), ("words", pa.int64()), ("total", pa.int64())])


def _meet(t):
    """One bucket: distinct units with their training counts and those of their words, and per slice where its units are."""
    sent = []
    for name, n, size, data, counts in zip(*(t.column(k).to_pylist() for k in ("slice", "n", "size", "data", "counts"))):
        sent.append((name, pa.decompress(data, size, codec="zstd", asbytes=True).split(b"\xff"), _unpack(counts, n, np.uint32)))
    # in the order of a hash, whatever slices they came in
    known = sorted({u for _, units, _ in sent for u in units}, key=lambda u: (zlib.crc32(u), u))
    index = {u: i for i, u in enumerate(known)}
    where, total = [], np.zeros(len(known), np.int64)
    for name, units, counts in sent:
        places = np.fromiter((index[u] for u in units), np.uint32, len(units))
        total[places] += counts  # units of a slice are distinct
        where.append((name, places))
    words: dict[bytes, int] = {}
    of = np.fromiter((words.setdefault(u[1:].lstrip(b" \t\n\r\x0b\x0c").lower(), len(words)) for u in known), np.int64, len(known))
    c = np.bincount(of, weights=total, minlength=len(words)).astype(np.int64)
    joined, bucket = b"\xff".join(known), t.column("bucket")[0].as_py()
    rows = [{"bucket": bucket, "n": len(known), "size": len(joined), "units": pa.compress(joined, codec="zstd", asbytes=True), "tf": _pack(total), "c": _pack(c[of]), "words": int((c > 0).sum()), "total": int(total.sum())}]
    rows += [{"bucket": bucket, "slice": name, "n": len(places), "places": _pack(places)} for name, places in where]
    return pa.Table.from_pylist(rows, schema=_BUCKET_ARROW)


_PAIRED = "slice string, share int, n int, pairs binary"
_PAIRED_ARROW = pa.schema([("slice", pa.string()), ("share", pa.int32()), ("n", pa.int32()), ("pairs", pa.binary()), ("again", pa.int64()), ("seen", pa.int64())])


def _meet_pairs(t):
    """One share: how often each pair that a slice asked for occurs in all training texts."""
    asked = [(name, _unpack(p, n, np.uint32), _unpack(c, n, np.uint32).astype(np.int64)) for name, n, p, c in zip(*(t.column(k).to_pylist() for k in ("slice", "n", "data", "counts")))]
    pairs, counts = _summed(np.concatenate([p for _, p, _ in asked]), np.concatenate([c for _, _, c in asked]))
    share = -2 - t.column("bucket")[0].as_py()
    rows = [{"slice": name, "share": share, "n": len(p), "pairs": _pack(counts[np.searchsorted(pairs, p)])} for name, p, _ in asked]
    # tokens whose pair occurs again, and all tokens, once a share
    rows[0] |= {"again": int(counts[counts > 1].sum()), "seen": int(counts.sum())}
    return pa.Table.from_pylist(rows, schema=_PAIRED_ARROW)


# --- the model


def _spelled(units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the units, where their symbols are, the unit of each symbol, and where that begins."""
    joined = np.frombuffer(b"\xff".join(units) + b"\xff", np.uint8)
    ends = np.flatnonzero(joined == _STOP)
    begin = np.concatenate(([0], ends[:-1] + 1))
    first = np.zeros(len(joined), bool)
    first[begin] = True
    at = np.flatnonzero(~first)  # the class byte is context only
    unit = np.cumsum(first)[at] - 1
    return joined, at, unit, begin[unit]


class Bits:
    """Context slots and bits of a block of units: rows are symbols, columns their eight bits.

    ``pairs`` are sorted pairs of context and symbol, as ``own_pairs`` gives them; a slot is a pair's place and the bit.
    """

    def __init__(self, units: list[bytes], pairs: np.ndarray | None = None):
        joined, at, self.unit, begin = _spelled(units)
        symbol = joined[at].astype(np.uint64)
        self.n = len(units)
        self.bit = _bits_of(joined[at])
        bases = _contexts(joined, at, at - begin, begin)
        if pairs is not None:
            self.places = np.searchsorted(pairs, (bases & ~np.uint64(255)) | symbol)
            self.slots = self.places[:, :, None] * 8 + np.arange(8)
            return
        node = np.ones((len(at), 8), np.uint64)
        for k in range(1, 8):
            node[:, k] = node[:, k - 1] * np.uint64(2) + self.bit[:, k - 1]
        self.slots = (mixed(bases[:, :, None] + node * np.uint64(0xD6E8FEB86659FD93)) & np.uint64(SLOTS - 1)).astype(np.int32)


def _bits_of(symbols: np.ndarray) -> np.ndarray:
    return np.unpackbits(symbols[:, None], axis=1)


class Rows(NamedTuple):
    """Bits of some symbols, and the places of their pairs by order."""

    bit: np.ndarray
    places: np.ndarray


class Edges:
    """Distinct pairs of the longest context and a symbol: the edges of the tree of the units' prefixes.

    The longest context is all of the unit so far, so an edge tells the contexts of every order: what symbols share is
    counted, looked up and predicted once an edge.  ``of`` is the edge of every symbol, ``unit`` its unit; ``pairs`` are
    the sorted distinct pairs of all orders, ``places`` (edges, orders) where those of an edge are.
    """

    def __init__(self, units: list[bytes]):
        keys, of, unit, n = [np.zeros((ORDERS, 0), np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
        for a in range(0, len(units), 64 * BLOCK_UNITS):
            joined, at, own, begin = _spelled(units[a : a + 64 * BLOCK_UNITS])
            first, inverse = _grouped(_keyed(_longest(joined, at, begin), joined[at]))
            at, begin = at[first], begin[first]
            keys.append(_keyed(_contexts(joined, at, at - begin, begin), joined[at]))
            of.append((inverse + n).astype(np.int32))
            unit.append((own + a).astype(np.int32))
            n += len(first)
        met = np.concatenate(keys, axis=1)
        first, inverse = _grouped(met[-1])
        keys = met[:, first]
        self.of = inverse.astype(np.int32)[np.concatenate(of)]
        self.unit = np.concatenate(unit)
        self.bit = _bits_of((keys[-1] & np.uint64(255)).astype(np.uint8))
        # a context tells the shorter ones, so each order needs only one edge for every pair of the order above
        apart, own = [keys[-1]], np.arange(len(first))
        ranks, n = [own], len(first)
        for k in range(ORDERS - 2, -1, -1):
            first, inverse = _grouped(keys[k, own])
            own = own[first]
            apart.append(keys[k, own])
            ranks.append(inverse if k == ORDERS - 2 else inverse[ranks[-1]])
        apart_at = np.cumsum([0, *(len(x) for x in apart)])
        every = np.concatenate(apart)
        first, inverse = _grouped(every)
        self.pairs, inverse = every[first], inverse.astype(np.int32)
        self.places = np.empty((n, ORDERS), np.int32)
        for k, (rank, at) in enumerate(zip(ranks, apart_at.tolist())):
            self.places[:, ORDERS - 1 - k] = inverse[rank + at]

    def some(self, edges) -> Rows:
        return Rows(self.bit[edges], np.ascontiguousarray(self.places[edges].T))


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct key, ascending by key, and the rank of every key."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    ascending = keys[order]
    new[1:] = ascending[1:] != ascending[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def _keyed(bases: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Pairs of context (upper 56 bits) and symbol."""
    return (bases & ~np.uint64(255)) | symbols.astype(np.uint64)


def _longest(joined: np.ndarray, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hashes of the last order's contexts, the unit so far."""
    return _seeded(range_hash(prefix_hash(_BYTE[joined]), begin, at), ORDERS - 1)


def _seeded(seed: np.ndarray, order: int) -> np.ndarray:
    return mixed(seed * np.uint64(2) + np.uint64((order * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))


def _contexts(joined: np.ndarray, at: np.ndarray, depth: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hashes (orders, symbols) of the contexts of the symbols ``at``."""
    wide = joined.astype(np.uint64)
    context = np.zeros(len(at), np.uint64)
    out = np.empty((ORDERS, len(at)), np.uint64)
    for order in range(ORDERS - 1):
        if order:
            reach = np.minimum(depth, order)
            context = np.where(reach >= order, context * np.uint64(257) + wide[np.maximum(at - order, 0)] + np.uint64(1), context * np.uint64(257))
        out[order] = _seeded(context, order)
    out[-1] = _longest(joined, at, begin)
    return out


def own_pairs(units: list[bytes], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct pairs of context and symbol of the units, and how often each occurs in training."""
    edges = Edges(units)
    # sums of whole numbers, exact in doubles
    times = np.bincount(edges.of, weights=times[edges.unit], minlength=len(edges.bit))
    counts = sum(np.bincount(places, weights=times, minlength=len(edges.pairs)) for places in edges.places.T)
    return edges.pairs, counts.astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _along_bits(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(pairs, 9): how often the context of a pair was followed by a symbol with its first 0 to 8 bits."""
    out = np.empty((len(pairs), 9), np.int64)
    for k in range(9):
        node = pairs >> np.uint64(8 - k)
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        out[:, k] = np.repeat(np.add.reduceat(counts, first), np.diff(np.append(first, len(pairs))))
    return out


def _as_tables(along: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Counts of clear and set bits by slot of ``Bits``, the same array for every order."""
    bit = ((pairs[:, None] >> np.arange(7, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(bool)
    same, other = along[:, 1:], along[:, :-1] - along[:, 1:]
    # the sums are exact; what is taken from these is their logarithms
    both = np.stack([np.where(bit, other, same), np.where(bit, same, other)]).astype(np.float32).reshape(2, -1)
    return np.broadcast_to(both, (ORDERS, *both.shape))


def _stretch(p):
    return np.log(p / (1 - p))


def _squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Mixer:
    """Gated weights and an adaptive map over the predictions of the counts."""

    def __init__(self, tables: np.ndarray, weights: np.ndarray | None = None, refined: np.ndarray | None = None):
        self.tables = tables  # (ORDERS, 2, slots)
        self.weights = self.start_weights() if weights is None else weights
        self.refined = self.start_map() if refined is None else refined
        self.known: tuple | None = None

    def know(self, pairs: np.ndarray, parts: Iterator[np.ndarray], own: bool) -> None:
        """Stretched predictions and gate levels of every slot, which is read often: ``parts`` are the counts along the bits of
        the pairs, some at a time; with ``own``, as if one occurrence of a slot's own pair had not been counted."""
        x, level, at = np.empty(8 * len(pairs), np.float32), np.empty(8 * len(pairs), np.int8), 0
        for along in parts:
            for a in range(0, len(along), 1 << 16):
                some = pairs[at : at + len(along[a : a + (1 << 16)])]
                n0, n1 = _as_tables(along[a : a + (1 << 16)], some)[0]
                if own:
                    bit = ((some[:, None] >> np.arange(7, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.float32).reshape(-1)
                    n0, n1 = np.maximum(n0 - (1 - bit), 0), np.maximum(n1 - bit, 0)
                n, to = n0 + n1, slice(8 * at, 8 * (at + len(some)))
                x[to], level[to] = np.log((n1 + 0.1) / (n0 + 0.1)) * (n / (n + 0.5)), np.minimum(np.log2(n + 1).astype(np.int8), 6) // 2
                at += len(some)
        self.known = x, level

    @staticmethod
    def start_weights() -> np.ndarray:
        return np.full((GATES, ORDERS), 0.3)

    @staticmethod
    def start_map() -> np.ndarray:
        return np.tile(_squash(np.linspace(-8, 8, MAP_STEPS)), (GATES, 1))

    def inputs(self, b: Bits, own: np.ndarray | None = None):
        """Stretched predictions (orders, bits), and the gate of each bit."""
        if self.known is not None:
            x, level = self.known
            return x.reshape(-1, 8)[b.places].reshape(ORDERS, -1), (np.arange(8) * 4 + level.reshape(-1, 8)[b.places[-1]]).reshape(-1)
        shape = b.bit.size
        bit = b.bit.reshape(-1)
        x = np.empty((ORDERS, shape), np.float32)
        seen = None
        for k in range(ORDERS):
            slot = b.slots[k].reshape(-1)
            n0, n1 = self.tables[k, 0][slot], self.tables[k, 1][slot]
            if own is not None:  # as if this occurrence had not been counted
                n0, n1 = np.maximum(n0 - own * (bit == 0), 0), np.maximum(n1 - own * (bit == 1), 0)
            n = n0 + n1
            x[k] = np.log((n1 + 0.1) / (n0 + 0.1)) * (n / (n + 0.5))
            seen = n
        level = np.minimum(np.log2(seen + 1).astype(np.int64), 6) // 2
        gate = np.tile(np.arange(8), len(b.bit)) * 4 + level
        return x, gate

    def predict(self, x, gate):
        """Probability of a set bit, mixed and then refined; and what an update needs."""
        t = sum(own * weights[gate] for own, weights in zip(x, np.ascontiguousarray(self.weights.T)))
        t = np.clip(t, -7.999, 7.999)
        p = _squash(t)
        at = (t + 8) * ((MAP_STEPS - 1) / 16)
        low = at.astype(np.int64)
        part = at - low
        cell, cells = gate * MAP_STEPS + low, self.refined.reshape(-1)
        fine = cells[cell] * (1 - part) + cells[cell + 1] * part
        return p, np.clip(0.5 * p + 0.5 * fine, 1e-6, 1 - 1e-6), low, part

    def learn(self, b: Rows, times: np.ndarray, rate: float) -> None:
        """One update from symbols that occur so many ``times``; slots are known as without the own occurrence."""
        x, gate = self.inputs(b)
        bit, weight = b.bit.reshape(-1), np.repeat(times, 8)
        p, _, low, part = self.predict(x, gate)
        error = (bit - p) * weight
        total = np.bincount(gate, weights=weight, minlength=GATES)
        for k in range(ORDERS):
            self.weights[:, k] += rate * np.bincount(gate, weights=error * x[k], minlength=GATES) / np.maximum(total, 1) * np.minimum(total, 50) / 10
        nearest = low + (part > 0.5)
        cell = gate * MAP_STEPS + nearest
        hits = np.bincount(cell, weights=weight, minlength=GATES * MAP_STEPS).reshape(GATES, MAP_STEPS)
        ones = np.bincount(cell, weights=weight * bit, minlength=GATES * MAP_STEPS).reshape(GATES, MAP_STEPS)
        pace = hits / (hits + 200)
        self.refined += pace * (np.where(hits > 0, ones / np.maximum(hits, 1e-9), 0) - self.refined)

    def score(self, edges: Edges, n: int) -> np.ndarray:
        """Natural-log probability of every one of ``n`` units."""
        cost = np.empty(len(edges.bit))
        for a in range(0, len(cost), 32 * BLOCK_UNITS):
            b = edges.some(slice(a, a + 32 * BLOCK_UNITS))
            x, gate = self.inputs(b)
            _, p, _, _ = self.predict(x, gate)
            cost[a : a + len(b.bit)] = np.log(np.where(b.bit.reshape(-1) == 1, p, 1 - p)).reshape(-1, 8).sum(axis=1)
        return np.bincount(edges.unit, weights=cost[edges.of], minlength=n)


def flag_costs(flags: np.ndarray, level: np.ndarray, first: np.ndarray, rate: float) -> np.ndarray:
    """Natural-log probability of every flag; documents start at ``first`` and learn apart, all in step, block by block.

    ``level`` (0 to 15) tells how frequent the unit before is, ``rate`` the share of set flags in all training texts.
    """
    n, k = len(flags), len(FLAG_CONTEXTS)
    out, flag = np.zeros(n), flags.astype(np.int64)
    ends = np.append(first[1:], n)
    old = np.zeros((3, n), np.int64)
    for back in (1, 2, 3):
        old[back - 1, back:] = flag[:-back] if n > back else []
        for i in range(back):
            old[back - 1, np.minimum(first + i, ends - 1)] = 0
    last, history = old[0], old[0] + 2 * old[1] + 4 * old[2]
    context = np.stack([history, level, level * 2 + last, history * 16 + level])
    by_size = np.argsort(-(ends - first), kind="stable")
    begin, sizes = first[by_size], (ends - first)[by_size]
    m = len(begin)
    counts = [np.repeat([FLAG_PRIOR * (1 - rate), FLAG_PRIOR * rate], m * size) for size in FLAG_CONTEXTS]
    weights, refined = np.full((m, 2, k), 1.25 / k), np.tile(_squash(np.linspace(-8, 8, FLAG_STEPS)), (m, 2, 1))
    for at in range(0, int(sizes[0]) if m else 0, FLAG_BLOCK):
        live = int(np.searchsorted(-sizes, -at, "left"))
        spot = begin[:live, None] + at + np.arange(FLAG_BLOCK)
        real = at + np.arange(FLAG_BLOCK) < sizes[:live, None]
        spot = np.where(real, spot, begin[:live, None])
        row = np.arange(live)[:, None]
        y, c, gate = flag[spot], context[:, spot], last[spot]
        slot = [row * FLAG_CONTEXTS[i] + c[i] for i in range(k)]
        x = np.stack([np.log(counts[i][slot[i] + m * FLAG_CONTEXTS[i]] / counts[i][slot[i]]) for i in range(k)], axis=-1)
        t = np.clip((x * weights[row, gate]).sum(axis=-1), -7.999, 7.999)
        p = _squash(t)
        place = (t + 8) * ((FLAG_STEPS - 1) / 16)
        low = place.astype(np.int64)
        part = place - low
        fine = refined[row, gate, low] * (1 - part) + refined[row, gate, low + 1] * part
        final = np.clip(0.5 * p + 0.5 * fine, 1e-6, 1 - 1e-6)
        out[spot[real]] = np.log(np.where(y == 1, final, 1 - final))[real]
        error = np.where(real, y - p, 0.0)
        for g in (0, 1):
            weights[:live, g] += FLAG_RATE * (np.where(gate == g, error, 0.0)[..., None] * x).sum(axis=1)
        for i in range(k):
            np.add.at(counts[i], (slot[i] + y * (m * FLAG_CONTEXTS[i]))[real], 1.0)
        cell = ((row * 2 + gate) * FLAG_STEPS + low + (part > 0.5))[real]
        hits, ones = (np.bincount(cell, weights=w, minlength=live * 2 * FLAG_STEPS).reshape(live, 2, FLAG_STEPS) for w in (None, y[real]))
        refined[:live] += np.where(hits > 0, 1 - (1 - FLAG_PACE) ** hits, 0) * (ones / np.maximum(hits, 1) - refined[:live])
    return out


def _listed(row_units: bytes, size: int) -> list[bytes]:
    return pa.decompress(row_units, size, codec="zstd", asbytes=True).split(b"\xff")


_ASKED = "share int, bucket int, n int, pairs binary, counts binary"
_COUNTED = "bucket int, share int, n int, along binary"
_COUNTED_ARROW = pa.schema([("bucket", pa.int32()), ("share", pa.int32()), ("n", pa.int32()), ("along", pa.binary())])


def _count_contexts(vocabulary: DataFrame, shares: int) -> DataFrame:
    """Per bucket and share of contexts, ascending: counts along the bits of the bucket's sorted pairs."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, n, size, data, tf in zip(*(batch.column(k).to_pylist() for k in ("bucket", "n", "size", "units", "tf"))):
                pairs, counts = own_pairs(_listed(data, size), _unpack(tf, n, np.int64))
                share = _share(pairs, shares)
                cut = np.searchsorted(share, np.arange(shares + 1)).tolist()
                own = [i for i in range(shares) if cut[i + 1] > cut[i]]
                packed = lambda x: pa.array([_pack(x[cut[i] : cut[i + 1]]) for i in own], pa.binary())
                sizes = pa.array([cut[i + 1] - cut[i] for i in own], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([bucket] * len(own), pa.int32()), sizes, packed(pairs), packed(counts)], names=["share", "bucket", "n", "pairs", "counts"])

    def answer(t):
        asked = [(b, _unpack(p, n, np.uint64), _unpack(c, n, np.int64)) for b, n, p, c in zip(*(t.column(k).to_pylist() for k in ("bucket", "n", "pairs", "counts")))]
        pairs, counts = _summed(np.concatenate([p for _, p, _ in asked]), np.concatenate([c for _, _, c in asked]))
        along, share = _along_bits(pairs, counts), t.column("share")[0].as_py()
        return pa.Table.from_pylist([{"bucket": b, "share": share, "n": len(p), "along": _pack(along[np.searchsorted(pairs, p)].reshape(-1))} for b, p, _ in asked], schema=_COUNTED_ARROW)

    return stage(vocabulary.select("bucket", "n", "size", "units", "tf").mapInArrow(ask, _ASKED).groupBy("share").applyInArrow(answer, _COUNTED), "mix-contexts")


def _share(pairs: np.ndarray, shares: int) -> np.ndarray:
    """Share of each pair: ascending with the pair, all symbols of a context in one."""
    return ((pairs >> np.uint64(40)) * np.uint64(shares)) >> np.uint64(24)


def _told(rows: list[dict]) -> Iterator[np.ndarray]:
    """Counts along the bits of a bucket's pairs, from the rows that ``_count_contexts`` gave it."""
    for r in sorted(rows, key=lambda r: r["share"]):
        yield _unpack(r["along"], 9 * r["n"], np.int64).reshape(-1, 9)


def _beside(frame: DataFrame, counted: DataFrame) -> DataFrame:
    """Rows of ``met`` and of counts of contexts in one table, to be grouped by bucket."""
    left = frame.select("*", F.lit(None).cast("int").alias("share"), F.lit(None).cast("binary").alias("along"))
    return left.unionByName(counted, allowMissingColumns=True)


def learn_units(mixer: Mixer, edges: Edges, times: np.ndarray) -> None:
    """Learn from the units that occur, ``BLOCK_UNITS`` at a time; a block's equal edges count together."""
    mine = times[edges.unit] > 0
    of, unit = edges.of[mine], edges.unit[mine]
    cuts = np.searchsorted(unit, np.append(np.flatnonzero(times)[::BLOCK_UNITS], len(times)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        first, inverse = _grouped(of[a:b])
        weight = np.bincount(inverse, weights=times[unit[a:b]])
        mixer.learn(edges.some(of[a:b][first]), weight, RATE)


def _fit_mixer(vocabulary: DataFrame, counted: DataFrame, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and map: learned online by each task over all its training units, averaged by their number."""

    def learn(t):
        mixer, seen = Mixer(np.zeros((ORDERS, 2, 0), np.float32)), 0
        for bucket in sorted(set(t.column("bucket").to_pylist())):
            rows = t.filter(pc.equal(t.column("bucket"), bucket)).to_pylist()
            own = next(r for r in rows if r["share"] is None)
            units, times = _listed(own["units"], own["size"]), _unpack(own["tf"], own["n"], np.int64)
            known = np.flatnonzero(times)
            if len(known):
                edges = Edges(units)
                mixer.know(edges.pairs, _told([r for r in rows if r["share"] is not None]), True)
                learn_units(mixer, edges, times)
            seen += len(known)
        learned = [[*mixer.weights.ravel().tolist(), *mixer.refined.ravel().tolist()]] if seen else []
        return pa.table({"seen": pa.array([seen][: len(learned)], pa.int64()), "learned": pa.array(learned, pa.list_(pa.float64()))})

    # averaged by evidence where they are; the driver gets the mean, in whole units of 1e-9 so that any order of rows gives the same sum
    both = _beside(vocabulary.select("bucket", "n", "size", "units", "tf"), counted)
    learned = both.groupBy((F.col("bucket") % tasks).alias("task")).applyInArrow(learn, "seen long, learned array<double>").select("seen", F.posexplode("learned").alias("at", "x"))
    share = F.round(F.col("x") * 1e9).cast("decimal(28,0)") * F.col("seen").cast("decimal(10,0)")
    mean = np.concatenate([Mixer.start_weights().ravel(), Mixer.start_map().ravel()])
    for row in learned.groupBy("at").agg((F.sum(share).cast("double") / F.sum("seen") / 1e9).alias("mean")).collect():
        mean[row["at"]] = row["mean"]
    return mean[: GATES * ORDERS].reshape(GATES, ORDERS), mean[GATES * ORDERS :].reshape(GATES, MAP_STEPS)


_REPLY = "slice string, bucket int, c binary, tf binary, logp binary, n int"


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (null without bytes) for every row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    buckets = max(BUCKETS, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    kind = F.when(F.col("bucket") >= 0, "units").when(F.col("bucket") == -1, "texts").otherwise("pairs")
    slices = stage_parts(_slices(docs, buckets).withColumn("kind", kind), "mix-slices", "kind", ("units", "texts", "pairs"))
    met = stage(slices["units"].select("bucket", "slice", "n", "size", "data", "counts").groupBy("bucket").applyInArrow(_meet, _BUCKET), "mix-buckets")
    vocabulary = met.where("slice is null")
    words, total = (int(x or 0) for x in vocabulary.agg(F.sum("words"), F.sum("total")).first())
    tasks = max(TASKS, buckets // TASK_BUCKETS)
    free(slices["units"])
    paired = stage(slices["pairs"].select("slice", "bucket", "n", "data", "counts").groupBy("bucket").applyInArrow(_meet_pairs, _PAIRED + ", again long, seen long"), "mix-pairs")
    free(slices["pairs"])
    again, seen = (int(x or 0) for x in paired.agg(F.sum("again"), F.sum("seen")).first())
    rate = (again + 0.5) / (seen + 1)
    counted = _count_contexts(vocabulary, buckets)
    weights, refined = _fit_mixer(vocabulary, counted, tasks)

    def reply(t):
        counts = pc.is_valid(t.column("share"))
        told = t.filter(counts).select(["share", "n", "along"]).to_pylist()
        t = t.filter(pc.invert(counts))
        own = t.filter(pc.is_null(t.column("slice"))).to_pylist()[0]
        c, tf, units = _unpack(own["c"], own["n"], np.int64), _unpack(own["tf"], own["n"], np.int64), _listed(own["units"], own["size"])
        edges = Edges(units)
        mixer = Mixer(np.zeros((ORDERS, 2, 0), np.float32), weights, refined)
        mixer.know(edges.pairs, _told(told), False)
        logp = mixer.score(edges, len(units))
        rows = []
        for name, n, places in zip(*(t.column(k).to_pylist() for k in ("slice", "n", "places"))):
            if name is not None:
                at = _unpack(places, n, np.uint32)
                rows.append({"slice": name, "bucket": own["bucket"], "c": _pack(c[at]), "tf": _pack(tf[at]), "logp": logp[at].astype(np.float32).tobytes(), "n": n})
        return pa.Table.from_pylist(rows, schema=pa.schema([("slice", pa.string()), ("bucket", pa.int32()), *((k, pa.binary()) for k in ("c", "tf", "logp")), ("n", pa.int32())]))

    replies = _beside(met, counted).groupBy("bucket").applyInArrow(reply, _REPLY)
    told = slices["texts"].select("slice", "bucket", "n", "size", "places", "docs", "held", "tokens", "missing", "bytes")
    both = told.unionByName(replies, allowMissingColumns=True).unionByName(paired.select("slice", (-2 - F.col("share")).alias("bucket"), "n", "pairs"), allowMissingColumns=True)

    def finish(t):
        rows = sorted(t.to_pylist(), key=lambda r: r["bucket"])
        own = next(r for r in rows if r["bucket"] == -1)
        units, pairs = [r for r in rows if r["bucket"] >= 0], [r for r in reversed(rows) if r["bucket"] < -1]
        c, tf = (np.concatenate([_unpack(r[k], r["n"], np.int64) for r in units]) for k in ("c", "tf"))
        logp = np.concatenate([np.frombuffer(r["logp"], np.float32) for r in units]).astype(float)
        sizes = np.zeros(buckets, np.int64)
        sizes[[r["bucket"] for r in units]] = [r["n"] for r in units]
        places = _unpack(own["places"], own["size"], np.uint32).astype(np.int64)
        tokens = _unpack(own["tokens"], own["n"], np.uint32).astype(np.int64)
        missing = _unpack(own["missing"], own["n"], np.uint8).astype(bool)
        held = _unpack(own["held"], own["n"], np.uint8).astype(bool)
        first = np.cumsum(tokens) - tokens
        base = np.log10((c + 0.5) / (total + 0.5 * (words + 1)))
        sums = lambda x: np.add.reduceat(x, first)  # noqa: E731  every document has its end
        # how often the pair and the unit before occur in training texts, the token's own occurrence left out
        old, _, _, pair = unit_pairs(places, first, np.cumsum(sizes))
        mine = np.repeat(~held, tokens).astype(np.int64)
        met = np.maximum(np.concatenate([_unpack(r["pairs"], r["n"], np.int64) for r in pairs])[pair] - mine, 0)
        ends = c[places[first + tokens - 1]]  # as many texts are trained on as ends
        before = np.append(tf, 0)[old][pair]
        before[first] = ends
        before = np.maximum(before - mine, met)
        cost = flag_costs(met > 0, np.minimum(np.log2(before + 1.0).astype(np.int64), 15), first, rate)
        cost += np.where(met > 0, np.log(np.maximum(met, 1) / np.maximum(before, 1)), logp[places])
        score, size = sums(cost) / math.log(10), _unpack(own["bytes"], own["n"], np.uint32)
        return pa.table({
            "doc_id": pa.array(_unpack(own["docs"], own["n"], np.int64), mask=missing), "held_out": pa.array(held), "n_tokens": pa.array(tokens),
            "n_known": pa.array(sums((c > 0).astype(np.int64)[places])), "train_tokens": pa.array(np.full(len(tokens), total)), "base_score": pa.array(sums(base[places])), "score": pa.array(score),
            "bits_per_byte": pa.array(-score / math.log10(2) / np.maximum(size, 1), mask=size == 0),
        })

    return both.groupBy("slice").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
