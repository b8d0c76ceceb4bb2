"""Token counts by heap-and-linked-list byte-pair merging.

A piece starts as its bytes in a doubly linked list; a heap holds the adjacent
pairs that have a rank.  The lowest rank (leftmost on ties) is popped and merged
until none is left: count = initial symbols - merges.  No identifier is made.

Pieces are those of the byte-level pattern.  A text with no white space after a
blank splits at blanks into units whose pieces do not depend on their
neighbours, so a unit's count is looked up; other texts go through the pattern
whole.  Counts of units are cached per worker, with a bounded number of entries.

Edge cases: null and empty texts have 0 bytes and 0 tokens; special strings of
the vocabulary inside a text are one token each, as the library counts them;
long texts are counted whole; repeated rows are reported each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._cluster import table

LIMIT = 1024
#: Units kept per worker; beyond it the cache starts anew.
CACHE_UNITS = 300_000
SPACE = r"\p{White_Space}"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|{SPACE}+(?![^{SPACE}])|{SPACE}+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairCounter:
    """Counts of a byte-level vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        ids: dict[str, int] = dict(letters)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(told["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            new = ids.setdefault(a + b, len(ids) + 256)
            self.ranks.setdefault((ids[a], ids[b]), (rank, new))
        special = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.first = {s[0] for s in special}
        self.pieces = regex.compile(PIECES)
        self.odd = regex.compile(rf" (?={SPACE})")
        self.units: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Tokens of one piece."""
        symbols: list[int] = list(piece.encode())
        n = len(symbols)
        ranks = self.ranks
        if n == 1:
            return 1
        left = list(range(-1, n - 1))
        right = list(range(1, n + 1))
        heap = [(r[0], i, symbols[i], symbols[i + 1], r[1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1])))]
        heapify(heap)
        count = n
        while heap:
            _, i, a, b, new = heappop(heap)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = new, -1
            count -= 1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if r := ranks.get((new, symbols[k])):
                    heappush(heap, (r[0], i, new, symbols[k], r[1]))
            if (h := left[i]) >= 0 and (r := ranks.get((symbols[h], new))):
                heappush(heap, (r[0], h, symbols[h], new, r[1]))
        return count

    def _pieces(self, text: str) -> int:
        total, known = 0, self.known
        for piece in self.pieces.findall(text):
            n = known.get(piece)
            if n is None:
                n = self.merged(piece)
                if len(piece) < 64:
                    if len(known) >= CACHE_UNITS:
                        known.clear()
                    known[piece] = n
            total += n
        return total

    def _plain(self, text: str) -> int:
        if self.odd.search(text):
            return self._pieces(text)
        units = self.units
        parts = text.split(" ")
        total = self._pieces(parts[0])
        for unit in parts[1:]:
            n = units.get(unit)
            if n is None:
                n = self._pieces(" " + unit)
                if len(unit) < 64:
                    if len(units) >= CACHE_UNITS:
                        units.clear()
                    units[unit] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            if m.start() > at:
                total += self._plain(text[at : m.start()])
            total, at = total + 1, m.end()
        return total + (self._plain(text[at:]) if at < len(text) else 0)


_loaded: dict[str, PairCounter] = {}


def counter(path: str) -> PairCounter:
    if path not in _loaded:
        _loaded[path] = PairCounter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; ``path`` is a byte-level tokenizer file on every machine (None: the installed default)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        count = counter(path or public_tokenizers.path("byte_bpe_50k.json")).count
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = [count(t) for t in texts]
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
