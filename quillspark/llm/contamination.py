"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the item windows.  For each pattern length a shift table over blocks
of two words says how far a search may jump; only where the last block of a
window ends some pattern (shift 0) is its bucket looked up and the words compared
directly.  Short items are patterns of their own length with tables of their own,
so they do not shorten the jumps of the others.

The tables are broadcast in blocks of at most ``BLOCK_BYTES`` of item text; a
larger benchmark makes more passes over the rows, each adding to the hits.

Edge cases: a null or wordless text has 0 words and no hit; a null or wordless
item has no window; items with a null id are left out; equal ids count once;
an empty benchmark marks nothing; repeated rows are reported each; an empty table
gives an empty result; texts of any length are searched whole; other columns are
ignored (``contamination``) or kept, whatever their names (``clean_of``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import prepare, stage, table

WINDOW = 8
BLOCK_BYTES = 8 << 20
#: Lower-cases A-Z and blanks every ASCII character that is no letter or digit.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class Patterns:
    """Shift tables and suffix buckets of all windows of some items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        by_length: dict[int, dict[tuple, set[str]]] = {}
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1) if words else ():
                by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(item)
        self.tables = []
        for size, found in sorted(by_length.items()):
            block = min(2, size)
            shift: dict[bytes, int] = {}
            buckets: dict[bytes, dict[tuple, set[str]]] = {}
            for pattern, ids in found.items():
                for end in range(block, size + 1):
                    key = b" ".join(pattern[end - block : end])
                    shift[key] = min(shift.get(key, size), size - end)
                buckets.setdefault(b" ".join(pattern[size - block :]), {})[pattern] = ids
            self.tables.append((size, block, size - block + 1, shift, buckets))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of all occurrences, and the items they belong to."""
        spans, items = [], set()
        for size, block, most, shift, buckets in self.tables:
            i, n, get = size - 1, len(words), shift.get
            if block == 1:
                for i, w in enumerate(words):
                    if w in buckets:
                        spans.append((i, i + 1))
                        items |= buckets[w][(w,)]
                continue
            while i < n:
                key = words[i - 1] + b" " + words[i]
                if jump := get(key, most):
                    i += jump
                    continue
                found = buckets[key].get(tuple(words[i - size + 1 : i + 1]))
                if found:
                    spans.append((i - size + 1, i + 1))
                    items |= found
                i += 1
        return spans, items


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _prefix(docs: DataFrame) -> str:
    """Begins the names of the columns that ``annotate`` adds, and of no other."""
    out = "dc_"
    while any(c.lower().startswith(out) for c in docs.columns):
        out = f"_{out}"
    return out


def _pass(rows: DataFrame, patterns, first: bool, prefix: str) -> DataFrame:
    added = {"words": pa.int64(), "spans": pa.list_(pa.int64()), "items": pa.list_(pa.string())}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = patterns.value.search
        for batch in batches:
            n = batch.num_rows
            old_spans = [[]] * n if first else batch.column(f"{prefix}spans").to_pylist()
            old_items = [[]] * n if first else batch.column(f"{prefix}items").to_pylist()
            counts, all_spans, all_items = [], [], []
            for text, spans, items in zip(batch.column("text"), old_spans, old_items):
                words = words_of(text.as_py())
                found, ids = search(words)
                counts.append(len(words))
                all_spans.append([x for s in _union(found + list(zip(spans[::2], spans[1::2]))) for x in s])
                all_items.append(sorted(ids | set(items)))
            kept = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if not f.name.startswith(prefix)]
            new = [(prefix + k, pa.array(x, kind)) for (k, kind), x in zip(added.items(), (counts, all_spans, all_items))]
            yield pa.RecordBatch.from_arrays([a for _, a in kept + new], names=[k for k, _ in kept + new])

    plain = [f for f in rows.schema.fields if not f.name.startswith(prefix)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain), f"{prefix}words long, {prefix}spans array<long>, {prefix}items array<string>"])
    return rows.mapInArrow(scan, schema)


def annotate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with dc_words, dc_spans (flat starts and ends, in words) and dc_items, behind what ``_prefix`` tells."""
    spark, prefix = docs.sparkSession, _prefix(docs)
    prepare(spark)
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    rows = docs
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        patterns = spark.sparkContext.broadcast(Patterns([tuple(r) for r in part.toLocalIterator()], window))
        rows = _pass(rows, patterns, k == 0, prefix)
        if k % 4 == 3 and k + 1 < blocks:
            rows = stage(rows, "decontaminate")
    return rows


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_items: int = 2) -> DataFrame:
    rows = annotate(docs.select("doc_id", "text"), items, window)
    halves = F.aggregate(F.sequence(F.lit(0), F.size("dc_spans") - 2, F.lit(2)), F.lit(0).cast("long"), lambda acc, i: acc + F.get("dc_spans", i + 1) - F.get("dc_spans", i))
    return rows.select(
        "doc_id",
        F.col("dc_words").alias("n_words"),
        F.when(F.size("dc_spans") > 0, halves).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("dc_items") >= least_items).alias("contaminated"),
    )


def clean_of(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_items: int = 2) -> DataFrame:
    """Rows of ``docs`` without a run of ``window`` hit words and with fewer than ``least_items`` items.

    A single item shorter than a window is no proof by itself, as such words stand in clean texts too.
    """
    spans, found = (f"{_prefix(docs)}{k}" for k in ("spans", "items"))
    runs = F.transform(F.sequence(F.lit(0), F.size(spans) - 2, F.lit(2)), lambda i: F.get(spans, i + 1) - F.get(spans, i))
    longest = F.when(F.size(spans) > 0, F.array_max(runs)).otherwise(F.lit(0))
    return annotate(docs, items, window).where((F.size(found) < least_items) & (longest < window)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Windows of items and documents as joined word strings; short items match windows of their own length.
OP10_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iwin AS (SELECT DISTINCT item_id, least(8, len(w)) AS k, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS g
         FROM (SELECT item_id, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iwin),
dwin AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
         FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT d.r, d.k, d.i, b.item_id FROM dwin d JOIN iwin b ON d.k = b.k AND d.g = b.g),
cov AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, k, i FROM hit)) GROUP BY r),
its AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
