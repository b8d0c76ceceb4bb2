"""Substring deduplication of word passages by seed and extend.

Seeds are winnowed anchors: the smallest 20-word gram of every 50-word window.
Documents meet on anchors they share.  A seed is extended both ways over all
windows it is the anchor of.  Occurrences whose whole extensions are equal are
settled at once against the smallest document id.  The others are dealt out by
anchor, and each is extended word by word, to the left and to the right, against
the documents before it; what agrees over ``WINDOW`` words or more is marked, so
the marks of a document are its maximal repeats.  An anchor with more than
``SHARE_WORDS`` of extensions is first divided by longer common words on both
sides, as ``_blocks`` tells, until it fits.

Texts that are equal are one class with its smallest id.

Edge cases: null and wordless texts have no word; texts under 50 words have no
window; a row without an id is neither smaller than another nor removed from;
rows that share an id do not remove from one another; long texts are one
document each; an empty table gives an empty result; other columns are ignored.
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

GRAM, WINDOW = 20, 50
#: Words of extensions that one anchor may bring to a task; anchors are extended together from so many bytes on.
SHARE_WORDS, LEAST_BYTES = 150_000, 1 << 20


def extended(held: list[tuple[int, bytes, int, bytes]], window: int) -> list[np.ndarray]:
    """For each (key, node, doc, words): the places whose window stands in the same key in a document with a smaller id."""
    out, seen, number = [np.zeros(0, np.int64)] * len(held), {}, {}
    for i in sorted(range(len(held)), key=lambda i: (held[i][0], held[i][2])):
        key, _, doc, words = held[i]
        told = np.array([number.setdefault(w, len(number)) for w in words.split(b" ")], np.int32).tobytes()
        # words are compared, not hashes: a window is the numbers of its words
        least = [seen.setdefault((key, told[4 * k : 4 * (k + window)]), doc) for k in range(len(told) // 4 - window + 1)]
        out[i] = np.flatnonzero(np.array(least, np.int64) < doc)
    return out


def removals(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, share: int = SHARE_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    base = stage(scan(docs, True, gram, window).withColumn("node", node_of(F.col("sha"))).drop("sha"), "passage-scan")
    classes = stage(base.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_n")).where("_n > 1").select("node", "rep"), "passage-classes")
    # a class has the place of its smallest id
    told = perhaps(base, "node", bits_of(classes, "node"))
    placed = told.where("_maybe").join(classes, "node", "left").where("rep is null or doc_id = rep").select(*base.columns)
    blocks = unpack(told.where("not _maybe").select(*base.columns).unionByName(placed).where("doc_id is not null"))
    shared = stage(blocks.groupBy("gram").agg(F.min("doc").alias("_least"), F.max("doc").alias("_most")).where("_least < _most").select("gram"), "passage-anchors")
    met = stage(within(blocks, shared, "gram"), "passage-seeds")
    marked = []
    for width in [*widths(gram, window), None]:
        bodies = stage(met.groupBy("key", "body").agg(F.min("doc").alias("first"), F.max(F.col("hi") - F.col("lo")).alias("_span")), "passage-bodies")
        keys = bodies.groupBy("key").agg(F.count("*").alias("_n"), F.sum(F.col("_span") + window).alias("words")).where("_n > 1").select("key", "words")
        settled = met.join(bodies.select("key", "body", "first"), ["key", "body"])
        marked.append(settled.where("doc > first").select("node", "doc", "lo", "hi"))
        # the places of every extension, in its first document, that differs from another of its anchor
        todo = stage(settled.where("doc = first").join(keys, "key").select("gram", "key", "node", "doc", "lo", "hi", "words"), "passage-todo")
        dealt = contents(texts_of(docs, listed(todo.where(F.col("words") <= share)), "passage-open"), True, window)
        marked.append(stage(in_shares(dealt, lambda held: extended(held, window), LEAST_BYTES), "passage-extended"))
        large = todo.where(F.col("words") > share)
        if not large.limit(1).count():
            break
        parts = stage(divided(texts_of(docs, listed(large), "passage-large"), True, gram, window, width), "passage-parts")
        several = parts.groupBy("key").agg(F.min("doc").alias("_least"), F.max("doc").alias("_most")).where("_least < _most").select("key")
        met = stage(parts.join(several, "key", "left_semi"), "passage-seeds")
    spans = marked[0]
    for more in marked[1:]:
        spans = spans.unionByName(more)
    spans = spans.groupBy("node").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            removed, shas = [], []
            for text, spans in zip(part.column("text"), part.column("spans")):
                words = (text.as_py() or "").encode().split()
                own = pa.array(spans.values) if hasattr(spans, "values") else pa.array(spans.as_py())
                lo, hi = (np.asarray(own.field(k)).astype(np.int64) for k in ("lo", "hi"))
                starts, ends = covered(lo, hi, window, len(words))
                kept, at = [], 0
                for a, b in zip(starts.tolist(), ends.tolist()):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                removed.append(len(words) - len(kept))
                shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(removed, pa.int64()), pa.array(shas)], names=["node", "_removed", "_sha"])

    cuts = stage(texts_of(docs, spans, "passage-spans").mapInArrow(cut, "node binary, _removed long, _sha string"), "passage-cuts")
    known = cuts.unionByName(classes, allowMissingColumns=True).groupBy("node").agg(*(F.max(c).alias(c) for c in ("_removed", "_sha", "rep")))
    rows = base.select("doc_id", "node", "n", "kept_sha").join(known, "node", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    copy = (F.col("doc_id") > F.col("rep")) & (F.col("n") >= window)
    own = F.col("doc_id") == F.col("rep")
    return rows.select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).when(own, F.coalesce("_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(own, F.coalesce("_sha", "kept_sha")).otherwise(F.col("kept_sha")).alias("kept_sha256"),
    )


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Windows by digest of their words; a document's words joined anew without those that are covered.
OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
hit AS (SELECT r, i FROM win JOIN f USING (g) WHERE doc_id > first),
cov AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM hit),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN cov USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT r, count(*) AS n FROM cov GROUP BY r) c USING (r) LEFT JOIN kept USING (r)
"""
