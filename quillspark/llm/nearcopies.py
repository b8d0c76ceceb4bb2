"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document's set is its distinct word shingles.  Documents with equal sets are
one class.  A class has a signature of ``SYMBOLS`` b-bit min-hash values in
chunks of four; signatures that differ in at most ``DISTANCE`` symbols must, by
pigeonhole, agree in some chunk but for one symbol.  So every chunk is entered
under its four one-symbol wildcards, and all pairs under the distance meet in
an index entry.  At the least similarity the distance lies five standard
deviations above the expected one.

Entries are not expanded into pairs.  First each member is confirmed on full
sets against the smallest it meets, which gives components.  Only entries that
still hold several components are looked at again, in blocks of bounded size.
For their members the shingles that no other such member holds are counted, and
all shingles by ``PROFILE`` hash classes; what is left of a set, and the lesser
counts by class, bound its intersection with another, so pairs that cannot reach
the similarity are told without a comparison.  A pair is looked at in the first
entry it shares.  Each row names the nearest few of the rest, by signature and across components; these are confirmed on full
sets, and rows go on naming more until every pair under the distance lies in one
component, is out of reach, or has been compared.

Edge cases: null, empty and wordless texts have no set and are linked with
nothing; fewer words than a shingle make one shingle of all; rows that share an
id are one document's; a row without an id joins its class but is never kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._blocks import bits_of, perhaps, within
from ._cluster import free, prepare, stage, table
from ._words import Words, mixed, prefix_hash, range_hash, steps, window_hashes, window_starts
from .graph import components

SYMBOLS, CHUNK = 48, 4
CHUNKS = SYMBOLS // CHUNK
#: One error a chunk is enumerated, so 2 * CHUNKS - 1 errors leave a chunk with one at most.
DISTANCE = 2 * CHUNKS - 1
#: Rows of an index entry that are compared in one task are at most two blocks.
BLOCK_ROWS = 2048
#: Hash classes of the shingle counts that bound an intersection.
PROFILE = 512
#: Ids that may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000

_RND = np.random.default_rng(77)
_FLIP = _RND.integers(0, 1 << 64, SYMBOLS, dtype=np.uint64)
_TIMES = _RND.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents of a slice, and where each document's start."""
    w = Words(column)
    h = w.hashes()
    starts = window_starts(w.first, size)
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    g = np.concatenate([window_hashes(h, starts, size), range_hash(prefix_hash(h), w.first[short], w.first[short + 1])])
    d = np.concatenate([w.doc[starts], short])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[new], d[new]
    return g, np.searchsorted(d, np.arange(len(w.count) + 1))


def signatures(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """uint16 (documents with a set x SYMBOLS)."""
    begin = at[:-1][at[1:] > at[:-1]]
    out = np.zeros((len(begin), SYMBOLS), np.uint16)
    if len(begin):
        for k in range(SYMBOLS):
            least = np.minimum.reduceat((g ^ _FLIP[k]) * _TIMES[k], begin)
            out[:, k] = (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature (null without a set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            g, at = shingle_sets(part.column("text"), size)
            signed = iter(signatures(g, at))
            raw = g.tobytes()
            digests, sigs = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                digests.append(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None)
                sigs.append(next(signed).tobytes() if b > a else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "digest", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def _band(n: np.ndarray, percent: int) -> np.ndarray:
    """Sizes by a logarithm, so that sets of ``percent`` similarity lie in one band or in neighbours."""
    return np.floor(np.log(np.maximum(n, 1)) / (np.log(100 / percent) * 1.0001) if percent < 100 else n).astype(np.int16)


def _entries(classes: DataFrame, percent: int) -> DataFrame:
    """(key, node, band): the class under every chunk with one symbol left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
            keys = []
            for wild in range(CHUNK):
                x, y, z = (s[:, :, j] for j in range(CHUNK) if j != wild)
                place = (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(wild)) << np.uint64(48)
                keys.append(place | x << np.uint64(32) | y << np.uint64(16) | z)
            key = np.stack(keys, axis=2).reshape(len(s), -1)
            nodes, bands = (np.repeat(x, key.shape[1]) for x in (np.asarray(batch.column("node")), _band(np.asarray(batch.column("n")), percent)))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(nodes, pa.int64()), pa.array(bands, pa.int16())], names=["key", "node", "band"])

    return classes.select("node", "sig", "n").mapInArrow(run, "key long, node long, band smallint")


def _confirmed(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose full sets have 100 * intersection >= percent * union."""
    involved = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-involved")
    small = involved.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(involved) if small else involved, "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            g, at = shingle_sets(part.column("text"), size)
            raw = g.tobytes()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())], names=["doc_id", "own"])

    # one set an id; rows that share an id but not a text keep the smallest set
    own = stage(texts.mapInArrow(sets, "doc_id long, own binary").groupBy("doc_id").agg(F.min("own").alias("own")), "near-sets")
    # a member met by many is dealt out by a salt, and its set sent once a salt
    salted = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("_n")), "a").withColumn("_salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("_n") / 64)))
    copies = salted.select("a", "_salt").distinct().join(own.select(F.col("doc_id").alias("a"), F.col("own").alias("_first")), "a")
    both = salted.select("a", "b", "_salt").join(own.select(F.col("doc_id").alias("b"), F.col("own").alias("_second")), "b").join(copies, ["a", "_salt"]).select("a", "b", "_first", "_second")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("_first"), batch.column("_second")):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                good.append(len(p) > 0 and 100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    out = stage(both.mapInArrow(compare, "a long, b long"), "near-links")
    free(involved, own)
    return out


def _exclusive(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(node, own): how many shingles of a node no other of ``ids`` holds."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    texts = keyed.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "node", "left_semi")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            g, at = shingle_sets(part.column("text"), size)
            node = part.column("node").take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(at))))
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), node], names=["h", "node"])

    held = texts.mapInArrow(shingles, "h long, node long").groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("_most")).where("node = _most")
    return held.groupBy("node").agg(F.count("*").alias("own"))


def _profiles(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(node, profile): shingles by hash class, a byte each; empty where a class holds more than a byte tells."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    texts = keyed.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "node", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            g, at = shingle_sets(part.column("text"), size)
            kind = (g >> np.uint64(20)) % np.uint64(PROFILE)
            rows = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                n = np.bincount(kind[a:b].astype(np.int64), minlength=PROFILE)
                rows.append(n.astype(np.uint8).tobytes() if n.max() < 256 else b"")
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(rows, pa.binary())], names=["node", "profile"])

    return texts.mapInArrow(count, "node long, profile binary").groupBy("node").agg(F.min("profile").alias("profile"))


def _across(mixed_rows: DataFrame, top: int, percent: int) -> DataFrame:
    """Pairs under the distance between components, the ``top`` nearest of every row and group; ``more`` tells that a row has others.

    Rows are (key, node, comp, sig, n, common, major, n_major, n_minor): ``common`` of a node's n shingles are held by
    others too, ``profile`` counts all by class, and the major component is an entry's largest.
    """
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK_ROWS))
    dealt = F.xxhash64("node")
    minor = mixed_rows.where("not major").withColumn("_own", F.pmod(dealt, blocks("n_minor")))
    major = mixed_rows.where("major").withColumn("_own", F.pmod(dealt, blocks("n_major")))
    # minor block i meets minor blocks j >= i and every major block; each pair of blocks is a group of its own
    span = lambda n: F.sequence(F.lit(0).cast("long"), blocks(n) - 1)
    columns = ["key", "node", "comp", "sig", "n", "common", "profile"]
    as_first = minor.select(*columns, F.lit(0).alias("side"), F.col("_own").alias("i"), F.explode(F.concat(F.filter(span("n_minor"), lambda j: j >= F.col("_own")), F.transform(span("n_major"), lambda j: -1 - j))).alias("j"))
    as_second = minor.select(*columns, F.lit(1).alias("side"), F.explode(F.filter(span("n_minor"), lambda i: i <= F.col("_own"))).alias("i"), F.col("_own").alias("j"))
    majors = major.select(*columns, F.lit(1).alias("side"), F.explode(span("n_minor")).alias("i"), (-1 - F.col("_own")).alias("j"))
    rows = as_first.unionByName(as_second).unionByName(majors)

    def meet(t):
        side = np.asarray(t.column("side"))
        node, comp, n, common = (np.asarray(t.column(k)) for k in ("node", "comp", "n", "common"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        told = t.column("profile").to_pylist()
        plain = np.array([len(x) == PROFILE for x in told])
        profile = np.frombuffer(b"".join(x if len(x) == PROFILE else bytes(PROFILE) for x in told), np.uint8).reshape(-1, PROFILE)
        place = (t.column("key")[0].as_py() & 0xFFFFFFFFFFFFFFFF) >> 48
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b, more = [], [], []
        for i in p:
            most = np.minimum(common[q], common[i])
            hit = np.flatnonzero((comp[q] != comp[i]) & (100 * most >= percent * (n[q] + n[i] - most)))
            differ = (sig[q[hit]] != sig[i]).reshape(-1, CHUNKS, CHUNK)
            wrong = differ.sum(axis=2)
            chunk = (wrong <= 1).argmax(axis=1)
            first = chunk * CHUNK + differ[np.arange(len(hit)), chunk].argmax(axis=1)  # no error: the first wildcard
            off = wrong.sum(axis=1)
            good = (off <= DISTANCE) & (first == place)
            hit, off = hit[good], off[good]
            shared = np.where(plain[q[hit]] & plain[i], np.minimum(profile[q[hit]], profile[i]).sum(axis=1, dtype=np.int64), most[hit])
            good = 100 * shared >= percent * (n[q[hit]] + n[i] - shared)
            hit, off = hit[good], off[good]
            if len(hit) > top:
                hit = hit[np.lexsort((node[q[hit]], off))[: top + 1]]
                more.append(np.append(np.zeros(top, bool), True))
            else:
                more.append(np.zeros(len(hit), bool))
            a.append(np.full(len(hit), node[i]))
            b.append(node[q[hit]])
        a, b, more = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, more))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64()), "more": pa.array(more.astype(bool))})

    return rows.groupBy("key", "i", "j").applyInArrow(meet, "a long, b long, more boolean")


def _in_reach(rows: DataFrame, who: str) -> DataFrame:
    """``rows`` (key, band, ...) whose entry has several ``who`` in their band and its neighbours, with the ``least`` of these."""
    cells = rows.groupBy("key", "band").agg(F.min(who).alias("_lo"), F.max(who).alias("_hi"))
    near = F.explode(F.array(*((F.col("band") + k).cast("smallint") for k in (-1, 0, 1)))).alias("band")
    spread = cells.select("key", near, "_lo", "_hi").groupBy("key", "band").agg(F.min("_lo").alias("least"), F.max("_hi").alias("_hi")).where("least < _hi")
    return rows.join(spread.drop("_hi"), ["key", "band"])


def link_components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    signed = stage(_signed(docs, shingle), "near-signed")
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n"))
    # ids in several classes (rows that share an id) keep the links of each
    members = stage(classes.where("node is not null"), "near-classes")
    keys = _entries(members, percent)
    # the entries that more than one class has
    shared = stage(keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key"), "near-entries")
    held = stage(within(keys, shared, "key"), "near-held")
    met = stage(_in_reach(held, "node"), "near-met")
    free(shared, held)
    tried = stage(met.where("least < node").groupBy("node").agg(F.min("least").alias("a")).select("a", F.col("node").alias("b")), "near-stars")
    links = _confirmed(docs, tried, shingle, percent)
    found = stage(components(links), "near-components")
    free(links)
    labelled = lambda rows, name, out: rows.join(found.select(F.col("node").alias(name), F.col("component").alias("_c")), name, "left").withColumn(out, F.coalesce("_c", name)).drop("_c")
    places, top, known = met.drop("least"), 16, None
    while True:
        labels = stage(labelled(places, "node", "comp"), "near-labels")
        placed = stage(_in_reach(labels, "comp").drop("least"), "near-placed")
        free(labels)
        counts = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
        several = counts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n_all"))
        several = stage(several.select("key", F.col("top.comp").alias("top"), F.col("top.n").alias("n_major"), (F.col("n_all") - F.col("top.n")).alias("n_minor")), "near-several")
        rows = placed.drop("band").join(several, "key").withColumn("major", F.col("comp") == F.col("top"))
        if known is None:
            nodes = stage(placed.select("node").distinct(), "near-open")
            sizes = signed.where("digest is not null").groupBy(F.col("doc_id").alias("node")).agg(F.max("n_shingles").alias("_most"), F.min("n_shingles").alias("n"), F.count_distinct("digest").alias("_sets"))
            # an id with several sets is bounded by none of them
            common = F.when(F.col("_sets") > 1, F.col("_most")).otherwise(F.col("n") - F.coalesce("own", F.lit(0)))
            sigs = members.groupBy("node").agg(F.min("sig").alias("sig"))
            measured = nodes.join(sizes, "node").join(_exclusive(docs, nodes, shingle), "node", "left").select("node", "n", common.alias("common"), (F.col("_sets") > 1).alias("several_sets")).join(sigs, "node")
            measured = stage(measured.where(100 * F.col("common") >= percent * F.col("n")), "near-measured")
            known = measured.join(_profiles(docs, measured.select("node"), shingle), "node")
            known = stage(known.withColumn("profile", F.when(F.col("several_sets"), F.lit(b"")).otherwise(F.col("profile"))).drop("several_sets"), "near-known")
            places = stage(placed.drop("comp").join(known.select("node"), "node", "left_semi"), "near-places")
            free(met, nodes, measured, placed, several)
            continue
        near = stage(_across(rows.join(known, "node"), top, percent), "near-pairs")
        free(placed, several)
        fresh = stage(near.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "near-fresh")
        if fresh.limit(1).count():
            before, tried = tried, stage(tried.unionByName(fresh), "near-tried")
            free(before)
            new = _confirmed(docs, fresh, shingle, percent)
            if new.limit(1).count():
                joined = components(labelled(labelled(new, "a", "ca"), "b", "cb").select("ca", "cb"), "ca", "cb")
                every = found.unionByName(new.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
                before, found = found, stage(every.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left").select("node", F.coalesce("_to", "component").alias("component")), "near-components")
                free(before)
            free(new)
        done = not near.where("more").limit(1).count()
        free(near, fresh)
        # without more, every pair in reach has been named and compared
        if done:
            break
        top *= 16
    free(known, places, tried)
    to = members.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    linked = signed.drop("sig").join(to, "digest", "left")
    # an id in several classes reports the smallest component of them through its links
    component = F.coalesce(F.col("component"), F.col("doc_id"))
    return linked.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _own_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that numbers its texts: the id, but where it is null or has several texts a number beyond all ids; and its name."""
    name = "rid"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    sha = F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), 1, 16)
    told = docs.select(F.col("doc_id").cast("long").alias("_id"), sha.alias("_sha"))
    odd = stage(told.groupBy("_id").agg(F.min("_sha").alias("_a"), F.max("_sha").alias("_b")).where("_id is null or _a <> _b").select("_id"), "near-odd")
    if not odd.limit(1).count():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    most = told.agg(F.max("_id")).first()[0] or 0
    # numbered once and written, so that a lost task does not number them anew
    numbered = stage(told.alias("t").join(odd.alias("o"), F.expr("t._id <=> o._id"), "left_semi").distinct().withColumn("_new", F.monotonically_increasing_id() + (max(most, 0) + 1)), "near-numbers")
    keyed = docs.withColumn(name, sha).alias("d").join(numbered.alias("n"), F.expr(f"cast(d.doc_id as long) <=> n._id and d.{name} = n._sha"), "left")
    return keyed.select(*(F.col(f"d.`{c}`") for c in docs.columns), F.coalesce("n._new", F.col("d.doc_id").cast("long")).alias(name)), name


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of every component, unchanged: the one with the smallest id; rows without an id come after all others.

    Texts are linked by themselves: a null id or one that several texts share joins
    nothing and loses nothing.  Rows without a word are linked with nothing; rows
    with one id and one text are copies, of which one stays, the first by its columns.
    """
    rows, rid = _own_ids(docs)
    told = stage(link_components(rows.select(F.col(rid).alias("doc_id"), "text"), shingle, percent), "near-told")
    losers = stage(told.where("not kept").select(F.col("doc_id").alias(rid)).distinct(), "near-losers")
    again = stage(told.groupBy(F.col("doc_id").alias(rid)).count().where("count > 1").select(rid), "near-repeated")
    told = perhaps(rows, rid, bits_of(losers, rid), f"{rid}_")
    kept = told.where(~F.col(f"{rid}_")).drop(f"{rid}_").unionByName(told.where(F.col(f"{rid}_")).drop(f"{rid}_").join(losers, rid, "left_anti").select(*(F.col(f"`{c}`") for c in rows.columns)))
    if not again.limit(1).count():
        return kept.drop(rid)
    copy = (F.col("text").rlike(r"[^\x20\x09-\x0D]") & F.col("text").isNotNull()) | F.col("doc_id").isNotNull()
    first = Window.partitionBy(rid).orderBy(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))))
    repeated = kept.join(again, rid, "left_semi")
    one = repeated.where(copy).withColumn(f"{rid}_", F.row_number().over(first)).where(f"{rid}_ = 1")
    return kept.join(again, rid, "left_anti").drop(rid).unionByName(one.drop(rid, f"{rid}_")).unionByName(repeated.where(~copy).drop(rid))


def op9_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)


#: Shared shingles of all pairs, and labels spread along links to the smallest id.
OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node) c USING (doc_id)
"""
