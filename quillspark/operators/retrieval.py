"""Postings, TF-IDF, prefix search, spelling correction and deletion indexes as relational plans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.distance import damerau_levenshtein
from ..functions.text import StopWords, ascii_words
from ..session import attach

#: Terms of all queries together that are sent to the documents; more meet them in a join.
ASKED = 200_000
#: Scores, and products summed into them, that a worker holds at a time.
CELLS = 1 << 20


class Analyzer:
    """Text to terms: tokens, case folding, optional stop words; the same for documents and queries."""

    def __init__(self, tokenize=ascii_words, lower: bool = True, stop_words: StopWords | None = None):
        self.tokenize, self.lower, self.stop_words = tokenize, lower, stop_words

    def terms(self, text: Column) -> Column:
        out = self.tokenize(text)
        if self.lower:
            out = F.transform(out, F.lower)
        return self.stop_words.keep(out) if self.stop_words else out


class TfIdf:
    """A corpus as a postings table (doc, term, tf, first) and its document frequencies.

    Texts are shuffled once, by document, as they are smaller than their postings; statistics are aggregates of the postings.
    """

    def __init__(self, docs: DataFrame, key: str, text: str | Column, analyzer: Analyzer | None = None):
        self.analyzer = analyzer or Analyzer()
        column = F.col(text) if isinstance(text, str) else text
        self.documents = docs.select(F.col(key).alias("doc"), self.analyzer.terms(F.coalesce(column, F.lit(""))).alias("terms"))
        together = docs.select(F.col(key).alias("doc"), F.coalesce(column, F.lit("")).alias("text")).repartition("doc").select("doc", self.analyzer.terms(F.col("text")).alias("terms"))
        self.postings = together.select("doc", F.posexplode("terms").alias("pos", "term")).groupBy("doc", "term").agg(F.count("*").alias("tf"), F.min("pos").alias("first"))

    def without(self, doc) -> TfIdf:
        """The corpus without one document."""
        out = object.__new__(TfIdf)
        out.analyzer = self.analyzer
        out.documents = self.documents.where(F.col("doc") != F.lit(doc))
        out.postings = self.postings.where(F.col("doc") != F.lit(doc))
        return out

    def document(self, doc) -> DataFrame:
        """(distinct_terms, total_terms) of one document."""
        return self.documents.where(F.col("doc") == F.lit(doc)).select(F.size(F.array_distinct("terms")).cast("long").alias("distinct_terms"), F.size("terms").cast("long").alias("total_terms"))

    def size(self) -> DataFrame:
        return self.documents.agg(F.count("*").alias("n_docs"))

    def document_frequency(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def idf(self) -> DataFrame:
        """(term, df, idf): 1 + ln(n / (1 + df))."""
        return self.document_frequency().crossJoin(F.broadcast(self.size())).select("term", "df", (1 + F.log(F.col("n_docs") / (1 + F.col("df")))).alias("idf"))

    def scores(self, queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
        """(query, doc, score) of documents with a query term; terms of a query count as often as they stand in it."""
        asked = queries.select(F.col(key).alias("query"), F.explode(self.analyzer.terms(F.col(text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
        rows = asked.limit(ASKED + 1).collect()
        if len(rows) > ASKED:
            weighed = asked.join(self.idf(), "term")
            return self.postings.join(weighed, "term").groupBy("query", "doc").agg(F.sum(F.col("tf") * F.col("times") * F.col("idf")).alias("score"))
        return self._scores(rows, asked.schema["query"].dataType)

    def _scores(self, rows: list, kind: T.DataType) -> DataFrame:
        """Scores of few queries: only their terms leave the documents, and a document meets all queries at once."""
        spark = attach(self.documents.sparkSession)
        slots, names = {}, {}
        at = np.array([(slots.setdefault(r["term"], len(slots)), names.setdefault(r["query"], len(names)), r["times"]) for r in rows], np.int64).reshape(-1, 3)
        known = F.broadcast(spark.createDataFrame(list(slots.items()), "term string, slot int"))
        found = self.documents.select("doc", F.explode("terms").alias("term")).join(known, "term").groupBy("doc", "slot").agg(F.count("*").alias("tf"))
        # the counts are named here too, so that both uses read one shuffle
        df = found.groupBy("slot").agg(F.count(F.when(F.col("tf") > 0, 1)).alias("df"))
        idf = df.crossJoin(F.broadcast(self.size())).select("slot", (1 + F.log(F.col("n_docs") / (1 + F.col("df")))).alias("idf"))
        weighed = found.join(F.broadcast(idf), "slot").select("doc", "slot", "tf", "idf").repartition("doc").sortWithinPartitions("doc")
        schema = T.StructType([T.StructField("query", kind), T.StructField("doc", self.documents.schema["doc"].dataType), T.StructField("score", T.DoubleType())])
        at = at[np.argsort(at[:, 0], kind="stable")]
        return weighed.mapInArrow(_matcher(at, pa.array(list(names), to_arrow_type(kind)), len(slots)), schema)

    def rank(self, query: str, top: int | None = None) -> DataFrame:
        """All documents, 0.0 included, by score downwards and document upwards."""
        spark = self.documents.sparkSession
        found = self.scores(spark.createDataFrame([(0, query)], "query_id int, query string")).select("doc", "score")
        out = self.documents.select("doc").join(found, "doc", "left").select("doc", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "doc")
        return out.limit(top) if top is not None else out

    def list_terms(self) -> DataFrame:
        """(doc, term, tfidf, rank): each document's terms by weight downwards, term upwards."""
        # hashed, not sorted: the vocabulary of a partition is small beside its postings, and these need not spill
        weighed = self.postings.join(self.idf().hint("shuffle_hash"), "term").select("doc", "term", (F.col("tf") * F.col("idf")).alias("tfidf"))
        return weighed.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("tfidf"), "term")))

    def save(self, path: str) -> None:
        """Postings as Parquet, and a stamp of what they depend on."""
        from ..sources.artifacts import write_stamp

        self.postings.write.mode("overwrite").parquet(f"{path}/postings")
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        write_stamp(self.documents.sparkSession, path, "tfidf", {"lower": self.analyzer.lower})

    @classmethod
    def load(cls, spark, path: str, analyzer: Analyzer | None = None) -> TfIdf:
        from ..sources.artifacts import check_stamp

        out = object.__new__(cls)
        out.analyzer = analyzer or Analyzer()
        check_stamp(spark, path, "tfidf", {"lower": out.analyzer.lower})
        out.documents, out.postings = spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/postings")
        return out


def _matcher(asked: np.ndarray, queries: pa.Array, n_slots: int):
    """Sorted (doc, slot, tf, idf) batches to (query, doc, score); ``asked`` has (slot, query, times) by slot."""
    width = len(queries)
    lengths = np.bincount(asked[:, 0], minlength=n_slots)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)

    def sums(doc, slot, tf, idf, n):
        """Scores of ``n`` documents with all queries, and where they have a term in common."""
        scores, hits = np.zeros(n * width), np.zeros(n * width, bool)
        ends, i = np.cumsum(lengths[slot]), 0
        while i < len(slot):
            j = max(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CELLS, "right")), i + 1)
            size = lengths[slot[i:j]]
            row = np.repeat(np.arange(i, j), size)
            pick = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begins[slot[i:j]], size)
            cell = doc[row] * width + asked[pick, 1]
            np.add.at(scores, cell, tf[row] * asked[pick, 2] * idf[row])
            hits[cell] = True
            i = j
        return scores, np.flatnonzero(hits)

    def told(batch):
        coded = batch.column("doc").combine_chunks().dictionary_encode("encode")
        docs, doc = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        slot, tf, idf = (batch.column(c).to_numpy() for c in ("slot", "tf", "idf"))
        step = max(CELLS // max(width, 1), 1)
        for first in range(0, len(docs), step):
            n = min(step, len(docs) - first)
            i, j = np.searchsorted(doc, [first, first + n])
            scores, at = sums(doc[i:j] - first, slot[i:j], tf[i:j], idf[i:j], n)
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(at % width)), docs.take(pa.array(at // width + first)), pa.array(scores[at])], ["query", "doc", "score"])

    def match(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            if kept is not None:
                now = pa.concat_tables([kept, now])
            # the last document may go on in the next batch
            codes = now.column("doc").combine_chunks().dictionary_encode("encode").indices.to_numpy()
            cut = int(np.searchsorted(codes, codes[-1]))
            kept = now.slice(cut)
            if cut:
                yield from told(now.slice(0, cut))
        if kept is not None:
            yield from told(kept)

    return match


class Trie:
    """A set of keys; prefix questions are range predicates and equi-joins on prefixes."""

    def __init__(self, keys: DataFrame, column: str, ignore_case: bool = False):
        self.fold = F.lower if ignore_case else (lambda c: c)
        self.keys = keys.select(self.fold(F.col(column)).alias("key")).where("key is not null").distinct()

    def with_keys(self, more: DataFrame, column: str) -> Trie:
        out = object.__new__(Trie)
        out.fold = self.fold
        out.keys = self.keys.unionByName(more.select(self.fold(F.col(column)).alias("key")).where("key is not null")).distinct()
        return out

    def freeze(self, path: str) -> Trie:
        """The keys as a sorted table on disk, read again: a prefix scan then prunes files and row groups by their key ranges."""
        self.keys.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)
        return Trie.open(self.keys.sparkSession, path, self.fold)

    @classmethod
    def open(cls, spark, path: str, fold=lambda c: c) -> Trie:
        out = object.__new__(cls)
        out.fold, out.keys = fold, spark.read.parquet(path)
        return out

    def contains(self, words: DataFrame, column: str) -> DataFrame:
        known = self.keys.withColumn("found", F.lit(True))
        return words.withColumn("key", self.fold(F.col(column))).join(known, "key", "left").withColumn("found", F.coalesce("found", F.lit(False))).drop("key")

    def keys_with_prefix(self, prefix: str) -> DataFrame:
        return self.keys.where(F.col("key").startswith(self.fold(F.lit(prefix))))

    def prefixes(self) -> DataFrame:
        """Nodes below the root: all prefixes of all keys."""
        cut = F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring(F.col("key"), F.lit(1), i))
        return self.keys.where("length(key) > 0").select(F.explode(cut).alias("prefix")).distinct()

    def node_count(self) -> DataFrame:
        return self.prefixes().agg((F.count("*") + 1).alias("nodes"))

    @staticmethod
    def _cuts(words: DataFrame, column: Column) -> DataFrame:
        return words.withColumn("_n", F.explode(F.sequence(F.lit(0), F.length(column)))).withColumn("key", F.substring(column, F.lit(1), F.col("_n")))

    def prefix_matches(self, words: DataFrame, column: str) -> DataFrame:
        """(word, key): stored keys that begin the word."""
        asked = words.select(self.fold(F.col(column)).alias("word")).distinct()
        return self._cuts(asked, F.col("word")).join(self.keys, "key").select("word", "key")

    def longest_prefix(self, words: DataFrame, column: str) -> DataFrame:
        """(word, prefix, rest): the longest key that begins the word, and what is left where the walk along the nodes ended."""
        asked = words.select(self.fold(F.col(column)).alias("word")).where("word is not null").distinct()
        cuts = self._cuts(asked, F.col("word"))
        found = cuts.join(self.keys, "key").groupBy("word").agg(F.max("_n").alias("_key"))
        walked = cuts.join(self.prefixes().withColumnRenamed("prefix", "key"), "key").groupBy("word").agg(F.max("_n").alias("_walk"))
        joined = asked.join(found, "word", "left").join(walked, "word", "left")
        return joined.select("word", F.expr("substring(word, 1, _key)").alias("prefix"), F.expr("substring(word, coalesce(_walk, 0) + 1)").alias("rest"))


def _deletions(word: Column, k: int) -> Column:
    """The word and all strings left by up to ``k`` deletions, distinct."""
    out = F.array(word)
    level = F.array(word)
    for _ in range(k):
        level = F.array_distinct(F.flatten(F.transform(level, lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>")))))
        out = F.array_union(out, level)
    return out


#: Edits up to which words meet by shared deletions.
DELETIONS = 2


class ReachError(ValueError):
    """More edits were asked for than an index was built for."""


class DeletionIndex:
    """Words under their deletions, built for up to ``k`` edits; answers are verified by distance."""

    def __init__(self, words: DataFrame, column: str, k: int):
        self.k = k
        self.rows = words.select(F.col(column).alias("word")).where("word is not null").distinct().select("word", F.explode(_deletions(F.col("word"), k)).alias("cut"))

    def neighbours(self, queries: DataFrame, column: str, k: int | None = None) -> DataFrame:
        """(query, word, distance) within ``k`` edits, the index's own by default."""
        k = self.k if k is None else k
        if k > self.k:
            raise ReachError(f"the index reaches {self.k} edits, not {k}")
        asked = queries.select(F.col(column).alias("query")).where(F.col(column).isNotNull()).distinct().select("query", F.explode(_deletions(F.col("query"), k)).alias("cut"))
        met = asked.join(self.rows, "cut").select("query", "word").distinct()
        return met.withColumn("distance", damerau_levenshtein(F.col("query"), F.col("word"))).where(F.col("distance") <= k)


class Spellcheck:
    """A dictionary of word frequencies; corrections join on shared deletions and are verified by distance."""

    def __init__(self, corpus: DataFrame, column: str):
        self.words = corpus.select(F.col(column).alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("frequency"))

    def is_correct(self, queries: DataFrame, column: str) -> DataFrame:
        asked = queries.select(F.col(column).alias("word")).distinct()
        return asked.join(self.words, "word", "left").select("word", F.coalesce("frequency", F.lit(0)).alias("frequency"), F.col("frequency").isNotNull().alias("correct"))

    def deletion_index(self, k: int) -> DataFrame:
        """(cut, word): every string left by up to ``k`` deletions of a word."""
        return self.words.select("word", F.explode(_deletions(F.col("word"), k)).alias("cut"))

    def candidates(self, queries: DataFrame, column: str, k: int) -> DataFrame:
        """(query, word) that may lie within ``k``: two words within k edits share a string of k deletions each.

        Beyond ``DELETIONS`` the strings are too many; words are then met by length, which k edits change by k at most.
        """
        if k > DELETIONS:
            asked = queries.select(F.col(column).alias("query")).where(F.col(column).isNotNull()).distinct()
            lengths = F.explode(F.sequence(F.greatest(F.length("query") - k, F.lit(0)), F.length("query") + k)).alias("_n")
            return asked.select("query", lengths).join(self.words.select("word", F.length("word").alias("_n")), "_n").select("query", "word")
        asked = queries.select(F.col(column).alias("query")).where(F.col(column).isNotNull()).distinct()
        return asked.select("query", F.explode(_deletions(F.col("query"), k)).alias("cut")).join(self.deletion_index(k), "cut").select("query", "word").distinct()

    def neighbours(self, queries: DataFrame, column: str, k: int) -> DataFrame:
        """(query, word, distance) of all words within ``k`` Damerau-Levenshtein edits."""
        return self.candidates(queries, column, k).withColumn("distance", damerau_levenshtein(F.col("query"), F.col("word"))).where(F.col("distance") <= k)

    def correction_words(self, queries: DataFrame, column: str, k: int = 1) -> DataFrame:
        """(query, words): the words of the corrections in their order; queries without one are left out."""
        ranked = self.corrections(queries, column, k).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("w"))
        return ranked.select("query", F.transform("w", lambda x: x["word"]).alias("words"))

    def corrections(self, queries: DataFrame, column: str, k: int = 1) -> DataFrame:
        """(query, word, distance, frequency) of all words within ``k`` Damerau-Levenshtein edits, ranked."""
        near = self.neighbours(queries, column, k)
        order = Window.partitionBy("query").orderBy("distance", F.desc("frequency"), "word")
        return near.join(self.words, "word").withColumn("rank", F.row_number().over(order)).select("query", "word", "distance", "frequency", "rank")

    def best(self, queries: DataFrame, column: str, k: int = 1) -> DataFrame:
        near = self.neighbours(queries, column, k)
        first = near.join(self.words, "word").groupBy("query").agg(F.min(F.struct("distance", (-F.col("frequency")).alias("_f"), "word")).alias("b"))
        return first.select("query", F.col("b.word").alias("word"), F.col("b.distance").alias("distance"), (-F.col("b._f")).alias("frequency"))


def phonetic_index(entries: DataFrame, key: str, codes: Column) -> DataFrame:
    """(entry, code): a row per code; join two of them on code for blocking."""
    return entries.select(F.col(key).alias("entry"), F.explode(codes).alias("code")).where("code <> ''")


def phonetic_neighbours(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, entry) that share a code, each pair once."""
    return queries.select(F.col("entry").alias("query"), "code").join(index, "code").select("query", "entry").distinct()
