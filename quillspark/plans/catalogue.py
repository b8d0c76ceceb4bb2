"""Registered queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance, inflection, phonetics, stemming, text
from ..operators import classify, graphs, language, retrieval, sentiment, tagging
from ..session import attach, table
from ..sources import artifacts
from ..streaming import events as streaming

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _words(column) -> F.Column:
    return F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


_W = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
_DOCS = f"d AS (SELECT doc_id, lang, {_W.format('text')} AS w FROM documents)"
_TALK = f"t AS (SELECT conv_id * 1000 + turn AS doc, role, {_W.format('text')} AS w FROM conversations)"


def _talk(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), F.col("role").alias("label"), _words(F.col("text")).alias("tokens"))


# --- sequences and stop words


@query(f"WITH {_DOCS} SELECT w[i] || ' ' || w[i + 1] AS gram, count(*)::BIGINT AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM d) GROUP BY 1")
def ngrams_words(spark: SparkSession, sf: str) -> DataFrame:
    # the words are a column of their own, or every window would split the text again
    grams = text.ngrams(F.col("w"), 2)
    return table(spark, sf, "documents").select(_words(F.col("text")).alias("w")).select(F.explode(F.transform(grams, lambda g: F.array_join(g, " "))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey, ['<', '<'] || string_split(p_name, ' ') || ['>', '>'] AS w FROM part)
SELECT p_partkey, array_to_string(w[i : i + 2], ' ') AS gram FROM (SELECT p_partkey, w, unnest(range(1, len(w) - 1)) AS i FROM p)""")
def ngrams_padded(spark, sf):
    tokens = text.padded(F.split("p_name", " "), 3, "<", ">")
    return table(spark, sf, "part").select("p_partkey", tokens.alias("w")).select("p_partkey", F.explode(text.ngrams(F.col("w"), 3)).alias("g")).select("p_partkey", F.array_join("g", " ").alias("gram"))


@query("SELECT substr(p_name, i, 3) AS gram, count(*)::BIGINT AS n FROM (SELECT p_name, unnest(range(1, length(p_name) - 1)) AS i FROM part) GROUP BY 1")
def char_ngrams_part(spark, sf):
    return table(spark, sf, "part").select(F.explode(text.char_ngrams(F.col("p_name"), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


_STOPS = sorted(text.STOP_WORDS["en"])


@query(f"WITH {_DOCS}, s AS (SELECT unnest([{', '.join(repr(w) for w in _STOPS)}]) AS word) SELECT lang, count(*)::BIGINT AS kept FROM (SELECT lang, unnest(w) AS word FROM d) ANTI JOIN s USING (word) GROUP BY lang")
def stopword_antijoin(spark, sf):
    stops = text.StopWords.for_language("en").table(spark)
    rows = table(spark, sf, "documents").select("lang", F.explode(_words(F.col("text"))).alias("word"))
    return rows.join(F.broadcast(stops), "word", "left_anti").groupBy("lang").agg(F.count("*").alias("kept"))


@query(f"WITH {_DOCS} SELECT doc_id, len(w)::INT AS n_all, len(list_filter(w, lambda x: NOT list_contains([{', '.join(repr(w) for w in _STOPS)}], x)))::INT AS n_kept FROM d")
def stopword_filter(spark, sf):
    w = _words(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(w).alias("n_all"), F.size(text.StopWords.for_language("en").keep(w)).alias("n_kept"))


def _listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + "]"


@query(f"WITH {_DOCS} SELECT doc_id, len(list_filter(w, lambda x: " + " ".join(["CASE lang", *(f"WHEN '{k}' THEN list_contains({_listed(v)}, x)" for k, v in text.STOP_WORDS.items()), "ELSE false END"]) + "))::INT AS n_stops FROM d")
def stopword_languages(spark, sf):
    """Stop words of each document by the list of its own language."""
    lists = F.create_map(*[x for k, v in text.STOP_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    own = F.coalesce(F.try_element_at(lists, F.col("lang")), F.array().cast("array<string>"))
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(_words(F.col("text")), lambda w: F.array_contains(own, w))).alias("n_stops"))


@query(f"WITH {_DOCS} SELECT doc_id, len(list_filter(w, lambda x: list_contains({_listed(('lot', 'the', 'und'))}, x)))::INT AS n FROM d")
def global_stop_list(spark, sf):
    text.set_global_stop_words(spark, text.StopWords(("the", "und", "lot")))
    stops = text.global_stop_words(spark)
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(_words(F.col("text")), stops.holds)).alias("n"))


@query(f"""WITH a AS (SELECT DISTINCT unnest({_W.format('text')}) AS word FROM documents), b AS (SELECT DISTINCT unnest({_W.format('text')}) AS word FROM conversations)
SELECT word, 'both' AS side FROM (SELECT word FROM a INTERSECT SELECT word FROM b) UNION ALL SELECT word, 'documents' FROM (SELECT word FROM a EXCEPT SELECT word FROM b) UNION ALL SELECT word, 'conversations' FROM (SELECT word FROM b EXCEPT SELECT word FROM a)""")
def vocabulary_set_ops(spark, sf):
    a, b = (table(spark, sf, t).select(F.explode(_words(F.col("text"))).alias("word")) for t in ("documents", "conversations"))
    side = lambda rows, name: rows.withColumn("side", F.lit(name))
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "documents")).unionByName(side(b.subtract(a), "conversations"))


@query("SELECT doc_id, nfc_normalize(text) AS nfc FROM documents")
def normalize_nfc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalized(F.col("text")).alias("nfc"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def remove_diacritics(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.remove_diacritics(F.col("text")).alias("plain"))


@query()
def sentences(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(text.sentence_tokens(F.col("text"), ("Dr.", "Mr."))).alias("place", "sentence"))


@query()
def word_segments(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.word_tokens(F.col("text"))).alias("n_words"), F.size(text.segment_tokens(F.col("text"))).alias("n_segments"))


# --- distance

_PAIRS = "p AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey)"


def _pairs(spark, sf):
    n = table(spark, sf, "nation")
    x, y = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))
    return x.join(y, F.col("i") < F.col("j")).select("a", "b")


def _scored(spark, sf, fn, digits=6):
    return _pairs(spark, sf).select("a", "b", F.round(fn(F.col("a"), F.col("b")).cast("double"), digits).alias("score"))


@query(f"WITH {_PAIRS} SELECT a, b, levenshtein(a, b)::DOUBLE AS score FROM p")
def lev_names(spark, sf):
    return _scored(spark, sf, distance.levenshtein)


@query(f"WITH {_PAIRS} SELECT a, b, damerau_levenshtein(a, b)::DOUBLE AS score FROM p")
def damerau_names(spark, sf):
    return _scored(spark, sf, distance.damerau_levenshtein)


@query(f"WITH {_PAIRS} SELECT a, b, CASE WHEN length(a) = length(b) THEN hamming(a, b)::DOUBLE END AS score FROM p WHERE length(a) = length(b) UNION ALL SELECT a, b, NULL FROM p WHERE length(a) <> length(b)")
def hamming_null(spark, sf):
    return _scored(spark, sf, distance.hamming)


@query(f"WITH {_PAIRS} SELECT a, b, round(jaro_similarity(a, b), 6) AS score FROM p")
def jaro_names(spark, sf):
    return _scored(spark, sf, distance.jaro)


@query(f"""WITH {_PAIRS}, j AS (SELECT a, b, jaro_similarity(a, b) AS j,
  CASE WHEN a[1:1] <> b[1:1] THEN 0 WHEN a[1:2] <> b[1:2] THEN 1 WHEN a[1:3] <> b[1:3] THEN 2 WHEN a[1:4] <> b[1:4] THEN 3 ELSE 4 END AS l FROM p)
SELECT a, b, round(j + l * 0.1::DOUBLE * (1 - j), 6) AS score FROM j""")
def jaro_winkler_names(spark, sf):
    return _scored(spark, sf, distance.jaro_winkler)


_GRAMS = "list_distinct([substr({0}, i, 2) FOR i IN range(1, length({0}))])"


@query(f"WITH {_PAIRS} SELECT a, b, round(2.0::DOUBLE * len(list_intersect({_GRAMS.format('a')}, {_GRAMS.format('b')})) / (len({_GRAMS.format('a')}) + len({_GRAMS.format('b')})), 6) AS score FROM p")
def dice_names(spark, sf):
    return _scored(spark, sf, distance.dice_coefficient)


def _restricted_sql(insertion: float, deletion: float, substitution: float, transposition: float | None) -> str:
    """The rows of the edit table, one a step: a row is the least of what stands above, and of insertions from its left."""
    swap = f", CASE WHEN i >= 1 AND k >= 2 AND a[i + 1] = b[k - 1] AND a[i] = b[k] THEN before[k - 1] + {transposition}::DOUBLE END" if transposition is not None else ""
    above = f"[CASE WHEN k = 0 THEN last[1] + {deletion} ELSE least(last[k + 1] + {deletion}, last[k] + CASE WHEN a[i + 1] = b[k] THEN 0 ELSE {substitution} END{swap}) END - k * {insertion} FOR k IN range(0, length(b) + 1)]"
    return f"""r AS (SELECT a, b, 0 AS i, [j * {insertion}::DOUBLE FOR j IN range(0, length(b) + 1)] AS last, NULL::DOUBLE[] AS before FROM p
UNION ALL SELECT a, b, i + 1, [j * {insertion}::DOUBLE + list_min(c[1 : j + 1]) FOR j IN range(0, length(b) + 1)], last FROM (SELECT *, {above} AS c FROM r WHERE i < length(a)))"""


@query(f"WITH RECURSIVE {_PAIRS}, {_restricted_sql(1, 1, 1, 1)} SELECT a, b, last[length(b) + 1]::DOUBLE AS score FROM r WHERE i = length(a)")
def osa_names(spark, sf):
    return _scored(spark, sf, distance.osa)


_COSTS = distance.Costs(1.25, 0.75, 0.5, 1.0)


@query(f"WITH RECURSIVE {_PAIRS}, {_restricted_sql(1.25, 0.75, 0.5, None)} SELECT a, b, last[length(b) + 1]::DOUBLE AS score FROM r WHERE i = length(a)")
def weighted_levenshtein_names(spark, sf):
    return _scored(spark, sf, lambda a, b: distance.levenshtein_weighted(a, b, _COSTS))


@query(f"WITH RECURSIVE {_PAIRS}, {_restricted_sql(1.25, 0.75, 0.5, 1.0)} SELECT a, b, last[length(b) + 1]::DOUBLE AS score FROM r WHERE i = length(a)")
def weighted_osa_names(spark, sf):
    return _scored(spark, sf, lambda a, b: distance.osa_weighted(a, b, _COSTS))


_VOCABULARY = f"n AS (SELECT DISTINCT unnest({_W.format('text')}) AS name FROM documents)"


def _vocabulary(spark, sf):
    return table(spark, sf, "documents").select(F.explode(_words(F.col("text"))).alias("name")).distinct()


@query(f"WITH {_VOCABULARY} SELECT name, levenshtein(name, reverse(name))::INT AS levenshtein, damerau_levenshtein(name, reverse(name))::INT AS damerau, round(jaro_similarity(name, reverse(name)), 6) AS jaro FROM n")
def distance_vocabulary(spark, sf):
    """Every word of the documents against itself backwards."""
    a, b = F.col("name"), F.reverse("name")
    return _vocabulary(spark, sf).select("name", distance.levenshtein(a, b).alias("levenshtein"), distance.damerau_levenshtein(a, b).alias("damerau"), F.round(distance.jaro(a, b), 6).alias("jaro"))


@query("SELECT c_custkey, levenshtein('Customer#000000042', c_name)::INT AS distance FROM customer")
def prepared_pattern(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", distance.PreparedPattern("Customer#000000042").levenshtein(F.col("c_name")).alias("distance"))


@query("""WITH s AS (SELECT c_custkey, c_name, unnest(range(0, length(c_name) + 1)) AS a FROM customer), t AS (SELECT c_custkey, a, unnest(range(a, length(c_name) + 1)) AS b, c_name FROM s)
SELECT c_custkey, min(levenshtein('tomer#0001', c_name[a + 1 : b]))::DOUBLE AS distance FROM t GROUP BY c_custkey""")
def substring_distance(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", distance.best_substring(F.lit("tomer#0001"), F.col("c_name"))["distance"].alias("distance"))


@query()
def weighted_names(spark, sf):
    costs = distance.Costs(1.0, 1.0, 0.5, 1.0)
    return _pairs(spark, sf).select("a", "b", distance.levenshtein_weighted(F.col("a"), F.col("b"), costs).alias("lev"), distance.osa_weighted(F.col("a"), F.col("b"), costs).alias("osa"), distance.damerau_levenshtein_weighted(F.col("a"), F.col("b"), costs).alias("damerau"))


@query()
def substring_search(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", distance.best_substring(F.lit("tomer#0001"), F.col("c_name")).alias("m")).select("c_custkey", "m.*")


# --- phonetics

_NAMES = "SELECT DISTINCT name FROM (SELECT n_name AS name FROM nation UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part)"


def _names(spark, sf):
    parts = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("name"))
    return table(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(parts).distinct()


def _coded(spark, sf, fn):
    return _names(spark, sf).select("name", fn(F.col("name")).alias("code"))


_LETTERS = "upper(regexp_replace(name, '[^A-Za-z]', '', 'g'))"
_REFINED = f"(SELECT name, {_LETTERS} AS l, string_split(translate({_LETTERS}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{phonetics._REFINED}'), '') AS d FROM n)"
_COLLAPSED = "array_to_string([d[i] FOR i IN range(1, len(d) + 1) IF i = 1 OR d[i] <> d[i - 1]], '')"


@query(f"WITH n AS ({_NAMES}) SELECT name, CASE WHEN l = '' THEN '' ELSE l[1:1] || {_COLLAPSED} END AS code FROM {_REFINED}")
def refined_soundex(spark, sf):
    return _coded(spark, sf, phonetics.refined_soundex)


def _cascade_sql(version: int, size: int) -> str:
    out = "regexp_replace(lower(name), '[^a-z]', '', 'g')"
    for pattern, to in phonetics.caverphone_steps(version):
        pattern, ahead = re.subn(r"\(\?=(.*)\)$", r"(\1)", pattern)
        step = f"{to}\\1" if ahead else to
        out = f"regexp_replace({out}, '{pattern}', '{step}', 'g')"
    return f"WITH n AS ({_NAMES}) SELECT name, substr({out} || '{'1' * size}', 1, {size}) AS code FROM n"


@query(_cascade_sql(1, 6))
def caverphone1(spark, sf):
    return _coded(spark, sf, phonetics.caverphone1)


@query(_cascade_sql(2, 10))
def caverphone2(spark, sf):
    return _coded(spark, sf, phonetics.caverphone2)


#: Letters without H and W behind the first, as digits; runs are one, vowels part runs and go, and the first digit is the letter's own.
_SOUNDEX = f"""l AS (SELECT name, {_LETTERS} AS l FROM n),
d AS (SELECT name, l, string_split(translate(l[1:1] || regexp_replace(l[2:], '[HW]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202'), '') AS d FROM l)
SELECT name, CASE WHEN l = '' THEN '' ELSE substr(l[1:1] || replace(array_to_string([d[i] FOR i IN range(2, len(d) + 1) IF d[i] <> d[i - 1]], ''), '0', '') || '000', 1, 4) END AS code FROM d"""


@query(f"WITH n AS ({_NAMES}), {_SOUNDEX}")
def soundex_names(spark, sf):
    return _coded(spark, sf, phonetics.soundex)


@query(f"WITH {_VOCABULARY}, {_SOUNDEX}")
def soundex_vocabulary(spark, sf):
    return _vocabulary(spark, sf).select("name", phonetics.soundex(F.col("name")).alias("code"))


for _name, _fn in (("metaphone_names", phonetics.metaphone), ("double_metaphone_names", lambda c: F.array_join(phonetics.double_metaphone(c), "|")), ("nysiis_names", phonetics.nysiis), ("cologne_names", phonetics.cologne), ("phonex_names", phonetics.phonex), ("match_rating_names", phonetics.match_rating), ("daitch_mokotoff_names", lambda c: F.array_join(phonetics.daitch_mokotoff(c), "|"))):
    QUERIES[_name] = lambda spark, sf, fn=_fn: _coded(spark, sf, fn)


@query(f"WITH n AS ({_NAMES}), c AS (SELECT name, l[1:1] || {_COLLAPSED} AS code FROM {_REFINED} WHERE l <> '') SELECT a.name AS query, b.name AS entry FROM c a JOIN c b USING (code)")
def phonetic_bucket_join(spark, sf):
    index = retrieval.phonetic_index(_names(spark, sf), "name", F.array(phonetics.refined_soundex(F.col("name"))))
    return retrieval.phonetic_neighbours(index, index)


# --- words


@query("SELECT p_partkey, p_size::VARCHAR || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th' ELSE CASE p_size % 10 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END END AS nth FROM part")
def ordinal_en(spark, sf):
    return table(spark, sf, "part").select("p_partkey", inflection.ordinal(F.col("p_size")).alias("nth"))


@query("SELECT p_partkey, p_size::VARCHAR || CASE WHEN p_size = 1 THEN 're' ELSE 'e' END AS nth FROM part")
def ordinal_fr(spark, sf):
    return table(spark, sf, "part").select("p_partkey", inflection.ordinal_fr(F.col("p_size"), feminine=True).alias("nth"))


@query()
def plural_part_words(spark, sf):
    return _names(spark, sf).select("name", inflection.NOUNS.plural_of(F.col("name")).alias("plural"), inflection.VERBS.singular_of(F.col("name")).alias("verb"))


@query()
def stem_vocabulary(spark, sf):
    """Every language of the documents with its own stemmer, each distinct word once."""
    docs = table(spark, sf, "documents")
    out = None
    for code in ("en", "de", "fr", "es"):
        words = docs.where(F.col("lang") == code).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
        part = stemming.stem_vocabulary(words, "word", code).withColumn("lang", F.lit(code))
        out = part if out is None else out.unionByName(part)
    return out


_KANA = ("abcdefghijklmnopqrstuvwxyz", "アイウエオカキクケコサシスセソタチツテトナニヌネノハ")


@query(f"WITH n AS ({_NAMES}), k AS (SELECT name, translate(lower(name), '{_KANA[0]}', '{_KANA[1]}') || 'ー' AS w FROM n) SELECT name, CASE WHEN length(w) >= 4 AND regexp_full_match(w, '[゠-ヿ]+') THEN substr(w, 1, length(w) - 1) ELSE w END AS stem FROM k")
def japanese_stems(spark, sf):
    word = F.concat(F.translate(F.lower("name"), *_KANA), F.lit("ー"))
    return _names(spark, sf).select("name", stemming.stem(word, "ja").alias("stem"))


@query(f"WITH {_DOCS} SELECT doc_id, array_to_string(w, ' ') AS stems FROM d")
def persian_stems(spark, sf):
    """The Persian stemmer keeps every word."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(stemming.stems(_words(F.col("text")), "fa"), " ").alias("stems"))


@query()
def lancaster_words(spark, sf):
    return _names(spark, sf).select("name", stemming.stem(F.col("name"), "lancaster").alias("stem"))


# --- prefixes

_KEYS = "k AS (SELECT DISTINCT lower(p_name) AS key FROM part)"


def _trie(spark, sf):
    return retrieval.Trie(table(spark, sf, "part"), "p_name", ignore_case=True)


@query(f"WITH {_KEYS} SELECT key FROM k WHERE starts_with(key, 's')")
def trie_prefix_scan(spark, sf):
    return _trie(spark, sf).keys_with_prefix("S")


@query(f"WITH {_KEYS}, p AS (SELECT DISTINCT substr(key, 1, i) AS p FROM (SELECT key, unnest(range(1, length(key) + 1)) AS i FROM k)) SELECT (count(*) + 1)::BIGINT AS nodes FROM p")
def trie_node_count(spark, sf):
    return _trie(spark, sf).node_count()


_FIRST = "f AS (SELECT DISTINCT lower(string_split(p_name, ' ')[1]) AS key FROM part), q AS (SELECT DISTINCT lower(p_name) AS word FROM part)"


def _first_words(spark, sf):
    return retrieval.Trie(table(spark, sf, "part").select(F.split("p_name", " ")[0].alias("key")), "key", ignore_case=True)


@query(f"WITH {_FIRST} SELECT word, key FROM q JOIN f ON starts_with(word, key)")
def trie_prefix_matches(spark, sf):
    return _first_words(spark, sf).prefix_matches(table(spark, sf, "part"), "p_name")


@query(f"""WITH {_FIRST}, pre AS (SELECT DISTINCT substr(key, 1, i) AS p FROM (SELECT key, unnest(range(1, length(key) + 1)) AS i FROM f)),
m AS (SELECT word, max(length(key)) AS n FROM q JOIN f ON starts_with(word, key) GROUP BY word),
w AS (SELECT word, max(length(p)) AS n FROM q JOIN pre ON starts_with(word, p) GROUP BY word)
SELECT q.word, substr(q.word, 1, m.n) AS prefix, substr(q.word, coalesce(w.n, 0) + 1) AS rest FROM q LEFT JOIN m USING (word) LEFT JOIN w USING (word)""")
def trie_longest_prefix(spark, sf):
    return _first_words(spark, sf).longest_prefix(table(spark, sf, "part"), "p_name")


@query(f"WITH {_FIRST} SELECT word, EXISTS (SELECT 1 FROM f WHERE key = word) AS found FROM (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part)")
def trie_contains(spark, sf):
    return _first_words(spark, sf).contains(table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct(), "word")


@query("SELECT DISTINCT lower(n_name) AS key FROM nation UNION SELECT DISTINCT lower(r_name) FROM region")
def trie_insert(spark, sf):
    return retrieval.Trie(table(spark, sf, "nation"), "n_name", ignore_case=True).with_keys(table(spark, sf, "region"), "r_name").keys


# --- spelling

_SPELL = "c AS (SELECT word, count(*)::BIGINT AS frequency FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word), q AS (SELECT DISTINCT substr(word, 2) AS query FROM c)"


def _spell(spark, sf):
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return retrieval.Spellcheck(words, "word"), words.select(F.expr("substring(word, 2)").alias("query")).distinct()


@query(f"WITH {_SPELL} SELECT word, frequency FROM c")
def spell_frequency(spark, sf):
    return _spell(spark, sf)[0].words


@query(f"WITH {_SPELL} SELECT query, word, damerau_levenshtein(query, word)::INT AS distance, frequency, row_number() OVER (PARTITION BY query ORDER BY damerau_levenshtein(query, word), frequency DESC, word)::INT AS rank FROM q, c WHERE damerau_levenshtein(query, word) <= 2")
def spell_corrections_k2(spark, sf):
    checker, asked = _spell(spark, sf)
    return checker.corrections(asked, "query", 2)


@query(f"WITH {_SPELL}, r AS (SELECT query, word, damerau_levenshtein(query, word)::INT AS distance, frequency, row_number() OVER (PARTITION BY query ORDER BY damerau_levenshtein(query, word), frequency DESC, word) AS k FROM q, c WHERE damerau_levenshtein(query, word) <= 1) SELECT query, word, distance, frequency FROM r WHERE k = 1")
def spell_best(spark, sf):
    checker, asked = _spell(spark, sf)
    return checker.best(asked, "query", 1)


@query(f"WITH {_SPELL}, r AS (SELECT query, word, damerau_levenshtein(query, word) AS d, frequency AS f FROM q, c WHERE damerau_levenshtein(query, word) <= 2) SELECT query, string_agg(word, ' ' ORDER BY d, f DESC, word) AS words FROM r GROUP BY query")
def spell_words(spark, sf):
    checker, asked = _spell(spark, sf)
    return checker.correction_words(asked, "query", 2).select("query", F.array_join("words", " ").alias("words"))


@query(f"WITH {_SPELL} SELECT query, word, damerau_levenshtein(query, word)::INT AS distance FROM q, c WHERE damerau_levenshtein(query, word) <= 4")
def spell_wide(spark, sf):
    """Four edits, beyond what deletions reach: words meet by length."""
    checker, asked = _spell(spark, sf)
    return checker.neighbours(asked, "query", 4)


@query("SELECT a.n_name AS query, b.n_name AS word, damerau_levenshtein(a.n_name, b.n_name)::INT AS distance FROM nation a, nation b WHERE damerau_levenshtein(a.n_name, b.n_name) <= 2")
def deletion_neighbours(spark, sf):
    names = table(spark, sf, "nation")
    return retrieval.DeletionIndex(names, "n_name", 2).neighbours(names, "n_name")


@query(f"WITH n AS ({_NAMES}) SELECT a.name AS query, b.name AS word, damerau_levenshtein(a.name, b.name)::INT AS distance FROM n a, n b WHERE damerau_levenshtein(a.name, b.name) <= 1")
def fuzzy_neighbours(spark, sf):
    names = _names(spark, sf)
    return retrieval.DeletionIndex(names, "name", 2).neighbours(names, "name", 1)


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT DISTINCT word, cut FROM (SELECT word, word AS cut FROM w UNION ALL SELECT word, substr(word, 1, i - 1) || substr(word, i + 1) FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w))""")
def deletion_index(spark, sf):
    return _spell(spark, sf)[0].deletion_index(1)


# --- ranking

_TF = f"{_DOCS}, tf AS (SELECT doc_id AS doc, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL), n AS (SELECT count(*) AS n FROM d), idf AS (SELECT term, count(*)::BIGINT AS df, 1 + ln((SELECT n FROM n)::DOUBLE / (1 + count(*))) AS idf FROM tf GROUP BY term)"


def _corpus(spark, sf):
    return retrieval.TfIdf(table(spark, sf, "documents"), "doc_id", "text", retrieval.Analyzer(lambda c: _words(c), lower=False))


@query(f"WITH {_TF} SELECT doc, term, tf FROM tf")
def tf_counts(spark, sf):
    return _corpus(spark, sf).postings.select("doc", "term", "tf")


@query(f"WITH {_TF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def idf_all(spark, sf):
    return _corpus(spark, sf).idf().select("term", "df", F.round("idf", 6).alias("idf"))


_ASKED = "q AS (SELECT item_id AS query, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL)"


@query(f"WITH {_TF}, {_ASKED} SELECT query, doc, round(sum(tf * times * idf), 6) AS score FROM tf JOIN idf USING (term) JOIN q USING (term) GROUP BY ALL")
def tfidf_scores(spark, sf):
    return _corpus(spark, sf).scores(table(spark, sf, "benchmark"), "item_id", "text").select("query", "doc", F.round("score", 6).alias("score"))


@query(f"WITH {_TF} SELECT d.doc_id AS doc, round(coalesce(sum(tf * idf), 0), 6) AS score FROM d LEFT JOIN (tf JOIN idf USING (term)) x ON d.doc_id = x.doc AND x.term IN ('the', 'that', 'with') GROUP BY d.doc_id ORDER BY score DESC, doc LIMIT 10")
def tfidf_rank_topk(spark, sf):
    return _corpus(spark, sf).rank("the that with", 10).select("doc", F.round("score", 6).alias("score"))


@query(f"WITH {_DOCS}, k AS (SELECT * FROM d WHERE doc_id <> 7), t AS (SELECT doc_id, unnest(w) AS term FROM k) SELECT term, count(DISTINCT doc_id)::BIGINT AS df, round(1 + ln((SELECT count(*) FROM k)::DOUBLE / (1 + count(DISTINCT doc_id))), 6) AS idf FROM t GROUP BY term")
def tfidf_without_document(spark, sf):
    return _corpus(spark, sf).without(7).idf().select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_DOCS} SELECT len(list_distinct(w))::BIGINT AS distinct_terms, len(w)::BIGINT AS total_terms FROM d WHERE doc_id = 7")
def tfidf_document(spark, sf):
    return _corpus(spark, sf).document(7)


@query(f"WITH {_TF} SELECT doc, term, round(tf * idf, 6) AS tfidf FROM tf JOIN idf USING (term)")
def tfidf_list_terms(spark, sf):
    return _corpus(spark, sf).list_terms().select("doc", "term", F.round("tfidf", 6).alias("tfidf"))


# --- classification

_BAYES = f"""{_TALK}, f AS (SELECT role AS label, feature, count(*)::BIGINT AS docs FROM (SELECT DISTINCT doc, role, unnest(w) AS feature FROM t) GROUP BY ALL),
c AS (SELECT role AS label, count(*)::BIGINT AS docs FROM t WHERE len(w) > 0 GROUP BY role), a AS (SELECT sum(docs) + 1.0::DOUBLE AS n FROM c),
p AS (SELECT DISTINCT doc, unnest(w) AS feature FROM t),
l AS (SELECT p.doc, c.label, sum(ln((coalesce(f.docs, 0) + 1.0::DOUBLE) / (c.docs + 1.0::DOUBLE))) AS l FROM p CROSS JOIN c LEFT JOIN f ON f.label = c.label AND f.feature = p.feature GROUP BY ALL),
r AS (SELECT t.doc, c.label, round(coalesce(l.l, 0) + ln((c.docs + 1.0::DOUBLE) / (SELECT n FROM a)), 6) AS score FROM t CROSS JOIN c LEFT JOIN l ON l.doc = t.doc AND l.label = c.label)"""


@query(f"WITH {_BAYES} SELECT label, feature, docs FROM f")
def bayes_counts(spark, sf):
    return classify.Bayes(_talk(spark, sf)).features


@query(f"WITH {_BAYES} SELECT doc, label, score FROM r")
def bayes_scores(spark, sf):
    talk = _talk(spark, sf)
    return classify.Bayes(talk).scores(talk).select("doc", "label", F.round("score", 6).alias("score"))


@query(f"WITH {_BAYES}, k AS (SELECT doc, label, score, row_number() OVER (PARTITION BY doc ORDER BY score DESC, label) AS k FROM r) SELECT doc, label, score FROM k WHERE k = 1")
def bayes_classify(spark, sf):
    talk = _talk(spark, sf)
    return classify.Bayes(talk).classify(talk).select("doc", "label", F.round("score", 6).alias("score"))


@query(f"WITH {_TALK}, k AS (SELECT * FROM t WHERE doc % 7 <> 0) SELECT role AS label, feature, count(*)::BIGINT AS docs FROM (SELECT DISTINCT doc, role, unnest(w) AS feature FROM k) GROUP BY ALL")
def bayes_remove(spark, sf):
    talk = _talk(spark, sf)
    return classify.Bayes(talk).minus(talk.where("doc % 7 = 0")).features


@query()
def logistic_classify(spark, sf):
    talk = _talk(spark, sf)
    return classify.Logistic.fit(talk).classify(talk)


@query()
def maxent_distribution(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_orderstatus").alias("outcome"), F.array(F.col("o_orderpriority"), F.year("o_orderdate").cast("string")).alias("predicates"))
    return classify.MaxEnt.fit(rows).distribution(rows.select(F.xxhash64("predicates").alias("event"), "predicates").distinct())


_BY_PRIORITY = "SELECT o_orderpriority AS predicate, o_orderstatus AS outcome, count(*) AS n FROM orders GROUP BY ALL"


def _by_priority(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_orderstatus").alias("outcome"), F.array("o_orderpriority").alias("predicates"))


@query(f"WITH n AS ({_BY_PRIORITY}) SELECT predicate, outcome, round(n / sum(n) OVER (PARTITION BY predicate), 4)::DOUBLE AS p FROM n")
def maxent_shares(spark, sf):
    """With one predicate an event the maximum-entropy distribution is the share of each outcome."""
    rows = _by_priority(spark, sf)
    asked = rows.select(F.col("predicates")[0].alias("predicate"), F.xxhash64("predicates").alias("event"), "predicates").distinct()
    return classify.MaxEnt.fit(rows).distribution(asked).join(asked.select("event", "predicate"), "event").select("predicate", "outcome", F.round("p", 4).alias("p"))


@query(f"WITH n AS ({_BY_PRIORITY}) SELECT round(sum(n * ln(n / s)) / sum(n), 6)::DOUBLE AS mean_log_likelihood FROM (SELECT n, sum(n) OVER (PARTITION BY predicate) AS s FROM n)")
def maxent_log_likelihood(spark, sf):
    rows = _by_priority(spark, sf)
    return spark.range(1).select(F.round(F.lit(classify.MaxEnt.fit(rows).log_likelihood(rows) / rows.count()), 6).alias("mean_log_likelihood"))


# --- tagging and clauses: a tag made from each word stands in for a tagged corpus

_TAGGED = f"{_TALK}, g AS (SELECT doc AS sent, i - 1 AS pos, w[i] AS token, CASE length(w[i]) % 4 WHEN 0 THEN 'NN' WHEN 1 THEN 'IN' WHEN 2 THEN 'VB' ELSE 'DT' END AS tag FROM (SELECT doc, w, unnest(range(1, len(w) + 1)) AS i FROM t))"


def _lines(spark, sf):
    tag = lambda x: F.when(F.length(x) % 4 == 0, "NN").when(F.length(x) % 4 == 1, "IN").when(F.length(x) % 4 == 2, "VB").otherwise("DT")
    return _talk(spark, sf).select(F.col("doc").alias("sent"), F.array_join(F.transform("tokens", lambda x: F.concat(x, F.lit("_"), tag(x))), " ").alias("value"))


def _tagged(spark, sf):
    return tagging.parse_brown(_lines(spark, sf))


@query(f"WITH {_TAGGED} SELECT sent, pos::INT AS pos, token, tag FROM g")
def brown_parse(spark, sf):
    return _tagged(spark, sf)


@query(f"WITH {_TAGGED}, c AS (SELECT token, tag, count(*) AS n FROM g GROUP BY ALL), r AS (SELECT token, tag, row_number() OVER (PARTITION BY token ORDER BY n DESC, tag) AS k FROM c) SELECT token, tag FROM r WHERE k = 1")
def lexicon_primary_tag(spark, sf):
    return tagging.Lexicon.build(_tagged(spark, sf)).entries


_RULES = ["NN VB PREV-TAG IN", "VB NN NEXT-TAG DT", "* JJ CURRENT-WORD-ENDS-WITH ing"]


@query(f"""WITH {_TAGGED},
a AS (SELECT sent, pos, token, CASE WHEN tag = 'NN' AND coalesce(lag(tag) OVER (PARTITION BY sent ORDER BY pos) = 'IN', false) THEN 'VB' ELSE tag END AS tag FROM g),
b AS (SELECT sent, pos, token, CASE WHEN tag = 'VB' AND coalesce(lead(tag) OVER (PARTITION BY sent ORDER BY pos) = 'DT', false) THEN 'NN' ELSE tag END AS tag FROM a)
SELECT sent, pos::INT AS pos, token, CASE WHEN ends_with(token, 'ing') THEN 'JJ' ELSE tag END AS tag FROM b""")
def tag_rules(spark, sf):
    return tagging.apply_rules(_tagged(spark, sf), [tagging.Rule.parse(r) for r in _RULES])


#: Tags of the Brown corpus and capitals, made from each word, so that all ten rules have sites.
_BROWN_TAGS = ("TO", "IN", "AT", "VBN", "VBD", "HVD", "VB", "NN", "MD", "PPS", ".", "NP")
_BROWN = f"{_TALK}, g AS (SELECT doc AS sent, i - 1 AS pos, CASE WHEN length(w[i]) % 3 = 0 THEN upper(w[i]) ELSE w[i] END AS token, [{', '.join(repr(x) for x in _BROWN_TAGS)}][(ascii(w[i]) * 7 + length(w[i]) * 5 + i) % {len(_BROWN_TAGS)} + 1] AS tag FROM (SELECT doc, w, unnest(range(1, len(w) + 1)) AS i FROM t))"


def _rule_sql(rule: str, before: str) -> str:
    """One rule of the ten: a CASE over the neighbours' tags and tokens as they stand before it."""
    source, to, name, value = rule.split()
    cap = lambda c: f"coalesce(regexp_matches({c}, '^[A-Z]'), false) = {value == 'YES'}"
    near = lambda c, k: f"{'lag' if k < 0 else 'lead'}({c}, {abs(k)}) OVER s"
    tests = {"NEXT-TAG": [("tag", 1)], "PREV-TAG": [("tag", -1)], "PREV-1-OR-2-TAG": [("tag", -1), ("tag", -2)], "PREV-1-OR-2-OR-3-TAG": [("tag", -1), ("tag", -2), ("tag", -3)]}
    shapes = {"PREV-WORD-IS-CAP": near("token", -1), "NEXT-WORD-IS-CAP": near("token", 1), "CURRENT-WORD-IS-CAP": "token"}
    test = cap(shapes[name]) if name in shapes else " OR ".join(f"coalesce({near(*x)} = '{value}', false)" for x in tests[name])
    return f"SELECT sent, pos, token, CASE WHEN tag = '{source}' AND ({test}) THEN '{to}' ELSE tag END AS tag FROM {before} WINDOW s AS (PARTITION BY sent ORDER BY pos)"


@query(f"WITH {_BROWN}, " + ", ".join(f"b{k} AS ({_rule_sql(r, f'b{k - 1}' if k else 'g')})" for k, r in enumerate(tagging.BRILL_1992)) + " SELECT sent, pos::INT AS pos, token, tag FROM b9")
def tag_brill_1992(spark, sf):
    words = _talk(spark, sf).select(F.col("doc").alias("sent"), F.posexplode("tokens").alias("pos", "w"))
    kind = (F.ascii("w") * 7 + F.length("w") * 5 + F.col("pos") + 1) % len(_BROWN_TAGS)
    tagged = words.select("sent", "pos", F.when(F.length("w") % 3 == 0, F.upper("w")).otherwise(F.col("w")).alias("token"), F.array(*map(F.lit, _BROWN_TAGS))[kind].alias("tag"))
    return tagging.apply_rules(tagged, tagging.brill_1992())


_PART = "('0x' || substr(md5(sent::VARCHAR), 1, 8))::BIGINT % 100"


@query(f"""WITH {_TAGGED}, c AS (SELECT token, tag, count(*) AS n FROM g WHERE {_PART} < 80 GROUP BY ALL),
l AS (SELECT token, first(tag ORDER BY n DESC, tag) AS tag FROM c GROUP BY token),
z AS (SELECT sent, pos, g.token, g.tag AS gold, coalesce(l.tag, 'NN') AS before FROM g LEFT JOIN l USING (token) WHERE {_PART} >= 80),
a AS (SELECT *, CASE WHEN before = 'NN' AND coalesce(lag(before) OVER (PARTITION BY sent ORDER BY pos) = 'IN', false) THEN 'VB' ELSE before END AS t1 FROM z),
b AS (SELECT *, CASE WHEN t1 = 'VB' AND coalesce(lead(t1) OVER (PARTITION BY sent ORDER BY pos) = 'DT', false) THEN 'NN' ELSE t1 END AS t2 FROM a)
SELECT round(avg((before = gold)::INT), 9)::DOUBLE AS accuracy_before, round(avg((CASE WHEN ends_with(token, 'ing') THEN 'JJ' ELSE t2 END = gold)::INT), 9)::DOUBLE AS accuracy FROM b""")
def tag_accuracy(spark, sf):
    rows = _tagged(spark, sf)
    fit, check = tagging.split_corpus(rows, 80)
    told = tagging.evaluate(check.withColumnRenamed("tag", "gold"), tagging.Lexicon.build(fit), [tagging.Rule.parse(r) for r in _RULES])
    return told.select(F.round("accuracy_before", 9).alias("accuracy_before"), F.round("accuracy", 9).alias("accuracy"))


@query(f"""WITH {_TAGGED}, f AS (SELECT *, max(CASE WHEN tag = 'IN' THEN pos END) OVER (PARTITION BY sent ORDER BY pos ROWS UNBOUNDED PRECEDING) AS i,
  max(CASE WHEN tag = 'NN' THEN pos END) OVER (PARTITION BY sent ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM g),
h AS (SELECT *, i IS NOT NULL AND (n IS NULL OR n < i) AS in_phrase FROM f),
v AS (SELECT *, min(CASE WHEN tag = 'VB' AND NOT in_phrase THEN pos END) OVER (PARTITION BY sent) AS verb, first_value(tag) OVER (PARTITION BY sent ORDER BY pos) AS opens FROM h)
SELECT sent, pos::INT AS pos, CASE WHEN in_phrase THEN 'prepositional' WHEN verb IS NULL OR (opens <> 'VB' AND pos < verb) THEN 'subject' ELSE 'predicate' END AS role, CASE WHEN opens = 'VB' THEN 'Command' END AS sentence_type FROM v""")
def clause_roles(spark, sf):
    return tagging.analyze(_tagged(spark, sf)).select("sent", "pos", "role", "sentence_type")


# --- language


def _script_sql(rows: str) -> str:
    """(key, text) -> script: letters counted by block, the rest of the letters as Other, ties to the script seen first."""
    letters = {"Latin": r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}\x{1E00}-\x{1EFF}", "Greek": r"\x{370}-\x{373}\x{376}-\x{37D}\x{37F}-\x{383}\x{386}\x{388}-\x{3F5}\x{3F7}-\x{3FF}", "Cyrillic": r"\x{400}-\x{481}\x{48A}-\x{52F}"}
    votes = " UNION ALL ".join(f"SELECT key, '{name}' AS script, length(regexp_replace(text, '[^{inside}]', '', 'g')) AS n, length(regexp_extract(text, '^[^{inside}]*')) AS place FROM t" for name, inside in letters.items())
    return f"""WITH t AS ({rows}), v AS ({votes}),
o AS (SELECT key, length(regexp_replace(text, '[^\\p{{L}}]|[{"".join(letters.values())}]', '', 'g')) AS other FROM t),
b AS (SELECT key, script, n, row_number() OVER (PARTITION BY key ORDER BY n DESC, place) AS r FROM v)
SELECT key, CASE WHEN text IS NULL OR (n = 0 AND other = 0) THEN NULL WHEN other > n THEN 'Other' ELSE script END AS script FROM t JOIN b USING (key) JOIN o USING (key) WHERE r = 1"""


@query(_script_sql("SELECT doc_id AS key, text FROM documents"))
def script_majority(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("key"), language.detect_script(F.col("text")).alias("script"))


#: Letters written in another script by turns: majorities, ties, letters of no named script, and none at all.
_MIXED = ("aeiou", "abcdefghijklm", "nopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz")
_WRITTEN = ("αειου", "абцдефгхийклм", "ԱԲԳԴԵԶԷԸԹԺԻԼԽ", "01234567890123456789012345")


@query(_script_sql("SELECT p_partkey AS key, CASE p_partkey % 4 " + " ".join(f"WHEN {k} THEN translate(p_name, '{a}', '{b}')" for k, (a, b) in enumerate(zip(_MIXED, _WRITTEN))) + " END AS text FROM part"))
def script_mixed(spark, sf):
    name, kind = F.col("p_name"), F.col("p_partkey") % 4
    text_ = F.coalesce(*(F.when(kind == k, F.translate(name, a, b)) for k, (a, b) in enumerate(zip(_MIXED, _WRITTEN))))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), language.detect_script(text_).alias("script"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'double_metaphone' WHEN 'de' THEN 'cologne' WHEN 'es' THEN 'beider_morse:spanish' WHEN 'fr' THEN 'beider_morse:french' END AS encoder, CASE WHEN lang IN ('en', 'de', 'es', 'fr') THEN 'named' END AS basis FROM documents")
def phonetic_strategy(spark, sf):
    told = language.recommend(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", told["encoder"].alias("encoder"), told["basis"].alias("basis"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'double_metaphone' WHEN 1 THEN 'beider_morse:greek' WHEN 2 THEN 'double_metaphone' END AS encoder, CASE p_partkey % 4 WHEN 0 THEN 'not_needed' WHEN 1 THEN 'not_needed' WHEN 2 THEN 'recommended' ELSE 'unsupported' END AS transliteration FROM part")
def script_strategy(spark, sf):
    written = F.element_at(F.array(*map(F.lit, ("name", "όνομα", "なまえ", "名前"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    told = language.recommend_for_script(language.detect_script(written))
    return table(spark, sf, "part").select("p_partkey", told["encoder"].alias("encoder"), told["transliteration"].alias("transliteration"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'sakura' ELSE 'さくら' END AS text FROM part")
def transliteration_advice(spark, sf):
    advice = F.when(F.col("p_size") % 2 == 0, "recommended").otherwise("not_needed")
    return table(spark, sf, "part").select("p_partkey", language.apply_transliteration(advice, F.lit("さくら")).alias("text"))


@query("SELECT p_partkey, p_size::BIGINT AS size, string_split(p_name, ' ')[1] AS first, CASE WHEN p_size % 2 = 0 THEN p_name END AS note FROM part")
def json_dynamic(spark, sf):
    """Rows written as JSON and read back as dynamic values, field by field."""
    row = F.to_json(F.struct(F.col("p_size").alias("size"), F.split("p_name", " ").alias("words"), F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("note")).alias("more")))
    value = artifacts.dynamic(row)
    return table(spark, sf, "part").select("p_partkey", artifacts.dynamic_field(value, "$.size", "bigint").alias("size"), artifacts.dynamic_field(value, "$.words[0]", "string").alias("first"), artifacts.dynamic_field(value, "$.more.note", "string").alias("note"))


@query()
def language_detect(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return language.LanguageDetector.fit(docs).detect(docs).select("doc_id", "lang", "language", F.round("confidence", 4).alias("confidence"))


# --- graphs


def _dag(spark, sf):
    """Edges from a part to the parts with twice and three times its key, weighed by size; the part 0 would be its own."""
    rows = table(spark, sf, "part").where("p_partkey > 0").select("p_partkey", F.col("p_size").cast("double").alias("weight"), F.explode(F.array(F.lit(2), F.lit(3))).alias("k"))
    return rows.select((F.col("p_partkey") * 10 + F.col("k")).alias("edge_id"), F.col("p_partkey").alias("src"), (F.col("p_partkey") * F.col("k")).alias("dst"), "weight")


_DAG = "e AS (SELECT p_partkey * 10 + k AS edge_id, p_partkey AS src, p_partkey * k AS dst, p_size::DOUBLE AS weight FROM part, (SELECT unnest([2, 3]) AS k) WHERE p_partkey > 0)"
_WALK = f"WITH RECURSIVE {_DAG}, r AS (SELECT 1::BIGINT AS vertex, 0.0::DOUBLE AS distance UNION SELECT e.dst, r.distance + e.weight FROM r JOIN e ON e.src = r.vertex)"


@query(f"{_WALK} SELECT vertex, min(distance) AS distance FROM r GROUP BY vertex")
def dag_shortest(spark, sf):
    return graphs.Digraph(_dag(spark, sf)).paths(1).select("vertex", "distance")


@query(f"{_WALK} SELECT vertex, max(distance) AS distance FROM r GROUP BY vertex")
def dag_longest(spark, sf):
    return graphs.Digraph(_dag(spark, sf)).paths(1, longest=True).select("vertex", "distance")


@query(f"WITH RECURSIVE {_DAG}, r AS (SELECT src AS vertex, 0 AS level FROM e UNION SELECT dst, 0 FROM e UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.vertex) SELECT vertex, max(level)::INT AS level FROM r GROUP BY vertex")
def dag_levels(spark, sf):
    return graphs.Digraph(_dag(spark, sf)).levels()


@query(f"WITH RECURSIVE {_DAG}, r AS (SELECT src AS root, dst AS node, 1 AS depth FROM e WHERE src IN (1, 5) UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node) SELECT root, node, min(depth)::INT AS depth FROM r GROUP BY ALL")
def closure_bfs(spark, sf):
    return graphs.closure(_dag(spark, sf), spark.createDataFrame([(1,), (5,)], "node long"))


@query(f"""WITH RECURSIVE {_DAG}, r AS (SELECT src AS vertex, 0 AS level FROM e UNION SELECT dst, 0 FROM e UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.vertex), l AS (SELECT vertex, max(level)::INT AS level FROM r GROUP BY vertex)
SELECT level, count(*)::BIGINT AS n, (sum(count(*)) OVER (ORDER BY level) - count(*))::BIGINT AS first_place FROM l GROUP BY level""")
def topological_levels(spark, sf):
    """The first-in first-out order takes the levels one after the other."""
    return graphs.Digraph(_dag(spark, sf)).topological().groupBy("level").agg(F.count("*").alias("n"), F.min("place").alias("first_place"))


@query("SELECT v AS vertex, (SELECT count(*) FROM lineitem WHERE l_orderkey = v) AS out_degree FROM (SELECT DISTINCT l_orderkey AS v FROM lineitem)")
def graph_out_degree(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.monotonically_increasing_id().alias("edge_id"), F.col("l_orderkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst"), F.lit(1.0).alias("weight"))
    return graphs.Digraph(rows, check=False).out_degree().where("vertex >= 0")


# --- sentiment: words of four letters are the lexicon here

_MOOD = f"{_TALK}, k AS (SELECT doc, i AS pos, w[i] AS token FROM (SELECT doc, w, unnest(range(1, len(w) + 1)) AS i FROM t)), x AS (SELECT doc, pos, token, CASE WHEN length(token) = 4 THEN (ascii(token) % 3 - 1)::DOUBLE END AS polarity, coalesce(max((token IN ('as', 'of'))::INT) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg FROM k)"


@query(f"WITH {_MOOD}, u AS (SELECT doc, CASE WHEN token IN ('as', 'of') THEN 0.0::DOUBLE ELSE coalesce(polarity, 0) * CASE WHEN neg = 1 THEN -1 ELSE 1 END END AS unit FROM x) SELECT doc, sum(unit) + 0.0::DOUBLE AS total, count(*)::BIGINT AS units, round(sum(unit) / count(*) + 0.0::DOUBLE, 6) AS mean FROM u GROUP BY doc")
def sentiment_sticky(spark, sf):
    tokens = _talk(spark, sf).select("doc", F.posexplode("tokens").alias("pos", "token"))
    lexicon = tokens.where("length(token) = 4").select(F.col("token").alias("form"), (F.ascii("token") % 3 - 1).cast("double").alias("polarity"), F.lit(0).alias("ord")).distinct()
    return sentiment.score_rows(tokens, sentiment.vocabulary(lexicon), ["as", "of"]).select("doc", (F.col("total") + 0.0).alias("total"), "units", (F.round("mean", 6) + 0.0).alias("mean"))


@query(f"WITH {_MOOD}, u AS (SELECT doc, CASE WHEN polarity IS NULL AND token IN ('as', 'of') THEN 0.0::DOUBLE ELSE coalesce(polarity, 0) * CASE WHEN neg = 1 THEN -1 ELSE 1 END END AS unit FROM x) SELECT doc, round(sum(unit) + 0.0::DOUBLE, 6) AS total, count(*)::INT AS units FROM u GROUP BY doc")
def sentiment_analyzer(spark, sf):
    """An analyzer of one language and kind out of a table of lexicons."""
    words = _talk(spark, sf).select(F.explode("tokens").alias("form")).where("length(form) = 4").distinct()
    lexicons = words.select(F.lit("afinn").alias("kind"), F.lit("en").alias("language"), "form", (F.ascii("form") % 3 - 1).cast("double").alias("polarity"), F.xxhash64("form").alias("ord"))
    analyzer = sentiment.SentimentAnalyzer(lexicons, "en", "afinn", frozenset(("as", "of")))
    told = _talk(spark, sf).where("size(tokens) > 0").select("doc", analyzer.score(F.col("tokens")).alias("s"))
    return told.select("doc", (F.round("s.total", 6) + 0.0).alias("total"), F.col("s.units").alias("units"))


# --- events


@query("SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf):
    return streaming.tumbling(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events),
k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*)::BIGINT AS n FROM k GROUP BY user_id, k""")
def events_sessions(spark, sf):
    return streaming.sessions(table(spark, sf, "events"))


def prepare(spark: SparkSession) -> SparkSession:
    return attach(spark)
