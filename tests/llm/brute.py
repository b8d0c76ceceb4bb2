"""Small texts with copies, shared passages and edge cases, and plain versions of the operators' contracts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0D]+")


def fold(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def corpus(seed=1, n=60):
    """(doc_id, text): prose, exact and near copies, shared and repeated passages, junk, blanks and nulls."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice(["an", "the", "ion", "ré", "ñ", "st", "Qu", "o"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    prose = lambda k: [rnd.choice(vocabulary) + rnd.choice(["", "", "", ",", "."]) for _ in range(k)]
    passage = [prose(70) for _ in range(4)]
    texts = []
    for _ in range(n):
        words = prose(rnd.randint(5, 260))
        if rnd.random() < 0.4:
            at = rnd.randint(0, len(words))
            words[at:at] = rnd.choice(passage)
        if rnd.random() < 0.1:
            words += words[: len(words) // 2]
        texts.append("".join(w + rnd.choice([" ", " ", " ", " ", "\n", "  ", "\t", "\x0b"]) for w in words))
    for k in range(12):  # near copies: a few words changed
        words = texts[k].split(" ")
        for _ in range(rnd.randint(0, 6)):
            words[rnd.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += texts[3:9] + ["x " * 300, "ab" * 500, "ab" * 500 + "c", "", " \n", "one", "one two", "One TWO", None, None, "é　 x 日本語 😀", " ".join(prose(6000))]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows, parts=3):
    """The rows as documents, with other columns whose names clash with results."""
    data = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), 7, "clash") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string").repartition(parts)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, k):
    w = WORD.findall(fold(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near(docs, k, percent=80):
    sets = {i: shingles(t, k) for i, t in docs}
    inverted = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    links = []
    for i, s in sets.items():
        common = Counter(j for g in s for j in inverted[g] if j < i)
        links += [(i, j) for j, n in common.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)]
    return sets, components(sets, links)
