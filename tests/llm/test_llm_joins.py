"""Phrases, the Jaccard join and the prefix trie against plain versions, on odd input."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.llm import jaccard, phrases, skew, tries


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# --- phrases

def plain_phrases(docs, max_words, min_count, cover):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, max_words + 1):
                f.update((lang, *ws[i:i + k]) for i in range(len(ws) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    out = []
    for (lang, *ws), a in found.items():
        if any(len(q) > len(ws) + 1 and q[0] == lang and 100 * b >= cover * a and any(list(q[1 + i:1 + i + len(ws)]) == ws for i in range(len(q)))
               for q, b in found.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, *ws[:k]] * f[lang, *ws[k:]]), k, f[lang, *ws[:k]], f[lang, *ws[k:]]) for k in range(1, len(ws)))
        out.append((lang, " ".join(ws), a, left, right, n[lang], score))
    return sorted(out)


def phrase_docs(seed, words=8, size=90):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)] + ["Éa", "İx", "don't", "\x85", "a b"]
    docs = [(None, None), ("en", ""), ("en", " \t. ,;"), (None, "x y. x y"), ("de", "W1 w2 " * 300), ("de", "W1 w2 " * 300), ("", "w1 w2")]
    for _ in range(size):
        docs.append((rng.choice(["en", "de", "en", None, "e n"]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", "\r\n"])
                                                                            for _ in range(rng.randint(0, 40)))))
    return docs


def phrase_frame(spark, docs):
    return spark.createDataFrame([(k, x, t, 1, "z") for k, (x, t) in enumerate(docs)], "doc_id long, lang string, text string, n int, h1 string").repartition(3)


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_phrases(spark, share):
    """Whatever the sample proposes, nothing, some or all, the counts are whole."""
    docs = phrase_docs(1)
    found = phrases.phrases(phrase_frame(spark, docs), min_count=4, share=share, chunk_bytes=500).collect()
    assert sorted(map(tuple, found)) == plain_phrases(docs, 3, 4, 50)


def test_longer_phrases(spark):
    docs = phrase_docs(2, words=3, size=40)
    found = phrases.phrases(phrase_frame(spark, docs), max_words=5, min_count=3, cover=80, share=0.3, chunk_bytes=400).collect()
    assert sorted(map(tuple, found)) == plain_phrases(docs, 5, 3, 80)


def test_phrases_ranked(spark):
    docs = phrase_docs(3)
    found = phrases.top_phrases(phrases.phrases(phrase_frame(spark, docs), min_count=2), 5).collect()
    plain = defaultdict(list)
    for row in plain_phrases(docs, 3, 2, 50):
        plain[row[0]].append(row)
    wanted = [(lang, k, *row[1:]) for lang, rows in plain.items()
              for k, row in enumerate(sorted(rows, key=lambda r: (-r[6], -r[2], r[1].encode()))[:5], 1)]
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_phrases_of_nothing(spark):
    assert phrases.top_phrases(phrases.phrases(phrase_frame(spark, []))).count() == 0
    assert phrases.phrases(phrase_frame(spark, [("en", None), (None, "")])).count() == 0


def test_score_is_exact(spark):
    a, left, right = 3 * 10**12 + 1, 7 * 10**12 + 3, 5 * 10**12 + 11
    row = spark.range(1).select(phrases._score(*(F.lit(x) for x in (a, left, right))).alias("s")).first()
    assert row.s == 10**6 * a * a // (left * right)


def test_filter_has_no_false_negatives(spark):
    rng = np.random.default_rng(1)
    members = rng.integers(-2**62, 2**62, (3000, 2))
    df = spark.createDataFrame([tuple(map(int, m)) for m in members], "h1 long, h2 long").repartition(3)
    made = phrases.Filter.of(df, 2)
    assert made.admits(phrases.gram_keys(*members.T.copy().view(np.uint64))).all()
    others = rng.integers(-2**62, 2**62, (20000, 2))
    assert made.admits(phrases.gram_keys(*others.T.copy().view(np.uint64))).mean() < 0.1


# --- Jaccard join

def plain_sets(text, shingle):
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not ws:
        return frozenset()
    return frozenset([tuple(ws)] if len(ws) < shingle else zip(*(ws[k:] for k in range(shingle))))


def plain_components(docs, shingle=4, percent=85):
    sets = [plain_sets(t, shingle) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(s), least.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(docs, sets))), key=str)


def near_copies(seed, groups=(2, 3, 40), singles=40):
    rng = random.Random(seed)
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one Two"), (4, "ONE two"), (5, "one two three"), (None, "one two"), (6, "one"), (6, "one"), (None, None)]

    def words(n):
        return [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    for size in groups:
        origin = words(rng.randint(60, 120))
        for _ in range(size):
            copy = list(origin)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = words(1)[0]
            docs.append((rng.choice([None, 10 + len(docs), 10 + len(docs), 50]), " ".join(copy)))
    passage = words(50)
    for _ in range(singles):  # a shared passage, chains of slow change, and texts of their own
        docs.append((100 + len(docs), " ".join(words(rng.randint(1, 30)) + (passage if rng.random() < 0.4 else []) + words(rng.randint(0, 20)))))
    chain = words(80)
    for _ in range(25):
        docs.append((100 + len(docs), " ".join(chain)))
        chain = chain[2:] + words(2)
    docs.append((900, " ".join(words(20000))))
    docs.append((901, docs[-1][1]))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [4, 8])
def test_jaccard(spark, frame, seed):
    docs = near_copies(seed)
    found = jaccard.similar(frame(docs), chunk_bytes=3000).select("doc_id", "n", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == plain_components(docs)


@pytest.mark.parametrize("shingle, percent", [(1, 60), (2, 50), (5, 100)])
def test_jaccard_of_other_bounds(spark, frame, shingle, percent):
    docs = near_copies(9, groups=(4, 12), singles=15)
    found = jaccard.similar(frame(docs), shingle=shingle, percent=percent).select("doc_id", "n", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == plain_components(docs, shingle, percent)


def test_jaccard_of_nothing(spark, frame):
    assert jaccard.similar(frame([])).count() == 0
    assert [tuple(r) for r in jaccard.similar(frame([(1, None)])).select("doc_id", "n", "component_id").collect()] == [(1, 0, 1)]


def test_salted_join(spark):
    big = spark.range(9000).select(F.when(F.col("id") < 5000, F.lit(7)).when(F.col("id") < 5100, None).otherwise(F.col("id") % 50).alias("k"), "id")
    table = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    found = skew.salted_join(big, table, "k", "id")
    assert found.columns == ["k", "id", "twice"]
    assert found.where("twice = 2 * k").count() == found.count() == 8900
    assert skew.salted_join(big, table.where("k > 7"), "k", "id", "left").count() == 9000


# --- prefix trie

def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        totals[p] = (sum(totals[k][0] for k in kids[p]) or 1,
                     sum(totals[k][1] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0))
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *totals[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest()) for p, m in members.items()), key=str)


def talks(seed, n=260):
    rng = random.Random(seed)
    says = ["hi", "Hi", "", None, "é\U0001F600", "a longer turn", "x" * 50]
    rows = [(None, 1, "user", "lost"), (700, None, None, None), (700, None, "user", "b"), (700, 2, "user", "a"), (700, 2, "user", "a"), (3, 0, "a", "bc"), (4, 0, "ab", "c")]
    rows += [(5, k, "user", str(k)) for k in range(300)] + [(6, k, "user", str(k)) for k in range(250)]
    for _ in range(n):
        c = rng.randint(-320, 800)
        same = rng.random() < 0.4
        for k in range(rng.randint(1, 9)):
            rows.append((c, k, "user" if k % 2 else "assistant", "same" if same else rng.choice(says)))
    rng.shuffle(rows)
    return rows


def trie_frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 5) for r in rows], "conv_id long, turn long, role string, text string, key string, block int").repartition(4)


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_trie(spark, block_bytes):
    rows = talks(block_bytes)
    found = tries.prefix_trie(tries.with_family_heads(tries.sequences(trie_frame(spark, rows))), block_bytes).collect()
    assert sorted(map(tuple, found), key=str) == plain_trie(rows)


def test_trie_of_little(spark):
    def of(rows):
        return sorted((tuple(r) for r in tries.prefix_trie(tries.with_family_heads(tries.sequences(trie_frame(spark, rows)))).collect()), key=str)
    assert of([]) == []
    for rows in ([(100, 0, "user", "a")], [(100, 0, "user", "a"), (101, 0, "user", "a"), (199, 0, None, None)]):
        assert of(rows) == plain_trie(rows)


def test_forest_of_equal_and_nested_rows():
    # a, a, ab, abc, abc, b: root, a (2 end, ab below), ab, abc (2 end), b
    f = tries.forest([1, 1, 2, 3, 3, 1], [1, 1, 2, 3, 0], [9, 8, 7, 6, 5, 4])
    nodes = {v for v in range(len(f.depth)) if v == f.root or f.parent[v] >= 0}
    assert sorted((f.depth[v], f.count[v], f.least[v], len(f.kids[v])) for v in nodes) == [(0, 6, 4, 2), (1, 1, 4, 0), (1, 5, 5, 1), (2, 3, 5, 1), (3, 2, 5, 0)]
