"""Substring dedup, suffixes, SimHash."""
import random

import brute
import pytest
from pyspark.sql import functions as F

from strideframe.llm import components, simhash, substrings, suffixes

KEY = lambda r: (r[0] is None, r[0] or 0, r[1:])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=KEY)


def test_difference_cover_covers():
    for window in (*range(1, 70), 200):
        period, members = substrings.difference_cover(window)
        assert 1 <= period <= max(window, 1)
        assert {(a - b) % period for a in members for b in members} == set(range(period))


@pytest.mark.parametrize(("window", "chunk"), [(50, 2 << 20), (50, 3000), (7, 500), (1, 300)])
def test_substrings(frame, copies, window, chunk):
    docs = copies(window, lambda rng: f"w{rng.randint(0, 400)}é", " ", window)
    got = substrings.substring_dedup(frame(docs), window=window, chunk_bytes=chunk).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256))
    assert rows(got) == sorted(brute.substrings(docs, window), key=KEY)


@pytest.mark.parametrize(("window", "gram", "chunk"), [(400, 256, 20_000), (40, 25, 1500), (40, 40, 1500), (8, 5, 300)])
def test_suffixes(frame, copies, window, gram, chunk):
    docs = copies(window, lambda rng: rng.choice("abcé \n"), "", window)
    got = suffixes.suffix_dedup(frame(docs), window=window, gram=gram, chunk_bytes=chunk).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256), "n_later")
    assert rows(got) == sorted(brute.suffixes(docs, window), key=KEY)


def test_suffixes_that_share_their_first_gram(frame):
    """Two windows with equal first grams whose last grams' hashes agree in 32 of 64 bits (found in check_l) are no copies."""
    shared = ("Éan de aiê la. Patre éeux de des ètionoi et reeuxque de re étionré. Éen êoioi èouoi treai airéier ierment de repa "
              "leê, éçanpa pament, de çç auxêvi an éreoien en le ou ééaux èpaque. Le oivi. Aiqueauxou onqueaux queaian des éè anque"
              " reétre la. De éeauvi la, laèeuxêtion ier le épaen émentai et éoitre vile et ellelere éê èeauou le trevivi, euxoi "
              "ére réoipa. Ç èier chai. ")
    docs = [(1, shared + "of onst orre then as ontith, ernteresonst. Th eren inea with, heednt on, thinged thesat. Thwhshhe the"),
            (2, shared + "are of by. Thingenon from ininha of anti the onea ouha are erouble ining to and. Blestin whnden edon ")]
    got = suffixes.suffix_dedup(frame(docs)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256), "n_later")
    assert rows(got) == brute.suffixes(docs, 400)


def test_small_table(frame, small):
    assert rows(suffixes.suffix_dedup(frame(small)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256), "n_later")) \
        == sorted(brute.suffixes(small, 400), key=KEY)


def test_empty_tables(frame):
    none = frame([(1, "a")]).where("false")
    assert substrings.substring_dedup(none).count() == suffixes.suffix_dedup(none).count() == simhash.near_duplicates(none).count() == 0
    with pytest.raises(ValueError, match="gram"):
        suffixes.suffix_dedup(none, window=400, gram=100)


def _near(seed):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 300)}" for _ in range(200)]
    docs = [(0, None), (1, ""), (2, "A b"), (3, "a B"), (4, "x")]
    for i in range(5, 200):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 9)}"
        docs.append((i, " ".join(w)))
    return docs


def test_simhash(frame, small):
    for docs in (_near(5), small):
        got = simhash.near_duplicates(frame(docs)).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("f"), "component_id")
        assert {r.doc_id: (r.f, r.component_id) for r in got.collect()} == brute.simhash(docs)


def test_simhash_keeps_one_of_each_group(frame):
    docs = _near(6)
    want = {c for _, c in brute.simhash(docs).values()}
    assert sorted(r.doc_id for r in simhash.keep_smallest(frame(docs)).collect()) == sorted(want)
    odd = [(5, "p q r s"), (5, "p q r s"), (5, "P Q r s"), (None, "p q r S"), (None, "only here, without an id")]
    kept = simhash.keep_smallest(frame(odd)).collect()
    assert sorted(str(r.doc_id) for r in kept) in (["5", "None"], ["5", "5", "None"])  # equal rows go together
    assert {r.text for r in kept if r.doc_id is None} == {odd[-1][1]}


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 90), (95, 90), (95, 80)] + [(200 + i, 200) for i in range(1, 30)] + [(7, 3), (7, 3)]
    got = {r.u: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 100: 80, 95: 80, 90: 80, **{200 + i: 200 for i in range(1, 30)}}
