"""Quality rules, line chunks, personal data, decontamination."""
import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F

from strideframe.llm import decontamination, line_chunks, personal, quality, queries
from strideframe.llm.store import documents, texts

ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "a b c d e f g h i j"), (4, "the of " * 40), (5, "x y z w v " * 3 + "q"),
       (5, "x y z w v " * 3 + "q"), (None, "Ünï cödé 日本 😀 #tag"), (6, "l1 a\nl2 b\nl1 a\n\nl1 a"), (7, "w" * 50_000), (8, "a b c\x1cd " * 4000)]


def test_quality_counts(frame, small):
    docs = ODD + small
    rows = quality.quality_rules(frame(docs)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((str(i), *brute.quality(x)) for i, x in docs)
    assert all(not r.kept for r in rows if r.base_failed)


def test_quality_keeps_prose_and_columns(frame):
    prose = "The committee met on Monday and agreed to a plan that will be sent to all of the members before the end of the week."
    junk = " | ".join(["Thing"] + [f"w{i}" for i in range(60)])
    kept = quality.keep_good(frame([(1, prose), (2, junk), (3, None), (1, prose)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1]
    assert kept.columns == ["doc_id", "text", "n_words", "chunk", "own"]
    assert quality.keep_good(frame([]).where("false")).count() == 0


def test_quality_keeps_short_texts_without_stop_words(frame):
    """A listed word in 200 is asked of texts of 200 words or more."""
    short = " ".join(f"maoni{chr(97 + i)}" for i in range(12))
    under, long = (" ".join(f"neno{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n)) for n in (199, 200))
    docs = frame([(1, short), (2, under), (3, long), (4, under + " the")])
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == [1, 2, 4]


def test_quality_is_one_native_projection(spark):
    plan = queries.op7_quality_rules(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def _line_brute(docs, mean=line_chunks.MEAN):
    """Every two neighbouring lines with a word, compared as texts; all but the first of equal ones go."""
    signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    rolling = lambda a, b: signed(xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42)))
    seen, gone = set(), set()
    for d in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0)):
        lines = [] if d[1] is None else d[1].split("\n")
        for i, pair in enumerate(zip(lines, lines[1:])):
            if brute.WORD.search("\n".join(pair)) and rolling(*pair) % mean == 0:
                if pair in seen:
                    gone |= {(d, i), (d, i + 1)}
                seen.add(pair)
    return [(d[0], None if d[1] is None else "\n".join(x for i, x in enumerate(d[1].split("\n")) if (d, i) not in gone)) for d in docs]


@pytest.mark.parametrize("mean", [1, 3])
def test_line_chunks(frame, mean):
    rng = random.Random(2)
    pool = [f"line {i} é" for i in range(30)] + ["", "very common line"] * 4
    passages = [[rng.choice(pool) for _ in range(rng.randint(2, 12))] for _ in range(6)]
    docs = [(0, None), (1, ""), (2, "\n\n\n\n"), (3, "\n\n\n\n"), (None, "\n".join(passages[0]))]
    for i in range(4, 60):
        lines = sum((rng.choice(passages) if rng.random() < 0.6 else [f"own {i}", rng.choice(pool)] for _ in range(rng.randint(0, 5))), [])
        docs.append((i, "\n".join(lines)))
    docs += [docs[9], (-(1 << 63), docs[12][1]), ((1 << 63) - 1, docs[12][1])]  # the same row twice: one document, treated alike
    out = line_chunks.line_dedup(frame(docs), mean=mean)
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, _line_brute(docs, mean)))
    assert line_chunks.line_dedup(frame(docs), counts=False).columns == frame(docs).columns
    assert line_chunks.line_dedup(frame(docs).where("false")).count() == 0


def test_line_chunks_find_all_repeated_runs(spark, small):
    """Runs of two lines or more that an earlier document holds: none is left, whatever its length."""
    rows = line_chunks.line_dedup(texts(spark.createDataFrame(small, "doc_id long, text string"))).collect()
    left = {r.doc_id: set(zip((x := (r.text or "").split("\n")), x[1:])) for r in rows}
    seen, runs = set(), 0
    for i, x in sorted(small):
        pairs = set(zip((ls := (x or "").split("\n")), ls[1:]))
        again = {p for p in pairs & seen if brute.WORD.search("\n".join(p))}
        runs += len(again)
        assert not again & left[i]
        seen |= pairs
    assert runs > 100


def test_line_chunks_compare_bytes(spark, frame, monkeypatch):
    """Chunks of one hash and other bytes stay."""
    monkeypatch.setattr(line_chunks.F, "xxhash64", lambda *c: F.crc32(F.concat_ws("|", *c).cast("binary")) % 5 if len(c) == 2 else F.hash(*c).cast("long"))
    docs = [(i, "\n".join(f"{i} {k}" for k in range(4))) for i in range(12)] + [(20, "0 0\n0 1"), (21, "0 0\n0 1\nmore")]
    out = {r.doc_id: r.text for r in line_chunks.line_dedup(frame(docs)).collect()}
    assert all(out[i] == x for i, x in docs[:12])


def test_line_chunks_count_hot_hashes_without_texts(spark, monkeypatch):
    """Salting reads the staged counts: a job over the texts would shuffle them once more."""
    counted, join = [], line_chunks.salted_join
    monkeypatch.setattr(line_chunks, "salted_join", lambda *a, counts=None: counted.append(counts) or join(*a, counts=counts))
    line_chunks.line_dedup(texts(documents(spark, SMALL)))
    assert len(counted) == 2
    assert all(c is not None and c.inputFiles() and not any("documents" in f for f in c.inputFiles()) for c in counted)


def test_scraps_of_copies_go(frame):
    origin = "\n".join(f"line {i} of the origin" for i in range(12))
    docs = [(1, origin), (2, origin + "\nend"), (3, origin), (4, "\n".join(f"own {i}" for i in range(40)) + "\n" + origin), (5, None), (6, "own"), (7, "")]
    kept = {r.doc_id for r in line_chunks.line_dedup(frame(docs), counts=False, least_left=0.2).collect()}
    assert kept == {1, 4, 5, 6, 7}


def test_line_chunks_are_native(spark):
    plan = queries.op9_line_chunks(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_base_spans_match_the_patterns():
    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice("a1.@+- ()0259é%") if rng.random() < 0.97 else "4111111111111111" for _ in range(rng.randint(0, 40)))
        assert personal.base_spans(t) == brute.personal(t)
    long = "9" * 30_000 + " a" * 1000 + "@" * 1000 + "1.a" * 20_000
    assert personal.base_spans(long) == []


def test_personal_on_documents(spark, frame, small):
    docs = small + [(None, "é a.b@c.de +1 (269) 555-3296"), (901, None), (901, "")]
    rows = {(r.doc_id, r.base): r for r in personal.find_personal(frame(docs)).collect()}
    for i, x in docs:
        spans = brute.personal(x)
        r = rows[i, personal.written(spans)]
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(s[2] == k for s in spans) for k in personal.KINDS]
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    assert personal.find_personal(frame(docs).where("false")).count() == 0


def test_personal_held_out(spark):
    """Fitted on half of the documents, judged on the respelled, broken and other candidates of the rest."""
    docs = texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    trees = personal.fit(docs.where("doc_id % 2 = 0"))
    found = [e for r in docs.where("doc_id % 2 = 1").collect() for e in personal.examples(r.text or "")]
    labels = np.array([y for _, y in found]) > 0
    chosen = trees.scores(np.array([x for x, _ in found])) >= trees.threshold
    assert labels[chosen].mean() > 0.95 and chosen[labels].mean() > 0.6

    def scan(text):
        return next(personal._scan(trees, [pa.record_batch({"doc_id": [1], "text": [text]})])).to_pylist()[0]["spans"]

    assert scan("Please call (269) 555-3296 now") == "phone:12:26"
    for clean in ("on 2024-01-30 12:30 we met", "order 12345678", "see you at the house of dots", "4111111111111112 is no card"):
        assert scan(clean) == ""


def _spelled(n):
    """Documents with one base span of each kind and four spans in other spellings, and those spans."""
    rng, docs, want = random.Random(4), [], {}
    digits = lambda k: "".join(rng.choice("23456789") for _ in range(k))
    for i in range(n):
        card = digits(15)
        card += next(c for c in "0123456789" if personal.luhn(card + c))
        name, octets = "".join(rng.choice("abcdefgh") for _ in range(6)), [str(rng.randint(1, 255)) for _ in range(4)]
        text = (f"Write to {name}@site{i}.org or call +1 ({digits(3)}) {digits(3)}-{digits(4)}, card {card}, host {'.'.join(octets)} "
                f"since 20{rng.randint(10, 24)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} 12:30")
        spans = []
        for kind, other in (("phone", f"({digits(3)}) {digits(3)}-{digits(4)}"), ("email", f"{name} [at] host{i}.org"),
                            ("phone", f"({digits(3)}) {digits(3)}-{digits(4)}"), ("email", f"{name}.b [at] mail{i}.net")):
            text += "; reach me under "
            spans.append(f"{kind}:{len(text)}:{len(text) + len(other)}")
            text += other
        docs.append((i, text))
        want[i] = set(spans)
    return docs, want


def test_personal_in_other_spellings(frame):
    """Fitted on documents that hold more respelled spans than base spans: they are found all the same."""
    docs, want = _spelled(300)
    rows = personal.find_personal(frame(docs)).collect()
    added = {r.doc_id: set(r.spans.split(",")) - set(r.base.split(",")) for r in rows}
    assert all((r.n_email, r.n_phone) == (1, 1) for r in rows)
    assert sum(len(added[i] & want[i]) for i in want) > 0.95 * sum(map(len, want.values()))
    assert not any(added[i] - want[i] for i in want)


def test_personal_sample_is_of_distinct_texts(frame):
    """Copies of one text whose hash comes first don't fill the sample."""
    signed = lambda x: (xxhash.xxh64_intdigest(x.encode(), 42) + (1 << 63)) % (1 << 64)
    docs, _ = _spelled(300)
    hot = min((f"no {k}" for k in range(100_000)), key=signed)
    assert signed(hot) < min(signed(x) for _, x in docs)
    assert personal.fit(frame(docs + [(1000 + i, hot) for i in range(400)]), sample=300) is not None


def test_personal_fit_reads_all_texts(frame):
    """2,500 texts without examples, whose hashes come first, don't keep the others from the fit."""
    signed = lambda x: (xxhash.xxh64_intdigest(x.encode(), 42) + (1 << 63)) % (1 << 64)
    docs, want = _spelled(600)
    docs = [d for d in docs if signed(d[1]) >= 1 << 63]
    empty = [x for x in (f"no {k}" for k in range(6000)) if signed(x) < 1 << 63][:2500]
    assert len(docs) > 200 and len(empty) == 2500
    rows = personal.find_personal(frame(docs + [(1000 + i, x) for i, x in enumerate(empty)])).collect()
    found = {r.doc_id: set(r.spans.split(",")) - set(r.base.split(",")) for r in rows}
    assert sum(len(found[i] & want[i]) for i, _ in docs) > 0.95 * sum(len(want[i]) for i, _ in docs)


def test_personal_examples_of_all_texts(frame):
    """Copies count once, nulls and empty texts not; addresses without digit or at-sign and texts of many examples count."""
    docs, _ = _spelled(40)
    docs += [(500, "dinner (AT) home, we [ at ] work"), (501, " ".join(f"20{i % 90 + 10}-01-02 at 10.{i % 256}.0.1, " for i in range(3000))), (502, None), (503, "")]
    want = Counter((tuple(x), y) for t in {t for _, t in docs if t} for x, y in personal.examples(t))
    assert len(list(personal.examples(docs[40][1]))) == 2 and sum(want.values()) > 2 * personal.BATCH
    rows = personal.labelled(frame(docs + docs[:30] + [(None, docs[0][1])] * 50))
    assert Counter((tuple(r.x), r.label) for r in rows.collect()) == want


def test_personal_examples_beside_base_spans():
    """A harmless candidate is an example if it overlaps no base span, however many lie before and behind."""
    text = "a@b.org 1.2.3.4 2024-01-30 12 " * 30 + "x+10.0.0.1.10.0.0.2.10.0.0.3.10.0.0.4.10.0.0.5@10.0.0.1 @ c 2024-01-30 12"
    base = personal.base_spans(text)
    harmless = [s for s in personal.candidates(text) if not any(a < s[1] and s[0] < b for a, b, _ in base) and personal.harmless(text, s)]
    exact = [s for s in personal.candidates(text) if s in base]
    got = list(personal.examples(text))[:len(harmless) + len(exact)]
    assert harmless and sorted(got) == sorted([(personal.features(text, s), 0.0) for s in harmless] + [(personal.features(text, s), 1.0) for s in exact])


@pytest.mark.parametrize("precision", [0.5, 0.8, 0.9, 0.99, 1.0])
def test_personal_threshold(spark, precision):
    rng = random.Random(5)
    judged = [(p := round(rng.random(), 2 if i % 2 else 4), float(rng.random() < p + 0.1)) for i in range(3000)]
    fits = [p for p in {p for p, _ in judged if p > 0.5} if np.mean([y for q, y in judged if q >= p]) >= precision]
    assert personal._threshold(spark.createDataFrame(judged, "p double, label double").repartition(5), precision) == min(fits, default=None)
    low = spark.createDataFrame([(0.5, 1.0), (0.9, 0.0)], "p double, label double")
    assert personal._threshold(low, precision) is None and personal._threshold(low.where("p < 0.6"), precision) is None


def test_harmless_candidates():
    def judged(text, kind):
        return {personal.harmless(text, s) for s in personal.candidates(text) if s[2] == kind}

    for text, kind in (("on 2024-01-30 12 we", "phone"), ("version 1.2.3.4", "ip"), ("at 10.0.0.300", "ip"), ("4111.1111.1111.1112", "card"),
                       ("ISBN 978-3-16-148410-0", "card"), ("noon @ home", "email")):
        assert judged(text, kind) == {True}, text
    for text, kind in (("call (269) 555-3296", "phone"), ("host 10[.]0[.]0[.]30", "ip"), ("name [at] host.org", "email"),
                       ("4111.1111.1111.1111", "card")):
        assert judged(text, kind) == {False}, text


@pytest.mark.parametrize("block", [200_000, 60])
def test_decontamination(spark, frame, block):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "B", "É", "c9", "日本", "x-y"]) for _ in range(n))
    items = [(i, text(rng.choice([5, 6, 12, 13, 14, 30]))) for i in range(30)] + [(100, None), (101, "..."), (102, items0 := "a A, a! É c9"), (103, items0)]
    docs = [(i, text(rng.randint(0, 80))) for i in range(150)] + [(1000, None), (1001, ""), (None, items[0][1]), (1003, " ".join([items[1][1]] * 300))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.overlaps(frame(docs), bench, block_windows=block).select(
        "doc_id", "overlap.n_words", "overlap.n_hit", F.size("overlap.items").alias("n"), F.sha2(F.array_join("overlap.items", ","), 256).alias("s"))
    want = brute.winnowing(docs, items)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    kept = decontamination.decontaminate(frame(docs), bench)
    assert kept.count() == sum(n_hit == 0 or 20 * n_hit < n for n, n_hit, _, _ in want.values()) and kept.columns == frame(docs).columns
    clash = frame(docs).withColumn("overlap", F.lit(5)).withColumn("overlap_", F.lit("x")).withColumn("row", F.lit(1)).withColumn("found", F.lit(2.5))
    assert decontamination.decontaminate(clash, bench).columns == clash.columns
    again = decontamination.overlaps(clash, bench, block_windows=block)
    assert {r.doc_id: r.overlap.n_hit for r in again.collect()} == {i: w[1] for i, w in want.items()} and "found" in again.columns
    assert decontamination.overlaps(frame(docs), bench.where("false")).where("overlap.n_hit > 0").count() == 0
