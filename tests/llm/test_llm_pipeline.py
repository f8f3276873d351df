"""The pipeline, stage by stage, against plain versions on each stage's own input."""
import brute
import pytest
import public_tokenizers
from conftest import SMALL
from tokenizers import Tokenizer

import corpus_pipeline
from test_llm_text import _line_brute


@pytest.fixture(scope="module")
def stages(spark):
    """name -> (rows in, rows out), by doc_id."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out, before = {}, {r.doc_id: r for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, SMALL), f"test-{name}")
        after = {r.doc_id: r for r in docs.collect()}
        out[name], before = (before, after), after
    return out


def test_names_and_columns(stages):
    assert list(stages) == ["quality_rules", "line_dedup", "simhash_dedup", "decontaminate", "encode"]
    for before, after in list(stages.values())[:-1]:
        assert next(iter(after.values())).__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]
        assert set(after) <= set(before)


def test_quality_stage(stages):
    before, after = stages["quality_rules"]
    assert all(not brute.quality(r.text)[-1] for r in after.values())
    assert len(after) > len(before) / 2


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    rest = _line_brute([(r.doc_id, r.text) for r in before.values()])
    want = {i: x for i, x in rest if x and brute.WORD.search(x) and (x == before[i].text or len(x) >= corpus_pipeline.LEAST_LEFT * len(before[i].text))}
    assert {i: (r.text, r.n_chars) for i, r in after.items()} == {i: (x, len(x)) for i, x in want.items()}


def test_simhash_stage(stages):
    before, after = stages["simhash_dedup"]
    assert set(after) == {c for _, c in brute.simhash([(r.doc_id, r.text) for r in before.values()]).values()}


def test_decontamination_stage(spark, stages):
    before, after = stages["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    found = brute.winnowing([(r.doc_id, r.text) for r in before.values()], items)
    assert set(after) == {i for i, (n, hit, _, _) in found.items() if not hit or 20 * hit < n}


def test_encode_stage(stages):
    before, after = stages["encode"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {i: r.n_tokens for i, r in after.items()} == {i: len(t.encode(r.text, add_special_tokens=False).ids) for i, r in before.items()}


def test_run(spark, stages):
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()} == set(stages["encode"][1])


@pytest.mark.parametrize("name, step", corpus_pipeline.STAGES)
def test_stages_on_odd_input(spark, name, step):
    """Null, empty, repeated and long rows, ids at the edge, columns that clash, and no rows at all."""
    good = "The committee met on Monday and agreed to a plan that will be sent to all of the members before the end of the week."
    rows = [(1, good), (1, good), (None, good + " Once more."), (2, None), (3, ""), (4, good + "\nand a second line of it\n" + good), (-(1 << 63), "x" * 60_000),
            ((1 << 63) - 1, "\n".join(f"{good} {i}" for i in range(50))), (5, " \n\t"), (5, "a b")]
    extra = "doc_id long, text string, overlap int, own string, rest string, marks int, fp long, chunk long, n_words int, n_lines int, known boolean, root int"
    docs = spark.createDataFrame([(i, x, 1, "o", "r", 2, 3, 4, 5, 6, True, 7) for i, x in rows], extra).repartition(3)
    kept = corpus_pipeline.stage(step(spark, docs, SMALL), f"odd-{name}")
    assert step(spark, docs.where("false"), SMALL).count() == 0
    if name == "encode":
        assert kept.count() == len(rows)
        return
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    group = brute.simhash([(k, x) for k, (_, x) in enumerate(rows)])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k][1]] = min(least.get(group[k][1], i), i)
    first, last = -(1 << 63), (1 << 63) - 1
    assert ids == sorted({"quality_rules": [1, 1, None], "line_dedup": [1, 1, None, 4, first, last, 5],
                          "simhash_dedup": [i for k, (i, _) in enumerate(rows) if least.get(group[k][1]) == i],
                          "decontaminate": [i for i, _ in rows]}[name], key=str)
    assert {tuple(r)[2:] for r in kept.collect()} == {(1, "o", "r", 2, 3, 4, 5, 6, True, 7)}
