import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    """(doc_id, text) of the smallest table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture
def frame(spark):
    """Documents with columns that clash with the operators' own."""
    def make(docs):
        rows = [(i, x, "k", 1, [2]) for i, x in docs]
        return spark.createDataFrame(rows, "doc_id long, text string, n_words string, chunk int, own array<int>").repartition(3)
    return make


@pytest.fixture
def copies():
    """Random documents that share passages: (unit, join, long) -> documents, some null, empty, repeated, without id."""
    def make(seed, unit, join, long):
        rng = random.Random(seed)
        def some(n):
            return join.join(unit(rng) for _ in range(n))
        pool = [some(rng.randint(long // 2, 4 * long)) for _ in range(6)] + [join.join([unit(rng)] * (2 * long))]
        docs = [(0, None), (1, ""), (2, some(1)), (3, " \n\t"), (None, pool[0]), (None, join.join([pool[0]] * 2)),
                (77, pool[1]), (77, pool[1]), (77, join.join([some(3), pool[1]])), (4, some(30 * long))]
        for i in range(5, 70):
            parts = []
            for _ in range(rng.randint(0, 4)):
                z = rng.choice(pool)
                a, b = sorted((rng.choice([0, rng.randint(0, len(z))]), rng.choice([len(z), rng.randint(0, len(z))])))
                parts.append(z[a:b] if rng.random() < 0.6 else some(rng.randint(0, long)))
            docs.append((i, join.join(parts)))
        rng.shuffle(docs)
        return docs
    return make
