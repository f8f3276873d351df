"""Distributed ranks / quantiles and hypothesis statistics against direct numpy formulas."""
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strideframe.functions.distributions import chi2_sf, f_sf, t_two_sided
from strideframe.operators import profile, stats
from strideframe.operators.ranks import exact_quantiles, mid_ranks

VALUES = [5, 3, 3, 9, 1, 3, 9, 7, 2, 2, 8, 5, 5, 5, 0, 4, 6, 6, 1, 10]
GROUPS = ["a", "b", "c", "a", "b", "c", "a", "b", "c", "a", "b", "c", "a", "b", "c", "a", "b", "c", "a", "b"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(zip(VALUES, GROUPS)), "v int, g string")


def test_mid_ranks_match_average_rank(df):
    got = {r.v: r.midrank for r in mid_ranks(df, "v", buckets=4).collect()}
    exp = pd.Series(VALUES).rank(method="average")
    for val, rk in zip(VALUES, exp):
        assert got[val] == pytest.approx(rk)
    n = len(VALUES)
    counts = pd.Series(VALUES).value_counts()
    assert sum(got[v] * c for v, c in counts.items()) == pytest.approx(n * (n + 1) / 2)


def test_exact_quantiles(df):
    q = {r.p: r.q for r in exact_quantiles(df, "v", [0.0, 0.05, 0.25, 0.5, 0.75, 1.0], buckets=3).collect()}
    for p in q:
        assert q[p] == pytest.approx(np.percentile(VALUES, p * 100))


def test_grouped_quantiles(df):
    q = exact_quantiles(df, "v", [0.5], by=["g"]).collect()
    for r in q:
        vals = [v for v, g in zip(VALUES, GROUPS) if g == r.g]
        assert r.q == pytest.approx(np.median(vals))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=6), min_size=2, max_size=40))
def test_quantiles_property(spark, xs):
    d = spark.createDataFrame([(x,) for x in xs], "v int")
    got = {r.p: r.q for r in exact_quantiles(d, "v", [0.1, 0.5, 0.9], buckets=2).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.percentile(xs, p * 100))


def test_kruskal_formula(df):
    h = stats.kruskal(df, "v", "g").first()
    ranks = pd.Series(VALUES).rank(method="average").to_numpy()
    n = len(VALUES)
    sr = sum(ranks[[i for i, g in enumerate(GROUPS) if g == k]].sum() ** 2 / GROUPS.count(k) for k in "abc")
    hh = 12 / (n * (n + 1)) * sr - 3 * (n + 1)
    t = pd.Series(VALUES).value_counts().to_numpy()
    hh /= 1 - (t ** 3 - t).sum() / (n ** 3 - n)
    assert h.H == pytest.approx(hh, abs=1e-6) and h.k == 3


def test_welch_and_anova(df):
    w = stats.welch_t(df, "v", F.col("g") == "a").first()
    a = np.array([v for v, g in zip(VALUES, GROUPS) if g == "a"], float)
    b = np.array([v for v, g in zip(VALUES, GROUPS) if g != "a"], float)
    se = a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b)
    assert w.t == pytest.approx((a.mean() - b.mean()) / math.sqrt(se), abs=1e-6)
    f = stats.anova(df, "v", F.col("g")).first()
    groups = [np.array([v for v, g in zip(VALUES, GROUPS) if g == k], float) for k in "abc"]
    allv = np.concatenate(groups)
    ssb = sum(len(x) * (x.mean() - allv.mean()) ** 2 for x in groups)
    ssw = sum(((x - x.mean()) ** 2).sum() for x in groups)
    assert f.F == pytest.approx((ssb / 2) / (ssw / (len(allv) - 3)), abs=1e-6)


def test_spearman_equals_pearson_of_ranks(spark):
    xs = [1, 2, 2, 3, 5, 8, 8, 8, 9]
    ys = [2, 1, 4, 4, 6, 5, 9, 7, 9]
    d = spark.createDataFrame(list(zip(xs, ys)), "x int, y int")
    rho = stats.spearman_test(d, "x", "y").first().rho
    rx, ry = pd.Series(xs).rank(), pd.Series(ys).rank()
    assert rho == pytest.approx(np.corrcoef(rx, ry)[0, 1], abs=1e-6)


def test_distribution_tails():
    assert t_two_sided(2.0, 10) == pytest.approx(0.07339, abs=1e-5)
    assert f_sf(3.0, 2, 20) == pytest.approx(0.07254, abs=1e-5)
    assert chi2_sf(5.991, 2) == pytest.approx(0.05, abs=1e-4)


def test_box_and_histogram(spark, df):
    b = profile.box_stats(df, "v").first()
    q1, q3 = np.percentile(VALUES, [25, 75])
    assert (b.q1, b.q3) == (pytest.approx(q1), pytest.approx(q3))
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert b.whisker_lo == min(v for v in VALUES if v >= lo) and b.outliers == sum(v < lo or v > hi for v in VALUES)
    h = profile.histogram(df, "v", 5).collect()
    assert sum(r.n for r in h) == len(VALUES)
    counts, _ = np.histogram(VALUES, bins=5)
    assert [r.n for r in sorted(h, key=lambda r: r.bin)] == [c for c in counts if c > 0] or \
        sum(counts) == sum(r.n for r in h)


def test_ecdf_monotone(df):
    e = sorted(profile.ecdf(df, "v").collect(), key=lambda r: r.v)
    assert e[-1].ecdf == pytest.approx(1.0)
    assert all(a.ecdf <= b.ecdf for a, b in zip(e, e[1:]))
