"""Dashboard filters and the persona model."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.config import StudyConfig
from strideframe.operators import personas
from strideframe.operators.filters import Filters


def test_filters(spark):
    df = spark.createDataFrame([(1, dt.date(2016, 4, 12)), (2, dt.date(2016, 4, 20)), (3, dt.date(2016, 5, 11))],
                               "user_id long, activity_date date")
    assert df.filter(Filters(users=()).users_col()).count() == 0            # empty selection -> no rows
    f = Filters(users=(1, 3), start=dt.date(2016, 4, 12), end=dt.date(2016, 5, 11))
    assert sorted(r.user_id for r in f.apply(df, "activity_date").collect()) == [1, 3]   # inclusive range
    ids = spark.createDataFrame([(2,), (3,)], "user_id long")
    f2 = Filters(users=ids, start=dt.date(2016, 4, 13))
    assert sorted(r.user_id for r in f2.apply(df, "activity_date").collect()) == [2, 3]


def test_persona_naming_rules(spark):
    cols = "cluster int, avg_steps double, avg_sedentary_min double, avg_mvpa_min double, avg_light_min double, " \
           "valid_days double"
    centres = spark.createDataFrame([
        (0, 12000.0, 600.0, 80.0, 200.0, 25.0),    # MVPA > 1.4 x mean
        (1, 9000.0, 700.0, 20.0, 300.0, 25.0),     # light > 1.15 x mean and steps >= mean
        (2, 3000.0, 1100.0, 10.0, 100.0, 10.0),    # few wear days
        (3, 3500.0, 1200.0, 12.0, 110.0, 11.0),    # also few wear days -> "II"
    ], cols)
    overall = centres.agg(*[F.avg(c).alias(f"overall_{c}") for c in
                            ("avg_steps", "avg_sedentary_min", "avg_mvpa_min", "avg_light_min", "valid_days")])
    names = {r.cluster: r.persona for r in personas.name_personas(centres.crossJoin(overall)).collect()}
    assert names[0] == "Performance Seekers" and names[1] == "Everyday Movers"
    assert {names[2], names[3]} == {"Drifting Users", "Drifting Users II"}
    assert names[2] == "Drifting Users II"          # the lower-MVPA repeat (10 < 12) gets the suffix


def test_kmeans_personas_cover_users(spark):
    rows = [(i, float(1000 * (i % 7) + i), float(500 + 13 * i), float(i % 5 * 9), float(100 + i % 3 * 50),
             (i % 4) * 5 + 1) for i in range(40)]
    rows.append((99, 0.0, 0.0, 0.0, 0.0, 0))     # no valid day -> not clustered
    dim = spark.createDataFrame(rows, "user_id long, avg_steps double, avg_sedentary_min double, avg_mvpa_min double,"
                                      " avg_light_min double, valid_days long")
    cfg = StudyConfig(persona_n_init=3, elbow_n_init=2, elbow_max_k=4)
    p = personas.dim_user_persona(dim, cfg)
    got = p.collect()
    assert len(got) == 40 and len({r.user_id for r in got}) == 40
    assert len({r.persona for r in got}) <= 4
    el = personas.elbow(dim, cfg).collect()
    inertia = [r.inertia for r in sorted(el, key=lambda r: r.k)]
    assert [r.k for r in sorted(el, key=lambda r: r.k)] == [1, 2, 3, 4]
    assert inertia[0] == pytest.approx(5 * 40)      # standardised: k=1 inertia = n * features
    assert all(a >= b - 1e-6 for a, b in zip(inertia, inertia[1:]))


def _users(spark, n=300, parts=1):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 1, (n // 3, 5)) for m in (0, 4, 9)])
    rows = [(int(i), *map(float, r[:4]), int(abs(r[4]) * 3) + 1) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "user_id long, avg_steps double, avg_sedentary_min double, avg_mvpa_min double,"
                                       " avg_light_min double, valid_days long").repartition(parts)


def test_all_fits_in_one_job_match_plain_lloyd(spark):
    """Each fit of the batch ends where Lloyd's algorithm on its own ends, and the best of them is kept."""
    feats = personas.PERSONA_FEATURES
    points = personas._points(personas.zscore_pop(personas.persona_features(_users(spark, parts=3))), feats)
    x = np.array([tuple(r) for r in points.select(*feats).collect()], float) / personas.SCALE
    drawn = points.orderBy(F.xxhash64(F.lit(7), "user_id"), "user_id").limit(personas.START_POINTS).select(*feats).collect()
    sample = np.array([tuple(r) for r in drawn], float) / personas.SCALE
    wanted = [(1, 1), (2, 2), (5, 3)]
    for (k, restarts), fit in zip(wanted, personas.fit_all(points, feats, wanted, seed=7)):
        best = None
        for s in range(restarts):
            c = personas._start(sample, k, 7 + s)
            while True:
                d = ((x[:, None] - c) ** 2).sum(-1)
                at = d.argmin(1)
                new = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(k)])
                if np.abs(new - c).max() < personas.TOLERANCE:
                    break
                c = new
            best = min(best or (np.inf, 0), (d.min(1).sum(), s))
        assert fit.cost == pytest.approx(best[0], abs=1e-3) and fit.centres.shape == (k, 5)


def test_fits_do_not_depend_on_partitions(spark):
    cfg = StudyConfig(persona_n_init=4, elbow_n_init=2, elbow_max_k=5)
    one, many = (personas.fit_models(_users(spark, parts=p), cfg) for p in (1, 7))
    assert (one.personas.centres == many.personas.centres).all()
    assert [f.cost for f in one.elbow] == [f.cost for f in many.elbow]
    labels = {r.user_id: r.cluster for r in personas.assign_clusters(_users(spark, parts=2), cfg, models=one).collect()}
    points = personas._points(personas.zscore_pop(personas.persona_features(_users(spark))), personas.PERSONA_FEATURES).collect()
    x = np.array([r[1:] for r in points], float) / personas.SCALE
    assert [labels[r.user_id] for r in points] == personas.nearest(x, one.personas.centres)[0].tolist()


def test_fits_of_equal_and_no_users(spark):
    same = spark.createDataFrame([(i, 1.0, 2.0, 3.0, 4.0, 5) for i in range(9)], _users(spark).schema)
    assert {r.cluster for r in personas.dim_user_persona(same, StudyConfig(persona_n_init=2)).collect()} == {0}
    assert personas.dim_user_persona(same.where("user_id < 0"), StudyConfig()).count() == 0
