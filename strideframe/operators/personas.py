"""Persona model (P1-P7): K-Means on standardised per-user behaviour features.

The model is fitted on one row per user (the feature build is the only large step).  All restarts of all models go
through Lloyd's iterations together: one job an iteration adds up, for each fit and centre, the users nearest to it,
and only these sums (fits x centres rows) reach the driver.  Coordinates are whole numbers of 1 / SCALE, so the sums are
exact and a fit doesn't depend on how the users are partitioned.  Start points are drawn by k-means++ from the START_POINTS
users with the smallest hashes; a fit ends when no centre moves by TOLERANCE.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.config import PAIR_COLUMNS, PERSONA_FEATURES, PERSONA_Z_FEATURES, StudyConfig
from strideframe.functions.bootstrap import draw
from strideframe.functions.compat import rnd
from strideframe.functions.stats_exprs import pearson, scalars
from strideframe.session import ensure_checkpoint_dir, written

USERS_PER_TASK = 50_000
SCALE = 1 << 20
#: Days of each persona in the pair plot's point feed.
POINTS = 200
START_POINTS, TOLERANCE, MAX_ITERATIONS = 512, 1e-4, 300


def persona_features(dim_user: DataFrame, feats=PERSONA_FEATURES) -> DataFrame:
    """Users with at least one valid day; missing features become 0."""
    return dim_user.filter(F.col("valid_days") > 0).select("user_id", *feats).fillna(0, subset=list(feats))


def zscore_pop(df: DataFrame, feats=PERSONA_FEATURES) -> DataFrame:
    """(x - mean) / population sd, the one-row moments read as scalar subqueries (sd 0 -> 0)."""
    mom = scalars(df.agg(*[F.avg(f).alias(f"{f}__m") for f in feats],
                         *[F.stddev_pop(f).alias(f"{f}__s") for f in feats]))
    return df.select("user_id", *[F.coalesce(F.try_divide(F.col(f) - mom[f"{f}__m"], mom[f"{f}__s"]),
                                             F.lit(0.0)).alias(f) for f in feats])


@dataclass
class Fit:
    """Centres (k x features, standardised) and the sum of squared distances of all users to the nearest one."""
    centres: np.ndarray
    cost: float


def _points(z: DataFrame, feats) -> DataFrame:
    """user_id and whole-numbered coordinates, written once to the shared checkpoint folder (cuts the lineage back to the
    raw scan, so that each iteration plans a short scan and a lost executor re-reads files)."""
    ensure_checkpoint_dir(z.sparkSession)
    return z.select("user_id", *(F.round(F.col(f) * SCALE).cast("long").alias(f) for f in feats)).checkpoint(eager=True)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row of x (the first of equally near ones) and its squared distance, added up
    feature by feature, so that a row's result doesn't depend on the rows beside it."""
    distance = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        distance += (x[:, j, None] - centres[:, j]) ** 2
    best = distance.argmin(1)
    return best, distance[np.arange(len(x)), best]


def _sums(points: DataFrame, feats, fits: list[np.ndarray]) -> list:
    """(fit, centre, n, cost, sum of each feature) over the users nearest to each centre, of all fits in one job."""
    given = points.sparkSession.sparkContext.broadcast(fits)
    kind = ["fit int", "centre int", "n long", "cost long", *(f"s{j} long" for j in range(len(feats)))]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(c), 2 + len(feats)), np.int64) for c in given.value]
        for batch in batches:
            whole = np.stack([batch.column(f).to_numpy() for f in feats], 1)
            x = whole / SCALE
            for centres, t in zip(given.value, total):
                at, distance = nearest(x, centres)
                t[:, 0] += np.bincount(at, minlength=len(centres))
                for j, values in enumerate([np.rint(distance * SCALE).astype(np.int64), *whole.T], 1):
                    np.add.at(t[:, j], at, values)
        fit = np.repeat(np.arange(len(total), dtype=np.int32), [len(t) for t in total])
        centre = np.concatenate([np.arange(len(t), dtype=np.int32) for t in total])
        yield pa.record_batch([pa.array(c) for c in (fit, centre, *np.concatenate(total).T.copy())], names=[k.split()[0] for k in kind])

    sums = [F.sum(F.col(k.split()[0]).cast("decimal(38,0)")).alias(k.split()[0]) for k in kind[2:]]
    found = points.select(*feats).mapInArrow(add_up, ", ".join(kind)).groupBy("fit", "centre").agg(*sums).collect()
    given.unpersist()
    return found


def _start(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the sample's points, each drawn in proportion to the squared distance to the nearest one drawn before."""
    rng = np.random.default_rng(seed)
    chosen = [sample[rng.integers(len(sample))]]
    while len(chosen) < k:
        far = nearest(sample, np.array(chosen))[1]
        chosen.append(sample[rng.choice(len(sample), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(sample))])
    return np.array(chosen)


def fit_all(points: DataFrame, feats, wanted: list[tuple[int, int]], seed: int, max_iter: int = MAX_ITERATIONS) -> list[Fit]:
    """For each (k, restarts) of ``wanted`` the best fit, lowest cost first, then earliest start."""
    points = points.coalesce(max(1, math.ceil(points.count() / USERS_PER_TASK))).persist()
    try:
        drawn = points.orderBy(F.xxhash64(F.lit(seed), "user_id"), "user_id").limit(START_POINTS).select(*feats).collect()
        sample = np.array([tuple(r) for r in drawn], np.float64).reshape(-1, len(feats)) / SCALE
        owner = [i for i, (_, restarts) in enumerate(wanted) for _ in range(restarts)]
        centres = [_start(sample, k, seed + s) for k, restarts in wanted for s in range(restarts)]
        cost, moving = [math.inf] * len(centres), list(range(len(centres)))
        for _ in range(max_iter):
            moved = [c.copy() for c in centres]
            total = dict.fromkeys(moving, 0)
            for r in _sums(points, feats, [centres[f] for f in moving]):
                f = moving[r["fit"]]
                total[f] += int(r["cost"])
                if r["n"]:  # a centre without users stays where it is
                    moved[f][r["centre"]] = [int(r[f"s{j}"]) / int(r["n"]) / SCALE for j in range(len(feats))]
            for f in moving:  # the cost is that of the centres that the sums were taken for
                cost[f] = total[f] / SCALE
            still = [f for f in moving if np.abs(moved[f] - centres[f]).max() >= TOLERANCE]
            centres, moving = [moved[f] if f in still else c for f, c in enumerate(centres)], still
            if not moving:
                break
    finally:
        points.unpersist()
    best = [min((f for f in range(len(owner)) if owner[f] == i), key=lambda f: (cost[f], f)) for i in range(len(wanted))]
    return [Fit(centres[f], cost[f]) for f in best]


def _label(feats, centres: np.ndarray) -> Column:
    """The number of the nearest centre, the first of equally near ones."""
    x = [F.round(F.col(f) * SCALE).cast("long") / F.lit(float(SCALE)) for f in feats]
    distances = [sum(((x[j] - F.lit(float(c[j]))) * (x[j] - F.lit(float(c[j]))) for j in range(len(feats))), F.lit(0.0)) for c in centres]
    if len(distances) == 1:
        return F.lit(0)
    return (F.array_position(F.array(*distances), F.least(*distances)) - 1).cast("int")


@dataclass
class Models:
    """The best persona fit and the elbow's fits; either may be missing."""
    personas: Fit | None = None
    elbow: list[Fit] | None = None


def fit_models(dim_user: DataFrame, cfg: StudyConfig | None = None, personas: bool = True, curve: bool = True, feats=PERSONA_FEATURES) -> Models:
    """The persona model, the elbow's models or both, from one input and in the same jobs."""
    cfg = cfg or StudyConfig()
    points = _points(zscore_pop(persona_features(dim_user, feats), feats), feats)
    users = points.count()
    if curve and users < cfg.elbow_max_k:
        raise ValueError(f"{users} users can't be put into up to {cfg.elbow_max_k} clusters")
    if not users:
        return Models(Fit(np.zeros((1, len(feats))), 0.0), [])
    wanted = [(cfg.persona_k, cfg.persona_n_init)] * personas \
        + [(k, cfg.elbow_n_init if k > 1 else 1) for k in range(1, cfg.elbow_max_k + 1)] * curve
    fits = fit_all(points, feats, wanted, cfg.seed)
    return Models(fits[0] if personas else None, fits[personas:] if curve else None)


def assign_clusters(dim_user: DataFrame, cfg: StudyConfig | None = None, feats=PERSONA_FEATURES, models: Models | None = None) -> DataFrame:
    """The clustered users with their features and cluster."""
    models = models or fit_models(dim_user, cfg, curve=False, feats=feats)
    f = persona_features(dim_user, feats)
    labelled = zscore_pop(f, feats).select("user_id", _label(feats, models.personas.centres).alias("cluster"))
    return f.join(labelled, "user_id")


def cluster_centres(assigned: DataFrame, feats=PERSONA_FEATURES) -> DataFrame:
    """Centres in raw units (k rows) joined with the overall mean (one row)."""
    c = assigned.groupBy("cluster").agg(*[F.avg(f).alias(f) for f in feats])
    o = scalars(assigned.agg(*[F.avg(f).alias(f"overall_{f}") for f in feats]))
    return c.select("*", *[o[f"overall_{f}"].alias(f"overall_{f}") for f in feats])


def name_personas(centres: DataFrame) -> DataFrame:
    """P5: rule names vs the overall mean, highest MVPA centre named first; repeats get II, III, 4, 5, ..."""
    c = F.col
    # fixed naming rule (published thresholds: 1.4 x MVPA, 1.15 x light with steps >= mean, 0.8 x wear days)
    name = (F.when(c("avg_mvpa_min") > c("overall_avg_mvpa_min") * 1.4, "Performance Seekers")
            .when((c("avg_light_min") > c("overall_avg_light_min") * 1.15) & (c("avg_steps") >= c("overall_avg_steps")),
                  "Everyday Movers")
            .when(c("valid_days") < c("overall_valid_days") * 0.8, "Drifting Users")
            .otherwise("Desk-Bound Sitters"))
    w = Window.partitionBy("base").orderBy(F.col("avg_mvpa_min").desc(), F.col("cluster"))
    n = centres.withColumn("base", name).withColumn("dup", F.row_number().over(w))
    suffix = F.when(F.col("dup") == 1, F.lit("")).when(F.col("dup") == 2, " II").when(F.col("dup") == 3, " III") \
        .otherwise(F.concat(F.lit(" "), F.col("dup").cast("string")))
    return n.select("cluster", F.concat(F.col("base"), suffix).alias("persona"))


def dim_user_persona(dim_user: DataFrame, cfg: StudyConfig | None = None, models: Models | None = None) -> DataFrame:
    """user_id, cluster, persona for every clustered user.  The labelled users are written once: the names' centres and means
    read them many times, and each reading would plan the features' moments again."""
    assigned = written(assign_clusters(dim_user, cfg, models=models), "assigned")
    names = name_personas(cluster_centres(assigned))
    return assigned.join(F.broadcast(names), "cluster").select("user_id", "cluster", "persona")


def elbow(dim_user: DataFrame, cfg: StudyConfig | None = None, feats=PERSONA_FEATURES, models: Models | None = None) -> DataFrame:
    """Inertia for k = 1..max_k (k = 1 is the total squared distance to the mean), a VALUES table of k rows."""
    models = models or fit_models(dim_user, cfg, personas=False, feats=feats)
    rows = [(len(fit.centres), float(round(fit.cost, 4))) for fit in models.elbow]
    return dim_user.sparkSession.createDataFrame(rows, "k int, inertia double").orderBy("k")


def persona_minmax(dim_user: DataFrame, personas: DataFrame,
                   feats=("avg_steps", "avg_mvpa_min", "avg_light_min", "avg_sedentary_min", "valid_days")) -> DataFrame:
    """Persona means min-max scaled by the range over all clustered users."""
    u = dim_user.join(personas.select("user_id", "persona"), "user_id")
    rng = scalars(u.agg(*[F.min(f).alias(f"{f}__lo") for f in feats], *[F.max(f).alias(f"{f}__hi") for f in feats]))
    g = u.groupBy("persona").agg(*[F.avg(f).alias(f) for f in feats])
    return g.select("persona", *[rnd(F.try_divide(F.col(f) - rng[f"{f}__lo"], rng[f"{f}__hi"] - rng[f"{f}__lo"]), 6)
                                 .alias(f) for f in feats])


def persona_zscore(dim_user: DataFrame, personas: DataFrame, feats=PERSONA_Z_FEATURES) -> DataFrame:
    """Per-persona mean of sample-sd z-scores."""
    u = dim_user.join(personas.select("user_id", "persona"), "user_id")
    mom = scalars(u.agg(*[F.avg(f).alias(f"{f}__m") for f in feats], *[F.stddev_samp(f).alias(f"{f}__s") for f in feats]))
    z = u.select("persona", *[F.try_divide(F.col(f) - mom[f"{f}__m"], mom[f"{f}__s"]).alias(f) for f in feats])
    return z.groupBy("persona").agg(*[rnd(F.avg(f), 6).alias(f) for f in feats])


def pair_by_persona(fct_daily_sleep: DataFrame, personas: DataFrame, feats=PAIR_COLUMNS) -> DataFrame:
    """Pairwise correlations over the persona's days with a night, every pair in one aggregate."""
    d = fct_daily_sleep.join(personas.select("user_id", "persona"), "user_id")
    pairs = [(a, b) for i, a in enumerate(feats) for b in feats[i + 1:]]
    g = d.groupBy("persona").agg(F.count(F.lit(1)).alias("days"),
                                 *[rnd(pearson(a, b), 6).alias(f"{a}__{b}") for a, b in pairs])
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    return g.select("persona", "days", F.expr(f"stack({len(pairs)}, {stack}) AS (var_a, var_b, r)"))


def points_by_persona(fct_daily_sleep: DataFrame, personas: DataFrame, points: int = POINTS, feats=PAIR_COLUMNS) -> DataFrame:
    """E19's point feed: of each persona the ``points`` days whose user and date draw the smallest numbers, the same
    days however the table is partitioned.

    Draws are counted per persona in logarithmic cells (a sixteenth of a power of two, 512 at most), a mergeable
    aggregate; days in the cells that hold the smallest ``points`` pass, a few more than wanted, and only these are
    ranked.  A persona with any share of the days is neither sorted nor gathered.
    """
    d = fct_daily_sleep.join(personas.select("user_id", "persona"), "user_id") \
        .withColumn("h", draw(F.col("user_id"), F.unix_date("activity_date"), F.lit(0)))
    d = d.withColumn("cell", F.floor(16 * F.log2(F.col("h") + F.lit(1.0))).cast("int"))
    cells = d.groupBy("persona", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("persona").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limit = cells.withColumn("before", before).where(F.col("before") < points).groupBy("persona").agg(F.max("cell").alias("last"))
    near = d.join(limit, "persona").where(F.col("cell") <= F.col("last"))
    rank = F.row_number().over(Window.partitionBy("persona").orderBy("h", "user_id", "activity_date"))
    return near.withColumn("k", rank).where(F.col("k") <= points).select("persona", "user_id", "activity_date", *feats)


def by_tier(dim_user: DataFrame) -> DataFrame:
    """A persona table by rule (the engagement tier), which SQL can build too: (user_id, cluster, persona)."""
    tier = F.col("engagement_tier")
    cluster = F.when(tier == "Committed", 0).when(tier == "Regular", 1).otherwise(2)
    return dim_user.filter(F.col("valid_days") > 0).select("user_id", cluster.alias("cluster"), tier.alias("persona"))
