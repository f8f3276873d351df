"""Plan shape of the queries that combine rows with one-row aggregates: no cross products and no
nested-loop joins (one-row aggregates are scalar subqueries), and no row-at-a-time Python UDF."""
import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
NAMES = ["welch_weekend", "kruskal_weekday", "anova_bedtime", "spearman_sit_sleep", "mid_ranks", "percentile_rank",
         "curve_minmax", "data_quality", "duplicate_count", "box_steps", "histogram_steps", "hexbin", "median_mean",
         "describe"]


def test_no_cross_products_or_python_rows(spark):
    qs = E.queries()
    offenders = {}
    for name in NAMES:
        plan = qs[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        hit = [b for b in BAD if b in plan]
        if hit:
            offenders[name] = hit
    assert not offenders, offenders
