"""Rows that joins make inside operators."""

from pyspark.sql import functions as F

from sieveline.llm import jaccard_join


def join_rows(df):
    """Rows out of the joins of a frame's plan, once it has run."""
    rows = df.collect()
    plans, made = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plans.append(plan.finalPhysicalPlan())
        elif name.endswith("QueryStageExec"):
            plans.append(plan.plan())
        elif name.endswith("JoinExec"):
            made += plan.longMetric("numOutputRows").value()
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return rows, made


def test_sets_meet_their_chunks_as_one_row_each(spark):
    paths = {n: [n % 7, 100 + n % 3, *range(1000 * n, 1000 * n + 38)] for n in range(300)}
    sets = spark.createDataFrame(list(paths.items()), "node long, paths array<long>")
    chunked = spark.range(200).select(F.col("id").alias("node"), F.lit(5).cast("long").alias("root"), (F.col("id") % 2).cast("int").alias("own"))
    rows, made = join_rows(jaccard_join.chunks_on_paths(sets, chunked))
    assert {(r.path, r.root, r.own) for r in rows} == {(p, 5, n % 2) for n in range(200) for p in paths[n]}
    assert len(rows) == len({(p, n % 2) for n in range(200) for p in paths[n]})
    assert made == 200
