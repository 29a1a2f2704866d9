"""Running sums, tie ranks and counted summaries against brute force, and how the rows are cut."""

import random

import pytest
from pyspark.sql import functions as F

from riskgrain.operators import profiling, ranking


def pairs(spark, n=4000, seed=1):
    """A third of the rows have one x, each with a y of its own."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x = 7.0 if k % 3 == 0 else float(rng.randint(-40, 40)) / 4
        rows.append((rng.choice("abc"), x, float(k) if k % 3 == 0 else float(rng.randint(0, 20))))
    return [*rows, ("one", 1.0, 1.0), ("two", 1.0, 2.0), ("two", 1.0, 3.0)]


def mean_rank(values, x):
    return sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2


@pytest.mark.parametrize(("partitions", "batch"), [(2, 10_000), (7, 3)])
def test_tie_ranks_equal_brute_force(spark, partitions, batch):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = pairs(spark, 600)
        counted = spark.createDataFrame(rows, "k string, x double, y double").groupBy("k", "x", "y").agg(F.count("*").alias("w"))
        got = ranking.tie_ranks(counted, "x", "y", "w", ["k"], "r").collect()
        assert len(got) == len({r for r in rows})
        for r in got:
            own = [x for k, x, _ in rows if k == r["k"]]
            assert (r["r"], r["r_of"]) == (mean_rank(own, r["x"]), len(own))
        runs = ranking.ranked_values(spark.createDataFrame(rows, "k string, x double, y double"), "x", ["k"]).collect()
        for r in runs:
            own = [x for k, x, _ in rows if k == r["k"]]
            assert (r["cum_n"], r["tot_n"]) == (sum(x <= r["x"] for x in own), len(own))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rank_correlation_of_a_common_value(spark):
    rows = pairs(spark)
    df = spark.createDataFrame(rows, "k string, x double, y double")
    for r in profiling.spearman(df, "x", "y", ["k"]).collect():
        own = [(x, y) for k, x, y in rows if k == r["k"]]
        assert r["observed_rows"] == len(own)
        if r["k"] in ("one", "two"):
            assert r["spearman"] is None
            continue
        xs, ys = [x for x, _ in own], [y for _, y in own]
        rx, ry = {x: mean_rank(xs, x) for x in set(xs)}, {y: mean_rank(ys, y) for y in set(ys)}
        m = (len(own) + 1) / 2
        xy, xx, yy = (sum(a * b for a, b in z) for z in (
            [(rx[x] - m, ry[y] - m) for x, y in own], [(rx[x] - m, rx[x] - m) for x in xs], [(ry[y] - m, ry[y] - m) for y in ys]))
        assert r["spearman"] == pytest.approx(xy / (xx * yy) ** 0.5, abs=1e-12)


def test_a_common_value_is_cut_over_partitions(spark):
    df = spark.createDataFrame(pairs(spark, 30_000), "k string, x double, y double").drop("k")
    counted = df.groupBy("x", "y").agg(F.count("*").alias("n"))
    cut = ranking._ranged(counted, [], [F.asc("x"), F.asc("y")])
    sizes = [r["count"] for r in cut.groupBy("_bucket").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert cut.where("x = 7").select("_bucket").distinct().count() > 1


def test_summaries_read_their_input_once(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice([0, 1]), rng.choice([None, float("nan"), 0.0, 1.5, rng.gauss(1e6, 3)]), rng.choice([None, 2])) for _ in range(500)]
    spark.createDataFrame(rows, "TARGET int, a double, b int").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").withColumn("none", F.lit(None).cast("double"))
    counter = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(v):
        counter.add(1)
        return v

    watched = df.withColumn("a", seen("a"))
    got = {r["column_name"]: r for r in profiling.numeric_summary(watched, ["a"]).collect()}
    assert counter.value == len(rows)
    known = [v for _, v, _ in rows if v is not None and v == v]
    mean = sum(known) / len(known)
    a = got["a"]
    assert (a["row_count"], a["observed_count"], a["missing_count"], a["zero_count"]) == (500, len(known), 500 - len(known), known.count(0.0))
    assert (a["unique_count"], a["modal_count"], a["min"], a["max"]) == (len(set(known)), max(known.count(v) for v in set(known)), min(known), max(known))
    assert a["mean"] == pytest.approx(mean, rel=1e-13) and a["std"] == pytest.approx((sum((v - mean) ** 2 for v in known) / (len(known) - 1)) ** 0.5, rel=1e-12)
    empty = {r["column_name"]: r for r in profiling.numeric_summary(df, ["none", "b"]).collect()}
    assert (empty["none"]["row_count"], empty["none"]["observed_count"], empty["none"]["mean"], empty["none"]["median"]) == (500, 0, None, None)
    assert (empty["b"]["std"], empty["b"]["unique_count"], empty["b"]["median"]) == (0.0, 1, 2.0)
    assert profiling.numeric_summary(df.limit(0), ["a"]).count() == 0
