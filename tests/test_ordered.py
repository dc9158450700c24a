"""Ordered scans and percentiles: the way for large groups must equal plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import ordered, quantiles, summary


def skewed(spark, rows=3000):
    """Two thirds of the rows in one group, a third of those with one value."""
    base = spark.range(rows)
    g = F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))
    v = F.when(F.col("id") % 9 == 1, 5.0).otherwise(F.pmod(F.col("id") * 7919, F.lit(1013)) / 4)
    return base.select("id", g.alias("g"), v.alias("v"))


@pytest.mark.parametrize("limit", [50, 10**6])
def test_percentiles_match_numpy(spark, limit):
    df = skewed(spark)
    probs = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99}
    found = {r["g"]: r for r in quantiles.percentiles(df, ["g"], "v", probs, limit=limit).collect()}
    pdf = df.toPandas()
    assert set(found) == set(pdf["g"])
    for g, part in pdf.groupby("g"):
        assert found[g]["total"] == len(part)
        for name, p in probs.items():
            assert found[g][name] == pytest.approx(np.quantile(part["v"], p))


def test_percentiles_with_counts_fall_back_when_brackets_miss(spark):
    # Row counts shift the ranks far from where the sketch of distinct rows puts them.
    df = spark.range(2000).select(
        F.col("id").cast("double").alias("v"), F.when(F.col("id") > 1990, 5000).otherwise(1).alias("n")
    )
    rows = np.repeat(np.arange(2000), np.where(np.arange(2000) > 1990, 5000, 1))
    got = quantiles.percentile_numbers(df, "v", [0.1, 0.5], limit=100, n="n")
    assert got == pytest.approx([np.quantile(rows, 0.1), np.quantile(rows, 0.5)])


def test_percentile_numbers_of_nothing(spark):
    assert quantiles.percentile_numbers(spark.range(0), "id", [0.5]) == [None]


@pytest.mark.parametrize("limit", [10, 10**6])
def test_index_and_curve(spark, limit):
    df = skewed(spark)
    idx = [r["idx"] for r in ordered.with_index(df, ["v", "id"], limit=limit).orderBy("v", "id").collect()]
    assert idx == list(range(3000))
    curve = ordered.cumulative_counts(df, ["g"], "v", limit=limit).toPandas().sort_values(["g", "v"])
    pdf = df.toPandas()
    want = pdf.groupby(["g", "v"]).size().groupby("g").cumsum()
    assert list(curve["solved"]) == list(want)


@pytest.mark.parametrize("limit", [10, 10**6])
def test_fill_forward(spark, limit):
    df = skewed(spark).withColumn("s", F.when(F.col("id") % 50 == 1, F.col("id")))
    got = ordered.fill_forward(df, ["g"], ["id"], ["s"], limit=limit).toPandas().sort_values("id")
    want = df.toPandas().sort_values("id")
    want["s"] = want.groupby("g")["s"].ffill()
    assert got["s"].fillna(-1).tolist() == want["s"].fillna(-1).tolist()


def test_range_partitions_spread_the_hot_group(spark):
    placed = ordered.ranged(skewed(spark), ["g", "v", "id"])
    hot = placed.filter(F.col("g") == "hot").select(ordered.SEG).distinct().count()
    assert hot > 1
    largest = placed.groupBy(ordered.SEG).count().agg(F.max("count")).first()[0]
    assert largest < 1500


def test_whole_values_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    placed = ordered.ranged(df, ["g", "v"])
    out = ordered.scan(placed, ["g"], ["v"], running={"r": ("sum", "v")}, whole={"w": ("max", "v")})
    assert sorted((r["v"], r["r"], r["w"]) for r in out.collect()) == [(1, 1, 2), (2, 3, 2), (3, 3, 3)]


def test_describe_and_empty_summary(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None)], "a double, b double")
    row = summary.column_summary(df, "a", {"p50": 0.5}).first()
    assert (row["rows"], row["min"], row["p50"], row["max"]) == (3, 1.0, 2.0, 4.0)
    empty = summary.column_summary(df, "b", {"p50": 0.5}, empty_as_zero=True).first()
    assert (empty["rows"], empty["min"], empty["max"], empty["p50"], empty["avg"]) == (0, 0.0, 0.0, None, None)
    pair = summary.paired_summary(df.withColumn("c", F.col("a") * 2), "c", "a", {"p50": 0.5})
    assert {r["statistic"]: r["speedup"] for r in pair.collect()} == {"min": 2.0, "p50": 2.0, "avg": 2.0, "max": 2.0}


@pytest.mark.parametrize("limit", [50, 10**6])
def test_many_rows_take_more_tasks(spark, monkeypatch, limit):
    from runlens import session

    df = skewed(spark)
    ones = df.withColumn("one", F.lit(1))
    plain = ordered.scan_groups(ones, ["g"], ["v", "id"], running={"r": ("sum", "one")}, limit=limit)
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    assert session.tasks_for(spark, 3000) == 30 and session.tasks_for(spark, 400) is None
    dealt = ordered.scan_groups(ones, ["g"], ["v", "id"], running={"r": ("sum", "one")}, limit=limit)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))
    assert dealt.rdd.getNumPartitions() >= 30
    bucketed = session.keep_bucketed(df, "more", "g", rows=3000).groupBy("g").count()
    assert bucketed.rdd.getNumPartitions() == 30
