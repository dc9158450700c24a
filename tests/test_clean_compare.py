"""Cleaning rules, cohorts and the funnel on literal cases."""

import pytest
from pyspark.sql import functions as F

from runlens.functions.numeric import number_text, ratio, round_half_even
from runlens.functions.predicates import Limits
from runlens.operators import clean, compare

LIMITS = Limits(timeout=11.0, spread=1.2)
CASES = {
    "kept": ([10, 11, 11], [True] * 3),
    "straddle": ([10, 12, 12], [True] * 3),
    "spread": ([5, 5, 7], [True] * 3),
    "outcome": ([5, 5, 5], [True, False, True]),
    "zero": ([0, 1, 1], [True] * 3),
    "zeros": ([0, 0, 0], [True] * 3),
    "even": ([10, 11], [True] * 2),
    "half": ([2, 2], [False] * 2),
}


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        ("v", unit, ok, float(value), i)
        for unit, (values, oks) in CASES.items()
        for i, (value, ok) in enumerate(zip(values, oks))
    ]
    return spark.createDataFrame(rows, "variant string, unit string, ok boolean, value double, run int")


@pytest.mark.parametrize("limit", [1, 10**6])
def test_median_values(runs, limit):
    got = {r["unit"]: (r["value"], r["ok"]) for r in clean.median_values(runs, LIMITS, limit=limit).collect()}
    assert got == {"kept": (11, True), "even": (10, True), "half": (2, False)}


@pytest.mark.parametrize("limit", [1, 10**6])
def test_median_runs(runs, limit):
    odd = clean.median_runs(runs, LIMITS, ["run"], limit=limit).collect()
    assert {(r["unit"], r["value"], r["run"]) for r in odd} == {("kept", 11.0, 1)}
    lower = clean.median_runs(runs, LIMITS, ["run"], even="lower", limit=limit).collect()
    assert {(r["unit"], r["run"]) for r in lower} == {("kept", 1), ("even", 0), ("half", 0)}
    with pytest.raises(ValueError):
        clean.median_runs(runs, LIMITS, ["run"], even="upper")


def test_null_values_sort_last_and_count(spark):
    rows = [("v", "u", True, 1.0, 0), ("v", "u", True, None, 1), ("v", "u", True, 1.1, 2)]
    runs = spark.createDataFrame(rows, "variant string, unit string, ok boolean, value double, run int")
    for limit in (1, 100):
        assert clean.median_runs(runs, LIMITS, ["run"], limit=limit).first()["value"] == 1.1
        ranks = {r["run"]: (r["rn"], r["cnt"]) for r in clean.with_run_ranks(runs, ["value"], limit=limit).collect()}
        assert ranks == {0: (1, 3), 2: (2, 3), 1: (3, 3)}


def test_exclusion_report(runs):
    row = clean.exclusion_report(runs, LIMITS).first()
    assert (row["raw"], row["kept"], row["outcome"], row["timeout"], row["spread"]) == (8, 3, 1, 1, 3)
    assert row["excluded_pct"] == pytest.approx(62.5)


def test_unique_check(runs):
    with pytest.raises(ValueError):
        clean.require_unique(runs, ["unit"])


def test_numbers(spark):
    row = spark.range(1).select(
        ratio(F.lit(1), F.lit(0)).alias("inf"),
        F.isnan(ratio(F.lit(0), F.lit(0))).alias("nan"),
        round_half_even(F.lit(2.5)).alias("down"),
        round_half_even(F.lit(3.5)).alias("up"),
        number_text(F.lit(None).cast("double")).alias("na"),
    ).first()
    assert (row["inf"], row["nan"], row["down"], row["up"], row["na"]) == (float("inf"), True, 2, 4, "N/A")


def make_sources(spark):
    def frame(rows):
        return spark.createDataFrame(rows, "variant string, unit string, ok boolean, value double")

    results, stats = [], []
    spec = {
        "good": (True, True, 5, 5, False),
        "mismatch": (True, False, 5, 5, False),
        "slow": (True, True, 5, 20, False),
        "failed": (False, False, 5, 5, False),
        "easy": (True, True, 5, 5, True),
    }
    for unit, (a, b, x, y, easy) in spec.items():
        results += [("old", unit, a, float(x)), ("new", unit, b, float(y))]
        stats += [("old", unit, a, float(x)), ("new", unit, b, float(y))]
        results.append(("base", unit, easy, 1.0))
    results.append(("old", "alone", True, 1.0))
    results.append(("base", None, True, 1.0))
    return compare.Sources(frame(results), frame(stats), LIMITS, LIMITS, baseline="base")


def test_funnel_parts_sum_up(spark):
    src = make_sources(spark)
    joined = compare.joined_sources(src, "old", "new")
    row = compare.funnel(joined, src, compare.FUNNEL).first().asDict()
    assert row["base"] == 5
    parts = [*[f"without_{name}" for name in compare.FUNNEL], "included"]
    assert [row[p] for p in parts] == [1, 1, 1, 1, 1]
    assert sum(row[p] for p in parts) == row["base"]
    units = compare.cohort(src, "old", "new", compare.FUNNEL)
    assert [r["unit"] for r in units.collect()] == ["good"]


def test_exclusion_ignores_null_baseline_units(spark):
    src = make_sources(spark)
    solved = src.results.filter((F.col("variant") == "base") & F.col("ok"))
    left = compare.not_in_cohort(compare.variant_slice(src.results, "old"), solved)
    assert {r["unit"] for r in left.collect()} == {"good", "mismatch", "slow", "failed", "alone"}


def test_limits_differ_at_the_bound(spark):
    from runlens.functions.predicates import in_time, timed_out

    row = spark.range(1).select(in_time(F.lit(11.0), 11.0).alias("a"), timed_out(F.lit(11.0), 11.0).alias("b")).first()
    assert row["a"] and row["b"]


def test_plans_have_no_python_and_no_cross_join(spark):
    src = make_sources(spark)
    plan = compare.joined_sources(src, "old", "new")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
    semi = compare.in_cohort(src.stats, src.results)._jdf.queryExecution().toString()
    assert "LeftSemi" in semi
