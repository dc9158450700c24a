"""Cleaning of repeated runs: stability, median value, median run, exclusion report.

Runs have columns ``variant``, ``unit``, ``value`` and ``ok``. Statistics combine before the shuffle,
and ordering inside a unit goes through ``ordered.scan_groups``; so one unit may hold any share of
all runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.numeric import percent, round_half_even
from runlens.functions.predicates import Limits, straddles, too_spread
from runlens.operators.ordered import GROUP_LIMIT, scan_groups
from runlens.operators.quantiles import at_positions

GROUP = ["variant", "unit"]


def dataset_stats(runs: DataFrame) -> DataFrame:
    """Rows and distinct units of a run table."""
    return runs.agg(F.count("*").alias("total_rows"), F.countDistinct("unit").alias("unique_units"))


def _ranked_runs(runs: DataFrame, by: Sequence[str], whole: dict, limit: int) -> DataFrame:
    """Runs with place ``rn`` by ``by`` inside (variant, unit), NULLs last, and whole-group values.

    Full ties get some order of their own, so that they too spread over partitions.
    """
    nulls = {f"_n{i}": F.col(c).isNull() for i, c in enumerate(by)}
    order = [x for pair in zip(nulls, by) for x in pair] + ["_tie"]
    rows = runs.withColumns({**nulls, "_one": F.lit(1).cast("long"), "_tie": F.monotonically_increasing_id()})
    out = scan_groups(
        rows, GROUP, order, running={"rn": ("sum", "_one")}, whole={"cnt": ("sum", "_one"), **whole}, limit=limit
    )
    return out.drop(*nulls, "_one", "_tie")


def with_run_ranks(
    runs: DataFrame, by: Sequence[str] = ("value",), limit: int = GROUP_LIMIT
) -> DataFrame:
    """Runs with ``rn``, their place by ``by`` inside (variant, unit) with NULLs last, and ``cnt``.

    ``by`` should end in columns that identify a run, so that places are repeatable.
    """
    return _ranked_runs(runs, by, {}, limit)


def group_stats(runs: DataFrame) -> DataFrame:
    """Per (variant, unit): number of runs, lowest and highest value and outcome."""
    return runs.groupBy(*GROUP).agg(
        F.count("*").alias("runs"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.min("ok").alias("ok_low"),
        F.max("ok").alias("ok_high"),
    )


def is_stable(limits: Limits) -> Column:
    """Over ``group_stats`` columns: one outcome, same side of the timeout, small spread."""
    return (
        (F.col("ok_low") == F.col("ok_high"))
        & ~straddles(F.col("low"), F.col("high"), limits.timeout)
        & ~too_spread(F.col("low"), F.col("high"), limits.spread)
    )


def stable_groups(runs: DataFrame, limits: Limits) -> DataFrame:
    """The stability filter: (variant, unit) groups whose runs agree, with their statistics."""
    return group_stats(runs).filter(is_stable(limits))


_BOUNDS = {
    "low": ("min", "value"),
    "high": ("max", "value"),
    "ok_low": ("min", "ok"),
    "ok_high": ("max", "ok"),
}


def median_values(
    runs: DataFrame, limits: Limits, whole_number: bool = True, limit: int = GROUP_LIMIT
) -> DataFrame:
    """One row per stable group: ``variant, unit, ok, value`` with the interpolated median.

    ``whole_number`` rounds the median to an integer, halves to even. Runs without a value count for
    the outcome only.
    """
    cells = runs.select(
        *GROUP,
        "value",
        F.col("value").isNull().alias("_null"),
        F.col("ok").alias("_ok_low"),
        F.col("ok").alias("_ok_high"),
        F.when(F.col("value").isNotNull(), 1).otherwise(0).cast("long").alias("n"),
    )

    def merge(large: DataFrame) -> DataFrame:
        merged = large.groupBy(*GROUP, "value", "_null").agg(
            F.min("_ok_low").alias("_ok_low"), F.max("_ok_high").alias("_ok_high"), F.sum("n").alias("n")
        )
        return merged.select(*cells.columns)

    ranks = scan_groups(
        cells,
        GROUP,
        ["_null", "value"],
        running={"upto": ("sum", "n")},
        whole={
            "total": ("sum", "n"),
            "low": ("min", "value"),
            "high": ("max", "value"),
            "ok_low": ("min", "_ok_low"),
            "ok_high": ("max", "_ok_high"),
        },
        limit=limit,
        merge=merge,
    )
    ranks = ranks.filter(is_stable(limits) & ~F.col("_null"))
    keys = [*GROUP, "ok_low"]
    med = at_positions(ranks, keys, "value", {"median": 0.5})
    value = round_half_even(F.col("median")) if whole_number else F.col("median")
    return med.select(*GROUP, F.col("ok_low").alias("ok"), value.alias("value"))


def median_runs(
    runs: DataFrame, limits: Limits, tie_break: Sequence[str], even: str = "drop", limit: int = GROUP_LIMIT
) -> DataFrame:
    """The whole run row at the median place of each stable group.

    Of n runs this is place (n+1)/2 by value, then by ``tie_break``; groups of even size have no such
    place and are dropped, or take the lower middle run with ``even="lower"``. Derive metrics from
    nested columns before, so that only narrow rows are ordered.
    """
    if even not in ("drop", "lower"):
        raise ValueError("even must be 'drop' or 'lower'")
    ranks = _ranked_runs(runs, ["value", *tie_break], _BOUNDS, limit)
    here = F.col("rn") == F.floor((F.col("cnt") + 1) / 2)
    if even == "drop":
        here = here & (F.col("cnt") % 2 == 1)
    return ranks.filter(is_stable(limits) & here).select(*runs.columns)


def exclusion_report(runs: DataFrame, limits: Limits, kept: DataFrame | None = None) -> DataFrame:
    """Per variant: raw, kept and excluded units, and units per reason of exclusion.

    The reasons ``outcome`` and ``timeout`` may overlap; ``spread`` excludes both. ``kept`` is the
    cleaned frame to count; without it the stable groups count as kept.
    """
    outcome = F.col("ok_low") != F.col("ok_high")
    timeout = straddles(F.col("low"), F.col("high"), limits.timeout)
    spread = too_spread(F.col("low"), F.col("high"), limits.spread) & ~outcome & ~timeout
    report = group_stats(runs).groupBy("variant").agg(
        F.count("unit").alias("raw"),
        F.count_if(is_stable(limits)).alias("stable"),
        F.count_if(outcome).alias("outcome"),
        F.count_if(timeout).alias("timeout"),
        F.count_if(spread).alias("spread"),
    )
    if kept is not None:
        counts = kept.groupBy("variant").agg(F.count("*").alias("_kept"))
        report = report.join(counts, "variant", "left").withColumn(
            "stable", F.coalesce(F.col("_kept"), F.lit(0))
        )
    excluded = F.col("raw") - F.col("stable")
    return report.select(
        "variant",
        "raw",
        F.col("stable").alias("kept"),
        excluded.alias("excluded"),
        percent(excluded, F.col("raw")).alias("excluded_pct"),
        "outcome",
        percent(F.col("outcome"), F.col("raw")).alias("outcome_pct"),
        "timeout",
        percent(F.col("timeout"), F.col("raw")).alias("timeout_pct"),
        "spread",
        percent(F.col("spread"), F.col("raw")).alias("spread_pct"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once; empty for a unique key."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself, or an error when ``keys`` repeat."""
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"duplicate values in key {list(keys)}")
    return df
