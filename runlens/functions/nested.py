"""Per-row metrics over nested statistics columns; no UDF, no explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _no_nulls(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull())


def rule_count(rules: Column, builder: str = "forward", only_successful: bool = False) -> Column:
    """Number of rule entries made by ``builder``; NULL for a NULL list."""

    def wanted(r: Column) -> Column:
        hit = r["rule"]["builder"] == builder
        return hit & r["successful"] if only_successful else hit

    return F.size(F.filter(rules, wanted))


def max_instantiations(goals: Column) -> Column:
    """Longest instantiation list over all goals, rules and clusters; NULL when there is none.

    NULL lists on the way are passed over.
    """
    per_goal = F.transform(goals, lambda g: g["forwardStateStats"]["ruleStateStats"])
    rules = F.flatten(_no_nulls(per_goal))
    clusters = F.flatten(_no_nulls(F.transform(rules, lambda r: r["clusterStateStats"])))
    return F.array_max(F.transform(clusters, lambda c: F.size(c["instantiationStats"])))


def max_of(goals: Column, field: str) -> Column:
    """Largest value of a number field over the goals."""
    return F.array_max(F.transform(goals, lambda g: g[field]))


def with_metrics(stats: DataFrame, drop_nested: bool = True) -> DataFrame:
    """The five derived metrics of a statistics row.

    The nested columns are dropped, so that later shuffles carry only numbers.
    """
    out = stats.withColumns(
        {
            "forward_success": rule_count(F.col("ruleStats"), only_successful=True),
            "forward_total": rule_count(F.col("ruleStats")),
            "max_instantiations": max_instantiations(F.col("goalStats")),
            "max_depth": max_of(F.col("goalStats"), "depth"),
            "max_lctx_size": max_of(F.col("goalStats"), "lctxSize"),
        }
    )
    return out.drop("ruleStats", "goalStats") if drop_nested else out
