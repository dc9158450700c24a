"""Distribution summaries of one or more number columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.numeric import ratio
from runlens.operators.ordered import GROUP_LIMIT, match
from runlens.operators.quantiles import percentiles

# The percentiles each report states.
PAIRED = {"p01": 0.01, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p99": 0.99}
COUNTS = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def unpivot(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, metric, value), one per column."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("_m")).select(*keys, "_m.*")


def describe(
    df: DataFrame,
    columns: Sequence[str],
    probs: dict[str, float],
    keys: Sequence[str] = (),
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """One row per (keys, metric): count, mean, lowest, highest and percentiles; NULLs left out.

    All columns are summarised together. ``df`` is read several times; pass a written frame when it is
    costly to make.
    """
    by = [*keys, "metric"]
    rows = unpivot(df, columns, keys).filter(F.col("value").isNotNull())
    shape = rows.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.avg("value").alias("avg"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    found = percentiles(rows, by, "value", probs, limit).drop("total")
    return match(shape, found, by)


def paired_summary(pairs: DataFrame, old: str, new: str, probs: dict[str, float] = PAIRED) -> DataFrame:
    """One row per statistic: old, new, difference old − new and ratio old / new."""
    table = describe(pairs, [old, new], probs)
    names = ["min", *probs, "avg", "max"]
    long = table.select(
        "metric",
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("v")) for s in names])
        ).alias("_s"),
    )
    wide = long.groupBy(F.col("_s.statistic").alias("statistic")).agg(
        F.max(F.when(F.col("metric") == old, F.col("_s.v"))).alias("old"),
        F.max(F.when(F.col("metric") == new, F.col("_s.v"))).alias("new"),
    )
    return wide.withColumns(
        {"difference": F.col("old") - F.col("new"), "speedup": ratio(F.col("old"), F.col("new"))}
    )


def column_summary(df: DataFrame, column: str, probs: dict[str, float], empty_as_zero: bool = False) -> DataFrame:
    """One row of count, min, percentiles, max and mean, also for a column of NULLs only.

    ``empty_as_zero`` gives min and max 0 when there is no value.
    """
    found = describe(df, [column], probs)
    out = found.agg(
        F.coalesce(F.max("rows"), F.lit(0)).alias("rows"),
        *[F.max(c).alias(c) for c in ("min", *probs, "max", "avg")],
    )
    if empty_as_zero:
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("min", "max")})
    return out
