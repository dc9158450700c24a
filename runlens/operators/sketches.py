"""Stored quantile sketches per group and day, merged on reading, as brackets of exact percentiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.ordered import GROUP_LIMIT, match
from runlens.operators.quantiles import between_marks, marks_around, percentiles
from runlens.session import keep

# Size of a sketch, and how far in rank its answers may lie off: the published bound of such sketches for this size is
# 0.13 %, taken three times as merged ones answer for many days.
K = 4000
MARGIN = 0.004


def add_days(rows: DataFrame, store: str, keys: Sequence[str], day: str, value: str, k: int = K) -> None:
    """Sketch ``value`` of the new days' ``rows`` into the table at ``store``, a folder per day.

    Days of ``rows`` that the store has are replaced, so a run that is repeated changes nothing; other days are neither
    read nor written. Sketches are built before the shuffle, so a hot group sends one per task. NULL and NaN are left out;
    a group without other values has an empty sketch.
    """
    v = F.col(value).cast("double")
    sketch = F.kll_sketch_agg_double(F.when(~F.isnan(v), v), F.lit(k))
    days = rows.groupBy(*keys, day).agg(sketch.alias("sketch"))
    writer = days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    writer.partitionBy(day).parquet(store)


def merged(spark: SparkSession, store: str, keys: Sequence[str], k: int = K) -> DataFrame:
    """One sketch per group, ``keys, sketch``, of all days of the store."""
    return spark.read.parquet(store).groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def approximate(spark: SparkSession, store: str, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Keys, ``total`` and near percentiles from the sketches alone; NULL for groups without values."""
    found = merged(spark, store, keys).withColumn("total", F.kll_sketch_get_n_double("sketch"))
    marks = F.when(F.col("total") > 0, F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p) for p in probs.values()])))
    found = found.withColumn("_q", marks)
    return found.select(*keys, "total", *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(probs)])


def stored_percentiles(
    rows: DataFrame, store: str, keys: Sequence[str], value: str, probs: dict[str, float], limit: int = GROUP_LIMIT
) -> DataFrame:
    """``quantiles.percentiles`` of all days' ``rows`` per group, bracketed by the store's sketches.

    ``rows`` are read once for all groups, however large: values outside the brackets only count. The result is exact
    whatever the store holds: a group that it lacks, or whose ranks fall outside its brackets because the store is behind,
    takes the plain way.
    """
    spark = rows.sparkSession
    wanted = marks_around(probs, MARGIN)
    found = merged(spark, store, keys)
    ranks = F.array(*[F.lit(float(m)) for m in wanted])
    marks = F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", ranks))
    brackets = keep(found.select(*keys, marks.alias("_marks")), "brackets")
    counted = rows.filter(F.col(value).isNotNull()).select(*keys, value, F.lit(1).cast("long").alias("n"))
    marked = match(counted, brackets, keys, "left")
    out = keep(between_marks(marked, len(wanted), keys, value, probs, limit), "percentiles")
    missed = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in probs])
    again = keep(out.filter(missed).select(*keys), "missed")
    if again.isEmpty():
        return out
    left = match(rows, again, keys, "left_semi") if keys else rows
    return out.filter(~missed).unionByName(percentiles(left, keys, value, probs, limit))
