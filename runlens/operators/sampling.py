"""First rows and samples of exact size."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.ordered import GROUP_LIMIT, with_index


def draw(key: Column, seed: int) -> Column:
    """A hash of key and seed, the same in every run and on every machine."""
    return F.md5(F.concat_ws("#", key.cast("string"), F.lit(str(seed))))


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key."""
    return _lowest(df, [key], n)


def _lowest(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n lowest rows; a small n keeps n rows per task, a larger one numbers all rows."""
    if n <= GROUP_LIMIT:
        return df.orderBy(*order).limit(n)
    return with_index(df, order, "_place").filter(F.col("_place") < n).drop("_place")


def sample(df: DataFrame, key: str, n: int, seed: int | None = None) -> DataFrame:
    """n different rows (all rows, if fewer), the same for the same seed; a random seed by default."""
    seed = secrets.randbits(62) if seed is None else seed
    return _lowest(df.withColumn("_draw", draw(F.col(key), seed)), ["_draw", key], n).drop("_draw")


def sample_with_replacement(df: DataFrame, key: str, n: int, seed: int | None = None) -> DataFrame:
    """n draws of any row: ``draw`` 0 … n−1 and the drawn row."""
    seed = secrets.randbits(62) if seed is None else seed
    rows = df.count()
    if rows == 0:
        return df.limit(0).select(F.lit(0).cast("bigint").alias("draw"), "*")
    spot = F.conv(F.substring(draw(F.col("id"), seed), 1, 15), 16, 10).cast("bigint") % rows
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), spot.alias("_place"))
    return draws.join(with_index(df, [key], "_place"), "_place").drop("_place")
