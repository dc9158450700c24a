"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.ordered import GROUP_LIMIT
from runlens.session import keep

# A list of hot keys is broadcast up to this length; it is far smaller than the rows it comes from.
HOT_LIST = 50_000


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = GROUP_LIMIT) -> DataFrame | None:
    """Keys with more than ``limit`` rows and ``_parts``, the number of shares to cut them into; None if there are none."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    hot = sizes.select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    first = hot.limit(HOT_LIST + 1).collect()
    if not first:
        return None
    if len(first) > HOT_LIST:
        return keep(hot, "hot")
    return F.broadcast(df.sparkSession.createDataFrame(first, hot.schema))


def _parts(df: DataFrame, hot: DataFrame | None, keys: Sequence[str], name: str) -> DataFrame:
    if hot is None:
        return df.withColumn(name, F.lit(1))
    return df.join(hot, keys, "left").withColumn(name, F.coalesce("_parts", F.lit(1))).drop("_parts")


def _share(parts: str) -> Column:
    """A share from the row's number, so that equal rows are spread too."""
    return (F.col("_row") % F.col(parts)).cast("int")


def _every(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def _numbered(df: DataFrame) -> DataFrame:
    """Rows with a number, written so that a task that runs again finds the same one."""
    return keep(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not collect it on the driver.

    The planner goes by the size of files; columns of a few values or of steady steps are many times larger in memory.
    """
    return df.hint("merge")


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", limit: int = GROUP_LIMIT, collected: bool = True
) -> DataFrame:
    """``left.join(right, keys, how)`` for inner, left, left_semi and left_anti.

    Keys with more than ``limit`` rows of one side are cut into shares by the number of the row, and the other side's
    rows of the key are repeated once per share; inner joins do so for both sides. All other keys join as usual.
    Semi- and anti-joins with up to ``HOT_LIST`` distinct keys broadcast those instead.
    Without ``collected`` neither side is broadcast.
    """
    keys = list(keys)
    if how in ("left_semi", "left_anti"):
        # Few keys go to all tasks: the rows of the left side stay where they are.
        right = keep(right.select(*keys).distinct(), "keys")
        if collected and right.count() <= HOT_LIST:
            return left.join(F.broadcast(right), keys, how)
    left_hot = hot_keys(left, keys, limit)
    right_hot = hot_keys(right, keys, limit) if how == "inner" else None
    if left_hot is None and right_hot is None:
        return left.join(right if collected else unbroadcast(right), keys, how)

    def grid(df: DataFrame, own: str, other: str, cut: bool) -> DataFrame:
        df = _parts(_parts(_numbered(df) if cut else df.withColumn("_row", F.lit(0)), left_hot, keys, "_l"), right_hot, keys, "_r")
        df = df.withColumn(f"_share{own}", _share(own)).withColumn(f"_share{other}", _every(other))
        return df.drop("_row", "_l", "_r")

    cut = grid(left, "_l", "_r", left_hot is not None)
    repeated = grid(right, "_r", "_l", right_hot is not None)
    repeated = repeated if collected else unbroadcast(repeated)
    return cut.join(repeated, [*keys, "_share_l", "_share_r"], how).drop("_share_l", "_share_r")
