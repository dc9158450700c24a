"""Benchmark console logs and series texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.ordered import GROUP_LIMIT, fill_forward, scan_groups
from runlens.session import keep as written

# Markers of the console log, term sizes and the two algorithms' labels.
SIZE_MARK = r"term size (0|100)\)"
ALGORITHMS = {"StatefulForward: false": "naive", "StatefulForward: true": "inc"}
# A line of points; one that begins with a space goes on with the line before it.
POINTS_MARK = r"^ ?\([0-9]"
POINT = r"\(([0-9]+), ([^)]*)\)"


def parse_console(
    lines: DataFrame, limit: int = GROUP_LIMIT, size_mark: str = SIZE_MARK, algorithms: dict[str, str] = ALGORITHMS
) -> DataFrame:
    """Points ``path, size, variant, x, y_ms`` of console lines with ``path, block, seq``.

    Size and algorithm carry over from the line that last named them; a title of an unknown size
    keeps the earlier one, and points before any title count for size 0. A later line of points for
    the same size and algorithm replaces an earlier one, together with the lines that go on with it.
    """
    value = F.col("value")
    size = F.when(value.rlike(size_mark), F.regexp_extract(value, size_mark, 1).cast("int"))
    variant = F.coalesce(*[F.when(value.contains(mark), name) for mark, name in algorithms.items()])
    telling = lines.withColumns(
        {"size": size, "variant": variant, "_points": F.when(value.rlike(POINTS_MARK), value)}
    ).filter(F.coalesce(F.col("size").cast("string"), F.col("variant"), F.col("_points")).isNotNull())
    # The lines of points are long: a log's order is found without them.
    telling = written(telling.drop("value").withColumn("_row", F.monotonically_increasing_id()), "console")
    short = telling.withColumn("_begins", ~F.col("_points").startswith(" ")).drop("_points")
    state = fill_forward(short, ["path"], ["block", "seq"], ["size", "variant"], limit)
    state = state.filter(F.col("_begins").isNotNull() & F.col("variant").isNotNull())
    state = state.withColumn("size", F.coalesce("size", F.lit(0)))
    place = F.struct("block", "seq")
    group = ["path", "size", "variant"]
    first = F.when(F.col("_begins"), place)
    heads = state.groupBy(*group).agg(F.max(first).alias("_head"))
    last = state.join(heads, group).filter(F.col("_head").isNull() | (place >= F.col("_head")))
    points = last.select(*group, "_row").join(telling.select("_row", "_points"), "_row")
    return explode_points(points, F.col("_points"), group)


def explode_points(df: DataFrame, text: Column, keep: Sequence[str]) -> DataFrame:
    """Rows ``x, y_ms`` from texts of the form ``(x, y) (x, y)``."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(POINT), F.lit(1)).alias("x"),
        F.regexp_extract_all(text, F.lit(POINT), F.lit(2)).alias("y"),
    )
    return df.select(*keep, F.explode(pairs).alias("_p")).select(
        *keep, F.col("_p.x").cast("bigint").alias("x"), F.col("_p.y").try_cast("double").alias("y_ms")
    )


def series_text(series: DataFrame, keys: Sequence[str], per_line: int = 10_000) -> DataFrame:
    """``(x, y) (x, y) …`` per group in the order of x: keys, ``line``, ``text``.

    A series above ``per_line`` points takes several numbered lines; all but the first begin with a space, by which
    ``parse_console`` puts them together again.
    """
    ones = series.withColumn("_one", F.lit(1).cast("long"))
    placed = scan_groups(ones, keys, ["x", "y_ms"], running={"_n": ("sum", "_one")})
    placed = placed.withColumn("line", F.floor((F.col("_n") - 1) / per_line))
    point = F.struct("_n", F.format_string("(%d, %.6f)", "x", "y_ms").alias("t"))
    points = F.transform(F.sort_array(F.collect_list(point)), lambda p: p["t"])
    text = F.concat(F.when(F.col("line") > 0, " ").otherwise(""), F.array_join(points, " "))
    return placed.groupBy(*keys, "line").agg(text.alias("text"))


def mean_series(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean per (keys, x) of ``ns`` runs: whole nanoseconds first, then milliseconds."""
    means = runs.groupBy(*keys, "x").agg(F.sum("ns").alias("_ns"), F.count("*").alias("_n"))
    return means.select(*keys, "x", (F.expr("_ns div _n") / F.lit(1e6)).alias("y_ms"))
