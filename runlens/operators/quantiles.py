"""Exact interpolated percentiles whose state does not grow in one task.

Small groups are ranked by a window. For large groups a mergeable sketch first brackets every wanted
percentile; rows between brackets then only count, so the values that are ranked exactly are a small
share of all. Ranks outside the brackets are noticed, and the group is then ranked in full.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.ordered import GROUP_LIMIT, match, ranked, scan_groups, split_large, windowed
from runlens.session import keep

ACCURACY = 10_000


def at_positions(rows: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Percentiles from rows that carry ``n``, ``upto`` and ``total``; one column per entry of ``probs``.

    Position p·(total−1) is read off the ranks, linear between its two neighbours. Each row only
    contributes where its rank interval covers a position, so the aggregate holds two numbers per
    percentile.
    """
    start = F.col("upto") - F.col("n")
    last = (F.col("total") - 1).cast("double")

    def covers(position: Column) -> Column:
        return (start <= position) & (position < F.col("upto"))

    low = {name: F.floor(F.lit(float(p)) * last) for name, p in probs.items()}
    high = {name: F.ceil(F.lit(float(p)) * last) for name, p in probs.items()}
    aggs = [F.max("total").alias("total")]
    for name in probs:
        aggs.append(F.max(F.when(covers(low[name]), F.col(value))).cast("double").alias(f"_lo_{name}"))
        aggs.append(F.max(F.when(covers(high[name]), F.col(value))).cast("double").alias(f"_hi_{name}"))
    picked = rows.groupBy(*keys).agg(*aggs)
    out = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * last
        share = spot - F.floor(spot)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        # Equal ends need no step; between two infinite ones it would be no number.
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * share).alias(name))
    return picked.select(*keys, "total", *out)


def _bracketed(rows: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], limit: int) -> DataFrame:
    """Percentiles of large groups; NULL where a position fell between the brackets."""
    margin = 2.0 / ACCURACY
    marks = marks_around(probs, margin)
    sketch = F.approx_percentile(value, F.array(*[F.lit(m) for m in marks]), F.lit(ACCURACY))
    found = rows.groupBy(*keys).agg(sketch.alias("_marks"))
    if keys:
        # Written first, so that the planner knows how small it is and need not shuffle the rows.
        marked = match(rows, keep(found, "brackets"), keys)
    else:
        marked = rows.withColumn("_marks", F.array(*[F.lit(m) for m in found.first()["_marks"]]))
    return between_marks(marked, len(marks), keys, value, probs, limit)


def marks_around(probs: dict[str, float], margin: float) -> list[float]:
    """Ranks a margin below and above each wanted one, ascending by the wanted."""
    return [b for p in sorted(set(probs.values())) for b in (max(p - margin, 0.0), min(p + margin, 1.0))]


def between_marks(
    marked: DataFrame, marks: int, keys: Sequence[str], value: str, probs: dict[str, float], limit: int
) -> DataFrame:
    """Percentiles of rows that carry their group's bracket bounds in ``_marks``; NULL where a position fell between brackets."""
    # Even slots lie between brackets, odd slots inside one.
    v, slot = F.col(value), F.lit(marks)
    for i in reversed(range(marks)):
        mark = F.col("_marks")[i]
        slot = F.when(v < mark if i % 2 == 0 else v <= mark, F.lit(i)).otherwise(slot)
    cells = marked.withColumn("_slot", slot)
    cells = cells.withColumn("_v", F.when(F.col("_slot") % 2 == 1, v.cast("double")))
    cells = keep(cells.groupBy(*keys, "_slot", "_v").agg(F.sum("n").alias("n")), "cells")
    ranks = scan_groups(
        cells,
        keys,
        ["_slot", "_v"],
        running={"upto": ("sum", "n")},
        whole={"total": ("sum", "n")},
        limit=limit,
    )
    return at_positions(ranks, keys, "_v", probs)


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    limit: int = GROUP_LIMIT,
    n: str | None = None,
    size: int | None = None,
) -> DataFrame:
    """Exact percentiles of ``value`` per group: keys, ``total``, one column per entry of ``probs``.

    NULLs are left out. ``n`` names a column of row counts, ``size`` is a bound of the number of rows,
    if known. ``df`` is read several times; pass a written frame when it is costly to make.
    """
    rows = _weighted(df, keys, value, n)
    if not keys:
        row = _overall(rows, value, probs, limit, size)
        types = "total bigint, " + ", ".join(f"{name} double" for name in probs)
        return df.sparkSession.createDataFrame([row], types)
    small, large = split_large(rows, keys, limit, size)
    ranks = windowed(small, keys, [value], {"upto": ("sum", "n")}, {"total": ("sum", "n")})
    found = at_positions(ranks, keys, value, probs)
    if large is None:
        return found
    bracketed = keep(_bracketed(large, keys, value, probs, limit), "percentiles")
    missed = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in probs])
    if not bracketed.filter(missed).isEmpty():
        bracketed = at_positions(ranked(large, keys, value, limit, n="n"), keys, value, probs)
    return found.unionByName(bracketed)


def _weighted(df: DataFrame, keys: Sequence[str], value: str, n: str | None) -> DataFrame:
    count = F.lit(1).cast("long") if n is None else F.col(n).cast("long")
    return df.filter(F.col(value).isNotNull()).select(*keys, value, count.alias("n"))


def _overall(rows: DataFrame, value: str, probs: dict[str, float], limit: int, size: int | None):
    """One row of percentiles over all rows."""
    small, large = split_large(rows, [], limit, size)
    if small is not None:
        ranks = windowed(small, [], [value], {"upto": ("sum", "n")}, {"total": ("sum", "n")})
        return at_positions(ranks, [], value, probs).first()
    row = _bracketed(large, [], value, probs, limit).first()
    if any(row[name] is None for name in probs):
        row = at_positions(ranked(large, [], value, limit, n="n"), [], value, probs).first()
    return row


def percentile_numbers(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    limit: int = GROUP_LIMIT,
    n: str | None = None,
    size: int | None = None,
) -> list[float | None]:
    """Overall percentiles as Python numbers, one per entry of ``probs``."""
    named = {f"p{i}": p for i, p in enumerate(probs)}
    row = _overall(_weighted(df, [], value, n), value, named, limit, size)
    return [row[name] for name in named]
