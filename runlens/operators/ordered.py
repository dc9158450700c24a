"""Operators that need a global or per-group order, without one task for a large group.

Groups of up to ``GROUP_LIMIT`` rows use a plain window. Larger groups are range-partitioned by
(group keys, order columns) and written once with their partition number. A running value is then a
window inside each (partition, group) plus a carry from earlier partitions. Only groups on a
partition border need a carry, so the carry table has at most two rows per partition, whatever the
data size; a group that holds most rows is spread over many partitions. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import keep, tasks_for

SEG = "_seg"
GROUP_LIMIT = 100_000
HASH_BUCKETS = 65_536


def dealt(df: DataFrame, keys: Sequence[str], rows: int | None) -> DataFrame:
    """``df``, in partitions of ``keys`` that grow in number with ``rows``; few rows stay where they are."""
    tasks = tasks_for(df.sparkSession, rows)
    return df.repartition(tasks, *keys) if tasks and keys else df


def ranges(df: DataFrame, order: Sequence[str], rows: int | None = None) -> DataFrame:
    """``df`` in range partitions by ``order``, more than the session's where ``rows`` are many."""
    tasks = tasks_for(df.sparkSession, rows)
    return df.repartitionByRange(*([tasks] if tasks else []), *[F.col(c) for c in order])


def ranged(df: DataFrame, order: Sequence[str], rows: int | None = None) -> DataFrame:
    """``df`` in range partitions by ``order``, with the partition number in ``_seg``; ``rows`` bounds its rows, if known."""
    return keep(ranges(df, order, rows).withColumn(SEG, F.spark_partition_id()), "ranged")


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the keys come from the left."""
    names = {k: f"_right{i}" for i, k in enumerate(keys)}
    right = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in names.items()])
    return left.join(right, on, how).drop(*names.values())


def _fold(fn: str, column: Column, order: Sequence[str]) -> Column:
    if fn == "last":
        return F.max_by(column, F.when(column.isNotNull(), F.struct(*order)))
    return getattr(F, fn)(column)


def _over(fn: str, column: Column, window) -> Column:
    if fn == "last":
        return F.last(column, ignorenulls=True).over(window)
    return getattr(F, fn)(column).over(window)


def _merge(fn: str, local: Column, carry: Column) -> Column:
    if fn == "sum":
        return F.coalesce(local + carry, local, carry)
    if fn == "max":
        return F.greatest(local, carry)
    if fn == "min":
        return F.least(local, carry)
    return F.coalesce(local, carry)


def scan(
    placed: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    running: dict[str, tuple[str, str]] | None = None,
    whole: dict[str, tuple[str, str]] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add running and whole-group values to a ``ranged`` frame.

    ``running`` maps a new column to ``(fn, column)`` with fn in sum, max, min, last (last
    non-null), including the current row. ``whole`` maps a new column to the group's sum, max or
    min. ``order`` must be the columns given to ``ranged`` after ``keys``; ``rows`` bounds the rows.
    """
    running, whole = running or {}, whole or {}
    keys, order = list(keys), list(order)
    steps = {**running, **whole}

    totals = placed
    if keys:
        edges = placed.groupBy(SEG).agg(
            F.min(F.struct(*keys)).alias("_first"), F.max(F.struct(*keys)).alias("_last")
        )
        edges = edges.select(F.explode(F.array("_first", "_last")).alias("_edge")).distinct()
        edges = edges.select("_edge.*")
        totals = match(placed, F.broadcast(edges), keys, "left_semi")
    totals = totals.groupBy(*keys, SEG).agg(
        *[_fold(fn, F.col(c), order).alias(name) for name, (fn, c) in steps.items()]
    )
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SEG)
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*(keys or [F.lit(0)]))
    carry = totals.select(
        *keys,
        SEG,
        *[_over(fn, F.col(name), before).alias(f"_c_{name}") for name, (fn, _) in running.items()],
        *[_over(fn, F.col(name), across).alias(f"_c_{name}") for name, (fn, _) in whole.items()],
    )

    inside = Window.partitionBy(SEG, *keys)
    upto = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt(placed, [SEG, *keys], rows).select(
        "*",
        *[_over(fn, F.col(c), upto).alias(f"_l_{name}") for name, (fn, c) in running.items()],
        *[_over(fn, F.col(c), inside).alias(f"_l_{name}") for name, (fn, c) in whole.items()],
    )
    joined = match(local, F.broadcast(carry), [*keys, SEG], "left")
    return joined.select(
        *placed.columns,
        *[_merge(fn, F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, (fn, _) in running.items()],
        *[F.coalesce(F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n in whole],
    )


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    running: dict[str, tuple[str, str]],
    whole: dict[str, tuple[str, str]],
) -> DataFrame:
    """The values of ``scan`` by plain windows, for groups of bounded size."""
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    upto = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(
        "*",
        *[_over(fn, F.col(c), upto).alias(name) for name, (fn, c) in running.items()],
        *[_over(fn, F.col(c), group).alias(name) for name, (fn, c) in whole.items()],
    )


def _split(df: DataFrame, keys: Sequence[str], limit: int, rows: int | None):
    """``split_large`` and a bound of the number of rows, the one given or one counted."""
    if rows is not None and rows <= limit:
        return df, None, rows
    if not keys:
        rows = df.count() if rows is None else rows
        return (df, None, rows) if rows <= limit else (None, df, rows)
    # A cheap pass first: if no hash bucket is above the limit, no group is.
    buckets = df.groupBy(F.pmod(F.hash(*keys), F.lit(HASH_BUCKETS)).alias("_b")).agg(F.count("*").alias("_rows"))
    most, counted = buckets.agg(F.max("_rows"), F.sum("_rows")).first()
    rows = counted or 0
    if (most or 0) <= limit:
        return dealt(df, keys, rows), None, rows
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > limit)
    large = keep(sizes.select(*keys), "large")
    if large.isEmpty():
        return dealt(df, keys, rows), None, rows
    return dealt(match(df, large, keys, "left_anti"), keys, rows), match(df, large, keys, "left_semi"), rows


def split_large(df: DataFrame, keys: Sequence[str], limit: int = GROUP_LIMIT, rows: int | None = None):
    """``df`` as (rows of groups up to ``limit`` rows or None, rows of larger groups or None).

    ``rows`` is a bound of the number of rows, where the caller knows one.
    """
    return _split(df, keys, limit, rows)[:2]


def scan_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    running: dict[str, tuple[str, str]] | None = None,
    whole: dict[str, tuple[str, str]] | None = None,
    limit: int = GROUP_LIMIT,
    merge: Callable[[DataFrame], DataFrame] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """``scan`` for any frame, choosing per group by its size.

    ``merge`` shrinks the rows of large groups first, for instance to one row per distinct value; it
    keeps the columns. ``rows`` is a bound of the number of rows, if known.
    """
    running, whole = running or {}, whole or {}
    small, large, rows = _split(df, keys, limit, rows)
    parts = []
    if small is not None:
        parts.append(windowed(small, keys, order, running, whole))
    if large is not None:
        placed = ranged(merge(large) if merge else large, [*keys, *order], rows)
        parts.append(scan(placed, keys, order, running, whole, rows).drop(SEG))
    return reduce(DataFrame.unionByName, parts)


def with_index(df: DataFrame, order: Sequence[str], name: str = "idx", limit: int = GROUP_LIMIT) -> DataFrame:
    """Number all rows 0, 1, … in ``order``, which must identify a row."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    out = scan_groups(ones, [], order, running={name: ("sum", "_one")}, limit=limit)
    return out.withColumn(name, F.col(name) - 1).drop("_one")


def value_counts(df: DataFrame, keys: Sequence[str], value: str, n: str | None = None) -> DataFrame:
    """Rows per (keys, value); equal values merge before the shuffle."""
    rows = F.count("*") if n is None else F.sum(n)
    return df.groupBy(*keys, value).agg(rows.alias("n"))


def ranked(
    df: DataFrame, keys: Sequence[str], value: str, limit: int = GROUP_LIMIT, n: str | None = None
) -> DataFrame:
    """``n`` rows of a value, ``upto`` (rows up to here) and the group's ``total``; NULLs left out.

    A value may take several rows in small groups and takes one in large groups. ``n`` names a column
    of row counts; without it each row counts once.
    """
    count = F.lit(1).cast("long") if n is None else F.col(n).cast("long")
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value, count.alias("n"))
    return scan_groups(
        rows,
        keys,
        [value],
        running={"upto": ("sum", "n")},
        whole={"total": ("sum", "n")},
        limit=limit,
        merge=lambda large: value_counts(large, keys, value, "n"),
    )


def cumulative_counts(df: DataFrame, keys: Sequence[str], value: str, limit: int = GROUP_LIMIT) -> DataFrame:
    """The step curve y = number of rows with a value up to x, per group and distinct value."""
    counts = value_counts(df.filter(F.col(value).isNotNull()), keys, value)
    return scan_groups(counts, keys, [value], running={"solved": ("sum", "n")}, limit=limit)


def fill_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], limit: int = GROUP_LIMIT
) -> DataFrame:
    """Replace NULLs by the last non-NULL value before, in ``order`` inside each group.

    ``order`` must identify a row of its group.
    """
    out = scan_groups(df, keys, order, running={f"_f_{c}": ("last", c) for c in columns}, limit=limit)
    return out.select(*[F.col(f"_f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])
