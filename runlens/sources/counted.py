"""Counters taken in the pass that writes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from runlens.sources.results import runs_of
from runlens.sources.stats import BROKEN, good_rows, write_table

OUTCOMES = ["ok", "no_match", "wrong_length", "misformatted_result"]


def write_counted(
    df: DataFrame, counters: dict[str, Column], chosen: Callable[[DataFrame], DataFrame], path: str, by: Sequence[str] = ()
) -> dict[str, int]:
    """Write ``chosen(df)`` to ``path`` and count over all of ``df`` in the same pass.

    ``chosen`` must not shuffle (filters, columns, explode): counters then belong to the writing tasks, of which each
    counts once, also when lost ones run again.
    """
    seen = Observation()
    observed = df.observe(seen, *[c.alias(name) for name, c in counters.items()])
    write_table(chosen(observed), path, by)
    return seen.get


def write_good_rows(stats: DataFrame, path: str, by: Sequence[str] = ()) -> dict[str, int]:
    """Write the decoded rows; ``rows`` and ``errors`` as ``load_totals`` counts them."""
    counters = {"rows": F.count_if(F.col(BROKEN).isNull()), "errors": F.count_if(F.col(BROKEN).isNotNull())}
    return write_counted(stats, counters, good_rows, path, by)


def write_runs(parsed: DataFrame, variants: Sequence[str], path: str, by: Sequence[str] = (), drop_line: bool = False) -> dict[str, int]:
    """Write the runs of parsed result lines; number of lines per outcome."""
    counters = {o: F.count_if(F.col("outcome") == o) for o in OUTCOMES}
    return write_counted(parsed, counters, lambda df: runs_of(df, variants, drop_line), path, by)
