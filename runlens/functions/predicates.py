"""Row predicates over runs and pairs, and a builder that joins the wanted ones."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.numeric import ratio


@dataclass(frozen=True)
class Limits:
    """Cleaning limits of one source: run-time limit and highest allowed max/min."""

    timeout: float
    spread: float = 1.2


# 11 s run-time limit, in milliseconds and nanoseconds.
MS_LIMITS = Limits(timeout=11e3)
NS_LIMITS = Limits(timeout=11e9)


def all_of(conditions: Iterable[Column]) -> Column:
    """AND of the conditions; true when there are none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def in_time(value: Column, timeout: float) -> Column:
    return value <= F.lit(timeout)


def timed_out(value: Column, timeout: float) -> Column:
    """Counted as timed out; unlike ``in_time`` the limit itself counts as out."""
    return value >= F.lit(timeout)


def straddles(low: Column, high: Column, timeout: float) -> Column:
    """Some runs end in time and some do not."""
    return (low <= F.lit(timeout)) & (high > F.lit(timeout))


def too_spread(low: Column, high: Column, spread: float) -> Column:
    """max/min above ``spread``; a zero minimum is always too spread, 0/0 included."""
    return ratio(high, low) > F.lit(spread)


def agree(old_ok: Column, new_ok: Column) -> Column:
    return old_ok == new_ok


def both(old_ok: Column, new_ok: Column) -> Column:
    return old_ok & new_ok


def slower(old: Column, new: Column, factor: float = 1.5, at_least: float = 50e6) -> Column:
    """The new side takes more than ``factor`` times the old and at least ``at_least``."""
    return (new > old * F.lit(factor)) & (new >= F.lit(at_least))


def many(count: Column, at_least: int = 20) -> Column:
    return count >= F.lit(at_least)
