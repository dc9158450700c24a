"""A stored closure that takes inserted and deleted facts without starting again.

Deleting takes out every fact that some chain through a deleted one gives, and derives again those that another chain
still gives; inserting joins only what is new.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.fixpoint import _compose, closure
from runlens.operators.ordered import GROUP_LIMIT
from runlens.session import keep


@dataclass(frozen=True)
class Closed:
    """Given facts and all that follow from them by transitivity, both ``keys, src, dst`` without repeats."""

    given: DataFrame
    closed: DataFrame
    keys: tuple[str, ...] = ()

    def write(self, path: str) -> None:
        """Two Parquet tables below ``path``, which must be new: a failed run leaves the old state whole."""
        self.given.write.parquet(f"{path}/given")
        self.closed.write.parquet(f"{path}/closed")


def read_closed(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> Closed:
    return Closed(spark.read.parquet(f"{path}/given"), spark.read.parquet(f"{path}/closed"), tuple(keys))


def closed_under(facts: DataFrame, keys: Sequence[str] = (), limit: int = GROUP_LIMIT) -> Closed:
    """The closure of ``facts`` from the start."""
    given = keep(_facts(facts, keys), "given")
    return Closed(given, keep(closure(given, keys, limit=limit).drop("round"), "closed"), tuple(keys))


def _facts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct facts; one without start or end joins nothing and is none."""
    return df.select(*keys, "src", "dst").dropna(subset=[*keys, "src", "dst"]).distinct()


def _grow(known: DataFrame, delta: DataFrame, keys: Sequence[str], limit: int, within: DataFrame | None = None) -> DataFrame:
    """``known`` and ``delta`` with all that follows; new facts other than ``delta`` lie in ``within``, if given.

    Each round joins only the last round's facts, on both sides, so chains double and the rounds grow with the logarithm
    of their length.
    """
    fact = [*keys, "src", "dst"]
    tables, delta = [known], keep(delta, "delta")
    rows, new = known.count(), delta.count()
    while new:
        tables.append(delta)
        rows += new
        every = reduce(DataFrame.unionByName, tables)
        met = _compose(every, delta, keys, limit, rows).unionByName(_compose(delta, every, keys, limit, rows)).distinct()
        if within is not None:
            met = met.join(within, fact, "left_semi")
        delta = keep(met.join(every, fact, "left_anti"), "delta")
        new = delta.count()
    return reduce(DataFrame.unionByName, tables)


def _through(state: Closed, lost: DataFrame, limit: int, rows: int) -> DataFrame:
    """Facts of the closure with a chain that holds one of ``lost``."""
    keys = state.keys
    heads = keep(lost.unionByName(_compose(state.closed, lost, keys, limit, rows)).distinct(), "heads")
    return keep(heads.unionByName(_compose(heads, state.closed, keys, limit, rows)).distinct(), "doubted")


def changed(state: Closed, inserted: DataFrame, deleted: DataFrame, limit: int = GROUP_LIMIT) -> Closed:
    """``state`` after ``deleted`` facts left and ``inserted`` ones came; a fact in both stays.

    Facts that were not given cannot be deleted, whether they follow or not; facts already given change nothing.
    Every step is written once, and a change costs in proportion to the facts whose chains it touches.
    """
    keys, fact = state.keys, [*state.keys, "src", "dst"]
    new = keep(_facts(inserted, keys), "inserted")
    lost = _facts(deleted, keys).join(new, fact, "left_anti").join(state.given, fact, "left_semi")
    lost = keep(lost, "deleted")
    given = keep(state.given.join(lost, fact, "left_anti").unionByName(new).distinct(), "given")
    closed = state.closed
    if not lost.isEmpty():
        rows = closed.count()
        doubted = _through(state, lost, limit, rows)
        sure = keep(closed.join(doubted, fact, "left_anti"), "sure")
        # Doubted facts that are given, or follow from a given one and a sure one; the rest follows from these.
        direct = doubted.join(given, fact, "left_semi")
        step = _compose(given, sure, keys, limit, rows).join(doubted, fact, "left_semi")
        closed = keep(_grow(sure, direct.unionByName(step).distinct(), keys, limit, doubted), "closed")
    fresh = new.join(closed, fact, "left_anti")
    return Closed(given, keep(_grow(closed, fresh, keys, limit), "closed"), keys)


def given_count(state: Closed) -> DataFrame:
    """``given, derived`` per key: facts of the state that were given, and the others."""
    mark = state.closed.join(state.given.withColumn("_given", F.lit(True)), [*state.keys, "src", "dst"], "left")
    return mark.groupBy(*state.keys).agg(
        F.count("_given").alias("given"), F.count_if(F.col("_given").isNull()).alias("derived")
    )
