"""Scaling runs of the fixpoint workloads: both algorithms over a grid of sizes."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from runlens.operators.fixpoint import chain_facts, closure, closure_naive, depth_facts, match_depth

# Sizes of the two workloads, iterations per size, premises and rules of the second.
POWERS = [1, 2, 4, 8]
STEPS = [1, 2, 3, 4, 5]
ITERATIONS = 10
PREMISES = 6


def closed_form(n: int) -> int:
    """Facts that a chain of n facts adds."""
    return n * (n - 1) // 2


def transitivity(spark: SparkSession, n: int, start: int, incremental: bool) -> DataFrame:
    """The closure of one chain of n facts."""
    specs = spark.createDataFrame([(0, n, start)], "chain int, n bigint, start bigint")
    facts = chain_facts(specs, ["chain"])
    return closure(facts, ["chain"]).drop("round") if incremental else closure_naive(facts, ["chain"])


def partial_match(spark: SparkSession, depth: int, a: int, premises: int = PREMISES, inert: int = 0) -> DataFrame:
    """Match depth of a rule whose premise fails after ``depth`` slots."""
    specs = spark.createDataFrame(
        [(0, premises, inert, depth, a)], "case int, premises int, inert int, depth int, a bigint"
    )
    return match_depth(depth_facts(specs, ["case"]), ["case", "n"], [f"P{i}" for i in range(premises)])


def timed(
    spark: SparkSession,
    workload: str,
    variant: str,
    sizes: Sequence[int],
    iterations: int,
    make: Callable[[int], DataFrame],
) -> DataFrame:
    """Run ``make`` for every size and iteration to its end: ``workload, variant, x, iter, ns``."""
    rows = []
    for x in sizes:
        for i in range(iterations):
            start = time.perf_counter_ns()
            make(x).write.format("noop").mode("overwrite").save()
            rows.append((workload, variant, x, i, time.perf_counter_ns() - start))
    return spark.createDataFrame(rows, "workload string, variant string, x bigint, iter int, ns bigint")
