"""The driver's tables seen as runs, statistics, facts and catalogues.

Each view has a Spark form and the same view as SQL text, used as a CTE by the queries' SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.predicates import Limits
from runlens.operators.clean import median_runs, median_values
from runlens.operators.compare import Sources
from runlens.session import keep_bucketed

RESULTS_LIMITS = Limits(timeout=45.0, spread=3.0)
STATS_LIMITS = Limits(timeout=60000.0, spread=3.0)
OLD, NEW, BASE = "A", "R", "N"
TIES = ["run", "payload"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def result_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("variant"),
        F.col("l_orderkey").alias("unit"),
        (F.col("l_linestatus") == "F").alias("ok"),
        F.col("l_quantity").alias("value"),
    )


RESULT_RUNS = """result_runs AS (
  SELECT l_returnflag AS variant, l_orderkey AS unit, l_linestatus = 'F' AS ok, l_quantity AS value
  FROM lineitem)"""


def stats_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second source; counts per run stand for the nested metrics."""
    line = table(spark, sf_dir, "lineitem")
    depth = F.col("l_suppkey") % 25
    return line.select(
        F.col("l_returnflag").alias("variant"),
        F.col("l_orderkey").alias("unit"),
        (F.col("l_linestatus") == "F").alias("ok"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_linenumber").alias("run"),
        F.col("l_partkey").alias("payload"),
        (F.col("l_quantity").cast("int") % 7).alias("forward_success"),
        F.col("l_quantity").cast("int").alias("forward_total"),
        F.when(depth > 0, depth).cast("int").alias("max_depth"),
    )


STATS_RUNS = """stats_runs AS (
  SELECT l_returnflag AS variant, l_orderkey AS unit, l_linestatus = 'F' AS ok, l_extendedprice AS value,
    l_linenumber AS run, l_partkey AS payload,
    CAST(l_quantity AS INTEGER) % 7 AS forward_success, CAST(l_quantity AS INTEGER) AS forward_total,
    CASE WHEN l_suppkey % 25 > 0 THEN CAST(l_suppkey % 25 AS INTEGER) END AS max_depth
  FROM lineitem)"""

STABLE = """HAVING min(ok) = max(ok)
    AND NOT (min(value) <= {timeout} AND max(value) > {timeout})
    AND max(value)::DOUBLE / min(value) <= {spread}"""
RESULTS_STABLE = STABLE.format(timeout=45, spread=3)
STATS_STABLE = STABLE.format(timeout=60000, spread=3)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return median_values(result_runs(spark, sf_dir), RESULTS_LIMITS)


RESULTS = f"""{RESULT_RUNS},
results AS (
  SELECT variant, unit, first(ok) AS ok,
    CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY value) AS INTEGER) AS value
  FROM result_runs GROUP BY variant, unit {RESULTS_STABLE})"""


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return median_runs(stats_runs(spark, sf_dir), STATS_LIMITS, TIES)


STATS = f"""{STATS_RUNS},
stats_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY variant, unit ORDER BY value, run, payload) AS rn,
    count(*) OVER (PARTITION BY variant, unit) AS cnt
  FROM stats_runs),
stats AS (
  SELECT * EXCLUDE (rn, cnt) FROM stats_ranked WHERE rn = (cnt + 1) / 2 AND (variant, unit) IN (
    SELECT variant, unit FROM stats_runs GROUP BY variant, unit {STATS_STABLE}))"""


def sources(spark: SparkSession, sf_dir: str) -> Sources:
    rows = table(spark, sf_dir, "lineitem").count()
    return Sources(
        results=keep_bucketed(results(spark, sf_dir), "results", "unit", by=["variant"], rows=rows),
        stats=keep_bucketed(stats(spark, sf_dir), "stats", "unit", by=["variant"], rows=rows),
        results_limits=RESULTS_LIMITS,
        stats_limits=STATS_LIMITS,
        baseline=BASE,
        rows=rows,
    )


JOINED = f"""{RESULTS}, {STATS},
joined AS (
  SELECT o.unit, o.ok AS old_ok, o.value AS old_value, n.ok AS new_ok, n.value AS new_value,
    ao.value AS old_stats_value, an.value AS new_stats_value,
    o.unit IN (SELECT unit FROM results WHERE variant = 'N' AND ok) AS trivial
  FROM (SELECT * FROM results WHERE variant = 'A') o
  JOIN (SELECT * FROM results WHERE variant = 'R') n ON o.unit = n.unit
  JOIN (SELECT * FROM stats WHERE variant = 'A') ao ON o.unit = ao.unit
  JOIN (SELECT * FROM stats WHERE variant = 'R') an ON n.unit = an.unit)"""

IN_TIME = "old_value <= 45 AND new_value <= 45 AND old_stats_value <= 60000 AND new_stats_value <= 60000"

COHORT = f"""{JOINED},
cohort AS (SELECT unit FROM joined WHERE {IN_TIME} AND old_ok = new_ok)"""
