"""Whole analyses: the matrix of comparisons and the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.cleaning import EXCLUSIONS
from checks.cleaning import SQL as CLEANING_SQL
from checks.comparing import SQL as COMPARING_SQL
from checks.comparing import statistics_sql
from checks.registry import registry
from runlens.operators import summary
from runlens.plans import comparison, reports
from runlens.sources.report import report_text

QUERIES, SQL, query = registry()


def rounded_values(df):
    return df.withColumn("value", F.round("value", 6))


def tidy_sql(section, sql, metrics, key="'all'"):
    """The rows of ``tidy`` for a wide SQL result."""
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, CAST({key} AS VARCHAR) AS key, '{m}' AS metric, round(CAST({m} AS DOUBLE), 6) AS value FROM ({sql})"
        for m in metrics
    )


def sources(spark, sf):
    return comparison.clean_sources(
        t.result_runs(spark, sf), t.stats_runs(spark, sf), t.TIES, t.BASE,
        results_limits=t.RESULTS_LIMITS, stats_limits=t.STATS_LIMITS,
    )


FUNNEL_METRICS = ["base"] + [
    f"{n}{s}"
    for s in ("", "_pct")
    for n in ["without_in_time", "without_same_outcome", "without_both_ok", "without_nontrivial", "included"]
]
MATRIX = {
    "search-in_time-same_outcome": "funnel_all",
    "search-in_time-same_outcome-both_ok": "funnel_both_ok",
    "search-in_time-same_outcome-nontrivial": "funnel_nontrivial",
    "search-in_time-same_outcome-both_ok-nontrivial": "funnel_both_ok_nontrivial",
}


@query(
    "analysis_matrix",
    " UNION ALL ".join(
        f"SELECT '{label}' AS analysis, * FROM ({tidy_sql('funnel', COMPARING_SQL[name], FUNNEL_METRICS)})"
        for label, name in MATRIX.items()
    ),
)
def analysis_matrix(spark, sf):
    src = sources(spark, sf)
    outcomes = comparison.run_matrix(src, comparison.matrix(src, (t.OLD, t.NEW), None), LIMITS)
    return rounded_values(comparison.matrix_report(outcomes).filter(F.col("section") == "funnel"))


LIMITS = comparison.Thresholds(at_least=20000.0)
SIDES = ["old", "new", "difference", "speedup"]
OLD_DEPTH = f"""WITH {t.COHORT}, pairs AS (SELECT max_depth FROM stats WHERE variant = 'A' AND unit IN (SELECT unit FROM cohort)) """
FULL = [
    tidy_sql("funnel", COMPARING_SQL["funnel_all"], FUNNEL_METRICS),
    tidy_sql(
        "solved",
        "SELECT max(solved) FILTER (variant = 'A') AS old, max(solved) FILTER (variant = 'R') AS new "
        f"FROM ({COMPARING_SQL['solved_counts']})",
        ["old", "new"],
    ),
    tidy_sql("stats_values", COMPARING_SQL["stats_summary"], SIDES, "statistic"),
    tidy_sql("results_values", COMPARING_SQL["results_summary"], SIDES, "statistic"),
    tidy_sql(
        "max_depth",
        OLD_DEPTH + statistics_sql("pairs", ["max_depth"], summary.PAIRED),
        ["rows", "min", *summary.PAIRED, "max", "avg"],
    ),
]


@query("full_report", "SELECT 'search-in_time-same_outcome' AS analysis, * FROM (" + " UNION ALL ".join(FULL) + ")")
def full_report(spark, sf):
    src = sources(spark, sf)
    outcome = comparison.run(src, comparison.Analysis("search", t.OLD, t.NEW), LIMITS)
    return rounded_values(outcome.report())


EXCLUSION_METRICS = ["raw", "kept", "excluded", "excluded_pct", "outcome", "outcome_pct", "timeout", "timeout_pct", "spread", "spread_pct"]
# The statistics keep odd groups only, so their kept units are counted from the cleaned rows.
STATS_EXCLUSIONS = f"""SELECT e.variant, raw, s.kept, raw - s.kept AS excluded, (raw - s.kept) / raw * 100 AS excluded_pct,
  outcome, outcome_pct, timeout, timeout_pct, spread, spread_pct
  FROM ({EXCLUSIONS.format(runs=t.STATS_RUNS, name="stats_runs", timeout=60000, spread=3)}) e
  JOIN (WITH {t.STATS} SELECT variant, count(*) AS kept FROM stats GROUP BY variant) s ON e.variant = s.variant"""


@query(
    "cleaning_report",
    tidy_sql("exclusions/results", CLEANING_SQL["exclusion_report"], EXCLUSION_METRICS, "variant")
    + " UNION ALL "
    + tidy_sql("exclusions/stats", STATS_EXCLUSIONS, EXCLUSION_METRICS, "variant"),
)
def cleaning_report(spark, sf):
    src = sources(spark, sf)
    return rounded_values(reports.cleaning_report(t.result_runs(spark, sf), t.stats_runs(spark, sf), src))


@query(
    "sanity_report",
    tidy_sql("coverage", COMPARING_SQL["coverage"], ["successful", "in_stats", "in_stats_pct"], "variant")
    + " UNION ALL "
    + tidy_sql(
        "timeouts",
        COMPARING_SQL["timeout_prevalence"],
        ["over_results", "over_stats", "total", "over_results_pct", "over_stats_pct"],
        "variant",
    ),
)
def sanity_report(spark, sf):
    rows = reports.sanity_report(sources(spark, sf))
    return rounded_values(rows.filter(~F.col("section").startswith("mean_difference")))


def thousandths(sql):
    return f"SELECT section, key, metric, round(value, 3) AS value FROM ({sql})"


@query(
    "sanity_report_whole",
    thousandths(
        SQL["sanity_report"]
        + "".join(
            " UNION ALL "
            + tidy_sql(f"mean_difference/{section}", COMPARING_SQL[name], ["avg_results", "avg_stats", "abs_diff", "rel_diff"], "variant")
            for section, name in (("all", "mean_difference"), ("ok", "mean_difference_ok"))
        )
    ),
)
def sanity_report_whole(spark, sf):
    return reports.sanity_report(sources(spark, sf)).withColumn("value", F.round("value", 3))


@query(
    "report_lines",
    """SELECT 'size/results: all: total_rows: ' || printf('%.2f', CAST(count(*) AS DOUBLE)) AS value FROM lineitem
    UNION ALL SELECT 'size/results: all: unique_units: ' || printf('%.2f', CAST(count(DISTINCT l_orderkey) AS DOUBLE)) FROM lineitem
    UNION ALL SELECT 'size/stats: all: total_rows: ' || printf('%.2f', CAST(count(*) AS DOUBLE)) FROM lineitem
    UNION ALL SELECT 'size/stats: all: unique_units: ' || printf('%.2f', CAST(count(DISTINCT l_orderkey) AS DOUBLE)) FROM lineitem""",
)
def report_lines(spark, sf):
    return report_text(reports.size_report(t.result_runs(spark, sf), t.stats_runs(spark, sf))).select("value")
