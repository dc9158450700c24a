"""Cleaning and sanity reports over all variants, and the end-to-end analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.nested import with_metrics
from runlens.operators import clean, compare
from runlens.operators.compare import Sources
from runlens.plans import comparison
from runlens.sources.report import report_text, tidy
from runlens.sources.stats import as_runs, read_table


def cleaning_report(result_runs: DataFrame, stats_runs: DataFrame, src: Sources) -> DataFrame:
    """Exclusions per variant of both sources, against the cleaned frames."""
    parts = [
        tidy(clean.exclusion_report(stats_runs, src.stats_limits, src.stats), "exclusions/stats", ["variant"]),
        tidy(clean.exclusion_report(result_runs, src.results_limits, src.results), "exclusions/results", ["variant"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def sanity_report(src: Sources) -> DataFrame:
    """Coverage, mean difference of the sources and timeouts per variant."""
    parts = [
        tidy(compare.coverage(src.results, src.stats), "coverage", ["variant"]),
        tidy(compare.mean_difference(src), "mean_difference/all", ["variant"]),
        tidy(compare.mean_difference(src, only_ok=True), "mean_difference/ok", ["variant"]),
        tidy(compare.timeout_prevalence(src), "timeouts", ["variant"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def size_report(result_runs: DataFrame, stats_runs: DataFrame) -> DataFrame:
    """Rows and units of both raw tables."""
    return tidy(clean.dataset_stats(result_runs), "size/results", []).unionByName(
        tidy(clean.dataset_stats(stats_runs), "size/stats", [])
    )


def analyze(
    spark: SparkSession,
    results_path: str,
    stats_path: str,
    out_path: str,
    search: tuple[str, str] | None,
    saturate: tuple[str, str] | None,
    baseline: str | None = None,
    tie_break: tuple[str, ...] = ("file",),
) -> DataFrame:
    """Raw Parquet tables to reports, curves and outlier texts below ``out_path``.

    The results table has ``variant, unit, ok, value`` (ms), the statistics table the statistics
    schema with ``variant`` (ns). Returns the report.
    """
    result_runs = read_table(spark, results_path)
    stats_runs = with_metrics(as_runs(read_table(spark, stats_path, merge=True))).withColumnRenamed("goalSolved", "ok")
    src = comparison.clean_sources(result_runs, stats_runs, list(tie_break), baseline)
    outcomes = comparison.run_matrix(src, comparison.matrix(src, search, saturate))
    general = [size_report(result_runs, stats_runs), cleaning_report(result_runs, stats_runs, src), sanity_report(src)]
    rows = reduce(DataFrame.unionByName, general).select(F.lit("general").alias("analysis"), "*")
    rows.unionByName(comparison.matrix_report(outcomes)).write.parquet(f"{out_path}/report")
    comparison.export(outcomes, out_path)
    report = spark.read.parquet(f"{out_path}/report")
    report_text(report.withColumn("section", F.concat_ws("/", "analysis", "section"))).orderBy(
        "section", "key", "metric"
    ).select("value").write.text(f"{out_path}/report_text")
    return report
