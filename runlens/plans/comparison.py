"""The whole comparison of two variants: cohort, funnel, summaries, trends and outliers."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.numeric import ns_to_ms
from runlens.functions.predicates import many, slower
from runlens.operators import compare, summary, trend
from runlens.operators.clean import median_runs, median_values, require_unique
from runlens.operators.compare import Sources
from runlens.operators.ordered import cumulative_counts
from runlens.session import keep, keep_bucketed
from runlens.sources.report import tidy, write_outliers

NEEDED = ["unit", "value"]
METRICS = ["forward_success", "forward_total", "max_instantiations", "max_depth", "max_lctx_size"]
TEXTS = ["file", "syntax"]


@dataclass(frozen=True)
class Analysis:
    """One comparison. ``search`` variants also report depth and context size."""

    name: str
    old: str
    new: str
    only_ok: bool = False
    exclude_trivial: bool = False
    search: bool = True

    @property
    def wanted(self) -> list[str]:
        """The conditions of its units."""
        return ["in_time", "same_outcome", *["both_ok"] * self.only_ok, *["nontrivial"] * self.exclude_trivial]

    @property
    def label(self) -> str:
        return "-".join([self.name, *self.wanted])


@dataclass(frozen=True)
class Thresholds:
    """Limits of the outlier exports."""

    factor: float = 1.5
    at_least: float = 50e6
    rules: int = 20
    depth: int = 20
    fence: float = 3.0


@dataclass
class Outcome:
    """One comparison: small report ``tables``, and ``curves`` and ``outliers`` that may be large.

    Curves are made on demand, since smoothing runs jobs of its own; a curve without enough rows is
    None.
    """

    analysis: Analysis
    pairs: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    curves: dict[str, Callable[[], DataFrame | None]] = field(default_factory=dict)
    outliers: dict[str, DataFrame] = field(default_factory=dict)

    def report(self) -> DataFrame:
        """All tables as rows ``analysis, section, key, metric, value``."""
        parts = [
            tidy(df, section, ["statistic"] if "statistic" in df.columns else [])
            for section, df in self.tables.items()
        ]
        rows = reduce(DataFrame.unionByName, parts)
        return rows.select(F.lit(self.analysis.label).alias("analysis"), "*")


def clean_sources(
    result_runs: DataFrame, stats_runs: DataFrame, tie_break: list[str], baseline: str | None = None, **limits
) -> Sources:
    """Both sources cleaned and written once, in a folder per variant and buckets of units.

    ``limits`` are ``results_limits`` and ``stats_limits``.
    """
    src = Sources(results=result_runs, stats=stats_runs, baseline=baseline, **limits)
    cleaned = median_values(result_runs, src.results_limits)
    picked = median_runs(stats_runs, src.stats_limits, tie_break)
    rows = max(result_runs.count(), stats_runs.count())
    return Sources(
        results=keep_bucketed(cleaned, "results", "unit", by=["variant"], rows=rows),
        stats=keep_bucketed(picked, "stats", "unit", by=["variant"], rows=rows),
        rows=rows,
        baseline=baseline,
        results_limits=src.results_limits,
        stats_limits=src.stats_limits,
    )


def paired_frame(src: Sources, cohort: DataFrame, old: str, new: str) -> DataFrame:
    """Old and new statistics of the cohort's units with both ratios."""
    sides = []
    for variant in (old, new):
        part = compare.variant_slice(src.stats, variant)
        part = part.select(*[c for c in [*NEEDED, *METRICS, *TEXTS] if c in part.columns])
        sides.append(compare.in_cohort(part, cohort))
    return compare.with_speedup(compare.pair(*sides))


def _smoothed(points: DataFrame, x: str, y: str) -> DataFrame | None:
    """The trend of ``y`` over ``x``, for more than three points."""
    return trend.lowess(points, x, y) if len(points.select(x).take(4)) > 3 else None


def _curves(pairs: DataFrame, a: Analysis, limits: Thresholds) -> dict[str, Callable[[], DataFrame | None]]:
    sides = summary.unpivot(pairs, ["old_value", "new_value"])
    out: dict[str, Callable[[], DataFrame | None]] = {
        "cumulative": lambda: cumulative_counts(sides, ["metric"], "value"),
        "density": lambda: trend.density(sides, ["metric"], "value"),
    }
    for x in ("new_forward_success", "new_forward_total"):
        if x in pairs.columns:
            out[f"mean_speedup_by_{x}"] = lambda x=x: trend.mean_by(pairs, x, "speedup")
            out[f"trend_by_{x}"] = lambda x=x: _smoothed(pairs, x, "speedup")
            out[f"trend_of_means_by_{x}"] = lambda x=x: _smoothed(trend.mean_by(pairs, x, "speedup"), x, "avg_speedup")
    if a.search and "new_max_depth" in pairs.columns:

        def deep() -> DataFrame:
            known = pairs.filter(F.col("new_max_depth").isNotNull())
            return trend.inside_fence(known, "speedup", limits.fence)

        out["depth_profile"] = lambda: trend.group_profile(deep(), "new_max_depth", "speedup")
        out["depth_density"] = lambda: trend.density(deep(), ["new_max_depth"], "speedup")
        out["trend_by_depth"] = lambda: _smoothed(deep(), "new_max_depth", "speedup")
    return out


def run(src: Sources, analysis: Analysis, limits: Thresholds = Thresholds(), joined: DataFrame | None = None) -> Outcome:
    """One comparison. ``joined`` may hold ``joined_sources`` of the same variants, written once."""
    a = analysis
    if joined is None:
        joined = keep_bucketed(compare.joined_sources(src, a.old, a.new), "joined", "unit", rows=src.rows)
    met = joined.filter(compare.meets(src, a.wanted)).select("unit")
    cohort = require_unique(keep_bucketed(met, "cohort", "unit", rows=src.rows), ["unit"])
    pairs = keep_bucketed(paired_frame(src, cohort, a.old, a.new), "pairs", "unit", rows=src.rows)
    result_pairs = joined.join(cohort, "unit", "left_semi")
    out = Outcome(a, pairs)

    out.tables["funnel"] = compare.funnel(joined, src, a.wanted)
    solved = compare.solved_counts(src.results.filter(F.col("variant").isin(a.old, a.new)))
    out.tables["solved"] = solved.agg(
        F.max(F.when(F.col("variant") == a.old, F.col("solved"))).alias("old"),
        F.max(F.when(F.col("variant") == a.new, F.col("solved"))).alias("new"),
    )
    out.tables["stats_values"] = summary.paired_summary(pairs, "old_value", "new_value")
    out.tables["results_values"] = summary.paired_summary(result_pairs, "old_value", "new_value")
    if "new_max_instantiations" in pairs.columns:
        out.tables["max_instantiations"] = summary.column_summary(
            pairs, "new_max_instantiations", summary.COUNTS, empty_as_zero=True
        )
    if a.search:
        for metric in ("max_depth", "max_lctx_size"):
            if f"old_{metric}" in pairs.columns:
                out.tables[metric] = summary.column_summary(pairs, f"old_{metric}", summary.PAIRED)

    out.curves.update(_curves(pairs, a, limits))

    slow = pairs.filter(slower(F.col("old_value"), F.col("new_value"), limits.factor, limits.at_least))
    out.outliers["slowdowns"] = compare.ranked_outliers(slow)
    if "new_forward_total" in pairs.columns:
        out.outliers["slowdowns_many_forward"] = compare.ranked_outliers(
            slow.filter(many(F.col("new_forward_total"), limits.rules))
        )
    if a.search and "new_max_depth" in pairs.columns:
        out.outliers["high_depth"] = compare.ranked_outliers(
            pairs.filter(many(F.col("new_max_depth"), limits.depth))
        )
    return out


def matrix(src: Sources, search: tuple[str, str] | None, saturate: tuple[str, str] | None) -> list[Analysis]:
    """The usual analyses: search variants for all and only good units, the same without trivial
    units if the baseline has any rows, and saturation variants for all and only good units."""
    out = []
    if search:
        old, new = search
        out += [Analysis("search", old, new, only_ok) for only_ok in (False, True)]
        base = src.results.filter(F.col("variant") == src.baseline) if src.baseline else None
        if base is not None and not base.isEmpty():
            out += [Analysis("search", old, new, only_ok, exclude_trivial=True) for only_ok in (False, True)]
    if saturate:
        old, new = saturate
        out += [Analysis("saturate", old, new, only_ok, search=False) for only_ok in (False, True)]
    return out


def run_matrix(
    src: Sources, analyses: list[Analysis], limits: Thresholds = Thresholds(), at_once: int = 8
) -> list[Outcome]:
    """All analyses, ``at_once`` of them together; those of the same variants share one written join."""
    pairs = {(a.old, a.new) for a in analyses}
    joined = {pair: keep(compare.joined_sources(src, *pair), "joined") for pair in pairs}
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda a: run(src, a, limits, joined[a.old, a.new]), analyses))


def matrix_report(outcomes: list[Outcome]) -> DataFrame:
    """One table of all analyses' reports."""
    return reduce(DataFrame.unionByName, [o.report() for o in outcomes])


def export(outcomes: list[Outcome], path: str, at_once: int = 8) -> None:
    """Write curves as Parquet and outliers as text records (values in ns become ms).

    The jobs do not depend on each other, so ``at_once`` of them are handed to Spark together.
    """

    def write_curve(name: str, make: Callable[[], DataFrame | None]) -> None:
        curve = make()
        if curve is not None:
            curve.write.parquet(f"{path}/curves/{name}")

    def write_rows(name: str, df: DataFrame) -> None:
        texts = [F.col(f"new_{c}").alias(c) if f"new_{c}" in df.columns else F.lit("").alias(c) for c in TEXTS]
        old_ms, new_ms = (ns_to_ms(F.col(c)) for c in ("old_value", "new_value"))
        rows = df.select("unit", *texts, old_ms.alias("old_ms"), new_ms.alias("new_ms"), "slowdown")
        write_outliers(rows, f"{path}/samples/{name}")

    with ThreadPoolExecutor(at_once) as pool:
        jobs = []
        for outcome in outcomes:
            label = outcome.analysis.label
            jobs += [pool.submit(write_curve, f"{label}_{n}", make) for n, make in outcome.curves.items()]
            jobs += [pool.submit(write_rows, f"{label}_{n}", df) for n, df in outcome.outliers.items()]
        for job in jobs:
            job.result()
