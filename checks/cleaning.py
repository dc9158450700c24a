"""Cleaning, projections and window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import registry
from runlens.functions import numeric, predicates
from runlens.operators import clean, compare, ordered
from runlens.operators.quantiles import percentiles

QUERIES, SQL, query = registry()


@query(
    "dataset_stats",
    """SELECT 'results' AS source, count(*) AS total_rows, count(DISTINCT l_orderkey) AS unique_units FROM lineitem
    UNION ALL SELECT 'events', count(*), count(DISTINCT user_id) FROM events""",
)
def dataset_stats(spark, sf):
    events = t.table(spark, sf, "events").withColumnRenamed("user_id", "unit")
    one = clean.dataset_stats(t.result_runs(spark, sf)).select(F.lit("results").alias("source"), "*")
    return one.unionByName(clean.dataset_stats(events).select(F.lit("events").alias("source"), "*"))


@query(
    "stability_filter",
    f"""WITH {t.RESULT_RUNS} SELECT variant, unit, count(*) AS runs, min(value) AS low, max(value) AS high,
    min(ok) AS ok_low, max(ok) AS ok_high FROM result_runs GROUP BY variant, unit {t.RESULTS_STABLE}""",
)
def stability_filter(spark, sf):
    return clean.stable_groups(t.result_runs(spark, sf), t.RESULTS_LIMITS)


@query("median_value", f"WITH {t.RESULTS} SELECT variant, unit, ok, value FROM results")
def median_value(spark, sf):
    return t.results(spark, sf)


@query(
    "run_ranks",
    f"""WITH {t.STATS_RUNS} SELECT variant, unit, run, payload, value,
    row_number() OVER (PARTITION BY variant, unit ORDER BY value, run, payload) AS rn,
    count(*) OVER (PARTITION BY variant, unit) AS cnt FROM stats_runs""",
)
def run_ranks(spark, sf):
    out = clean.with_run_ranks(t.stats_runs(spark, sf), by=["value", "run", "payload"])
    return out.select("variant", "unit", "run", "payload", "value", "rn", "cnt")


@query("median_run", f"WITH {t.STATS} SELECT * FROM stats")
def median_run(spark, sf):
    return t.stats(spark, sf)


@query(
    "median_run_even_lower",
    f"""WITH {t.STATS_RUNS}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY variant, unit ORDER BY value, run, payload) AS rn,
        count(*) OVER (PARTITION BY variant, unit) AS cnt FROM stats_runs)
    SELECT variant, unit, value FROM ranked WHERE rn = (cnt + 1) // 2 AND (variant, unit) IN (
      SELECT variant, unit FROM stats_runs GROUP BY variant, unit {t.STATS_STABLE})""",
)
def median_run_even_lower(spark, sf):
    out = clean.median_runs(t.stats_runs(spark, sf), t.STATS_LIMITS, t.TIES, even="lower")
    return out.select("variant", "unit", "value")


EXCLUSIONS = """WITH {runs}, g AS (
  SELECT variant, unit, min(ok) != max(ok) AS outcome,
    min(value) <= {timeout} AND max(value) > {timeout} AS timeout,
    max(value)::DOUBLE / min(value) > {spread} AS spread FROM {name} GROUP BY variant, unit),
c AS (SELECT variant, count(*) AS raw,
    count(*) FILTER (NOT outcome AND NOT timeout AND NOT spread) AS kept,
    count(*) FILTER (outcome) AS outcome, count(*) FILTER (timeout) AS timeout,
    count(*) FILTER (spread AND NOT outcome AND NOT timeout) AS spread FROM g GROUP BY variant)
SELECT variant, raw, kept, raw - kept AS excluded, round((raw - kept) / raw * 100, 6) AS excluded_pct,
  outcome, round(outcome / raw * 100, 6) AS outcome_pct, timeout, round(timeout / raw * 100, 6) AS timeout_pct,
  spread, round(spread / raw * 100, 6) AS spread_pct FROM c"""


def rounded(df):
    """Percentages and means to six digits, so that both engines print the same number."""
    return df.select(
        *[F.round(F.col(n), 6).alias(n) if kind == "double" else F.col(n) for n, kind in df.dtypes]
    )


@query("exclusion_report", EXCLUSIONS.format(runs=t.RESULT_RUNS, name="result_runs", timeout=45, spread=3))
def exclusion_report(spark, sf):
    return rounded(clean.exclusion_report(t.result_runs(spark, sf), t.RESULTS_LIMITS))


@query("exclusion_report_stats", EXCLUSIONS.format(runs=t.STATS_RUNS, name="stats_runs", timeout=60000, spread=3))
def exclusion_report_stats(spark, sf):
    return rounded(clean.exclusion_report(t.stats_runs(spark, sf), t.STATS_LIMITS))


REASON = """WITH {runs} SELECT variant, unit FROM result_runs GROUP BY variant, unit HAVING {having}"""


@query("inconsistent_outcome", REASON.format(runs=t.RESULT_RUNS, having="min(ok) != max(ok)"))
def inconsistent_outcome(spark, sf):
    groups = clean.group_stats(t.result_runs(spark, sf))
    return groups.filter(F.col("ok_low") != F.col("ok_high")).select("variant", "unit")


@query("straddles_timeout", REASON.format(runs=t.RESULT_RUNS, having="min(value) <= 45 AND max(value) > 45"))
def straddles_timeout(spark, sf):
    groups = clean.group_stats(t.result_runs(spark, sf))
    return groups.filter(predicates.straddles(F.col("low"), F.col("high"), 45.0)).select("variant", "unit")


@query("high_variance", REASON.format(runs=t.RESULT_RUNS, having="max(value)::DOUBLE / min(value) > 3"))
def high_variance(spark, sf):
    groups = clean.group_stats(t.result_runs(spark, sf))
    return groups.filter(predicates.too_spread(F.col("low"), F.col("high"), 3.0)).select("variant", "unit")


@query(
    "stable_runs_semi_join",
    f"""WITH {t.RESULT_RUNS} SELECT variant, unit, ok, value FROM result_runs WHERE (variant, unit) IN (
    SELECT variant, unit FROM result_runs GROUP BY variant, unit {t.RESULTS_STABLE})""",
)
def stable_runs_semi_join(spark, sf):
    runs = t.result_runs(spark, sf)
    return runs.join(clean.stable_groups(runs, t.RESULTS_LIMITS), clean.GROUP, "left_semi")


@query(
    "duplicate_units",
    """SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def duplicate_units(spark, sf):
    return clean.duplicate_keys(t.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("variant_slice", "SELECT l_orderkey AS unit, l_linestatus = 'F' AS ok, l_quantity AS value FROM lineitem WHERE l_returnflag = 'A'")
def variant_slice(spark, sf):
    return compare.variant_slice(t.result_runs(spark, sf), t.OLD)


@query("not_timed_out", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity <= 45")
def not_timed_out(spark, sf):
    rows = t.table(spark, sf, "lineitem").filter(predicates.in_time(F.col("l_quantity"), 45.0))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "over_limit_flag",
    """SELECT l_returnflag AS variant, CAST(sum(CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END) AS BIGINT) AS over,
    count(*) AS total FROM lineitem GROUP BY l_returnflag""",
)
def over_limit_flag(spark, sf):
    runs = t.result_runs(spark, sf)
    flag = F.when(predicates.timed_out(F.col("value"), 45.0), 1).otherwise(0)
    return runs.groupBy("variant").agg(F.sum(flag).alias("over"), F.count("*").alias("total"))


@query(
    "unit_conversion",
    "SELECT event_id, round(value * 1e6, 3) AS ns, round(value * 1e6 / 1e6, 6) AS ms FROM events",
)
def unit_conversion(spark, sf):
    ns = numeric.ms_to_ns(F.col("value"))
    return t.table(spark, sf, "events").select(
        "event_id", F.round(ns, 3).alias("ns"), F.round(numeric.ns_to_ms(ns), 6).alias("ms")
    )


@query(
    "rounded_median",
    """SELECT user_id, event_type, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY value) AS INTEGER) AS value
    FROM events GROUP BY user_id, event_type""",
)
def rounded_median(spark, sf):
    med = percentiles(t.table(spark, sf, "events"), ["user_id", "event_type"], "value", {"m": 0.5})
    return med.select("user_id", "event_type", numeric.round_half_even(F.col("m")).alias("value"))


@query(
    "number_formats",
    """SELECT event_type, count(*) AS n, CASE WHEN max(value) IS NULL THEN 'N/A' ELSE printf('%.2f', max(value)) || 'ms' END AS high,
    printf('%.2f', count(*) FILTER (value > 50) * 100.0 / count(*)) || '%' AS over FROM events GROUP BY event_type""",
)
def number_formats(spark, sf):
    rows = t.table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.max("value").alias("m"), F.count_if(F.col("value") > 50).alias("o")
    )
    return rows.select(
        "event_type",
        "n",
        numeric.number_text(F.col("m"), 2, "ms").alias("high"),
        numeric.percent_text(F.col("o"), F.col("n")).alias("over"),
    )


@query(
    "cumulative_curve",
    """SELECT event_type, value, count(*) AS n,
    CAST(sum(count(*)) OVER (PARTITION BY event_type ORDER BY value) AS BIGINT) AS solved
    FROM events GROUP BY event_type, value""",
)
def cumulative_curve(spark, sf):
    return ordered.cumulative_counts(t.table(spark, sf, "events"), ["event_type"], "value")


@query(
    "global_index",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx FROM lineitem""",
)
def global_index(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return ordered.with_index(t.table(spark, sf, "lineitem").select(*cols), cols)


@query(
    "carry_forward",
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_signup FROM events""",
)
def carry_forward(spark, sf):
    events = t.table(spark, sf, "events").select(
        "event_id", "user_id", F.when(F.col("event_type") == "signup", F.col("value")).alias("last_signup")
    )
    return ordered.fill_forward(events, ["user_id"], ["event_id"], ["last_signup"])


@query("sorted_values", "SELECT DISTINCT l_quantity AS value FROM lineitem")
def sorted_values(spark, sf):
    return t.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("value")).distinct().orderBy("value")
