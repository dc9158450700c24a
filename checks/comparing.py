"""Comparison, funnel, summary and outlier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.cleaning import rounded
from checks.registry import registry
from runlens.functions import nested, predicates
from runlens.functions.numeric import ratio
from runlens.operators import clean, compare, summary
from runlens.session import keep

QUERIES, SQL, query = registry()


def statistics_sql(source, columns, probs, where=""):
    """One row per metric: count, percentiles, mean, min and max of the given columns."""
    parts = []
    for c in columns:
        ps = ", ".join(
            f"round(CAST(percentile_cont({p}) WITHIN GROUP (ORDER BY {c}) AS DOUBLE), 6) AS {n}" for n, p in probs.items()
        )
        parts.append(
            f"SELECT '{c}' AS metric, count({c}) AS rows, round(avg({c}), 6) AS avg, "
            f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, {ps} FROM {source} {where}"
        )
    return " UNION ALL ".join(parts)


PAIRED_STATS = f"""{t.COHORT},
pairs AS (
  SELECT o.unit, o.value AS old_value, n.value AS new_value, n.forward_success, n.forward_total, n.max_depth
  FROM (SELECT * FROM stats WHERE variant = 'A') o JOIN (SELECT * FROM stats WHERE variant = 'R') n ON o.unit = n.unit
  WHERE o.unit IN (SELECT unit FROM cohort))"""


def cohort_pairs(spark, sf, more=()):
    src = t.sources(spark, sf)
    units = compare.cohort(src, t.OLD, t.NEW, ["in_time", "same_outcome", *more])
    sides = [compare.in_cohort(compare.variant_slice(src.stats, v), units) for v in (t.OLD, t.NEW)]
    return keep(compare.pair(*sides), "pairs")


def wide_statistics(source, old, new, probs):
    rows = []
    stats = {"min": "min({c})", "avg": "avg({c})", "max": "max({c})"}
    stats.update({n: f"percentile_cont({p}) WITHIN GROUP (ORDER BY {{c}})" for n, p in probs.items()})
    for name, form in stats.items():
        rows.append(
            f"SELECT '{name}' AS statistic, CAST({form.format(c=old)} AS DOUBLE) AS old, "
            f"CAST({form.format(c=new)} AS DOUBLE) AS new FROM {source}"
        )
    return (
        "SELECT statistic, round(old, 6) AS old, round(new, 6) AS new, round(old - new, 6) AS difference, "
        f"round(old / new, 6) AS speedup FROM ({' UNION ALL '.join(rows)})"
    )


@query(
    "paired_summary",
    f"WITH {t.RESULTS}, pairs AS (SELECT o.value AS old_value, n.value AS new_value FROM results o JOIN results n "
    f"ON o.unit = n.unit WHERE o.variant = 'A' AND n.variant = 'R') "
    + wide_statistics("pairs", "old_value", "new_value", summary.PAIRED),
)
def paired_summary(spark, sf):
    medians = t.results(spark, sf)
    pairs = compare.pair(compare.variant_slice(medians, t.OLD), compare.variant_slice(medians, t.NEW))
    return rounded(summary.paired_summary(keep(pairs, "pairs"), "old_value", "new_value"))


@query(
    "paired_join",
    f"""WITH {t.RESULTS} SELECT o.unit, o.ok AS old_ok, o.value AS old_value, n.ok AS new_ok, n.value AS new_value
    FROM results o JOIN results n ON o.unit = n.unit WHERE o.variant = 'A' AND n.variant = 'R'""",
)
def paired_join(spark, sf):
    medians = t.results(spark, sf)
    return compare.pair(compare.variant_slice(medians, t.OLD), compare.variant_slice(medians, t.NEW))


@query("four_way_join", f"WITH {t.JOINED} SELECT * FROM joined")
def four_way_join(spark, sf):
    return compare.joined_sources(t.sources(spark, sf), t.OLD, t.NEW)


@query(
    "cross_source_join",
    f"""WITH {t.RESULTS}, {t.STATS} SELECT g.variant, g.unit, g.ok, g.value, a.value AS stats_value
    FROM results g JOIN stats a ON g.variant = a.variant AND g.unit = a.unit""",
)
def cross_source_join(spark, sf):
    return compare.cross_source(t.results(spark, sf), t.stats(spark, sf))


for _name, _more, _where in [
    ("cohort_all", [], f"{t.IN_TIME} AND old_ok = new_ok"),
    ("cohort_both_ok", ["both_ok"], f"{t.IN_TIME} AND old_ok = new_ok AND old_ok AND new_ok"),
    ("cohort_nontrivial", ["nontrivial"], f"{t.IN_TIME} AND old_ok = new_ok AND NOT trivial"),
]:

    @query(_name, f"WITH {t.JOINED} SELECT unit FROM joined WHERE {_where}")
    def _cohort(spark, sf, more=_more):
        src = t.sources(spark, sf)
        units = compare.cohort(src, t.OLD, t.NEW, ["in_time", "same_outcome", *more])
        return clean.require_unique(units, ["unit"])


@query(
    "cohort_slice",
    f"WITH {t.COHORT} SELECT unit, ok, value FROM stats WHERE variant = 'A' AND unit IN (SELECT unit FROM cohort)",
)
def cohort_slice(spark, sf):
    src = t.sources(spark, sf)
    units = compare.cohort(src, t.OLD, t.NEW, ["in_time", "same_outcome"])
    return compare.in_cohort(compare.variant_slice(src.stats, t.OLD), units).select("unit", "ok", "value")


@query(
    "not_in_baseline",
    f"""WITH {t.RESULTS} SELECT unit, ok, value FROM results WHERE variant = 'A'
    AND unit NOT IN (SELECT unit FROM results WHERE variant = 'N' AND ok)""",
)
def not_in_baseline(spark, sf):
    medians = t.results(spark, sf)
    solved = medians.filter((F.col("variant") == t.BASE) & F.col("ok"))
    return compare.not_in_cohort(compare.variant_slice(medians, t.OLD), solved)


@query(
    "presence_flag",
    f"""WITH {t.RESULTS}, {t.STATS} SELECT unit, unit IN (SELECT unit FROM stats WHERE variant = 'A') AS in_stats
    FROM results WHERE variant = 'A'""",
)
def presence_flag(spark, sf):
    left = compare.variant_slice(t.results(spark, sf), t.OLD)
    right = compare.variant_slice(t.stats(spark, sf), t.OLD)
    return compare.with_presence(left, right, "in_stats").select("unit", "in_stats")


@query(
    "outcome_agreement",
    f"""WITH {t.RESULTS}, p AS (SELECT o.ok AS a, n.ok AS b FROM results o JOIN results n ON o.unit = n.unit
      WHERE o.variant = 'A' AND n.variant = 'R')
    SELECT count(*) AS pairs, count(*) FILTER (a = b) AS agree, count(*) FILTER (a AND b) AS both_ok FROM p""",
)
def outcome_agreement(spark, sf):
    pairs = paired_join(spark, sf)
    old, new = F.col("old_ok"), F.col("new_ok")
    return pairs.agg(
        F.count("*").alias("pairs"),
        F.count_if(predicates.agree(old, new)).alias("agree"),
        F.count_if(predicates.both(old, new)).alias("both_ok"),
    )


def funnel_sql(both, nontrivial):
    c0 = IN = t.IN_TIME
    c1 = f"{IN} AND old_ok = new_ok"
    c2 = f"{c1} AND old_ok AND new_ok" if both else c1
    c3 = f"{c2} AND NOT trivial" if nontrivial else c2
    names = ["without_in_time", "without_same_outcome", "without_both_ok", "without_nontrivial", "included"]
    pct = ", ".join(f"round({n} / base * 100, 6) AS {n}_pct" for n in names)
    return f"""WITH {t.JOINED}, c AS (SELECT count(*) AS base, count(*) FILTER ({c0}) AS c0,
      count(*) FILTER ({c1}) AS c1, count(*) FILTER ({c2}) AS c2, count(*) FILTER ({c3}) AS included FROM joined),
    f AS (SELECT base, base - c0 AS without_in_time, c0 - c1 AS without_same_outcome, c1 - c2 AS without_both_ok,
      c2 - included AS without_nontrivial, included FROM c)
    SELECT f.*, {pct} FROM f"""


for _name, _both, _nontrivial in [
    ("funnel_all", False, False),
    ("funnel_both_ok", True, False),
    ("funnel_nontrivial", False, True),
    ("funnel_both_ok_nontrivial", True, True),
]:

    @query(_name, funnel_sql(_both, _nontrivial))
    def _funnel(spark, sf, both=_both, nontrivial=_nontrivial):
        src = t.sources(spark, sf)
        joined = compare.joined_sources(src, t.OLD, t.NEW)
        wanted = ["in_time", "same_outcome", *["both_ok"] * both, *["nontrivial"] * nontrivial]
        return rounded(compare.funnel(joined, src, wanted))


@query(
    "solved_counts",
    f"WITH {t.RESULTS} SELECT variant, count(*) FILTER (ok) AS solved FROM results GROUP BY variant",
)
def solved_counts(spark, sf):
    return compare.solved_counts(t.results(spark, sf))


@query(
    "coverage",
    f"""WITH {t.RESULTS}, {t.STATS}, c AS (SELECT variant, count(*) AS successful,
      count(*) FILTER ((variant, unit) IN (SELECT variant, unit FROM stats)) AS in_stats FROM results WHERE ok GROUP BY variant)
    SELECT variant, successful, in_stats, round(in_stats / successful * 100, 6) AS in_stats_pct FROM c""",
)
def coverage(spark, sf):
    return rounded(compare.coverage(t.results(spark, sf), t.stats(spark, sf)))


for _name, _ok in [("mean_difference", False), ("mean_difference_ok", True)]:

    @query(
        _name,
        f"""WITH {t.RESULTS}, {t.STATS}, m AS (SELECT g.variant, avg(g.value) * 1e6 AS avg_results, avg(a.value) AS avg_stats
          FROM results g JOIN stats a ON g.variant = a.variant AND g.unit = a.unit
          WHERE g.value <= 45 AND a.value <= 60000 {"AND g.ok" if _ok else ""} GROUP BY g.variant)
        SELECT variant, round(avg_results, 3) AS avg_results, round(avg_stats, 3) AS avg_stats,
          round(avg_results - avg_stats, 3) AS abs_diff, round((avg_results - avg_stats) / avg_results, 6) AS rel_diff FROM m""",
    )
    def _mean_difference(spark, sf, ok=_ok):
        out = compare.mean_difference(t.sources(spark, sf), only_ok=ok)
        three = {c: F.round(c, 3) for c in ("avg_results", "avg_stats", "abs_diff")}
        return out.withColumns({**three, "rel_diff": F.round("rel_diff", 6)})


@query(
    "timeout_prevalence",
    f"""WITH {t.RESULTS}, {t.STATS}, m AS (SELECT g.variant, count(*) FILTER (g.value >= 45) AS over_results,
        count(*) FILTER (a.value >= 60000) AS over_stats, count(*) AS total
      FROM results g JOIN stats a ON g.variant = a.variant AND g.unit = a.unit GROUP BY g.variant)
    SELECT m.*, round(over_results / total * 100, 6) AS over_results_pct, round(over_stats / total * 100, 6) AS over_stats_pct FROM m""",
)
def timeout_prevalence(spark, sf):
    return rounded(compare.timeout_prevalence(t.sources(spark, sf)))


@query("stats_summary", f"WITH {PAIRED_STATS} " + wide_statistics("pairs", "old_value", "new_value", summary.PAIRED))
def stats_summary(spark, sf):
    return rounded(summary.paired_summary(cohort_pairs(spark, sf), "old_value", "new_value"))


@query(
    "results_summary",
    f"""WITH {t.COHORT}, pairs AS (SELECT o.value AS old_value, n.value AS new_value FROM results o JOIN results n
      ON o.unit = n.unit WHERE o.variant = 'A' AND n.variant = 'R' AND o.unit IN (SELECT unit FROM cohort)) """
    + wide_statistics("pairs", "old_value", "new_value", summary.PAIRED),
)
def results_summary(spark, sf):
    src = t.sources(spark, sf)
    units = compare.cohort(src, t.OLD, t.NEW, ["in_time", "same_outcome"])
    sides = [compare.in_cohort(compare.variant_slice(src.results, v), units) for v in (t.OLD, t.NEW)]
    return rounded(summary.paired_summary(keep(compare.pair(*sides), "pairs"), "old_value", "new_value"))


@query(
    "paired_frame",
    f"""WITH {PAIRED_STATS} SELECT unit, old_value, new_value, round(old_value / new_value, 6) AS speedup,
    forward_success AS new_forward_success, forward_total AS new_forward_total, max_depth AS new_max_depth FROM pairs""",
)
def paired_frame(spark, sf):
    pairs = compare.with_speedup(cohort_pairs(spark, sf))
    cols = ["unit", "old_value", "new_value", "speedup", "new_forward_success", "new_forward_total", "new_max_depth"]
    return rounded(pairs.select(*cols))


SLOW = """SELECT unit, old_value, new_value, round(new_value / old_value, 6) AS slowdown FROM pairs
  WHERE {where} ORDER BY slowdown DESC, unit"""


@query("slowdowns", f"WITH {PAIRED_STATS} " + SLOW.format(where="new_value > old_value * 1.5 AND new_value >= 20000"))
def slowdowns(spark, sf):
    out = compare.slowdowns(cohort_pairs(spark, sf), 1.5, 20000.0)
    return rounded(out.select("unit", "old_value", "new_value", "slowdown"))


@query(
    "slowdowns_many_rules",
    f"WITH {PAIRED_STATS} "
    + SLOW.format(where="new_value > old_value * 1.5 AND new_value >= 20000 AND forward_total >= 20"),
)
def slowdowns_many_rules(spark, sf):
    pairs = cohort_pairs(spark, sf).filter(predicates.many(F.col("new_forward_total")))
    out = compare.slowdowns(pairs, 1.5, 20000.0)
    return rounded(out.select("unit", "old_value", "new_value", "slowdown"))


@query("high_depth", f"WITH {PAIRED_STATS} " + SLOW.format(where="max_depth >= 20"))
def high_depth(spark, sf):
    pairs = compare.with_speedup(cohort_pairs(spark, sf)).filter(predicates.many(F.col("new_max_depth")))
    return rounded(compare.ranked_outliers(pairs).select("unit", "old_value", "new_value", "slowdown"))


@query(
    "speedup_ratio",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_tax = 0 THEN CASE WHEN l_discount = 0 THEN 'undefined' ELSE 'infinite' END
      ELSE printf('%.4f', l_discount / l_tax) END AS ratio FROM lineitem""",
)
def speedup_ratio(spark, sf):
    r = ratio(F.col("l_discount"), F.col("l_tax"))
    text = (
        F.when(F.isnan(r), "undefined").when(r == float("inf"), "infinite").otherwise(F.format_string("%.4f", r))
    )
    return t.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("ratio")
    )


# Nested statistics of a document, row by row: lines are goals, sentences rules, clauses clusters,
# words instantiations; words are rule entries.
def nested_stats(spark, sf):
    docs = t.table(spark, sf, "documents")
    words = F.split(F.col("text"), " ")
    rules = F.transform(
        words,
        lambda w: F.struct(
            F.struct(F.when(F.length(w) > 6, "forward").when(F.length(w) > 2, "apply").alias("builder")).alias("rule"),
            F.when(F.length(w) % 3 != 0, w.contains("e")).alias("successful"),
        ),
    )

    def cluster(c):
        return F.struct(F.split(c, " ").alias("instantiationStats"))

    def rule(s):
        clauses = F.transform(F.split(s, ", "), cluster)
        return F.struct(F.when(F.length(s) > 20, clauses).alias("clusterStateStats"))

    def goal(line):
        states = F.when(F.length(line) > 10, F.transform(F.split(line, "\\. "), rule))
        return F.struct(
            F.length(line).alias("depth"),
            F.size(F.split(line, " ")).alias("lctxSize"),
            F.struct(states.alias("ruleStateStats")).alias("forwardStateStats"),
        )

    goals = F.transform(F.split(F.col("text"), "\n"), goal)
    return docs.select(
        F.col("doc_id").alias("unit"), F.col("source").alias("variant"),
        rules.alias("ruleStats"), goals.alias("goalStats"),
    )


METRICS = """metrics AS (
  SELECT doc_id AS unit, source AS variant,
    CAST(len(list_filter(string_split(text, ' '), lambda w: length(w) > 6 AND length(w) % 3 != 0 AND contains(w, 'e'))) AS INTEGER) AS forward_success,
    CAST(len(list_filter(string_split(text, ' '), lambda w: length(w) > 6)) AS INTEGER) AS forward_total,
    CAST(list_max(flatten(list_transform(list_filter(string_split(text, chr(10)), lambda l: length(l) > 10),
      lambda l: flatten(list_transform(list_filter(string_split(l, '. '), lambda s: length(s) > 20),
        lambda s: list_transform(string_split(s, ', '), lambda c: len(string_split(c, ' ')))))))) AS INTEGER) AS max_instantiations,
    CAST(list_max(list_transform(string_split(text, chr(10)), lambda l: length(l))) AS INTEGER) AS max_depth,
    CAST(list_max(list_transform(string_split(text, chr(10)), lambda l: len(string_split(l, ' ')))) AS INTEGER) AS max_lctx_size
  FROM documents)"""


@query("nested_metrics", f"WITH {METRICS} SELECT * FROM metrics")
def nested_metrics(spark, sf):
    return nested.with_metrics(nested_stats(spark, sf))


@query(
    "nested_metrics_summary",
    f"WITH {METRICS} "
    + statistics_sql("metrics", ["max_depth", "max_lctx_size"], summary.PAIRED),
)
def nested_metrics_summary(spark, sf):
    metrics = keep(nested.with_metrics(nested_stats(spark, sf)), "metrics")
    return rounded(summary.describe(metrics, ["max_depth", "max_lctx_size"], summary.PAIRED))


@query(
    "instantiation_summary",
    f"WITH {METRICS}, s AS ("
    + statistics_sql("metrics", ["max_instantiations"], summary.COUNTS)
    + ") SELECT * EXCLUDE (metric) FROM s",
)
def instantiation_summary(spark, sf):
    metrics = keep(nested.with_metrics(nested_stats(spark, sf)), "metrics")
    return rounded(summary.column_summary(metrics, "max_instantiations", summary.COUNTS, empty_as_zero=True))
