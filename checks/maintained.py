"""Queries of kept state: many rules, a closure under changes, stored sketches, counters of the writing pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import ingest
from checks import tables as t
from checks.registry import registry
from checks.selecting import SLOTS, event_facts, turn_edges
from runlens.operators import maintained, rules, sketches
from runlens.session import fresh_path
from runlens.sources import counted, lines, results

QUERIES, SQL, query = registry()


def nation_rules(spark, sf):
    """A rule per nation: one to five kinds of events, in an order that differs by nation and region."""
    nations = t.table(spark, sf, "nation")
    slot = F.explode(F.sequence(F.lit(0), F.col("n_nationkey") % 5))
    rows = nations.select("n_nationkey", "n_regionkey", F.col("n_name").alias("rule"), slot.alias("slot"))
    place = (F.col("n_nationkey") + F.col("slot") * (1 + F.col("n_regionkey") % 4)) % 5
    return rows.select("rule", "slot", F.get(F.array(*[F.lit(s) for s in SLOTS]), place).alias("predicate"))


RULES = f"""WITH p AS (SELECT n_name AS rule, slot, n_nationkey % 5 + 1 AS size,
    {[*SLOTS]}[CAST((n_nationkey + slot * (1 + n_regionkey % 4)) % 5 + 1 AS BIGINT)] AS predicate
    FROM nation, range(5) r(slot) WHERE slot <= n_nationkey % 5),
f AS (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS predicate FROM events),
m AS (SELECT user_id, day, rule, size, size - 1 - slot AS place FROM f JOIN p USING (predicate)),
g AS (SELECT user_id, day, rule, size, list(place) AS filled FROM m GROUP BY ALL)
SELECT user_id, day, rule, CAST(coalesce(list_min(list_filter(range(size), lambda i: NOT list_contains(filled, i))), size) AS INTEGER) AS depth,
    list_count(filled) = size AS matched FROM g"""


def text_days(spark, sf):
    return event_facts(spark, sf).withColumn("day", F.col("day").cast("string"))


@query("rule_depths", RULES)
def rule_depths(spark, sf):
    """All rules in one pass over the facts."""
    return rules.match_rules(text_days(spark, sf), nation_rules(spark, sf), ["user_id", "day"])


@query("rule_depths_grown", RULES)
def rule_depths_grown(spark, sf):
    """The same when facts come in three parts, by kind of event: partial matches grow."""
    facts, index, binding = text_days(spark, sf), rules.rule_index(nation_rules(spark, sf)), ["user_id", "day"]
    parts = [facts.filter(F.col("predicate").isin(*SLOTS[i::3])) for i in range(3)]
    partial = rules.partial_matches(parts[0], index, binding)
    for part in parts[1:]:
        partial = rules.grown(partial, part, index, binding)
    return rules.depths(partial, index, binding)


CHANGED = """WITH RECURSIVE t AS (SELECT conv_id, turn, role, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
e AS (SELECT conv_id, turn - 1 AS src, turn AS dst FROM t WHERE turn > 0 AND role <> 'assistant'
  UNION SELECT conv_id, turn, greatest(turn - 2, 0) FROM t WHERE role = 'assistant' AND turn < last),
r AS (SELECT conv_id, src, dst FROM e UNION SELECT r.conv_id, r.src, e.dst FROM r JOIN e ON r.conv_id = e.conv_id AND r.dst = e.src)
SELECT conv_id, src, dst FROM r"""


def turn_changes(spark, sf):
    """Steps to an assistant's turn leave; such turns lead back by two, unless they are the last."""
    turns = t.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    asked = turns.join(last, "conv_id").filter(F.col("role") == "assistant")
    gone = asked.filter(F.col("turn") > 0).select("conv_id", (F.col("turn") - 1).alias("src"), F.col("turn").alias("dst"))
    back = F.greatest(F.col("turn") - 2, F.lit(0)).alias("dst")
    return asked.filter(F.col("turn") < F.col("last")).select("conv_id", F.col("turn").alias("src"), back), gone


@query("closure_maintained", CHANGED)
def closure_maintained(spark, sf):
    """Chains of turns, stored with their closure, read again and changed: deleted steps, new cycles."""
    path = fresh_path(spark, "closed")
    maintained.closed_under(turn_edges(spark, sf), ["conv_id"]).write(path)
    new, gone = turn_changes(spark, sf)
    return maintained.changed(maintained.read_closed(spark, path, ["conv_id"]), new, gone).closed


HUB_CHANGED = """WITH RECURSIVE e AS (
  SELECT DISTINCT 'c' || l_suppkey AS src, l_returnflag AS dst FROM lineitem WHERE l_returnflag <> 'R'
  UNION SELECT DISTINCT l_returnflag, 'p' || l_linenumber FROM lineitem WHERE l_linenumber <> 3 OR l_returnflag = 'A'
  UNION SELECT DISTINCT 'p' || l_linenumber, l_linestatus || l_returnflag FROM lineitem
  UNION SELECT DISTINCT l_linestatus || l_returnflag, l_returnflag FROM lineitem WHERE l_linestatus = 'F'),
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r"""


@query("hub_closure_maintained", HUB_CHANGED)
def hub_closure_maintained(spark, sf):
    """Hubs that most chains pass: steps into one leave, and a cycle through all of them comes."""
    line = t.table(spark, sf, "lineitem")
    flag, number = F.col("l_returnflag"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string"))
    state = F.concat("l_linestatus", "l_returnflag")

    def facts(rows, src, dst):
        return rows.select(src.alias("src"), dst.alias("dst"))

    into = facts(line, F.concat(F.lit("c"), F.col("l_suppkey").cast("string")), flag)
    out = facts(line, flag, number)
    gone = into.filter(F.col("dst") == "R").unionByName(out.filter((F.col("dst") == "p3") & (F.col("src") != "A")))
    new = facts(line, number, state).unionByName(facts(line.filter(F.col("l_linestatus") == "F"), state, flag))
    return maintained.changed(maintained.closed_under(into.unionByName(out), limit=50), new, gone, limit=50).closed


PROBS = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p99": 0.99}


@query(
    "stored_percentiles",
    "SELECT l_returnflag AS variant, count(*) AS total, "
    + ", ".join(f"round(percentile_cont({p}) WITHIN GROUP (ORDER BY l_extendedprice), 6) AS {name}" for name, p in PROBS.items())
    + " FROM lineitem GROUP BY variant",
)
def stored_percentiles(spark, sf):
    """Months come in two loads; the store's sketches bracket the exact percentiles of all."""
    month = F.date_format("l_shipdate", "yyyy-MM")
    rows = t.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("variant"), month.alias("day"), "l_extendedprice")
    store = fresh_path(spark, "sketches")
    for load in (F.col("day") < "2000", F.col("day") >= "2000"):
        sketches.add_days(rows.filter(load), store, ["variant"], "day", "l_extendedprice")
    found = sketches.stored_percentiles(rows, store, ["variant"], "l_extendedprice", PROBS, limit=1000)
    return found.select("variant", "total", *[F.round(name, 6).alias(name) for name in PROBS])


@query(
    "load_counters",
    """SELECT 'rows' AS counter, count(*) FILTER (user_id % 17 > 1) AS lines FROM events
    UNION ALL SELECT 'errors', count(*) FILTER (user_id % 17 = 0) FROM events
    UNION ALL SELECT 'written', count(*) FILTER (user_id % 17 > 1) FROM events
    UNION ALL SELECT 'ok', count(*) FILTER (l_partkey % 10 > 4) FROM lineitem
    UNION ALL SELECT 'no_match', count(*) FILTER (l_partkey % 10 = 1) FROM lineitem
    UNION ALL SELECT 'wrong_length', count(*) FILTER (l_partkey % 10 = 2) FROM lineitem
    UNION ALL SELECT 'misformatted_result', count(*) FILTER (l_partkey % 10 = 3) FROM lineitem
    UNION ALL SELECT 'runs', sum(CASE WHEN l_partkey % 10 > 4 THEN 3 WHEN l_partkey % 10 = 3 THEN 2 ELSE 0 END)::BIGINT FROM lineitem""",
)
def load_counters(spark, sf):
    """Counters of both loads, each from the pass that wrote its table, and the rows then found there."""
    rows, runs = fresh_path(spark, "good"), fresh_path(spark, "runs")
    counts = counted.write_good_rows(ingest.parsed_stats(spark, sf), rows, ["variant"])
    counts["written"] = spark.read.parquet(rows).count()
    parsed = results.parse_lenient(lines.read_lines(spark, ingest.result_files(spark, sf), "*.txt"), ingest.VARIANTS)
    counts |= counted.write_runs(parsed, ingest.VARIANTS, runs, ["variant"])
    counts["runs"] = spark.read.parquet(runs).count()
    return spark.createDataFrame(list(counts.items()), "counter string, lines bigint")
