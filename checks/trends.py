"""Trend queries over paired rows and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.cleaning import rounded
from checks.registry import registry
from runlens.operators import trend

QUERIES, SQL, query = registry()


POINTS = """points AS (
  SELECT l_orderkey, l_extendedprice / (l_quantity + 0.37) AS speedup, CAST(l_quantity AS INTEGER) AS x,
    CASE WHEN l_suppkey % 25 > 0 THEN CAST(l_suppkey % 25 AS INTEGER) END AS depth FROM lineitem)"""


def points(spark, sf):
    line = t.table(spark, sf, "lineitem")
    depth = F.col("l_suppkey") % 25
    return line.select(
        "l_orderkey",
        (F.col("l_extendedprice") / (F.col("l_quantity") + 0.37)).alias("speedup"),
        F.col("l_quantity").cast("int").alias("x"),
        F.when(depth > 0, depth).cast("int").alias("depth"),
    )


@query("mean_speedup_by_count", f"WITH {POINTS} SELECT x, round(avg(speedup), 6) AS avg_speedup FROM points GROUP BY x")
def mean_speedup_by_count(spark, sf):
    return rounded(trend.mean_by(points(spark, sf), "x", "speedup"))


FENCED = f"""{POINTS}, q AS (SELECT percentile_cont(0.25) WITHIN GROUP (ORDER BY speedup) AS q1,
    percentile_cont(0.75) WITHIN GROUP (ORDER BY speedup) AS q3 FROM points WHERE depth IS NOT NULL),
fenced AS (SELECT points.* FROM points, q WHERE depth IS NOT NULL
    AND speedup >= q1 - 0.5 * (q3 - q1) AND speedup <= q3 + 0.5 * (q3 - q1))"""


def fenced(spark, sf):
    return trend.inside_fence(points(spark, sf).filter(F.col("depth").isNotNull()), "speedup", factor=0.5)


@query("inside_fence", f"WITH {FENCED} SELECT l_orderkey, x, depth, round(speedup, 6) AS speedup FROM fenced")
def inside_fence(spark, sf):
    return rounded(fenced(spark, sf)).select("l_orderkey", "x", "depth", "speedup")


@query(
    "depth_profile",
    f"""WITH {FENCED} SELECT depth, count(*) AS rows, round(median(speedup), 6) AS median, round(max(speedup), 6) AS high,
    round((SELECT max(speedup) FROM fenced), 6) AS overall_high FROM fenced GROUP BY depth""",
)
def depth_profile(spark, sf):
    return rounded(trend.group_profile(fenced(spark, sf), "depth", "speedup"))


DENSITY = """WITH v AS (SELECT event_type AS g, value AS v FROM events),
s AS (SELECT g, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * power(count(*), -0.2) AS bw FROM v GROUP BY g),
p AS (SELECT s.*, i, lo + i * (hi - lo) / 99 AS x FROM s, range(100) r(i))
SELECT p.g AS event_type, CAST(i AS INTEGER) AS i, round(any_value(x), 6) AS x,
  round(sum(exp(-0.5 * ((x - v) / bw) * ((x - v) / bw))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6) AS density
FROM p JOIN v ON p.g = v.g GROUP BY p.g, i"""


@query("density", DENSITY)
def density(spark, sf):
    return rounded(trend.density(t.table(spark, sf, "events"), ["event_type"], "value"))


LOWESS0 = """, g AS (SELECT x, count(*) AS n, sum(y) AS sy FROM pts GROUP BY x),
k AS (SELECT CAST(floor(0.2 * count(*) + 1e-10) AS BIGINT) AS k FROM pts),
d AS (SELECT a.x AS tx, b.x AS sx, b.n, b.sy, abs(b.x - a.x) AS dist FROM g a, g b),
c AS (SELECT *, sum(n) OVER (PARTITION BY tx ORDER BY dist) AS upto FROM d),
h AS (SELECT tx, min(dist) AS h FROM c, k WHERE upto >= k GROUP BY tx),
w AS (SELECT c.tx, sx, n, sy, CASE WHEN h = 0 THEN 0 ELSE (sx - c.tx) / h END AS u,
    CASE WHEN h = 0 THEN CASE WHEN dist = 0 THEN 1 ELSE 0 END WHEN dist >= h THEN 0
      ELSE power(1 - power(dist / h, 3), 3) END AS w FROM c JOIN h ON c.tx = h.tx),
m AS (SELECT tx, sum(w * n * u) / sum(w * n) AS mu, sum(w * sy) / sum(w * n) AS my,
    sum(w * n * u * u) / sum(w * n) AS uu, sum(w * sy * u) / sum(w * n) AS uy FROM w GROUP BY tx)
SELECT CAST(tx AS DOUBLE) AS x, g.n AS rows, round(CASE WHEN uu - mu * mu > 1e-12
  THEN my - mu * (uy - mu * my) / (uu - mu * mu) ELSE my END, 6) AS fit FROM m JOIN g ON m.tx = g.x"""


@query("trend_first_pass", f"WITH {POINTS}, pts AS (SELECT x, speedup AS y FROM points)" + LOWESS0)
def trend_first_pass(spark, sf):
    return rounded(trend.lowess(points(spark, sf), "x", "speedup", passes=0))


@query(
    "trend_first_pass_averages",
    "WITH pts AS (SELECT user_id AS x, avg(value) AS y FROM events GROUP BY user_id)" + LOWESS0,
)
def trend_first_pass_averages(spark, sf):
    means = trend.mean_by(t.table(spark, sf, "events"), "user_id", "value")
    return rounded(trend.lowess(means.withColumnRenamed("user_id", "x"), "x", "avg_value", passes=0, block=64))


def robust_sql(points_sql: str, passes: int = 3) -> str:
    """The trend of ``points_sql`` (CTEs that end in pts(x, y)) as chained CTEs: a fit, and for each pass residuals,
    their median, new weights and a new fit."""
    ctes = [
        points_sql,
        """g AS (SELECT x, count(*) AS n, avg(y) AS mean_y FROM pts GROUP BY x),
k AS (SELECT CAST(floor(0.2 * count(*) + 1e-10) AS BIGINT) AS k FROM pts),
d AS (SELECT a.x AS tx, b.x AS sx, b.n, abs(b.x - a.x) AS dist FROM g a, g b),
c AS (SELECT *, sum(n) OVER (PARTITION BY tx ORDER BY dist) AS upto FROM d),
h AS (SELECT tx, min(dist) AS h FROM c, k WHERE upto >= k GROUP BY tx),
near AS (SELECT c.tx, sx, CASE WHEN h = 0 THEN 0 ELSE (sx - c.tx) / h END AS u,
    CASE WHEN h = 0 THEN CASE WHEN dist = 0 THEN 1 ELSE 0 END WHEN dist >= h THEN 0
      ELSE power(1 - power(dist / h, 3), 3) END AS w FROM c JOIN h ON c.tx = h.tx),
w0 AS (SELECT x, count(*) AS w, sum(y) AS wy FROM pts GROUP BY x)""",
    ]
    for i in range(passes + 1):
        ctes.append(f"""s{i} AS (SELECT tx, sum(near.w * w{i}.w) AS s0, sum(near.w * w{i}.w * u) AS s1, sum(near.w * w{i}.w * u * u) AS s2,
    sum(near.w * wy) AS t0, sum(near.w * wy * u) AS t1 FROM near JOIN w{i} ON near.sx = w{i}.x GROUP BY tx),
f{i} AS (SELECT g.x, g.n, CASE WHEN s0 > 0 THEN CASE WHEN s2 / s0 - (s1 / s0) * (s1 / s0) > 1e-12
    THEN t0 / s0 - (s1 / s0) * (t1 / s0 - (s1 / s0) * (t0 / s0)) / (s2 / s0 - (s1 / s0) * (s1 / s0)) ELSE t0 / s0 END
    ELSE mean_y END AS fit FROM g JOIN s{i} ON g.x = s{i}.tx)""")
        if i < passes:
            ctes.append(f"""r{i} AS (SELECT pts.x, y, abs(y - fit) AS r FROM pts JOIN f{i} ON pts.x = f{i}.x),
m{i} AS (SELECT median(r) AS middle FROM r{i}),
u{i} AS (SELECT x, y, CASE WHEN middle > 0 THEN r / (6 * middle) WHEN r > 0 THEN 1 ELSE 0 END AS u FROM r{i}, m{i}),
w{i + 1} AS (SELECT x, sum(CASE WHEN u < 1 THEN power(1 - u * u, 2) ELSE 0 END) AS w,
    sum(CASE WHEN u < 1 THEN power(1 - u * u, 2) * y ELSE 0 END) AS wy FROM u{i} GROUP BY x)""")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT CAST(x AS DOUBLE) AS x, n AS rows, round(fit, 6) AS fit FROM f{passes}"


@query("trend_robust", robust_sql(f"{POINTS}, pts AS (SELECT x, speedup AS y FROM points)"))
def trend_robust(spark, sf):
    return rounded(trend.lowess(points(spark, sf), "x", "speedup").withColumn("x", F.col("x").cast("double")))


@query("trend_by_depth", robust_sql(f"{FENCED}, pts AS (SELECT depth AS x, speedup AS y FROM fenced)"))
def trend_by_depth(spark, sf):
    return rounded(trend.lowess(fenced(spark, sf), "depth", "speedup").withColumn("depth", F.col("depth").cast("double"))).withColumnRenamed("depth", "x")


@query(
    "trend_robust_averages",
    robust_sql("pts AS (SELECT user_id AS x, avg(value) AS y FROM events GROUP BY user_id)"),
)
def trend_robust_averages(spark, sf):
    means = trend.mean_by(t.table(spark, sf, "events"), "user_id", "value").withColumnRenamed("user_id", "x")
    return rounded(trend.lowess(means, "x", "avg_value", block=16).withColumn("x", F.col("x").cast("double")))
