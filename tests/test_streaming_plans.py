"""Streaming jobs, the whole analysis, and the registered queries on the smallest tables."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from checks import tables
from checks.run import check, database
from runlens import session
from runlens.operators import compare
from runlens.plans import comparison, reports
from runlens.plans.comparison import Analysis
from runlens.sources import stats
from runlens.streaming import ingest, progress


def test_progress_goes_on_where_it_stopped(spark, tmp_path):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.txt").write_text("A\nB\nA : 0\n")
    progress.track(spark, log, out, state)
    (tmp_path / "log" / "2.txt").write_text("C\nB : 137\n")
    progress.track(spark, log, out, state)
    got = {r["module"]: (r["started"], r["ended"], r["code"], r["running"]) for r in progress.current(spark, out).collect()}
    assert got == {"A": (True, True, 0, False), "B": (True, True, 137, False), "C": (True, False, None, True)}


def test_ingest_takes_each_file_once(spark, tmp_path):
    raw, out, state = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "state")
    raw.mkdir()
    line = json.dumps({"declaration": "d", "total": 1, "goalSolved": True})
    (raw / "m.stats.old.jsonl").write_text(line + "\n")
    ingest.append_new(ingest.stats_stream(spark, str(raw)), out, state)
    (raw / "m.stats.new.jsonl").write_text(line + "\nbroken\n")
    ingest.append_new(ingest.stats_stream(spark, str(raw)), out, state)
    rows = spark.read.parquet(out)
    assert sorted(r["variant"] for r in stats.good_rows(rows).collect()) == ["new", "old"]
    assert stats.load_totals(rows).first()["errors"] == 1


def test_appended_lines_are_seen(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()
    (log / "run.txt").write_text("A\n")
    progress.track(spark, str(log), out)
    (log / "run.txt").write_text("A\nA : 0\nB\n")
    progress.track(spark, str(log), out)
    progress.track(spark, str(log), out)
    got = {r["module"]: (r["ended"], r["code"], r["running"]) for r in progress.current(spark, out).collect()}
    assert got == {"A": (True, 0, False), "B": (False, None, True)}


def test_default_state_goes_on(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    line = json.dumps({"declaration": "d", "total": 1, "goalSolved": True})
    for variant in ("old", "new", "more"):
        (raw / f"m.stats.{variant}.jsonl").write_text(line + "\n")
        ingest.append_new(ingest.stats_stream(spark, str(raw)), out)
    rows = stats.good_rows(spark.read.parquet(out))
    assert sorted(r["variant"] for r in rows.collect()) == ["more", "new", "old"]


def test_scratch_leaves_nothing(spark, tmp_path, monkeypatch):
    work = tmp_path / "work"
    monkeypatch.setattr(session, "work_dir", lambda _: str(work))
    with session.scratch(spark):
        assert session.keep(spark.range(5), "x").count() == 5
        assert list(work.iterdir())
    assert not [f for f in work.iterdir() if not f.name.endswith(".crc")]


def test_joins_on_units_do_not_shuffle(spark):
    """The four-way join, cohort and pairs of bucketed sources read their buckets side by side."""
    src = tables.sources(spark, "/root/testdata/sf0.001")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = compare.joined_sources(src, tables.OLD, tables.NEW)
        cohort = session.keep_bucketed(joined.select("unit"), "cohort", "unit")
        pairs = comparison.paired_frame(src, cohort, tables.OLD, tables.NEW)
        for df in (joined, pairs, cohort.groupBy("unit").count()):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, plan
            assert df.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def write_raw(spark, tmp_path):
    """Raw tables of 60 units, three runs each; unit 9 differs in outcome."""
    units = spark.range(60).withColumn("unit", F.concat(F.lit("u"), "id"))
    runs = units.select("*", F.explode(F.array(*[F.lit(v) for v in ("base", "old", "new")])).alias("variant"))
    runs = runs.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("run"))
    speed = F.when(F.col("variant") == "new", F.col("id") % 5 + 1).otherwise(3)
    ms = (F.col("id") + 40) * speed + F.col("run")
    ok = F.when(F.col("variant") == "base", F.col("id") == 7).otherwise((F.col("id") != 9) | (F.col("variant") == "old"))
    runs.select("variant", "unit", ok.alias("ok"), ms.cast("bigint").alias("value")).write.parquet(f"{tmp_path}/results")
    goal = F.struct(
        (F.col("id") % 30).cast("bigint").alias("depth"),
        F.col("id").alias("lctxSize"),
        F.lit(None).cast("struct<ruleStateStats:array<struct<clusterStateStats:array<struct<instantiationStats:array<bigint>>>>>>").alias("forwardStateStats"),
    )
    rule = F.struct(F.struct(F.lit("forward").alias("builder")).alias("rule"), (F.col("id") % 2 == 0).alias("successful"))
    runs.select(
        "variant", F.col("unit").alias("declaration"), (ms * 1_000_000).cast("bigint").alias("total"), ok.alias("goalSolved"),
        F.concat(F.lit("f"), "run").alias("file"), F.lit("syn").alias("syntax"),
        F.array_repeat(rule, (F.col("id") % 25).cast("int")).alias("ruleStats"), F.array(goal).alias("goalStats"),
    ).write.parquet(f"{tmp_path}/stats")


def test_whole_analysis(spark, tmp_path):
    write_raw(spark, tmp_path)
    report = reports.analyze(
        spark, f"{tmp_path}/results", f"{tmp_path}/stats", f"{tmp_path}/out", ("old", "new"), None
    )
    values = {(r["analysis"], r["section"], r["key"], r["metric"]): r["value"] for r in report.collect()}
    assert values[("search-in_time-same_outcome", "funnel", "all", "base")] == 60
    assert values[("search-in_time-same_outcome", "funnel", "all", "included")] == 59
    assert values[("search-in_time-same_outcome", "solved", "all", "old")] == 60
    assert values[("search-in_time-same_outcome", "solved", "all", "new")] == 59
    assert values[("general", "exclusions/results", "old", "kept")] == 60
    assert values[("search-in_time-same_outcome", "max_instantiations", "all", "max")] == 0
    assert ("search-in_time-same_outcome", "max_depth", "all", "p50") in values
    curve = spark.read.parquet(f"{tmp_path}/out/curves/search-in_time-same_outcome_cumulative")
    assert curve.groupBy("metric").agg(F.max("solved")).first()[1] == 59
    assert spark.read.parquet(f"{tmp_path}/out/curves/search-in_time-same_outcome_trend_by_new_forward_total").count() == 25
    slow = spark.read.text(f"{tmp_path}/out/samples/search-in_time-same_outcome_slowdowns")
    assert slow.filter(F.col("value").startswith("slowdown: 1.6")).count() > 0
    assert spark.read.text(f"{tmp_path}/out/report_text").count() == report.count()


def test_matrix_needs_baseline_rows(spark, tmp_path):
    rows = spark.createDataFrame([("old", "u", True, 1.0)], "variant string, unit string, ok boolean, value double")
    src = comparison.Sources(rows, rows, baseline="base")
    labels = [a.label for a in comparison.matrix(src, ("old", "new"), ("so", "sn"))]
    assert labels == ["search-in_time-same_outcome", "search-in_time-same_outcome-both_ok", "saturate-in_time-same_outcome", "saturate-in_time-same_outcome-both_ok"]
    src = comparison.Sources(rows, rows, baseline="old")
    assert len(comparison.matrix(src, ("old", "new"), None)) == 4
    assert Analysis("x", "a", "b", True, True).label == "x-in_time-same_outcome-both_ok-nontrivial"


def test_entry(spark):
    assert entry_module.entry(spark).count() == 10


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize(
    "name", ["median_value", "median_run", "funnel_both_ok_nontrivial", "stats_summary", "trend_first_pass", "strict_results", "closure_incremental"]
)
def test_query_matches_sql(spark, sf, name):
    assert check(spark, database(sf), sf, name).startswith("ok")
