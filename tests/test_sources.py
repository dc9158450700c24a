"""File formats: lenient and strict result files, statistics, run logs, console logs, reports."""

import json

import pytest
from pyspark.sql import functions as F

from runlens.functions import keys
from runlens.sources import console, lines, report, results, runlog, stats

VARIANTS = ["v1", "v2", "v3", "v4", "v5", "v6"]
GOOD = "0 #[S 3 40, E 12 90, S 7 80, S 21 95, G 4 10, G 5 11] Foo.bar."


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_lenient_reader(spark, tmp_path):
    six = "S 1 1, S 1 1, S 1 1, S 1 1, S 1 1, S 1 1"
    body = [
        "Total elapsed time : 5 ms", "", "Summary:", "", GOOD, "x #[S 1 1] a.", "7 no list",
        "8 #[S 1 1, S 1 1, S 1 1, S 1 1, S 1 1] five.",
        "9 #[S 3 1, E 4 1, S, S 1 1, S 1 1, S 1 1] part.",
        f"10 #[{six}] a.b..", f"11 #[{six}] A.\\3.", "12 #[S x 1, S 1 1, S 1 1, S 1 1, S 1 1, S 1 1] nan.",
    ]
    write(tmp_path / "A" / "b.result", "\n".join(body) + "\n")
    parsed = results.parse_lenient(lines.read_lines(spark, str(tmp_path), "*.result"), VARIANTS)
    errors = {r["outcome"]: r["lines"] for r in results.parse_errors(parsed).collect()}
    assert errors == {"no_match": 1, "wrong_length": 1, "misformatted_result": 2}
    runs = {(r["unit"], r["variant"]): (r["ok"], r["value"]) for r in results.runs_of(parsed, VARIANTS).collect()}
    assert runs[("Foo.bar", "v1")] == (True, 3) and runs[("Foo.bar", "v2")] == (False, 12)
    assert {v for u, v in runs if u == "part"} == {"v1", "v2"}
    assert {u for u, _ in runs} == {"Foo.bar", "part", "a.b", "A.\\3"}
    whole = results.runs_of(parsed, VARIANTS, drop_line=True)
    assert whole.filter("unit = 'part'").isEmpty()
    decoded = results.read_runs(spark, str(tmp_path), VARIANTS, decode_keys=True)
    assert not decoded.filter("unit = 'A.3'").isEmpty()


def test_strict_reader(spark, tmp_path):
    head = "Total elapsed time : 5 ms\n\nSummary:\n\n"
    write(tmp_path / "ok" / "A" / "b.result", head + GOOD + "\n1 #[S 3 41] A.\\3.\n")
    rows = results.read_strict(spark, str(tmp_path / "ok"))
    assert rows.count() == 2
    write(tmp_path / "ok" / "C.result", "")
    planned = spark.createDataFrame([("A.b",), ("C",)], "module string")
    tree, missing = results.read_tree_tolerant(spark, str(tmp_path / "ok"), planned)
    assert [tuple(r) for r in missing.collect()] == [("C", "empty")]
    got = {r["k"]: (r["module"], len(r["results"]), r["results"][0]["hb"]) for r in tree.select("*", keys.readable_key(F.col("key")).alias("k")).collect()}
    assert got == {"Foo.bar": ("A.b", 6, 40), "A.3": ("A.b", 1, 41)}
    write(tmp_path / "nohead" / "a.result", "x\n\nsummary\n\n" + GOOD + "\n")
    with pytest.raises(Exception, match="format of result file changed"):
        results.read_strict(spark, str(tmp_path / "nohead")).count()
    write(tmp_path / "bad" / "a.result", head + "0 #[Q 1 1] a.\n")
    with pytest.raises(Exception, match="is not <status>"):
        results.read_strict(spark, str(tmp_path / "bad")).select("path").count()
    write(tmp_path / "odd" / "a.result", head + "garbage line\n1 [S 1 2] b.\n" + GOOD + "\n")
    with pytest.raises(Exception, match="is no result line"):
        results.read_strict(spark, str(tmp_path / "odd")).select("path").count()
    bad = {r["value"] for r in results.strict_violations(spark, str(tmp_path / "odd")).collect()}
    assert bad == {"garbage line", "1 [S 1 2] b."}


def test_write_and_read_back(spark, tmp_path):
    write(tmp_path / "in" / "A.result", "t\n\nSummary:\n\n" + "".join(f"{i} #[S {i} 1, E 2 3] u{i}.\\{i}.\n" for i in range(25)))
    rows = results.read_strict(spark, str(tmp_path / "in")).withColumn("module", F.lit("A"))
    rows = rows.withColumn("n", F.col("results")[0]["ms"])
    results.write_modules(rows, ["n"], str(tmp_path / "out"), elapsed_ms=7)
    assert (tmp_path / "out" / "module=A" / "results.txt").read_text().startswith("Total elapsed time : 7 ms\n\nSummary:\n\n0 #[S 0 1")
    back = results.read_written(spark, str(tmp_path / "out"))
    assert len({r["path"] for r in back.collect()}) == 1 and {r["module"] for r in back.collect()} == {"A"}
    pick = lambda df: sorted((str(r["key"]), str(r["results"])) for r in df.collect())
    assert pick(back) == pick(rows)


@pytest.mark.parametrize("parts", ["1", "4"])
def test_gathered_files_are_read_whatever_their_number(spark, tmp_path, parts):
    n = 2000
    write(tmp_path / "in" / "A.result", "t\n\nSummary:\n\n" + "".join(f"{i} #[S {i} 1, E 2 3] u{i}.\\{i}.\n" for i in range(n)))
    rows = results.read_strict(spark, str(tmp_path / "in")).withColumn("n", F.col("results")[0]["ms"])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        results.write_gathered(results.gather_lines(rows, ["path", "n"]), str(tmp_path / "all"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = sorted((tmp_path / "all").rglob("part*.txt"))
    assert (len(files) > 1) == (parts != "1")
    back = results.read_strict(spark, str(tmp_path / "all"), glob="*.txt")
    pick = lambda df: sorted((str(r["key"]), str(r["results"])) for r in df.collect())
    assert pick(back) == pick(rows)
    first = files[0].read_text().splitlines()
    assert first[2:6] == ["Summary:", "", "0 #[S 0 1, E 2 3] u0.\\0.", "1 #[S 1 1, E 2 3] u1.\\1."]


def test_not_returning(spark, tmp_path):
    write(tmp_path / "A" / "b.result", "t\n\nSummary:\n\n" + GOOD + "\n")
    write(tmp_path / "A" / "c.result", "t\n\nSummary:\n\n")
    write(tmp_path / "D.result", "")
    planned = spark.createDataFrame([("A.b",), ("A.c",), ("D",), ("E",)], "module string")
    found = results.not_returning(spark, str(tmp_path), planned)
    assert sorted(tuple(r) for r in found.collect()) == [("D", "empty"), ("E", "no_file")]
    results.write_not_returning(found, str(tmp_path / "list"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "list")).collect()] == ["D"]


def test_stats_reader(spark, tmp_path):
    rows = [
        json.dumps({"declaration": "d1", "total": 5, "goalSolved": True, "goalStats": []}),
        '{"declaration": "d2", "total":',
        "",
        json.dumps({"declaration": "d3", "total": 6, "goalSolved": False, "ruleStats": [{"rule": {"builder": "forward"}, "successful": None}]}),
    ]
    write(tmp_path / "A" / "b.stats.new.jsonl", "\n".join(rows) + "\n")
    write(tmp_path / "A" / "b.stats.old.jsonl", rows[0] + "\n")
    write(tmp_path / "A" / "b.other.old.jsonl", rows[0] + "\n")
    raw = stats.read_stats(spark, str(tmp_path))
    totals = stats.load_totals(raw).first()
    assert (totals["rows"], totals["errors"]) == (3, 1)
    good = stats.as_runs(stats.good_rows(raw))
    assert sorted((r["variant"], r["unit"], r["value"]) for r in good.collect()) == [
        ("new", "d1", 5), ("new", "d3", 6), ("old", "d1", 5),
    ]


def test_union_and_tables(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(2, 3.0)], "k int, d double")
    both = stats.union_tables([a, b])
    assert both.columns == ["k", "s", "d"] and both.count() == 2
    stats.write_table(a, str(tmp_path / "t" / "p=1"))
    stats.write_table(b, str(tmp_path / "t" / "p=2"))
    merged = stats.read_table(spark, str(tmp_path / "t"), view="merged", merge=True)
    assert {"s", "d"} <= set(merged.columns)
    assert spark.sql("SELECT count(*) AS n FROM merged").first()["n"] == 2


def test_run_log(spark, tmp_path):
    write(tmp_path / "log.txt", "Mod.A\nMod.B\n\nMod.A : 0\nMod.C : 137\n")
    log = runlog.read_log(spark, str(tmp_path / "log.txt"))
    assert [r["module"] for r in runlog.started(log).collect()] == ["Mod.A", "Mod.B"]
    assert {(r["module"], r["code"]) for r in runlog.ended(log).collect()} == {("Mod.A", 0), ("Mod.C", 137)}
    runlog.append_log(log, str(tmp_path / "copy"))
    runlog.append_log(log, str(tmp_path / "copy"))
    assert runlog.read_log(spark, str(tmp_path / "copy")).count() == 8
    write(tmp_path / "bad.txt", "Mod.A: x\n")
    with pytest.raises(Exception, match="unexpected line format"):
        runlog.read_log(spark, str(tmp_path / "bad.txt")).collect()


def test_names_and_problems(spark, tmp_path):
    names = spark.createDataFrame([("M.a", "x.y"), ("M.b", "z")], "module string, name string")
    names = names.select("module", keys.text_parts(F.col("name")).alias("key"))
    runlog.save_names(names, str(tmp_path / "names"))
    back = runlog.load_names(spark, str(tmp_path / "names"))
    assert {(r["module"], r["k"]) for r in back.select("module", keys.readable_key(F.col("key")).alias("k")).collect()} == {("M.a", "x.y"), ("M.b", "z")}
    problem = spark.createDataFrame([(0, "u", "P x", "S", 3, 4)], "variant_index int, unit string, text string, status string, ms bigint, hb bigint")
    runlog.append_problems(problem, str(tmp_path / "log"), as_text=True)
    text = [r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert len(text) == 1 and text[0].startswith("at=") and text[0].endswith("variant=0 unit=u status=S ms=3 hb=4 text=P x")


CONSOLE = """(9, 9.0)
Transitivity (term size 0)
StatefulForward: false
(1, 0.5) (2, 1.25)
StatefulForward: true
(1, 0.25) (2, 0.5)
Transitivity (term size 100)
StatefulForward: false
(1, 7.0)
(1, 8.0) (2, 9.0)
Other (term size 50)
StatefulForward: true
(4, 2.0)
"""


@pytest.mark.parametrize("limit", [2, 10**6])
def test_console(spark, tmp_path, limit):
    write(tmp_path / "run.txt", CONSOLE)
    points = console.parse_console(lines.read_lines(spark, str(tmp_path)), limit=limit)
    got = sorted((r["size"], r["variant"], r["x"], r["y_ms"]) for r in points.collect())
    assert got == [
        (0, "inc", 1, 0.25), (0, "inc", 2, 0.5), (0, "naive", 1, 0.5), (0, "naive", 2, 1.25),
        (100, "inc", 4, 2.0), (100, "naive", 1, 8.0), (100, "naive", 2, 9.0),
    ]


def test_order_of_a_log_is_found_without_its_points(spark, tmp_path, monkeypatch):
    seen = []
    filled = console.fill_forward

    def noted(df, *args):
        seen.append(df.columns)
        return filled(df, *args)

    monkeypatch.setattr(console, "fill_forward", noted)
    (tmp_path / "log.txt").write_text("StatefulForward: true\n(1, 0.5) (2, 1.5)\n (3, 2.5)\n")
    points = console.parse_console(lines.read_lines(spark, str(tmp_path))).select("variant", "x", "y_ms")
    assert sorted(map(tuple, points.collect())) == [("inc", 1, 0.5), ("inc", 2, 1.5), ("inc", 3, 2.5)]
    assert not {"value", "_points"} & set(seen[0])


def test_long_series_round_trip(spark, tmp_path):
    series = spark.range(25_000).select(F.lit("naive").alias("variant"), F.col("id").alias("x"), (F.col("id") / 8).alias("y_ms"))
    texts = console.series_text(series, ["variant"]).orderBy("line").collect()
    assert len(texts) == 3
    body = "\n".join(["(term size 0)", "StatefulForward: false", "(1, 7.0)", *[r["text"] for r in texts]])
    write(tmp_path / "run.txt", body + "\n")
    points = console.parse_console(lines.read_lines(spark, str(tmp_path)))
    assert points.count() == 25_000
    assert points.select("x").distinct().count() == 25_000


def test_outliers_with_missing_texts(spark, tmp_path):
    rows = spark.createDataFrame([(None, "u", None, 1.0, 3.0, 3.0), ("f", "v", "s", 1.0, 2.0, None)], "file string, unit string, syntax string, old_ms double, new_ms double, slowdown double")
    report.write_outliers(rows, str(tmp_path / "out"))
    got = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*"))).splitlines()
    assert [x for x in got if x.startswith("name:")] == ["name:     u", "name:     v"]


def test_series_and_figures(spark, tmp_path):
    runs = spark.createDataFrame([("f", "naive", 1, 3), ("f", "naive", 1, 4), ("f", "naive", 2, 10**6)], "figure string, label string, x bigint, ns bigint")
    means = console.mean_series(runs, ["figure", "label"])
    assert {r["x"]: r["y_ms"] for r in means.collect()} == {1: 3e-6, 2: 1.0}
    texts = console.series_text(means, ["figure", "label"])
    assert texts.first()["text"] == "(1, 0.000003) (2, 1.000000)"
    split = console.series_text(means, ["figure", "label"], per_line=1)
    assert [r["text"] for r in split.orderBy("line").collect()] == ["(1, 0.000003)", " (2, 1.000000)"]
    report.write_figures(report.figure_lines(texts, {"f": "F Benchmark"}), str(tmp_path / "fig"))
    got = "".join(p.read_text() for p in sorted((tmp_path / "fig").glob("part*"))).splitlines()
    assert got == ["F Benchmark", "naive", "(1, 0.000003) (2, 1.000000)"]


def test_outlier_records(spark, tmp_path):
    rows = spark.createDataFrame([("f1", "u1", "s1", 1.0, 2.0, 2.0), ("f2", "u2", "s2", 1.0, 3.004, 3.0)], "file string, unit string, syntax string, old_ms double, new_ms double, slowdown double")
    report.write_outliers(rows, str(tmp_path / "out"))
    got = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*"))).splitlines()
    assert got[:7] == ["file:     f2", "name:     u2", "syntax:   s2", "old_time: 1.00 ms", "new_time: 3.00 ms", "slowdown: 3.00x", ""]
    assert len(got) == 14


def test_lines_of_a_file_are_read_without_a_shuffle(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        body = spark.range(200).select(F.col("id").alias("idx"), F.format_string("%d #[S 1 2] a.", "id").alias("value"))
        results.write_gathered(body, str(tmp_path / "lines"))
        rows = results.read_strict(spark, str(tmp_path / "lines"), glob="*.txt")
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 200
        for file in (tmp_path / "lines").glob("*.txt"):
            written = file.read_text().split("\n")
            assert written[2] == results.SUMMARY
            numbers = [int(line.split(" ")[0]) for line in written[4:] if line]
            assert numbers and numbers == list(range(numbers[0], numbers[0] + len(numbers)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
