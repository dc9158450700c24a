"""Named files, listings and tails."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from runlens.sources import files, results
from runlens.streaming import progress, tail, timeouts

LINES = "file string, seq long, value string"


def texts(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and p.suffix != ".crc"}


def test_each_file_has_its_name_and_order(spark, tmp_path):
    rows = [(f"a/f{i % 5}.txt", -i, f"line {i}") for i in range(200)] + [("b/empty.txt", 0, None), ("c ü.txt", 1, "")]
    files.write_named(spark.createDataFrame(rows, LINES).repartition(4), str(tmp_path / "tree"))
    got = texts(tmp_path / "tree")
    want = {f"a/f{k}.txt": "".join(f"line {i}\n" for i in reversed(range(200)) if i % 5 == k) for k in range(5)}
    assert got == want | {"b/empty.txt": "", "c ü.txt": "\n"}
    assert [p.name for p in tmp_path.iterdir()] == ["tree"]


def test_tree_that_is_there(spark, tmp_path):
    root = str(tmp_path / "tree")
    one, two = (spark.createDataFrame([(n, 0, n)], LINES) for n in ("one", "two"))
    files.write_named(one, root)
    with pytest.raises(Exception, match="FileExistsError"):
        files.write_named(two, root)
    assert texts(tmp_path) == {"tree/one": "one\n"}
    files.write_named(two, root, mode="overwrite")
    assert texts(tmp_path) == {"tree/two": "two\n"}
    files.write_named(one.limit(0), str(tmp_path / "none"))
    assert texts(tmp_path / "none") == {}


def test_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(400).select(
        F.concat(F.lit("f"), (F.col("id") % 40).cast("string")).alias("file"),
        F.col("id").alias("seq"),
        F.when(F.col("id") == 399, F.raise_error(F.lit("broken line"))).otherwise(F.lit("x")).cast("string").alias("value"),
    )
    with pytest.raises(Exception, match="broken line"):
        files.write_named(rows, str(tmp_path / "tree"))
    assert texts(tmp_path) == {} and list(tmp_path.iterdir()) == []


def test_listing_finds_every_file(spark, tmp_path):
    want = {}
    for i in range(60):
        path = tmp_path / f"d{i % 7}" / f"e{i % 3}" / f"m{i}.result"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * i)
        want[str(path)] = i
    (tmp_path / "top.result").write_text("")
    (tmp_path / "top.other").write_text("1")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "m.result").write_text("1")
    (tmp_path / "empty").mkdir()
    want[str(tmp_path / "top.result")] = 0
    for root in (str(tmp_path), f"file://{tmp_path}/", f"file:{tmp_path}"):
        found = {"/" + r["path"].removeprefix("file:").lstrip("/"): r["length"] for r in files.list_files(spark, root, ".result").collect()}
        assert found == want
    assert files.list_files(spark, str(tmp_path / "nowhere")).count() == 0


def test_tree_with_empty_and_silent_modules(spark, tmp_path):
    planned = spark.createDataFrame([("A.b",), ("A.c",)], "module string")
    kind = "module string, n int, key array<struct<text: string, number: bigint>>, results array<struct<status: string, ms: bigint, hb: bigint>>"
    rows = spark.createDataFrame([("A.b", i, [("u", None), (None, i)], [("S", i, 2)]) for i in range(3)], kind)
    empty = spark.createDataFrame([("D",), ("E.f",)], "module string")
    results.write_tree(rows, ["n"], planned, str(tmp_path / "tree"), elapsed_ms=5, empty=empty)
    got = texts(tmp_path / "tree")
    head = "Total elapsed time : 5 ms\n\nSummary:\n\n"
    assert got == {
        "A/b.result": head + "0 #[S 0 2] u.\\0.\n1 #[S 1 2] u.\\1.\n2 #[S 2 2] u.\\2.\n", "A/c.result": head, "D.result": "", "E/f.result": "",
    }
    results.gather_tree(spark, str(tmp_path / "tree"), planned.union(empty), str(tmp_path / "end"))
    gathered = results.read_strict(spark, str(tmp_path / "end" / "gathered"), glob="*.txt")
    assert sorted(r["results"][0]["ms"] for r in gathered.collect()) == [0, 1, 2]
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "end" / "not_returning")).collect()) == ["D", "E.f"]


@pytest.mark.parametrize("share", [1, 7, 50, 10**6])
def test_shares_of_a_file_hold_each_line_once(tmp_path, share, monkeypatch):
    monkeypatch.setattr(tail, "STEP", 16)
    lines = ["", "a", "ä" * 30, "b" * 100, "", "", "c" * 15, "d" * 16, "e" * 17]
    data = "\n".join(lines).encode() + b"\nnot yet whole"
    (tmp_path / "log.txt").write_bytes(data)
    reader = tail.TailReader(str(tmp_path), share=share)
    parts = reader.partitions({}, reader.latestOffset())
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    places = [len("\n".join(lines[:i]).encode()) + (i > 0) for i in range(len(lines))]
    assert [(r["place"], r["value"]) for r in rows] == list(zip(places, lines))


def test_only_new_bytes_are_read(spark, tmp_path, monkeypatch):
    log, out = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()
    first = "".join(f"M{i}\n" for i in range(3000))
    (log / "run.txt").write_text(first + "half")
    (log / "still.txt").write_text("S\n")
    reader = tail.TailReader(str(log))
    start = reader.latestOffset()
    assert start == {str(log / "run.txt"): len(first), str(log / "still.txt"): 2}
    more = " done\nM0 : 0\n"
    with (log / "run.txt").open("a") as file:
        file.write(more)
    read = Counter()
    real = tail.file_system

    class Counting:
        def __init__(self, system):
            self.system = system

        def open_input_file(self, path):
            file = self.system.open_input_file(path)

            class Opened:
                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    file.close()

                def seek(self, at):
                    file.seek(at)

                def read(self, n):
                    data = file.read(n)
                    read[path] += len(data)
                    return data

            return Opened()

    # A new reader, as after a restart, that is given the offset of the checkpoint.
    again = tail.TailReader(str(log))
    end = again.latestOffset()
    parts = again.partitions(start, end)
    monkeypatch.setattr(tail, "file_system", lambda path: (Counting(real(path)[0]), real(path)[1]))
    rows = [r["value"] for p in parts for b in again.read(p) for r in b.to_pylist()]
    assert rows == ["half done", "M0 : 0"]
    assert read == {str(log / "run.txt"): len("half") + len(more)}


def test_a_stream_repeats_nothing_after_a_restart(spark, tmp_path):
    log, seen, state = tmp_path / "log", tmp_path / "seen", str(tmp_path / "state")
    log.mkdir()

    def take(fail=False):
        def save(batch, number):
            rows = batch.collect()
            if fail:
                raise RuntimeError("killed")
            batch.write.mode("overwrite").parquet(str(seen / f"batch={number}"))
            assert rows

        run = tail.tail(spark, str(log)).writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(save).start()
        run.awaitTermination()

    (log / "a.txt").write_text("1\n2\n")
    take()
    with (log / "a.txt").open("a") as file:
        file.write("3\n")
    (log / "b.txt").write_text("x\n")
    with pytest.raises(Exception, match="killed"):
        take(fail=True)
    with (log / "a.txt").open("a") as file:
        file.write("4\n")
    take()
    take()
    rows = spark.read.parquet(str(seen)).orderBy("path", "place").collect()
    assert [(r["place"], r["value"]) for r in rows] == [(0, "1"), (2, "2"), (4, "3"), (6, "4"), (0, "x")]


def test_progress_reads_appended_lines_only(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()
    (log / "run.txt").write_text("A\nB\n")
    progress.track(spark, str(log), out)
    with (log / "run.txt").open("a") as file:
        file.write("A : 3\n")
    progress.track(spark, str(log), out)
    batches = spark.read.parquet(out).groupBy("batch").agg(F.collect_set("module").alias("m")).collect()
    assert {tuple(sorted(r["m"])) for r in batches} == {("A", "B"), ("A",)}
    got = {r["module"]: (r["code"], r["running"]) for r in progress.current(spark, out).collect()}
    assert got == {"A": (3, False), "B": (None, True)}


def test_outcomes():
    assert timeouts.outcome(0, 10, 10, 99) == "ended"
    assert timeouts.outcome(0, 11, 10, 99) == "timed out"
    assert timeouts.outcome(0, None, 10, 9) == "running" and timeouts.outcome(0, None, 10, 10) == "timed out"
    assert timeouts.outcome(None, 5, 10, 99) == "ended" and timeouts.outcome(None, None, 10, 99) == "running"


def test_modules_time_out_between_restarts(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    kind = "module string, kind string, code int, at timestamp"

    def step(*rows):
        data = [(m, k, c, f"2024-01-01 00:{minute:02d}:00") for m, k, c, minute in rows]
        spark.createDataFrame(data, kind.replace("timestamp", "string")).withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(str(log))
        timeouts.track_limits(spark.readStream.schema(kind).parquet(str(log)), out, limit_seconds=600)
        return {r["module"]: (r["state"], r["code"]) for r in timeouts.current_limits(spark, out).collect()}

    assert step(("A", "start", None, 0), ("B", "start", None, 1), ("C", "end", 4, 1)) == {
        "A": ("running", None), "B": ("running", None), "C": ("ended", 4),
    }
    assert step(("A", "end", 0, 5), ("D", "start", None, 6))["A"] == ("ended", 0)
    got = step((None, "clock", None, 12))
    assert got == {"A": ("ended", 0), "B": ("timed out", None), "C": ("ended", 4), "D": ("running", None)}
    # An end after the limit comes too late, however the timer stands.
    got = step(("B", "end", 1, 13), ("D", "end", 2, 17))
    assert got["B"] == ("timed out", 1) and got["D"] == ("timed out", 2)
