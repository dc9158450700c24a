"""Many rules, a closure under changes, stored sketches and counters of the writing pass, against plain Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import maintained, quantiles, rules, sketches
from runlens.sources import counted, lines, results, stats


def plain_depths(facts, premises):
    bindings = {}
    for b, p in facts:
        bindings.setdefault(b, set()).add(p)
    out = set()
    for b, seen in bindings.items():
        for rule, slots in premises.items():
            if any(s in seen for s in slots):
                depth = 0
                while depth < len(slots) and slots[-1 - depth] in seen:
                    depth += 1
                out.add((b, rule, depth, depth == len(slots)))
    return out


@pytest.mark.parametrize("limit", [5, 10**6])
def test_hundred_rules(spark, limit):
    draw = random.Random(3)
    # Rules of up to 70 slots: more than one number of bits; every tenth rule has equal premises.
    premises = {f"r{i}": [f"P{draw.randrange(40)}" for _ in range(draw.choice([1, 2, 5, 33, 70]))] for i in range(100)}
    premises |= {f"r{i}": premises["r0"] for i in range(0, 100, 10)}
    premises["full"] = [f"P{i}" for i in range(40)]
    facts = [(b, f"P{draw.randrange(40)}") for b in range(12) for _ in range(30)] + [(99, f"P{i}") for i in range(40)] * 2
    facts += [(50, "unknown"), (51, None), (None, "P3")]
    df = spark.createDataFrame(facts, "b int, predicate string")
    table = spark.createDataFrame([(r, i, p) for r, ps in premises.items() for i, p in enumerate(ps)] * 2, "rule string, slot int, predicate string")
    want = plain_depths([(b, p) for b, p in facts if p], premises)
    got = rules.match_rules(df, table, ["b"], limit).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    index = rules.rule_index(table)
    partial = rules.partial_matches(df.filter("b % 2 = 0"), index, ["b"], limit)
    partial = rules.grown(partial, df.filter("b < 10"), index, ["b"], limit)
    partial = rules.grown(partial, df, index, ["b"], limit)
    assert {tuple(r) for r in rules.depths(partial, index, ["b"]).collect()} == want
    assert rules.match_rules(df.limit(0), table, ["b"]).count() == 0
    assert rules.match_rules(df, table.limit(0), ["b"]).count() == 0


def test_rules_meet_facts_once(spark):
    facts = spark.createDataFrame([(1, "P")], "b int, predicate string")
    table = spark.createDataFrame([(f"r{i}", 0, "P") for i in range(100)], "rule string, slot int, predicate string")
    index = rules.rule_index(table)
    assert index.rows == 1 and index.members.count() == 100
    plan = rules.partial_matches(facts, index, ["b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "Python" not in plan


def plain_closure(edges):
    closed = set(edges)
    while True:
        more = closed | {(a, d) for a, b in closed for c, d in closed if b == c}
        if more == closed:
            return closed
        closed = more


CHAIN = [(i, i + 1) for i in range(20)]
CYCLE = [(i, (i + 1) % 9) for i in range(9)]
HUB = [(i, 100) for i in range(12)] + [(100, 200 + i) for i in range(12)]


CASES = [
    (CHAIN, [(30, 0), (20, 31)], [(7, 8), (12, 13)]),
    (CHAIN, [(7, 8), (20, 0)], [(7, 8), (3, 9), (0, 19)]),
    (CHAIN + [(5, 9)], [], [(7, 8)]),
    (CYCLE, [(2, 50)], [(8, 0)]),
    (CYCLE + [(3, 6), (8, 1)], [], [(4, 5), (8, 0)]),
    (HUB + [(3, 101), (101, 205)], [(207, 2)], [(3, 100), (100, 203), (100, 205)]),
    (CHAIN, [], CHAIN),
    ([], CYCLE, CHAIN),
    ([(1, 1), (1, 2)], [(2, 2)], [(1, 1)]),
]


def test_changes_equal_a_fresh_closure(spark):
    """All cases at once, each a relation of its own, one of them with hubs above the limit."""
    schema = "k int, src int, dst int"

    def table(place, times=1):
        return spark.createDataFrame([(k, a, b) for k, case in enumerate(CASES) for a, b in case[place] * times], schema)

    gone = table(2).unionByName(spark.createDataFrame([(0, None, 1)], schema))
    state = maintained.changed(maintained.closed_under(table(0, 2), ["k"], limit=60), table(1, 2), gone, limit=60)
    now = {(k, *e) for k, (given, inserted, deleted) in enumerate(CASES) for e in (set(given) - set(deleted)) | set(inserted)}
    got = [tuple(r) for r in state.closed.select("k", "src", "dst").collect()]
    want = {(k, *e) for k in range(len(CASES)) for e in plain_closure({e[1:] for e in now if e[0] == k})}
    assert set(got) == want and len(got) == len(want)
    assert {tuple(r) for r in state.given.collect()} == now


def test_random_changes_in_turn(spark, tmp_path):
    draw = random.Random(5)

    def edges(n):
        return {(draw.randrange(2), draw.randrange(14), draw.randrange(14)) for _ in range(n)}

    schema = "k int, src int, dst int"
    given = edges(30)
    state = maintained.closed_under(spark.createDataFrame(list(given), schema), ["k"])
    for i in range(2):
        state.write(str(tmp_path / f"s{i}"))
        state = maintained.read_closed(spark, str(tmp_path / f"s{i}"), ["k"])
        gone, new = set(draw.sample(sorted(given), 6)), edges(4)
        state = maintained.changed(state, spark.createDataFrame(list(new), schema), spark.createDataFrame(list(gone), schema))
        given = (given - gone) | new
        want = {(k, a, b) for k in range(2) for a, b in plain_closure({(x, y) for z, x, y in given if z == k})}
        assert {tuple(r) for r in state.closed.select("k", "src", "dst").collect()} == want
    counts = {r["k"]: r["given"] + r["derived"] for r in maintained.given_count(state).collect()}
    assert counts == {k: sum(w[0] == k for w in want) for k in counts}


PROBS = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def test_stored_sketches_bracket_exactly(spark, tmp_path, monkeypatch):
    make = np.random.default_rng(1)
    # A hot group, a small one, one of equal values, one without a value, and a NULL group.
    groups = {"hot": make.gamma(0.5, 1.0, 40_000), "few": [3.0, 1.0], "same": [7.0] * 500, "none": [None, None], None: [2.0, 5.0, 9.0]}
    rows = [(g, f"d{i % 4}", None if v is None else float(v)) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, day string, v double").cache()
    store = str(tmp_path / "store")
    sketches.add_days(df.filter("day in ('d0', 'd1')"), store, ["g"], "day", "v")
    before = sorted(p.name for p in (tmp_path / "store" / "day=d0").glob("*.parquet"))
    for _ in range(2):
        sketches.add_days(df.filter("day in ('d2', 'd3')"), store, ["g"], "day", "v")
    assert before == sorted(p.name for p in (tmp_path / "store" / "day=d0").glob("*.parquet"))
    near = {r["g"]: r for r in sketches.approximate(spark, store, ["g"], PROBS).collect()}
    assert near["hot"]["total"] == 40_000 and near["none"]["p50"] is None
    # No group takes the plain way.
    with monkeypatch.context() as m:
        m.setattr(sketches, "percentiles", lambda *a, **k: pytest.fail("the brackets missed"))
        got = {r["g"]: r for r in sketches.stored_percentiles(df, store, ["g"], "v", PROBS, limit=1000).collect()}
    assert set(got) == {"hot", "few", "same", None}
    for g, row in got.items():
        assert [row[p] for p in PROBS] == pytest.approx(np.quantile(groups[g], list(PROBS.values())), rel=1e-12)
    # A store that is behind, and a group that it lacks.
    more = df.unionByName(spark.range(60_000).select(F.lit("hot").alias("g"), F.lit("d9").alias("day"), (F.col("id") + 100.0).alias("v")))
    more = more.unionByName(spark.createDataFrame([("new", "d9", 4.0)], "g string, day string, v double"))
    want = {r["g"]: tuple(r) for r in quantiles.percentiles(more, ["g"], "v", PROBS).collect()}
    assert {r["g"]: tuple(r) for r in sketches.stored_percentiles(more, store, ["g"], "v", PROBS).collect()} == want


def test_counters_come_with_the_write(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    texts = [json.dumps({"total": i}) if i % 5 else "{broken" for i in range(50)] + ["", " "]
    (path / "m.stats.new.jsonl").write_text("\n".join(texts) + "\n")
    loaded = stats.read_stats(spark, str(path), schema="total bigint")
    spark.sparkContext.setJobGroup("counted", "one pass")
    assert counted.write_good_rows(loaded, str(tmp_path / "out")) == {"rows": 40, "errors": 10}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) == 1
    spark.sparkContext.setJobGroup("rest", "other jobs")
    total = stats.load_totals(loaded).first()
    assert (total["rows"], total["errors"]) == (40, 10) and spark.read.parquet(str(tmp_path / "out")).count() == 40
    (path / "a.result").write_text("1 #[S 1 2, E 3 4] u.\n2 nothing\n3 #[S 1 2] v.\n4 #[S 1 2, E] w.\nno line\n")
    parsed = results.parse_lenient(lines.read_lines(spark, str(path), "*.result"), ["a", "b"])
    counts = counted.write_runs(parsed, ["a", "b"], str(tmp_path / "runs"))
    assert counts == {"ok": 1, "no_match": 1, "wrong_length": 1, "misformatted_result": 1}
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 3
    empty = counted.write_good_rows(loaded.filter("total = -1"), str(tmp_path / "none"))
    assert empty == {"rows": 0, "errors": 0}
