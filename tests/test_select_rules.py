"""Rules to a fixpoint, catalogue operators, salted joins and samples."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runlens.operators import catalog, fixpoint, joins, sampling
from runlens.plans import sweep
from runlens.sources.console import mean_series


@pytest.mark.parametrize("n", [1, 5, 8])
def test_chain_closed_form(spark, n):
    specs = spark.createDataFrame([(1, n, 100), (2, 3, 7)], "chain int, n bigint, start bigint")
    facts = fixpoint.chain_facts(specs, ["chain"], chunk=3)
    assert facts.filter("chain = 1").count() == n
    closed = fixpoint.closure(facts, ["chain"])
    counts = {r["chain"]: (r["given"], r["derived"]) for r in fixpoint.derived_counts(closed, ["chain"]).collect()}
    assert counts == {1: (n, sweep.closed_form(n)), 2: (3, 3)}
    naive = fixpoint.closure_naive(facts, ["chain"])
    pick = lambda df: sorted(tuple(r) for r in df.select("chain", "src", "dst").collect())
    assert pick(closed) == pick(naive)


def test_cycles_hubs_and_bounds(spark):
    edges = [(f"a{i}", "hub") for i in range(30)] + [("hub", f"b{i}") for i in range(20)] + [("b0", "a0")]
    df = spark.createDataFrame(edges, "src string, dst string")
    closed = fixpoint.closure(df, limit=5).drop("round")
    want = set(edges)
    while True:
        more = want | {(x, w) for x, y in want for z, w in want if y == z}
        if more == want:
            break
        want = more
    assert {tuple(r) for r in closed.collect()} == want
    assert closed.count() == len(want)
    assert {tuple(r) for r in fixpoint.closure(df, max_rounds=0).drop("round").collect()} == set(edges)


def test_large_closures_broadcast_no_facts(spark, monkeypatch):
    plans = []
    kept = fixpoint.keep

    def noted(df, tag, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, tag, **options)

    monkeypatch.setattr(fixpoint, "keep", noted)
    specs = spark.range(20).select(F.col("id").alias("chain"), F.lit(4).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("start"))
    facts = fixpoint.chain_facts(specs, ["chain"])
    assert fixpoint.closure(facts, ["chain"], limit=30).count() == 20 * (4 + sweep.closed_form(4))
    assert len(plans) == 4 and not any("BroadcastHashJoin" in p for p in plans)


def test_naive_closure_merges_before_it_shuffles(spark, monkeypatch):
    plans = []
    kept = fixpoint.keep

    def noted(df, tag, **options):
        if tag == "composed":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, tag, **options)

    monkeypatch.setattr(fixpoint, "keep", noted)
    specs = spark.range(20).select(F.col("id").alias("chain"), F.lit(4).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("start"))
    facts = fixpoint.chain_facts(specs.unionByName(spark.createDataFrame([(99, 9, 0)], specs.schema)), ["chain"])
    got = fixpoint.closure_naive(facts, ["chain"], limit=30)
    assert got.count() == got.distinct().count() == 20 * (4 + sweep.closed_form(4)) + 9 + sweep.closed_form(9)
    # The two sides are dealt by chain; nothing is shuffled between their join and the merge.
    assert plans and all("SortMergeJoin" in p and "Exchange" not in p.split("SortMergeJoin")[0] for p in plans)


def test_match_depth(spark):
    specs = spark.createDataFrame([(d, 6, 2, d, 50) for d in range(1, 7)], "case int, premises int, inert int, depth int, a bigint")
    facts = fixpoint.depth_facts(specs, ["case"])
    assert facts.filter("predicate like 'Q%'").count() == 12
    got = fixpoint.match_depth(facts, ["case", "n"], [f"P{i}" for i in range(6)]).filter("n = 50").collect()
    assert {r["case"]: (r["depth"], r["matched"]) for r in got} == {**{d: (d, False) for d in range(1, 6)}, 6: (6, True)}


def test_sweep(spark):
    runs = sweep.timed(spark, "t", "inc", [1, 2], 1, lambda n: sweep.transitivity(spark, n, 0, True))
    assert mean_series(runs, ["workload", "variant"]).count() == 2
    assert sweep.transitivity(spark, 4, 100, False).count() == 4 + sweep.closed_form(4)
    assert sweep.partial_match(spark, 3, 0).filter("n = 0").first()["depth"] == 3


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(300).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 9)).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3)], "k string, v int")
    pick = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert pick(joins.salted_join(left, right, ["k"], how, limit=10)) == pick(left.join(right, ["k"], how))
    assert joins.hot_keys(left, ["k"], 10).filter("k = 'hot'").first()["_parts"] == 10


def test_equal_rows_spread_over_all_shares(spark):
    left = spark.range(1000).select(F.lit("hot").alias("k"))
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    out = joins.salted_join(left, right, ["k"], limit=100)
    assert out.count() == 1000
    numbered = joins._numbered(left)
    shares = numbered.groupBy((F.col("_row") % 10).alias("s")).count().collect()
    assert len(shares) == 10 and max(r["count"] for r in shares) <= 300


def test_right_hub_is_cut(spark):
    left = spark.range(50).select(F.lit(1).alias("k"), "id")
    right = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("other"))
    out = joins.salted_join(left, right, ["k"], limit=100)
    assert out.select("id", "other").distinct().count() == out.count() == 100_000
    assert out.select(F.spark_partition_id()).distinct().count() > 1


@pytest.fixture(scope="module")
def units(spark):
    rows = [
        ("t1", "Lib.a", True, True, False, False, False, False, False, ["True", "And"], ["t2", "f", "gone"]),
        ("t2", "Lib.b", True, True, False, False, False, False, True, ["Bool", "Eq"], ["t1"]),
        ("t3", "Std.c", True, True, False, False, False, False, False, ["Nat", "Bool"], None),
        ("t4", "Std.c", True, True, True, False, False, False, False, ["Other"], []),
        ("f", "Lib.a", True, False, False, False, False, False, False, ["Other"], ["t3", "t3"]),
    ]
    flags = "has_range is_theorem is_proj is_private is_type is_instance is_simp".split()
    schema = "name string, module string, " + ", ".join(f"{f} boolean" for f in flags)
    return spark.createDataFrame(rows, schema + ", type_consts array<string>, value_consts array<string>")


def names(df, *cols):
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


def test_catalog(spark, units):
    assert names(catalog.human_units(units), "name") == ["t1", "t2", "t3"]
    assert names(catalog.from_package(units, "Lib"), "name") == ["f", "t1", "t2"]
    assert names(units.filter(catalog.relevant(True)), "name") == ["f", "t2", "t3", "t4"]
    assert names(units.filter(catalog.relevant(False)), "name") == ["f", "t3", "t4"]
    assert names(catalog.with_tiers(units), "name", "tier") == [("t1", "logic"), ("t2", "bool"), ("t3", "nat")]
    assert names(catalog.used_theorems(units, limit=1), "unit", "name") == [("f", "t3"), ("t1", "t2"), ("t2", "t1")]
    assert names(catalog.relevant_premises(units, include_simp=False), "unit", "name") == [("f", "t3")]
    assert ("t1", "gone") in names(catalog.unknown_references(units), "unit", "name")
    assert names(catalog.new_names(units.limit(2), units), "name") == ["f", "t3", "t4"]
    assert names(catalog.imports_of(units.select("name"), units), "module") == ["Lib.a", "Lib.b", "Std.c"]


def test_tally(spark, units):
    wanted = catalog.human_units(units).select("name")
    tally = catalog.tally_by_module(wanted, units)
    assert {r["module"]: (r["units"], r["names"]) for r in tally.collect()} == {
        "Lib.a": (1, ["t1"]), "Lib.b": (1, ["t2"]), "Std.c": (1, ["t3"]),
    }
    many = spark.range(25).select(F.lit("m").alias("module"), F.col("id").cast("string").alias("name"))
    lists = catalog.lists_by(many, "module", "name", chunk=10, limit=5).collect()
    assert sorted(len(r["names"]) for r in lists) == [5, 10, 10] and {r["units"] for r in lists} == {25}
    with pytest.raises(Exception, match="cannot find module of"):
        catalog.tally_by_module(spark.createDataFrame([("zzz",)], "name string"), units).collect()
    with pytest.raises(ValueError):
        catalog.require_file_safe(spark.createDataFrame([("a.b-c",)], "module string"))


def test_grid_and_skips(spark):
    units = spark.createDataFrame([("u1",), ("u2",)], "unit string")
    grid = catalog.experiment_grid(units, ["a", "b"], 3)
    assert grid.count() == 12
    skips = catalog.skip_list(units.limit(1), ["a", "b"])
    assert catalog.with_skips(grid, skips.unionByName(skips)).filter("status = 'T'").count() == 6


@pytest.mark.parametrize("limit", [3, 10**6])
def test_samples(spark, monkeypatch, limit):
    monkeypatch.setattr(sampling, "GROUP_LIMIT", limit)
    df = spark.range(100).select(F.concat(F.lit("k"), "id").alias("k"))
    one, two = (names(sampling.sample(df, "k", 10, seed=7), "k") for _ in range(2))
    assert one == two and len(set(one)) == 10
    assert names(sampling.sample(df, "k", 10, seed=8), "k") != one
    assert sampling.sample(df, "k", 500).count() == 100
    assert names(sampling.first_n(df, "k", 5), "k") == sorted(f"k{i}" for i in range(100))[:5]
    drawn = sampling.sample_with_replacement(df, "k", 300, seed=1)
    assert drawn.count() == 300 and drawn.select("k").distinct().count() < 101
    assert sampling.sample_with_replacement(df.limit(0), "k", 3).count() == 0


@pytest.mark.parametrize("matrix, step", [(fixpoint.MATRIX, fixpoint.STEP), (1, 64), (1, fixpoint.STEP), (10**9, 64)])
def test_ways_through_middles_are_no_rows(monkeypatch, matrix, step):
    """Relations of several shapes with nulls, put together by matrices, by blocks of them and by lists, against sets."""
    monkeypatch.setattr(fixpoint, "MATRIX", matrix)
    monkeypatch.setattr(fixpoint, "STEP", step)
    rng = random.Random(2)
    relations = [
        {(i, j) for i in range(30) for j in range(i + 1, 30)},
        {(i, 99) for i in range(40)} | {(99, -i) for i in range(1, 30)},
        {(rng.randrange(60), rng.randrange(60)) for _ in range(90)},
        {(None, 1), (1, None), (1, 2), (2, 1)},
    ]
    rows, want = [], set()
    for r, edges in enumerate(relations):
        mids = {b for _, b in edges} & {a for a, _ in edges} - {None}
        rows.append({"key": f"k{r}", "_mids": [{"_ins": [{"src": a} for a, b in edges if b == m], "_outs": [{"dst": b} for a, b in edges if a == m]} for m in mids]})
        want |= {(f"k{r}", a, d) for a, b in edges for c, d in edges if b == c and b is not None}
    node = pa.int64()
    kind = pa.list_(pa.struct([("_ins", pa.list_(pa.struct([("src", node)]))), ("_outs", pa.list_(pa.struct([("dst", node)])))]))
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("_mids", kind)]))
    got = [tuple(r.values()) for out in fixpoint._through(batch, ["key"]) for r in out.to_pylist()]
    assert len(got) == len(set(got)) and set(got) == want


def test_naive_closure_has_no_row_per_way(spark, monkeypatch):
    """No operator of the composing plan may give a chain's n^3/6 ways as rows: both sides meet once per middle."""
    met = []
    kept = fixpoint.keep

    def noted(df, tag, **options):
        if tag == "composed":
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            met.append(plan.split("Join LeftOuter")[1].count("Aggregate ["))
        return kept(df, tag, **options)

    monkeypatch.setattr(fixpoint, "keep", noted)
    specs = spark.createDataFrame([(k, 40, 0) for k in range(3)], "chain long, n long, start long")
    closed = fixpoint.closure_naive(fixpoint.chain_facts(specs, ["chain"]), ["chain"], limit=1000)
    assert closed.count() == closed.distinct().count() == 3 * 820
    # The sides are lists by middle on both sides of the join.
    assert met and all(n == 2 for n in met)
