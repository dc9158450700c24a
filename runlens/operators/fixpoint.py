"""Rules over fact tables, evaluated to a fixpoint, and the workloads that measure it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators.joins import salted_join, unbroadcast
from runlens.operators.ordered import GROUP_LIMIT, split_large
from runlens.session import keep, setting, tasks_for

# Bytes of relations that a Python worker gets at once, ways or cells of a matrix in one step, and ways from which on a
# relation may be a matrix.
BATCH = str(8 << 20)
STEP = 1 << 22
MATRIX = 4096


def _compose(first: DataFrame, second: DataFrame, keys: Sequence[str], limit: int, rows: int) -> DataFrame:
    """P x y and P y z give P x z; neither side has more than ``rows``."""
    left = first.select(*keys, "src", F.col("dst").alias("_mid"))
    right = second.select(*keys, F.col("src").alias("_mid"), "dst")
    on = [*keys, "_mid"]
    joined = left.join(right, on) if rows <= limit else salted_join(left, right, on, limit=limit)
    return joined.select(*keys, "src", "dst")


def _through(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The facts that lead through each ``_mid`` of the relations of ``batch``, each fact of a relation once.

    A relation is a row; ``_mids`` lists for each of its middles which sources lead there and which ends follow. Where many
    ways give few facts they are a product of matrices, block by block of the sources; the other ways are put together by
    source, up to ``STEP`` at once.
    """
    relations = batch.column("_mids")
    mids = relations.flatten()
    sides = mids.field("_ins"), mids.field("_outs")
    starts = [side.offsets.to_numpy().astype(np.int64) for side in sides]
    coded = [pc.dictionary_encode(side.flatten().field(0), null_encoding="encode") for side in sides]
    source, end = (c.indices.to_numpy().astype(np.int64) for c in coded)
    bounds = relations.offsets.to_numpy()
    of = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    into, out = (np.diff(v) for v in starts)
    ways = np.bincount(of, weights=into * out, minlength=batch.num_rows)

    def facts(relation: np.ndarray, src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
        columns = [*(batch.column(k).take(pa.array(relation)) for k in keys)]
        columns += [c.dictionary.take(pa.array(at)) for c, at in zip(coded, (src, dst))]
        return pa.RecordBatch.from_arrays(columns, [*keys, "src", "dst"])

    rest = np.ones(len(of), bool)
    for r in np.flatnonzero(ways >= MATRIX).tolist():
        low, high = int(bounds[r]), int(bounds[r + 1])
        names, places = zip(*(np.unique(v[s[low] : s[high]], return_inverse=True) for v, s in zip((source, end), starts)))
        middles = high - low
        if middles * len(names[1]) > STEP or middles * len(names[0]) * len(names[1]) > 64 * ways[r]:
            continue
        rest[low:high] = False
        middle = [np.repeat(np.arange(middles), n[low:high]) for n in (into, out)]
        after = np.zeros((middles, len(names[1])), np.float32)
        after[middle[1], places[1]] = 1
        order = np.argsort(places[0], kind="stable")
        block = max(1, STEP // max(middles, len(names[1])))
        for at in range(0, len(names[0]), block):
            own = order[np.searchsorted(places[0][order], at) : np.searchsorted(places[0][order], at + block)]
            before = np.zeros((min(block, len(names[0]) - at), middles), np.float32)
            before[places[0][own] - at, middle[0][own]] = 1
            src, dst = np.nonzero(before @ after)
            yield facts(np.full(len(src), r), names[0][src + at], names[1][dst])

    middle = np.repeat(np.arange(len(of)), into)
    entry = np.flatnonzero(rest[middle])
    entry = entry[np.lexsort((source[entry], of[middle[entry]]))]
    if not len(entry):
        return
    relation, src, middle = of[middle[entry]], source[entry], middle[entry]
    group = np.append(0, np.flatnonzero((np.diff(relation) != 0) | (np.diff(src) != 0)) + 1)
    done = np.append(0, np.cumsum(out[middle]))
    edges, at = np.append(group, len(entry)), 0
    while at < len(group):
        to = max(at + 1, int(np.searchsorted(done[edges], done[edges[at]] + STEP, side="right")) - 1)
        low, high = int(edges[at]), int(edges[to])
        number = out[middle[low:high]]
        way = np.repeat(np.arange(low, high), number)
        place = np.arange(done[low], done[high]) - done[way] + starts[1][middle[way]]
        here = np.searchsorted(group, way, side="right") - 1
        fact = np.unique(here * len(coded[1].dictionary) + end[place])
        here, dst = np.divmod(fact, len(coded[1].dictionary))
        yield facts(relation[group[here]], src[group[here]], dst)
        at = to


def _compose_whole(every: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``every`` and what it gives composed with itself, each fact once; a relation stays in one task from join to merge.

    The sides meet by their middle with a list of all sources and one of all ends, so a way from a source to an end is
    never a row of its own. The middle is one of the ends: these ways are the facts given.
    """
    spark = every.sparkSession
    tasks = tasks_for(spark, rows) or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = every.repartition(tasks, *keys)
    # In a struct, as lists leave out nulls.
    left = placed.groupBy(*keys, F.col("dst").alias("_mid")).agg(F.collect_list(F.struct("src")).alias("_ins"))
    right = placed.groupBy(*keys, F.col("src").alias("_mid")).agg(F.collect_list(F.struct("dst")).alias("_outs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _through(batch, keys)

    with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"), setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH):
        met = left.join(unbroadcast(right), [*keys, "_mid"], "left")
        own = F.struct(F.col("_mid").alias("dst"))
        ends = F.when(F.col("_outs").isNull(), F.array(own)).otherwise(F.array_append("_outs", own))
        relations = met.groupBy(*keys).agg(F.collect_list(F.struct("_ins", ends.alias("_outs"))).alias("_mids"))
        return keep(relations.mapInArrow(run, every.schema), "composed")


def closure(
    facts: DataFrame, keys: Sequence[str] = (), max_rounds: int | None = None, limit: int = GROUP_LIMIT
) -> DataFrame:
    """All facts ``src, dst`` that follow by transitivity, with the round that first gave them.

    Incremental: a fact of round r has a shortest chain of more than 2^(r-1) and at most 2^r steps. The first 2^(r-1)
    steps of that chain are the shortest way to where they end, so only facts of exactly that length meet the others,
    on the left, and a chain is put together once instead of at each of its places. It ends when a round gives nothing
    new or ``max_rounds`` are done. ``keys`` keep separate relations apart. Each round is written once, so a lost
    executor costs one round at most; the plan grows by one table a round, with the logarithm of the depth. Above ``limit`` rows
    no facts are broadcast: their files are much smaller than they are in memory.
    """
    fact = [*keys, "src", "dst"]
    start = facts.select(*fact).distinct().withColumns({"steps": F.lit(1).cast("long"), "round": F.lit(0)})
    known = [keep(start, "facts")]
    rows = known[0].count()
    number = 0
    while max_rounds is None or number < max_rounds:
        number += 1
        every = reduce(DataFrame.unionByName, known)
        left = known[-1].filter(F.col("steps") == 2 ** (number - 1))
        left = left.select(*keys, "src", F.col("dst").alias("_mid"), F.col("steps").alias("_steps"))
        right = every.select(*keys, F.col("src").alias("_mid"), "dst", "steps")
        # No key has more rows than its table.
        on = [*keys, "_mid"]
        met = left.join(right, on) if rows <= limit else salted_join(left, right, on, limit=limit, collected=False)
        found = met.groupBy(*fact).agg(F.min(F.col("_steps") + F.col("steps")).alias("steps"))
        old = every.select(*fact) if rows <= limit else unbroadcast(every.select(*fact))
        fresh = keep(found.join(old, fact, "left_anti").withColumn("round", F.lit(number)), "facts")
        new = fresh.count()
        if not new:
            break
        known.append(fresh)
        rows += new
    return reduce(DataFrame.unionByName, known).drop("steps")


def closure_naive(
    facts: DataFrame, keys: Sequence[str] = (), max_rounds: int | None = None, limit: int = GROUP_LIMIT
) -> DataFrame:
    """The same facts by joining all with all in every round, until their number stands still.

    A fact is put together at each place of its chain, so a relation of n facts in a chain has n^3/6 ways a round.
    Relations of up to ``limit`` facts are composed each in one task, where those ways are no rows and only facts come out.
    """
    fact = [*keys, "src", "dst"]
    every = keep(facts.select(*fact).distinct(), "facts")
    size, number = every.count(), 0
    while max_rounds is None or number < max_rounds:
        number += 1
        whole, cut = (every, None) if size <= limit else split_large(every, keys, limit, size)
        if whole is not None and keys and size > limit:
            done = [_compose_whole(whole, keys, size)]
            parts = [] if cut is None else [cut]
        else:
            done, parts = [], [every]
            if whole is not None:
                parts.append(_compose(whole, whole, keys, limit, size))
        if cut is not None:
            parts.append(_compose(cut, cut, keys, limit, size))
        if parts:
            done.append(keep(reduce(DataFrame.unionByName, parts).distinct(), "facts"))
        every = reduce(DataFrame.unionByName, done)
        now = every.count()
        if now == size:
            break
        size = now
    return every


def derived_counts(closed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Given and derived facts per relation."""
    return closed.groupBy(*keys).agg(
        F.count_if(F.col("round") == 0).alias("given"), F.count_if(F.col("round") > 0).alias("derived")
    )


def match_depth(facts: DataFrame, binding: Sequence[str], slots: Sequence[str], predicate: str = "predicate") -> DataFrame:
    """How far a rule with the premises ``slots`` gets for each binding, tried from the last slot.

    ``depth`` is the number of filled slots before the first gap; ``matched`` says that all are filled.
    """
    flags = [F.max(F.when(F.col(predicate) == s, True).otherwise(False)).alias(f"_s{i}") for i, s in enumerate(slots)]
    depth = F.lit(0)
    for i in range(len(slots)):
        depth = F.when(F.col(f"_s{i}"), depth + 1).otherwise(0)
    rows = facts.groupBy(*binding).agg(*flags)
    return rows.select(*binding, depth.alias("depth"), (depth == len(slots)).alias("matched"))


def chain_facts(specs: DataFrame, keys: Sequence[str], chunk: int = 10_000) -> DataFrame:
    """Chains of ``n`` facts start → start+1 → … per row of ``specs`` (keys, ``n``, ``start``)."""
    pieces = specs.filter(F.col("n") > 0).select(
        *keys, "n", "start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(chunk).cast("bigint"))).alias("_from")
    )
    to = F.least(F.col("_from") + chunk, F.col("n")) - 1
    steps = pieces.select(*keys, "start", F.explode(F.sequence("_from", to)).alias("_i"))
    return steps.select(*keys, (F.col("start") + F.col("_i")).alias("src"), (F.col("start") + F.col("_i") + 1).alias("dst"))


def depth_facts(specs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Facts ``predicate, n`` per row of ``specs`` (keys, ``premises``, ``inert``, ``depth``, ``a``).

    Premises P0 … hold at ``a``, but the one at index premises − depth − 1 holds at a + 1; inert facts
    Q0 … hold at ``a``.
    """
    index = F.col("_i")
    active = specs.select(
        *keys, "premises", "depth", "a", F.explode(F.sequence(F.lit(0), F.col("premises") - 1)).alias("_i")
    ).select(
        *keys,
        F.concat(F.lit("P"), index.cast("string")).alias("predicate"),
        F.when(index + 1 == F.col("premises") - F.col("depth"), F.col("a") + 1).otherwise(F.col("a")).alias("n"),
    )
    inert = specs.filter(F.col("inert") > 0).select(
        *keys, "a", F.explode(F.sequence(F.lit(0), F.col("inert") - 1)).alias("_i")
    ).select(*keys, F.concat(F.lit("Q"), index.cast("string")).alias("predicate"), F.col("a").alias("n"))
    return active.unionByName(inert)
