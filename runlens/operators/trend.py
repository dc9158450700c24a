"""Trends and distributions of a paired measure: means by x, fences, densities, smoothing."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators.ordered import GROUP_LIMIT, scan_groups, value_counts
from runlens.operators.quantiles import percentile_numbers, percentiles
from runlens.session import keep


def mean_by(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean of ``y`` per distinct ``x``."""
    return df.groupBy(x).agg(F.avg(y).alias(f"avg_{y}"))


def inside_fence(df: DataFrame, value: str, factor: float = 3.0) -> DataFrame:
    """Rows within ``factor`` interquartile ranges around the quartiles, bounds included."""
    q1, q3 = percentile_numbers(df, value, [0.25, 0.75])
    if q1 is None:
        return df.limit(0)
    reach = factor * (q3 - q1)
    return df.filter(F.col(value).between(q1 - reach, q3 + reach))


def group_profile(df: DataFrame, x: str, y: str) -> DataFrame:
    """Per distinct ``x``: rows, median and highest ``y``, and the highest ``y`` of all rows."""
    shape = df.groupBy(x).agg(F.count("*").alias("rows"), F.max(y).alias("high"))
    medians = percentiles(df, [x], y, {"median": 0.5}).drop("total")
    top = df.agg(F.max(y)).first()[0]
    return shape.join(medians, x).withColumn("overall_high", F.lit(top))


def density(df: DataFrame, keys: Sequence[str], value: str, points: int = 100) -> DataFrame:
    """Gaussian kernel density per group on ``points`` places from its lowest to highest value.

    The bandwidth is Scott's: n^(-1/5) times the sample deviation. Groups with one value only have no
    curve. Each distinct value is spread over the grid and summed in place before the shuffle.
    """
    valued = df.filter(F.col(value).isNotNull())
    counts = value_counts(valued, keys, value)
    shape = valued.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.min(value).alias("_low"),
        F.max(value).alias("_high"),
        F.stddev_samp(value).alias("_sd"),
    )
    shape = shape.filter(F.col("_sd") > 0).withColumn(
        "bandwidth", F.pow(F.col("rows").cast("double"), F.lit(-0.2)) * F.col("_sd")
    )
    if keys:
        rows = counts.join(shape, list(keys))
    else:
        one = shape.first()
        if one is None:
            one = {"rows": None, "_low": None, "_high": None, "bandwidth": None}
            counts = counts.limit(0)
        rows = counts.withColumns(
            {
                "rows": F.lit(one["rows"]).cast("long"),
                "_low": F.lit(one["_low"]).cast("double"),
                "_high": F.lit(one["_high"]).cast("double"),
                "bandwidth": F.lit(one["bandwidth"]).cast("double"),
            }
        )
    step = (F.col("_high") - F.col("_low")) / F.lit(points - 1)
    spread = rows.select(
        *keys, value, "n", "rows", "bandwidth", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"),
        F.col("_low"), step.alias("_step"),
    ).withColumn("x", F.col("_low") + F.col("i") * F.col("_step"))
    gap = (F.col("x") - F.col(value)) / F.col("bandwidth")
    mass = F.sum(F.col("n") * F.exp(gap * gap * F.lit(-0.5)))
    scale = F.first("rows") * F.first("bandwidth") * F.lit(math.sqrt(2 * math.pi))
    return spread.groupBy(*keys, "i").agg(F.first("x").alias("x"), (mass / scale).alias("density"))


_SUMS = ("s0", "s1", "s2", "t0", "t1")
# Powers of a point that its tricube weight (power 9) times its square needs.
_ORDERS = 12


def _edge_sums():
    """The task function, made here so that it travels with the job and tasks need not import this package."""

    def sums_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Weighted sums of one block of sources around one block of targets, point by point."""
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                tx, th = np.asarray(row.tx, float)[:, None], np.asarray(row.th, float)[:, None]
                sx, sw, sy = (np.asarray(v, float)[None, :] for v in (row.sx, row.sw, row.sy))
                u = (sx - tx) / np.where(th > 0, th, 1.0)
                near = np.clip(1.0 - np.abs(u) ** 3, 0.0, None) ** 3
                near = np.where(th > 0, near, (sx == tx).astype(float))
                weight, value = near * sw, near * sy
                sums = {
                    "s0": weight.sum(1),
                    "s1": (weight * u).sum(1),
                    "s2": (weight * u * u).sum(1),
                    "t0": value.sum(1),
                    "t1": (value * u).sum(1),
                }
                out.append(pd.DataFrame({"j": np.asarray(row.tj, "int64"), **sums}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return sums_of


def _node_sums():
    """Like ``_edge_sums`` for nodes: blocks of sources known by their moments, wholly inside every target's reach."""
    side = {}
    for sign in (-1, 1):  # weight (1 - |u|^3)^3 left and right of the target, as powers of u
        weight = np.zeros(10)
        weight[[0, 3, 6, 9]] = [1, -3 * sign, 3, -sign]
        for q in range(3):
            power = np.concatenate([np.zeros(q), weight, np.zeros(2 - q)])
            # Row j: the factor of v^j in the polynomial at u + v, as powers of u.
            side[sign, q] = np.array(
                [[power[j + i] * math.comb(j + i, j) if i + j < _ORDERS else 0.0 for i in range(_ORDERS)] for j in range(_ORDERS)]
            )

    def sums_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                tx, th = np.asarray(row.tx, float)[:, None], np.asarray(row.th, float)[:, None]
                centre, radius = np.asarray(row.centre, float)[None, :], np.asarray(row.radius, float)[None, :]
                moments = {"s": np.stack(row.m), "t": np.stack(row.my)}
                left = centre[0] < tx[0]
                sums = {name: np.zeros(len(tx)) for name in _SUMS}
                for sign, some in ((-1, left), (1, ~left)):
                    if not some.any():
                        continue
                    u = ((centre[:, some] - tx) / th).ravel()
                    scale = (radius[:, some] / th)[None] ** np.arange(_ORDERS)[:, None, None]
                    powers = u[None, :] ** np.arange(_ORDERS)[:, None]
                    for name, q in (("s0", 0), ("s1", 1), ("s2", 2), ("t0", 0), ("t1", 1)):
                        factor = (side[sign, q] @ powers).reshape(_ORDERS, len(tx), -1) * scale
                        sums[name] += np.einsum("jtn,nj->t", factor, moments[name[0]][some])
                out.append(pd.DataFrame({"j": np.asarray(row.tj, "int64"), **sums}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return sums_of


def _moments_of():
    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Moments of one block's points for each node above it, around the node's centre in units of its radius."""
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                x, w, wy = (np.asarray(v, float) for v in (row.sx, row.sw, row.sy))
                for node in row.path:
                    v = ((x - node["centre"]) / node["radius"])[None, :] ** np.arange(_ORDERS)[:, None]
                    out.append([node["level"], node["idx"], *(v @ w), *(v @ wy)])
            if out:
                yield pd.DataFrame(out, columns=["level", "idx", *_moment_names()])

    return moments


def _moment_names() -> list[str]:
    return [f"{kind}{i}" for kind in ("m", "y") for i in range(_ORDERS)]


def _parts_of():
    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The fewest nodes (level, idx) of a binary tree over the blocks that make up ``low`` to ``high``."""
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                low, end, level = int(row.low), int(row.high) + 1, 0
                while low < end:
                    if low & 1:
                        out.append((row.target, level, low))
                        low += 1
                    if end & 1:
                        end -= 1
                        out.append((row.target, level, end))
                    low, end, level = low >> 1, end >> 1, level + 1
            yield pd.DataFrame(out, columns=["target", "level", "idx"]).astype("int64")

    return parts


def _reach(grid: DataFrame, rows: int, k: int, limit: int, size: int) -> DataFrame:
    """Per distinct x: distance ``h`` of its k-th nearest row and the blocks of those k rows.

    The k nearest rows are consecutive in order. Their start ``a`` is the first with
    v[a] + v[a+k] >= 2x, and that sum only grows with a; so one running maximum gives v[a], v[a+k-1]
    and v[a+k] for every start, and one running minimum from above gives the start of every x.
    """
    before = F.col("upto") - F.col("n")
    none_d, none_l = F.lit(None).cast("double"), F.lit(None).cast("long")

    def event(pos, first=none_d, first_block=none_l, last=none_d, last_block=none_l, after=none_d):
        return F.struct(
            F.greatest(pos, F.lit(0)).cast("long").alias("pos"), first.alias("first"),
            first_block.alias("first_block"), last.alias("last"), last_block.alias("last_block"),
            after.alias("after"),
        )

    x, block = F.col("x"), F.col("block")
    events = grid.select(
        F.explode(
            F.array(
                event(before, first=x, first_block=block),
                event(before - F.lit(k - 1), last=x, last_block=block),
                event(before - F.lit(k), after=x),
                event(F.lit(rows - k)),
            )
        ).alias("e")
    ).select("e.*")
    names = ["first", "first_block", "last", "last_block", "after"]
    starts = events.filter(F.col("pos") <= rows - k).groupBy("pos").agg(*[F.max(c).alias(c) for c in names])
    starts = scan_groups(starts, [], ["pos"], running={f"r_{c}": ("max", c) for c in names}, limit=limit, rows=3 * size + 1)
    total = F.when(F.col("pos") < rows - k, F.col("r_first") + F.col("r_after")).otherwise(float("inf"))
    offers = starts.select(
        (-total).alias("key"),
        F.lit(0).alias("kind"),
        none_l.alias("j"),
        none_d.alias("x"),
        none_l.alias("block"),
        F.struct("pos", "r_first", "r_first_block", "r_last", "r_last_block").alias("start"),
    )
    wanted = grid.select(
        (x * F.lit(-2.0)).alias("key"), F.lit(1).alias("kind"), "j", "x", "block",
        F.lit(None).cast(offers.schema["start"].dataType).alias("start"),
    )
    met = scan_groups(
        offers.unionByName(wanted), [], ["key", "kind"], running={"found": ("min", "start")}, limit=limit, rows=4 * size + 1
    ).filter(F.col("kind") == 1)
    first, last = F.col("found.r_first"), F.col("found.r_last")
    return met.select(
        "j",
        "x",
        "block",
        F.greatest(x - first, last - x).alias("h"),
        F.col("found.r_first_block").alias("from_block"),
        F.col("found.r_last_block").alias("to_block"),
    )


def _tree(grid: DataFrame, blocks: int) -> DataFrame:
    """Per block the nodes above it: ``block, path`` of (level, idx, centre, radius). A node of level l holds 2^l blocks."""
    levels = max(1, (blocks - 1).bit_length())
    shape = grid.groupBy("block").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    above = shape.select("block", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    above = above.withColumn("idx", F.expr("shiftright(block, level)"))
    nodes = above.groupBy("level", "idx").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    radius = (F.col("high") - F.col("low")) / 2
    nodes = nodes.select(
        "level", "idx", ((F.col("low") + F.col("high")) / 2).alias("centre"), F.when(radius > 0, radius).otherwise(1.0).alias("radius")
    )
    path = F.collect_list(F.struct("level", "idx", "centre", "radius")).alias("path")
    return above.select("block", "level", "idx").join(nodes, ["level", "idx"]).groupBy("block").agg(path)


def lowess(
    points: DataFrame,
    x: str,
    y: str,
    frac: float = 0.2,
    passes: int = 3,
    block: int = 256,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Locally weighted linear fit of ``y`` at every distinct ``x``: columns x, ``rows``, ``fit``.

    Each fit uses the k = int(frac·rows + 1e-10) nearest rows with tricube weights; every pass after
    the first re-weights rows by their residual (bisquare, six median absolute residuals). Where the
    k nearest rows share one x the fit is their weighted mean.

    Rows merge per distinct x, and per distinct (x, y) for the passes. Distinct x form blocks of fixed
    size. Between the blocks where the reach of a block's targets begins and ends and the block itself,
    every source lies wholly inside the reach and on one side of all targets; there the weight is one
    polynomial, so that the sums follow from the moments of the sources. Moments are kept per node of a
    binary tree over the blocks, each around its own centre, and a block of targets asks for a
    logarithmic number of nodes. Only the blocks at the borders and the block itself are summed point by
    point: borders move one way along x, so there are a few blocks per block of targets over the table.
    """
    valued = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = valued.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(1).alias("n"))
    if passes:
        cells = keep(cells.groupBy("x", "y").agg(F.sum("n").alias("n")), "lowess-cells")
    per_x = cells.groupBy("x").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("ny"))
    per_x = keep(per_x, "lowess-x")
    size, rows = per_x.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    per_x = per_x.withColumn("_one", F.lit(1).cast("long"))
    grid = scan_groups(per_x, [], ["x"], running={"upto": ("sum", "n"), "j": ("sum", "_one")}, limit=limit, rows=size)
    grid = keep(grid.withColumn("block", F.floor((F.col("j") - 1) / block)).drop("_one"), "lowess-grid")
    k = min(max(int(frac * rows + 1e-10), 1), max(rows, 1))

    reach = _reach(grid, rows, k, limit, size)
    per_block = reach.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("j", "x", "h"))).alias("t"),
        *[fn(c).alias(f"{name}_{c}") for c in ("from_block", "to_block") for name, fn in (("min", F.min), ("max", F.max))],
    )
    per_block = keep(
        per_block.select(
            "block", F.col("t.j").alias("tj"), F.col("t.x").alias("tx"), F.col("t.h").alias("th"), *per_block.columns[2:]
        ),
        "lowess-targets",
    )
    own = F.col("block")
    borders = F.array_union(
        F.sequence("min_from_block", F.least("max_from_block", own)), F.sequence(F.greatest("min_to_block", own), "max_to_block")
    )
    edges = per_block.select("tj", "tx", "th", F.explode(F.array_union(borders, F.array(own))).alias("block"))
    blocks = -(-size // block)
    asked = tree = None
    if blocks > 2:  # else all blocks are borders
        between = F.array(
            F.struct((F.col("max_from_block") + 1).alias("low"), (own - 1).alias("high")),
            F.struct((own + 1).alias("low"), (F.col("min_to_block") - 1).alias("high")),
        )
        ranges = per_block.select(own.alias("target"), F.explode(between).alias("r")).select("target", "r.*").filter("low <= high")
        asked = keep(ranges.mapInPandas(_parts_of(), "target long, level long, idx long"), "lowess-asked")
        tree = keep(_tree(grid, blocks), "lowess-tree")

    def fit_with(weights: DataFrame) -> DataFrame:
        """``weights``: block, x, w and wy per distinct x."""
        sources = weights.groupBy("block").agg(F.collect_list(F.struct("x", "w", "wy")).alias("s"))
        sources = sources.select("block", F.col("s.x").alias("sx"), F.col("s.w").alias("sw"), F.col("s.wy").alias("sy"))
        schema = "j long, " + ", ".join(f"{c} double" for c in _SUMS)
        if asked is not None:
            sources = keep(sources, "lowess-sources")
        met = edges.join(sources, "block").select("tj", "tx", "th", "sx", "sw", "sy")
        sums = met.mapInPandas(_edge_sums(), schema)
        if asked is not None:
            names = _moment_names()
            found = sources.join(tree, "block").select("sx", "sw", "sy", "path")
            nodes = found.mapInPandas(_moments_of(), "level long, idx long, " + ", ".join(f"{c} double" for c in names))
            nodes = nodes.groupBy("level", "idx").agg(*[F.sum(c).alias(c) for c in names])
            shape = tree.select(F.explode("path").alias("p")).select("p.*").distinct()
            node = F.struct(
                "centre", "radius", F.array(*names[:_ORDERS]).alias("m"), F.array(*names[_ORDERS:]).alias("my")
            )
            lists = asked.join(nodes.join(shape, ["level", "idx"]), ["level", "idx"]).groupBy("target").agg(F.collect_list(node).alias("n"))
            whole = lists.join(per_block.select(own.alias("target"), "tj", "tx", "th"), "target")
            whole = whole.select("tj", "tx", "th", *[F.col(f"n.{c}").alias(c) for c in ("centre", "radius", "m", "my")])
            sums = sums.unionByName(whole.mapInPandas(_node_sums(), schema))
        sums = sums.groupBy("j").agg(*[F.sum(c).alias(c) for c in _SUMS])
        mean_u, mean_y = F.try_divide("s1", "s0"), F.try_divide("t0", "s0")
        var = F.try_divide("s2", "s0") - mean_u * mean_u
        cov = F.try_divide("t1", "s0") - mean_u * mean_y
        line = F.when(var > 1e-12, mean_y - mean_u * F.try_divide(cov, var)).otherwise(mean_y)
        fits = sums.select("j", F.when(F.col("s0") > 0, line).alias("_line"))
        out = grid.join(fits, "j").select(
            "x", "n", "block", F.coalesce(F.col("_line"), F.col("ny") / F.col("n")).alias("fit")
        )
        return keep(out, "lowess-fit")

    fit = fit_with(grid.select("block", "x", F.col("n").cast("double").alias("w"), F.col("ny").alias("wy")))
    size = cells.count() if passes else 0
    for _ in range(passes):
        resid = cells.join(fit.select("x", "block", "fit"), "x").withColumn(
            "r", F.abs(F.col("y") - F.col("fit"))
        )
        resid = keep(resid, "lowess-residuals")
        middle = percentile_numbers(resid, "r", [0.5], limit, n="n", size=size)[0]
        if middle is None:
            break
        if middle > 0:
            u = F.col("r") / F.lit(6.0 * middle)
        else:
            u = F.when(F.col("r") > 0, 1.0).otherwise(0.0)
        w = F.when(u < 1, F.pow(1 - u * u, F.lit(2.0))).otherwise(0.0) * F.col("n")
        fit = fit_with(
            resid.groupBy("block", "x").agg(F.sum(w).alias("w"), F.sum(w * F.col("y")).alias("wy"))
        )
    return fit.select(F.col("x").alias(x), F.col("n").alias("rows"), "fit")
