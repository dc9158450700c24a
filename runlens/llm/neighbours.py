"""Approximate nearest neighbours: a forest of sorted hash strings, met at the longest common prefix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from runlens.llm.blocks import table

EVERY = 50
NEAREST = 5
TREES = 96
BITS = 24
# The ascent goes on until the trees together name this share of a block's vectors, or ENOUGH of them.
SHARE = 0.4
ENOUGH = 500
# Vectors of one forest, and queries that go through it together.
BLOCK = 16_384
QUERIES = 1_024


def usable(vector: Column) -> Column:
    """Neither null nor zero nor with a null or non-finite component."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """Hash strings of signs against fixed hyperplanes, sorted per tree."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = 7):
        self.n, width = vectors.shape
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((width, trees * BITS)).astype(np.float32)
        self.trees = trees
        strings = self.strings(vectors)
        self.order = np.argsort(strings, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, axis=0)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """(vector, tree): the signs as a number, the first sign in its top bit."""
        out = np.zeros((len(vectors), self.trees), np.int64)
        unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        signs = (unit.astype(np.float32) @ self.planes > 0).reshape(len(vectors), self.trees, BITS)
        for bit in range(BITS):
            out = out << 1 | signs[:, :, bit]
        return out

    def candidates(self, queries: np.ndarray, share: float = SHARE, enough: int = ENOUGH) -> Iterator[np.ndarray]:
        """For each query the places of its candidates.

        In each tree the vectors that share a prefix with the query are a range of the sorted array. From the whole
        string on, all trees give up one bit at a time, until the ranges together are large enough; whole ranges are
        taken, so equal vectors come together.
        """
        strings = self.strings(queries)
        want = max(min(enough, self.n * self.trees), share * self.n)
        low = np.zeros((len(queries), self.trees), np.int64)
        high = np.zeros_like(low)
        open_rows = np.arange(len(queries))
        for gone in range(BITS + 1):
            prefix = strings[open_rows] >> gone
            a, b = np.empty_like(prefix), np.empty_like(prefix)
            for t in range(self.trees):
                a[:, t] = np.searchsorted(self.sorted[:, t], prefix[:, t] << gone)
                b[:, t] = np.searchsorted(self.sorted[:, t], (prefix[:, t] + 1) << gone)
            done = ((b - a).sum(axis=1) >= want) | (gone == BITS)
            low[open_rows[done]], high[open_rows[done]] = a[done], b[done]
            open_rows = open_rows[~done]
            if not len(open_rows):
                break
        for i in range(len(queries)):
            named = np.zeros(self.n, bool)
            for t in range(self.trees):
                named[self.order[low[i, t] : high[i, t], t]] = True
            yield np.flatnonzero(named)


class Measure:
    """Cosines to the vectors of a block, in double precision."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        # Scaled, so that squares neither overflow nor vanish.
        self.scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        self.norms = np.sqrt((self.scaled * self.scaled).sum(axis=1))
        self.rough = (self.scaled / self.norms[:, None]).astype(np.float32)

    def nearest(self, places: np.ndarray, query_id, query: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The ``k`` best (cosine, place) of the candidates, without the query's own id."""
        places = places[self.ids[places] != query_id]
        if not len(places):
            return []
        q = query / np.abs(query).max()
        size = np.sqrt((q * q).sum())
        if len(places) > k:  # single precision leaves out only what is clearly further away
            rough = self.rough[places] @ (q / size).astype(np.float32)
            places = places[rough >= np.partition(rough, -k)[-k] - 1e-4]
        score = (self.scaled[places] * q).sum(axis=1) / (self.norms[places] * size)
        order = np.lexsort((self.ids[places], -score))[:k]
        return [(float(score[j]), int(places[j])) for j in order]


def nearest_neighbours(vectors: DataFrame, every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` its ``k`` nearest found.

    Vectors go into blocks by a hash of their id, each with a forest; the query set, in blocks of its own, meets all
    of them, and the best of each block are merged. Null, zero and non-finite vectors and rows without id take no
    part; rows that share an id are one vector, the smallest; vectors of different lengths are not compared. Ties go to
    the smaller id. An empty table gives no rows; other columns are not read.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = (
        vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        .groupBy("vec_id")
        .agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))
        .withColumn("width", F.size("embedding"))
    )
    counts = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks, parts = max(1, -(-counts[0] // BLOCK)), max(1, -(-counts[1] // QUERIES))
    number = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))

    def packed(found: pa.Table) -> pa.Table:
        found = found.combine_chunks()
        flat = pa.concat_arrays(found.column("embedding").chunks).flatten().to_numpy()
        ids = pa.concat_arrays(found.column("vec_id").chunks)
        return pa.table(
            {
                "width": found.column("width")[:1],
                "block": found.column("block")[:1],
                "ids": pa.array([ids.to_pylist()], pa.list_(ids.type)),
                "flat": pa.array([flat.astype("<f8").tobytes()], pa.binary()),
            }
        )

    schema = f"width int, block long, ids array<{kind}>, flat binary"
    index = rows.withColumn("block", number % blocks).groupBy("width", "block").applyInArrow(packed, schema)
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("block", number % parts).groupBy("width", "block").applyInArrow(packed, schema)
    # Each query block goes to every index block; both are of bounded size.
    asked = asked.select("width", F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    met = index.join(asked, ["width", "block"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, forest, measure = None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                width, block = batch.column("width")[row].as_py(), batch.column("block")[row].as_py()
                ids_column = batch.column("ids")[row].values
                ids = ids_column.to_numpy(zero_copy_only=False)
                flat = np.frombuffer(batch.column("flat")[row].as_buffer(), "<f8").reshape(-1, width)
                if last != (width, block):
                    last, forest, measure = (width, block), Forest(flat), Measure(ids, flat)
                q_column = batch.column("q_ids")[row].values
                q_ids = q_column.to_numpy(zero_copy_only=False)
                queries = np.frombuffer(batch.column("q_flat")[row].as_buffer(), "<f8").reshape(-1, width)
                query, place, score = [], [], []
                for i, places in enumerate(forest.candidates(queries)):
                    for s, j in measure.nearest(places, q_ids[i], queries[i], k):
                        query.append(i)
                        place.append(j)
                        score.append(s)
                yield pa.RecordBatch.from_pydict(
                    {"query_id": q_column.take(pa.array(query, pa.int64())), "vec_id": ids_column.take(pa.array(place, pa.int64())), "score": pa.array(score, pa.float64())}
                )

    found = met.select("width", "block", "ids", "flat", "q_ids", "q_flat").mapInArrow(search, f"query_id {kind}, vec_id {kind}, score double")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark, sf_dir):
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
