"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.blocks import IS_WHITE, LOWER, fresh_name, row_scores, slices, table, text_bytes, word_places
from runlens.llm.components import components
from runlens.session import keep

SHINGLE = 3
SEED = 42
RADIUS = 2
# Fingerprints compared at once; larger groups are split by further equal bits, without loss.
MOST = 2048
PARTS = 4


def fingerprints(column: pa.Array) -> np.ndarray:
    """One unsigned 64-bit number per text; a text without words has 0."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = word_places(data, offsets)
    counts = np.diff(first)
    # The words with one space after each; where each begins and ends there.
    sizes = ends - starts
    ends_in = np.cumsum(sizes + 1) - 1
    starts_in = ends_in - sizes
    joined = np.full(int(ends_in[-1]) + 1 if len(ends_in) else 0, 32, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[ends_in] = False
    word_byte = ~IS_WHITE[data]
    joined[inside] = data[word_byte]
    flat = joined.tobytes()
    shingles = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    of = np.repeat(np.arange(len(counts)), shingles)
    rank = np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    begin = first[:-1][of] + rank
    last = np.minimum(begin + SHINGLE, first[1:][of]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(flat[s:e], SEED) for s, e in zip(starts_in[begin].tolist(), ends_in[last].tolist())), np.uint64, len(of)
    )
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(shingles)
    if len(some):
        heads = (np.cumsum(shingles) - shingles)[some]
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > shingles[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def compute(part: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"doc_id": part.column("doc_id"), "fp": pa.array(fingerprints(part.column("text")).view(np.int64))}

    return row_scores(docs.select("doc_id", "text"), compute, f"doc_id {kind}, fp long")


def masks(fixed: int = 0) -> list[int]:
    """``fixed`` and two of the four equal parts of its free bits, in all six ways.

    Two fingerprints that agree in ``fixed`` and differ in at most two bits agree in two of the parts.
    """
    free = [b for b in range(64) if not fixed >> b & 1]
    size = len(free) // PARTS
    parts = [sum(1 << b for b in free[i * size : (i + 1) * size]) for i in range(PARTS)]
    return [fixed | sum(pair) for pair in combinations(parts, PARTS - RADIUS)]


def close_pairs(members: np.ndarray, fixed: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each member (by place) the later members at ``RADIUS`` or fewer differing bits.

    The bits outside ``fixed`` are stored as planes, 64 members to a number. A two-bit carry-save counter per member
    counts differences; queries whose every counter has passed the radius leave the block, and the block is given up
    when none is left.
    """
    n = len(members)
    width = -(-n // 64)
    free = [b for b in range(64) if not fixed >> b & 1]
    planes = np.zeros((len(free), width * 64), np.uint8)
    for i, b in enumerate(free):
        planes[i, :n] = members >> np.uint64(b) & np.uint64(1)
    planes = np.packbits(planes, axis=1, bitorder="little").view(np.uint64)
    for low in range(0, n, 256):
        query = np.arange(low, min(low + 256, n))
        over = np.packbits(np.arange(width * 64)[None, :] <= query[:, None], axis=1, bitorder="little").view(np.uint64)
        if n % 64:
            over[:, -1] |= np.uint64(2**64 - 2 ** (n % 64))
        ones, twos = np.zeros_like(over), np.zeros_like(over)
        for i, b in enumerate(free):
            differs = planes[i][None, :] ^ (np.uint64(0) - (members[query] >> np.uint64(b) & np.uint64(1)))[:, None]
            carry = ones & differs
            ones ^= differs
            over |= twos & carry
            twos ^= carry
            if i % 8 == 7:
                alive = (over | (twos & ones)) != np.uint64(2**64 - 1)
                alive = alive.any(axis=1)
                if not alive.all():
                    query, over, ones, twos = query[alive], over[alive], ones[alive], twos[alive]
                if not len(query):
                    break
        for place, dead in zip(query, over | (twos & ones)):
            later = np.flatnonzero(np.unpackbits(dead.view(np.uint8), bitorder="little")[:n] == 0)
            if len(later):
                yield int(place), later


def forest(members: np.ndarray, fixed: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the close pairs: each member with the first of its tree."""
    label = np.arange(len(members))
    for place, later in close_pairs(members, fixed):
        met = np.unique(np.append(label[later], label[place]))
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    linked = np.flatnonzero(label != np.arange(len(members)))
    return members[linked], members[label[linked]]


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that join exactly the fingerprints (column fp, distinct) reachable at ``RADIUS`` bits a step.

    Groups agree in 32 bits. A group beyond ``MOST`` is dealt anew by 48, then 56 equal bits, where 256 distinct
    numbers are the most there can be.
    """

    def compare(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def out(rows: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
                fixed, group, fp = (rows.column(i).to_numpy() for i in range(3))
                edge = np.flatnonzero((np.diff(fixed) != 0) | (np.diff(group) != 0)) + 1
                bounds = np.concatenate([[0], edge, [len(fp)]])
                if not whole:
                    held.append(rows.slice(int(bounds[-2])).combine_chunks().to_batches()[0])
                    bounds = bounds[:-1]
                found: list[tuple[int, np.ndarray, np.ndarray]] = []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    if b - a > 1:
                        members = np.unique(fp[a:b].view(np.uint64))  # several coarser groups may lead here
                        if len(members) > MOST and not last:
                            found.append((int(fixed[a]), members, members))
                        else:
                            found.append((0, *forest(members, int(fixed[a]) & (2**64 - 1))))
                for mask, left, right in found:
                    if len(left):
                        yield pa.RecordBatch.from_pydict(
                            {
                                "mask": pa.array(np.full(len(left), mask, np.int64)),
                                "a": pa.array(left.view(np.int64)),
                                "b": pa.array(right.view(np.int64)),
                            }
                        )

            for batch in batches:
                rows = pa.Table.from_batches([*held, batch])
                held.clear()
                if rows.num_rows:
                    yield from out(rows, False)
            if held:
                rows = pa.Table.from_batches(held)
                held.clear()
                yield from out(rows, True)

        return run

    signed = lambda m: m - 2**64 if m >= 2**63 else m
    rows = prints.select(F.explode(F.array(*[F.lit(signed(m)).cast("long") for m in masks()])).alias("mask"), "fp")
    edges = None
    for last in (False, False, True):
        grouped = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("part"), "fp").repartition("mask", "part")
        found = keep(grouped.sortWithinPartitions("mask", "part").mapInArrow(compare(last), "mask long, a long, b long"), "close")
        new = found.where("mask = 0").select("a", "b")
        edges = new if edges is None else edges.union(new)
        large = found.where("mask <> 0")
        if last or large.isEmpty():
            return edges
        again = [r["mask"] for r in large.select("mask").distinct().collect()]  # six or 36 numbers at most
        finer = F.create_map(*[x for m in again for x in (F.lit(m), F.array(*[F.lit(signed(k)) for k in masks(m & (2**64 - 1))]))])
        rows = large.select(F.explode(finer[F.col("mask")]).alias("mask"), F.col("a").alias("fp"))
    return edges


def classes(marked: DataFrame) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint of ``marked`` (doc_id, fp)."""
    prints = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "prints")
    labels = components(links(prints.select("fp"))).toDF("fp", "root")
    rooted = prints.join(labels, "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs``.

    Nulls: a null text is empty (fingerprint zero, like every text without words); a null doc_id takes part and is
    never a component's id unless all its members are null. Repeated rows give repeated rows, an empty table none;
    other columns are not read.
    """
    marked = keep(fingerprint_rows(docs), "fingerprints")
    return marked.join(classes(marked), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, of the smallest doc_id, with all its columns; of equal rows one stays."""
    name, mark = fresh_name(docs, "fp"), fresh_name(docs, "chosen")

    @F.arrow_udf("long")
    def fp(text: pa.Array) -> pa.Array:
        if not len(text):
            return pa.array([], pa.int64())
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        return pa.concat_arrays([pa.array(fingerprints(p.column(0)).view(np.int64)) for p in slices(batch)])

    marked = keep(fingerprint_rows(docs), "fingerprints")
    chosen = (
        marked.join(classes(marked), "fp")
        .groupBy("root")
        .agg(F.min_by(F.struct("doc_id", "fp"), F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("one"))
        .select(F.col("one.doc_id").alias(mark), F.col("one.fp").alias(mark + "_fp"))
    )
    found = docs.withColumn(name, fp(F.col("text")))
    joined = found.join(chosen, found["doc_id"].eqNullSafe(chosen[mark]) & (found[name] == chosen[mark + "_fp"]), "left_semi")
    return joined.dropDuplicates(["doc_id", name]).drop(name)


def op10(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
