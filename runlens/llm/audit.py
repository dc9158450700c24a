"""Filter interaction audit: what each filter removes in every order, from one contingency tensor per part."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.blocks import table
from runlens.session import keep

# The filters' letters; a document's mask has bit i set where it fails the filter of letter i.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # percent of the words
MOST_CAPITALS = 3  # percent of the characters
SYMBOLS = "[#$%&*|]"
WHITE = r"[\x20\x09-\x0D]+"
REPEATED = 1 << FILTERS.index("E")
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D, which look at one text alone."""
    words = F.array_remove(F.split(text, WHITE), "")
    total, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    fails = [
        total < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT * total,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        text.rlike(SYMBOLS),
    ]
    return sum((fail.cast("int") * (1 << i) for i, fail in enumerate(fails)), F.lit(0))


def outcomes(docs: DataFrame) -> DataFrame:
    """(part, doc_id, digest, mask, n): equal rows counted, the mask without filter E."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.select(
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
            "doc_id",
            F.unhex(F.sha2(text, 256)).alias("digest"),
            text_mask(text).alias("mask"),
        )
        .groupBy("part", "doc_id", "digest", "mask")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def contingency(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failed filters, and those of them with a label 1.

    Filter E fails a document whose text a smaller id has. All rows of one text have one mask otherwise, so the rows of
    the smallest id are counted apart and taken off the others: no group of copies meets in one task.
    """
    rows = keep(outcomes(docs), "outcomes")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("toxic"),
    )
    least = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = rows.join(least, ["digest", "doc_id"], "left_semi").unionByName(rows.where("doc_id is null"))

    def moved(some: DataFrame, bit: int, sign: int) -> DataFrame:
        return some.select("part", "doc_id", F.col("mask").bitwiseOR(bit).alias("mask"), (sign * F.col("n")).alias("n"))

    signed = moved(rows, REPEATED, 1).unionByName(moved(first, REPEATED, -1)).unionByName(moved(first, 0, 1))
    counted = signed.groupBy("part", "doc_id", "mask").agg(F.sum("n").alias("n")).where("n <> 0")
    return (
        counted.join(marks, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
            F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
        )
    )


class Contractions:
    """Selections of pass, fail or all along each filter's axis, for every step of every order."""

    def __init__(self, filters: str = FILTERS):
        self.axes = len(filters)
        orders = list(permutations(range(self.axes)))
        self.names = ["".join(filters[i] for i in order) for order in orders for _ in order]
        self.steps = np.tile(np.arange(1, self.axes + 1, dtype=np.int32), len(orders))
        self.filter = np.array([i for order in orders for i in order])
        passes, fails, every = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
        pick = {name: np.tile(every, (len(self.filter), self.axes, 1)) for name in ("kept", "removed", "failing", "only")}
        at = 0
        for order in orders:
            for step, own in enumerate(order):
                earlier = list(order[:step])
                pick["kept"][at, [*earlier, own]] = passes
                pick["removed"][at, earlier] = passes
                pick["only"][at, :] = passes
                for name in ("removed", "failing", "only"):
                    pick[name][at, own] = fails
                at += 1
        self.pick = pick

    def __call__(self, tensor: np.ndarray, name: str) -> np.ndarray:
        """Sums (part, step) of ``tensor`` (part, pass or fail of each filter)."""
        axes = "abcdefgh"[: self.axes]
        operands = [self.pick[name][:, i] for i in range(self.axes)]
        return np.einsum(f"p{axes},{','.join('s' + a for a in axes)}->ps", tensor, *operands)


def audit_rows(batch: pa.RecordBatch, contractions: Contractions) -> pa.RecordBatch:
    """All orders and steps of each part of ``batch`` (part, cells of mask, n, good, toxic)."""
    parts = batch.column("part").to_pylist()
    shape = (len(parts), *(2,) * contractions.axes)
    flat = np.zeros((3, len(parts), 1 << contractions.axes), np.int64)
    for i, cells in enumerate(batch.column("cells").to_pylist()):
        for cell in cells:
            # The first filter is the first axis, hence the highest bit of the place.
            place = int(f"{cell['mask']:0{contractions.axes}b}"[::-1], 2)
            flat[:, i, place] += (cell["n"], cell["good"], cell["toxic"])
    documents, good, toxic = (one.reshape(shape) for one in flat)
    removed = contractions(documents, "removed")
    failing = contractions(documents, "failing")
    credit = np.stack([removed[:, contractions.filter == f].sum(1) for f in range(contractions.axes)], 1)
    steps = len(contractions.names)
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array(np.repeat(np.array(parts, object), steps), pa.string()),
            "filter_order": pa.array(contractions.names * len(parts), pa.string()),
            "step": pa.array(np.tile(contractions.steps, len(parts))),
            "kept": pa.array(contractions(documents, "kept").ravel()),
            "removed": pa.array(removed.ravel()),
            "redundant": pa.array((failing - removed).ravel()),
            "unique_fails": pa.array(contractions(documents, "only").ravel()),
            "good_lost": pa.array(contractions(good, "removed").ravel()),
            "toxic_lost": pa.array(contractions(toxic, "removed").ravel()),
            "shapley": pa.array(credit[:, contractions.filter].ravel()),
        }
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (language), order of the five filters and step; see ``SCHEMA``.

    Nulls: a null text is empty, a null lang the part ''; a null id is no smaller id of any document, has none itself
    and has no label; a null label is none. Of several label rows of an id one with 1 is enough. Rows that share text
    and smallest id (repeated rows) all pass filter E. Very long texts are split into words in one row's memory. An
    empty table gives no rows; other columns are not read.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contractions = Contractions()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield audit_rows(batch.slice(at, 256), contractions)

    cells = F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")  # 32 at most
    return contingency(docs, labels).groupBy("part").agg(cells).mapInArrow(contract, SCHEMA)


def op11(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
f AS (SELECT doc_id, part, CAST(len(words) < 200 AS INTEGER) AS fa,
    CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER) AS fb,
    CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) AS INTEGER) AS fc,
    CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) AS fd,
    CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS fe FROM w),
m AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, [fa, fb, fc, fd, fe] AS fails, fa + fb + fc + fd + fe AS n_fails, count(*) AS n,
    coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN m ON f.doc_id = m.doc_id GROUP BY part, fa, fb, fc, fd, fe),
l AS (SELECT * FROM (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')) v(i, name)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS places
  FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, places[step] AS own, places[1:step - 1] AS earlier FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, own, n, good, toxic, n_fails, fails[own] AS fails_own,
    list_sum(list_transform(earlier, lambda i: fails[i])) AS fails_earlier FROM c, s),
y AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN coalesce(fails_earlier, 0) = 0 AND fails_own = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN coalesce(fails_earlier, 0) = 0 AND fails_own = 1 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails_earlier > 0 AND fails_own = 1 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN n_fails = 1 AND fails_own = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN coalesce(fails_earlier, 0) = 0 AND fails_own = 1 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN coalesce(fails_earlier, 0) = 0 AND fails_own = 1 THEN toxic ELSE 0 END) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM y"""
