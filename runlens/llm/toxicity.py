"""Toxicity: sparse logistic regression whose score may not change when identity terms are swapped."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.blocks import IS_BREAK, LOWER, bounded_batches, fresh_name, id_hash, row_scores, slices, table, text_bytes, word_hashes, word_places

BITS = 20
# Labelled rows of each class that the model is fitted on, the first by a hash of their id.
SAMPLE = 4000
FOLDS = 5
# Fixed lists: terms that name groups of people; within a list each may stand for any other.
IDENTITY = [
    ["women", "men", "woman", "man", "girls", "boys", "transgender"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"],
    ["black", "white", "asian", "african", "european", "latino", "arab", "indian"],
    ["gay", "lesbian", "straight", "bisexual", "queer"],
    ["immigrants", "refugees", "foreigners", "natives", "citizens"],
    ["disabled", "blind", "deaf", "autistic", "old", "young"],
    ["mexican", "american", "german", "french", "spanish", "chinese", "russian", "polish"],
]


def buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets of all texts and the first word of each text; case of A-Z and punctuation do not count."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = word_places(data, offsets, IS_BREAK)
    return (word_hashes(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int32), first


@dataclass
class Model:
    features: np.ndarray  # buckets with a weight, ascending
    weights: np.ndarray
    bias: float


def _swaps(rows: np.ndarray, cols: np.ndarray, groups: list[np.ndarray]) -> list[tuple[int, int, float]]:
    """For each ordered pair of terms of a group: the number of labelled rows where the first stands and would be swapped for the second."""
    found = []
    for group in groups:
        for a in group:
            n = int((cols == a).sum())
            found += [(int(a), int(b), float(n)) for b in group if n and a != b]
    return found


def fit(features: list[np.ndarray], labels: np.ndarray, prior: float, l1: float = 3e-4, swap: float = 5.0, rounds: int = 300) -> Model:
    """Accelerated proximal gradient for logistic loss + l1 + swap * mean squared change of the score under swaps.

    ``features`` holds each labelled text's distinct buckets, ``prior`` the share of label 1 among all labelled
    rows. With one class, or none, the model is a constant (label 1 absent: near 0).
    """
    n = len(labels)
    if n == 0 or labels.min() == labels.max():
        share = (labels.sum() + 0.0) / max(1, n)
        return Model(np.zeros(0, np.int32), np.zeros(0), 6.0 if share > 0.5 else -6.0)
    rows = np.repeat(np.arange(n), [len(f) for f in features])
    flat = np.concatenate(features)
    identity = [np.unique(word_buckets(group)) for group in IDENTITY]
    named = np.concatenate(identity)
    kinds, inverse, df = np.unique(flat, return_inverse=True, return_counts=True)
    usable = (df >= max(3, n // 2000)) | np.isin(kinds, named)
    kept = kinds[usable]
    where = np.full(len(kinds), -1)
    where[usable] = np.arange(len(kept))
    cols = where[inverse]
    rows, cols = rows[cols >= 0], cols[cols >= 0]
    place = {int(k): i for i, k in enumerate(kept)}
    pairs = _swaps(rows, cols, [np.array([place[int(k)] for k in g if int(k) in place], int) for g in identity])
    first = np.array([p[0] for p in pairs], int)
    second = np.array([p[1] for p in pairs], int)
    times = np.array([p[2] for p in pairs]) / n
    y = labels.astype(float)

    w, b = np.zeros(len(kept)), float(np.log(y.mean() / (1 - y.mean())))
    step = 4.0 / max(1.0, _largest(rows, cols, n, len(kept)) + 8 * swap * (times.sum() if len(times) else 0.0))
    look, look_b, pace = w.copy(), b, 1.0
    for _ in range(rounds):
        z = look_b + np.bincount(rows, look[cols], n)
        off = (1 / (1 + np.exp(-z)) - y) / n
        slope = np.bincount(cols, off[rows], len(kept))
        if len(times):
            apart = 2 * swap * times * (look[first] - look[second])
            slope += np.bincount(first, apart, len(kept)) - np.bincount(second, apart, len(kept))
        nw = look - step * slope
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        nb = look_b - step * off.sum()
        quicker = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        look, look_b = nw + (pace - 1) / quicker * (nw - w), nb + (pace - 1) / quicker * (nb - b)
        w, b, pace = nw, nb, quicker
    # The sample has another share of label 1 than the table.
    b += float(np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean())))
    active = np.flatnonzero(w)
    order = active[np.argsort(kept[active])]
    return Model(kept[order].astype(np.int32), w[order], b)


def _largest(rows: np.ndarray, cols: np.ndarray, n: int, m: int) -> float:
    """Largest eigenvalue of X'X / n with the column of ones, by power iteration."""
    v, c, size = np.ones(m), 1.0, 1.0
    for _ in range(20):
        z = c + np.bincount(rows, v[cols], n)
        v, c = np.bincount(cols, z[rows], m) / n, z.sum() / n
        size = float(np.sqrt((v * v).sum() + c * c))
        v, c = v / size, c / size
    return size


def word_buckets(words: list[str]) -> np.ndarray:
    return buckets(pa.array([" ".join(words)]))[0]


def predict(model: Model, column: pa.Array) -> np.ndarray:
    """Score of each text: weights of its distinct words."""
    found, first = buckets(column)
    n = len(first) - 1
    place = np.minimum(np.searchsorted(model.features, found), max(0, len(model.features) - 1))
    hit = model.features[place] == found if len(model.features) else np.zeros(len(found), bool)
    doc = np.repeat(np.arange(n), np.diff(first))[hit]
    seen = np.unique(doc * (len(model.features) + 1) + place[hit])
    doc, place = seen // (len(model.features) + 1), seen % (len(model.features) + 1)
    return 1 / (1 + np.exp(-(model.bias + np.bincount(doc, model.weights[place] if len(place) else None, n))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows of each class, of ids outside fold 0.

    Null labels and ids are left out; several labels of one id count as toxic if any is. Of rows that share an id
    one text is used.
    """
    marked = (
        labels.select("doc_id", "toxic")
        .dropna()
        .where(id_hash(F.col("doc_id")) % FOLDS != 0)
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    prior = min(max(counts.get(1, 0) / max(1, total), 1e-4), 1 - 1e-4)
    by_hash = [F.xxhash64("doc_id"), "doc_id"]
    chosen = None
    for value in (0, 1):
        part = marked.where(F.col("toxic") == value).orderBy(*by_hash).limit(sample)
        chosen = part if chosen is None else chosen.union(part)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found, first = buckets(part.column("text"))
                lists = [np.unique(found[a:b]) for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "toxic": part.column("toxic"),
                        "found": pa.array(lists, pa.list_(pa.int32())),
                    }
                )

    # The ids are at most 2 * sample.
    taken = bounded_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = (
        taken.mapInArrow(distinct, f"doc_id {kind}, toxic int, found array<int>")
        .groupBy("doc_id", "toxic")
        .agg(F.min("found").alias("found"))
        .orderBy("doc_id")
        .collect()
    )
    return fit([np.array(r["found"], np.int32) for r in rows], np.array([r["toxic"] for r in rows], int), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; null text is empty, an empty text scores by the bias."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def compute(part: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"doc_id": part.column("doc_id"), "score": pa.array(predict(model, part.column("text")))}

    return row_scores(docs.select("doc_id", "text"), compute, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``, learnt from the labels outside fold 0.

    Nulls: a null text is empty; a null id is in fold 0 and has no label. Repeated rows give repeated rows; an
    empty table gives none; without labels every score is near 0. Other columns are not read.
    """
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        (id_hash(F.col("doc_id")) % FOLDS == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all their columns, whose text is not predicted toxic."""
    model = train(docs, labels)
    name = fresh_name(docs, "score")
    return keep_rows(docs, lambda text: predict(model, text) < 0.5, name)


def keep_rows(docs: DataFrame, test, name: str) -> DataFrame:
    """Rows whose text passes ``test`` (Arrow texts to booleans); ``name`` is free for the flag."""

    @F.arrow_udf("boolean")
    def flag(text: pa.Array) -> pa.Array:
        if not len(text):
            return pa.array([], pa.bool_())
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        return pa.concat_arrays([pa.array(test(part.column(0)), pa.bool_()) for part in slices(batch)])

    return docs.withColumn(name, flag(F.col("text"))).where(F.col(name)).drop(name)


def op9(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
