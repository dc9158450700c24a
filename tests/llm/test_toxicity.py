import zlib

import numpy as np
import pyarrow as pa
import pytest

from runlens.llm import toxicity
from runlens.llm.blocks import table

DOCS = "doc_id long, text string, score string, toxic string"


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, None, y) for i, _, y in rows if y is not None], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_ranking(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    bad, good = ([r.score for r in held if truth[r.doc_id] == v] for v in (1, 0))
    wins = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert wins > 0.95
    assert np.mean([s >= 0.5 for s in good]) < 0.01


def test_swaps_clear_identity_terms(spark):
    """One group is named in most toxic training texts; the penalty keeps neutral mentions of it below the threshold."""
    rng = np.random.default_rng(0)
    filler = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(2000):
        words = list(rng.choice(filler, 12))
        toxic = i % 4 == 0
        if toxic:
            words += ["women"] if rng.random() < 0.8 else []
            words += ["idiot"] if rng.random() < 0.6 else []
        elif rng.random() < 0.1:
            words += [rng.choice(["women", "men", "girls", "boys"])]
        rows.append((i, " ".join(words), int(toxic)))
    features = [np.unique(toxicity.buckets(pa.array([t]))[0]) for _, t, _ in rows]
    labels = np.array([y for *_, y in rows])
    neutral = pa.array(["women " + " ".join(filler[i : i + 5]) for i in range(40)])
    swapped = pa.array(["men " + " ".join(filler[i : i + 5]) for i in range(40)])
    plain = toxicity.fit(features, labels, labels.mean(), swap=0.0)
    fair = toxicity.fit(features, labels, labels.mean(), swap=50.0)
    gap = lambda m: np.abs(toxicity.predict(m, neutral) - toxicity.predict(m, swapped)).mean()
    assert gap(fair) < 0.1 * gap(plain)
    assert (toxicity.predict(fair, neutral) >= 0.5).sum() < (toxicity.predict(plain, neutral) >= 0.5).sum()


def test_odd_rows_and_filter(spark):
    rows = [(i, f"fine text number {i}" if i % 2 else f"you idiot number {i}", 1 - i % 2) for i in range(400)]
    rows += [(None, "you idiot", None), (1000, None, None), (1001, "", None), (1002, "idiot " + "calm " * 50_000, None), (3, rows[3][1], None), (4, rows[4][1], 0)]
    docs, labels = labelled(spark, rows)
    got = sorted(tuple(r) for r in toxicity.toxicity(docs.where("doc_id is not null"), labels).select("doc_id", "predicted").collect())
    assert got == sorted((i, int("idiot" in (t or ""))) for i, t, _ in rows if i is not None)
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, t, _ in rows if "idiot" not in (t or ""))


@pytest.mark.parametrize("value", [None, 0])
def test_missing_labels_and_empty_table(spark, value):
    docs, labels = labelled(spark, [(i, "some text", value) for i in range(20)])
    assert all(r.score < 0.5 for r in toxicity.toxicity(docs, labels).collect())
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.toxicity(empty, labels).collect() == []
    assert toxicity.without_toxic(empty, labels).collect() == []
