import math

import numpy as np
import pytest

from runlens.llm import neighbours
from runlens.llm.blocks import table

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(rows, every=50, k=5):
    good = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        v = [float(np.float32(x)) for x in v]
        good[i] = min(good.get(i, v), v)
    out = {}
    for q, v in good.items():
        if q % every == 0:
            scores = []
            for i, w in good.items():
                if i != q and len(w) == len(v):
                    a, b = np.array(v) / max(map(abs, v)), np.array(w) / max(map(abs, w))
                    scores.append((-float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))), i))
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        own = out.setdefault(r.query_id, [])
        assert r.rank == len(own) + 1
        own.append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("block", [40, 16_384])
def test_small_cases_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(-100, 140)]
    rows += [(150, None), (200, [0.0] * 8), (250, [1.0, None] * 4), (300, [float("nan")] * 8), (350, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    rows += [(400, [1.0, 2.0]), (401, [2.0, 4.0]), (402, [-1.0, 0.0]), (450, []), (500, [3e38] * 8), (501, [1e-40] * 8), (550, [5.0, 5.0, 5.0])]
    rows += [(i, [0.25] * 8) for i in range(600, 680)] + rows[:20]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA)
    got, want = found(neighbours.nearest_neighbours(df)), brute(rows)
    want = {q: v for q, v in want.items() if v}
    assert got.keys() == want.keys()
    for q, own in want.items():
        assert [round(s, 9) for _, s in got[q]] == [round(s, 9) for _, s in own]
        exact = {round(s, 9) for _, s in own}
        for level in exact:
            assert [i for i, s in got[q] if round(s, 9) == level] == [i for i, s in own if round(s, 9) == level]


def test_recall(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got, want = found(neighbours.nearest_neighbours(df)), brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in own}) for q, own in want.items())
    assert hits >= 0.9 * sum(len(own) for own in want.values())
    exact = {(q, i): s for q, own in want.items() for i, s in own}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, own in got.items() for i, s in own if (q, i) in exact)


def test_empty_table(spark):
    assert neighbours.nearest_neighbours(spark.createDataFrame([], SCHEMA)).collect() == []
