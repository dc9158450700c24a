from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from runlens.llm import simhash
from runlens.llm.blocks import table

SCHEMA = "doc_id long, text string, lang string, fp string"


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    for b in b"\t\n\x0b\x0c\r":
        words = words.replace(bytes([b]), b" ")
    words = [w for w in words.split(b" ") if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = {}
    for doc_id, text in rows:
        prints.setdefault(brute_print(text), []).append(doc_id)
    values = list(prints)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= 2:
                parent[root(a)] = root(b)
    members = defaultdict(list)
    for v in values:
        members[root(v)] += prints[v]
    return {v: min((d for d in members[root(v)] if d is not None), default=None) for v in values}


def compare(spark, rows, docs):
    want = brute_components(rows)
    expected = sorted(((d, f"{brute_print(t):016x}", want[brute_print(t)]) for d, t in rows), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str) == expected


def test_small_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    texts = ["One two  three\tfour", "one TWO three four", "one two", "", None, " \n ", "é É", "a" * 5000, long, long + " x", "one two"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "nobody knows this"), (0, texts[0])]
    docs = spark.createDataFrame([(i, t, None, "clash") for i, t in rows], SCHEMA)
    compare(spark, rows, docs)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.without_near_duplicates(docs).collect() == []


def test_documents_match_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    compare(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], docs)


def test_close_pairs_and_forest():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    members = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)]))
    found = {(i, int(j)) for i, later in simhash.close_pairs(members, 0) for j in later}
    want = {(i, j) for i in range(len(members)) for j in range(i + 1, len(members)) if bin(int(members[i] ^ members[j])).count("1") <= 2}
    assert found == want


@pytest.mark.parametrize("most", [1, 3, 2048])
def test_large_groups_are_split_without_loss(spark, monkeypatch, most):
    rng = np.random.default_rng(2)
    walk = [np.uint64(rng.integers(0, 2**63))]
    for _ in range(60):
        walk.append(walk[-1] ^ (np.uint64(1) << np.uint64(rng.integers(0, 64))) ^ (np.uint64(1) << np.uint64(rng.integers(0, 64))))
    values = sorted({int(np.int64(np.uint64(v).astype(np.int64))) for v in walk + list(rng.integers(0, 2**63, 50, dtype=np.uint64))})
    monkeypatch.setattr(simhash, "MOST", most)
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for r in found:
        assert bin((r.a ^ r.b) & (2**64 - 1)).count("1") or r.a != r.b
        parent[root(r.a)] = root(r.b)
    got = {frozenset(v for v in values if root(v) == root(w)) for w in values}
    parent = {v: v for v in values}
    for a in values:
        for b in values:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                parent[root(a)] = root(b)
    assert got == {frozenset(v for v in values if root(v) == root(w)) for w in values}


def test_one_of_each_group_stays_with_all_columns(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(3, text, "a", "1"), (2, text, "b", "2"), (2, text, "b", "2"), (9, "other words here now", None, None), (None, "alone and without id", "c", "3")]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = simhash.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((tuple(r) for r in left.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_fingerprint_of_sliced_array():
    column = pa.array(["skip", "One two three", None, "x"])
    assert [int(v) for v in simhash.fingerprints(column.slice(1, 3))] == [brute_print(t) for t in ["One two three", "", "x"]]
