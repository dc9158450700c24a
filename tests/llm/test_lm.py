import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from runlens.llm import lm
from runlens.llm.blocks import chunk_hashes, table


def brute(rows, order=3, weight=lm.WEIGHT):
    def words(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x20\x09-\x0D]+", low)

    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2

    grams = [Counter() for _ in range(order + 1)]
    for i, text in rows:
        if not held(i):
            seq = ["<s>", *words(text), "</s>"]
            for n in range(1, order + 1):
                for k in range(len(seq) - n + 1):
                    grams[n][tuple(seq[k : k + n])] += 1
    unigrams = Counter({k: v for k, v in grams[1].items() if k != ("<s>",)})
    total, distinct = sum(unigrams.values()), len(unigrams)
    out = []
    for i, text in rows:
        seq = ["<s>", *words(text), "</s>"]
        base = score = 0.0
        for k in range(1, len(seq)):
            p = (unigrams[(seq[k],)] + 1) / (total + distinct + 1)
            base += math.log10(p)
            for n in range(2, order + 1):
                if k - n + 1 >= 0:
                    seen = grams[n - 1][tuple(seq[k - n + 1 : k])]
                    if seen:
                        p = (grams[n][tuple(seq[k - n + 1 : k + 1])] + weight * p) / (seen + weight)
            score += math.log10(p)
        out.append((i, held(i), len(seq) - 1, sum(unigrams[(w,)] > 0 for w in seq[1:]), total, base, score))
    return out


def check(docs, order=3):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = sorted(brute(rows, order), key=str)
    got = sorted((tuple(r) for r in lm.lm_scores(docs, order).collect()), key=str)
    assert [w[:5] for w in want] == [g[:5] for g in got]
    for w, g in zip(want, got):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


SMALL = [(1, "a b a b c"), (2, "A b"), (3, None), (4, ""), (5, "b a  b"), (None, "a zz"), (5, "b a  b"), (9, "w " * 3000), (14, "é ü"), (21, "b c d")]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_small(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BLOCK_WORDS", 4)
    monkeypatch.setattr(lm, "BUCKET_KEYS", 3)
    monkeypatch.setattr(lm, "STRETCH", 5)
    check(spark.createDataFrame([(i, t, "clash") for i, t in SMALL], "doc_id long, text string, block string"), order)


def test_documents(spark, sf):
    check(table(spark, sf, "documents"))


def test_empty_table_and_no_training_rows(spark):
    schema = "doc_id long, text string"
    assert lm.lm_scores(spark.createDataFrame([], schema)).collect() == []
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    check(spark.createDataFrame([(only, "a b")], schema))


def test_context_helps_held_out_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [r for r in lm.lm_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_one_row_many_times(spark):
    docs = spark.range(0, 3000, 1, 3).selectExpr("CAST(7 AS LONG) doc_id", "'a b a c' text")
    docs = docs.unionByName(spark.createDataFrame(SMALL, "doc_id long, text string"))
    check(docs)


def test_walkers_in_a_long_text_keep_the_state():
    heads = lm.np.array([0, 1001, 1003])
    found = lm.np.random.default_rng(0).integers(1, 30, 1003).astype(lm.np.uint64)
    grams = [lm.grams_of(k) for k in lm.ngrams(found, heads, 3)]
    # Training has the first tokens only, so walkers fall back and climb again.
    counts = [g.counts(lm.np.arange(1003) < 300) for g in grams]
    auto = lm.automaton(grams, counts, 1000, 8, 2.0)
    wide = []
    for stretch in (7, 100_000):
        lm.STRETCH, before = stretch, lm.STRETCH
        wide.append(lm.walk(grams[0].at, heads, auto))
        lm.STRETCH = before
    assert wide[0] == pytest.approx(wide[1], rel=1e-12)


def test_string_ids(spark):
    docs = spark.createDataFrame([("x1", "a b"), (None, "a"), ("x1", None)], "doc_id string, text string")
    check(docs)


def test_packed_numbers_come_back():
    make = lm.np.random.default_rng(2)
    for numbers in ([], [0], [2**64 - 1, 0, 5], make.integers(0, 2**49, 5000), lm.np.ones(3000), make.integers(0, 3, 777)):
        numbers = lm.np.array(numbers, lm.np.uint64)
        assert (lm._unpacked(lm._packed(numbers), len(numbers)) == numbers).all()


def test_order_of_numbers_that_differ_in_low_bits_only():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 1000):
        wide = rng.integers(0, 4, n).astype(np.uint64) | (rng.integers(0, 3, n).astype(np.uint64) << np.uint64(62))
        for key in (wide, rng.integers(0, 50, n).astype(np.uint64), rng.integers(0, 2**64, n, np.uint64)):
            assert lm.ascending(key).tolist() == np.argsort(key, kind="stable").tolist()
            found = lm.grams_of(key)
            kinds, first, at = np.unique(key[key > 0], return_index=True, return_inverse=True)
            assert found.kinds.tolist() == kinds.tolist() and found.at[key > 0].tolist() == at.tolist()
            assert found.first.tolist() == np.flatnonzero(key > 0)[first].tolist()


def test_tokens_do_not_depend_on_the_pieces(monkeypatch):
    texts = pa.array(["Ab cd " * 400, None, "", "x", "  y z\tAB", "w" * 3000, "cd"])
    whole, heads = lm.tokens(texts)
    monkeypatch.setattr(lm, "PIECE", 7)
    pieces, same = lm.tokens(texts)
    assert pieces.tolist() == whole.tolist() and same.tolist() == heads.tolist()


def test_tokens_are_counted_without_hashing_and_words_come_from_whole_ranges(spark, monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 7)
    docs = spark.createDataFrame(SMALL, "doc_id long, text string").repartition(2)
    assert lm.token_count(docs) == sum(len((t or "").split()) + 1 for _, t in SMALL)
    assert lm.token_count(docs.where("false")) == 0
    # Texts that end and begin inside a word, and empty ones between them.
    glued = spark.createDataFrame([(1, "a b"), (2, ""), (3, "c"), (4, None), (5, "\td e ")], "doc_id long, text string").coalesce(1)
    assert lm.token_count(glued) == 5 + 5


def test_chunk_hashes_depend_on_the_bytes_alone():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(0, 3, n, dtype=np.uint8)) for n in range(150) for _ in range(4)] + [b"a", b"a\0", b"a" * 8, b"a" * 8 + b"\0"]
    by: dict[bytes, set[int]] = {}
    for pad in range(9):
        data = np.frombuffer(b"x" * pad + b"y".join(words), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1 + pad
        starts = ends - np.array([len(w) for w in words])
        for w, h in zip(words, chunk_hashes(data, starts, ends).tolist()):
            by.setdefault(w, set()).add(h)
    assert all(len(h) == 1 for h in by.values())
    assert len({h for hashes in by.values() for h in hashes}) == len(by)
