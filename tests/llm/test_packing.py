import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from runlens.llm import bpe, packing
from runlens.llm.bpe import default_path
from runlens.llm.blocks import table


def check(docs, capacity=packing.CAPACITY):
    tokenizer = Tokenizer.from_file(bpe.default_path())
    want = defaultdict(int)
    tokens = 0
    for r in docs.select("doc_id", "text").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        tokens += len(ids)
        for k in range(0, len(ids), capacity):
            own = np.array(ids[k : k + capacity], "<u4")
            want[r.doc_id, k // capacity, k, len(own), zlib.crc32(own.tobytes())] += 1
    rows = packing.pack(docs, capacity=capacity).collect()
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-tokens // capacity)


def test_documents(spark, sf):
    used, least = check(table(spark, sf, "documents"))
    assert used <= least * 1.01 + 1


def test_chunks_are_encoded_as_whole_texts(spark):
    from test_bpe import ODD

    odd = [*ODD, "<|ENDOFTEXT|> <|endoftext|>. The. the, a's. a'S! x... 9.9. é. É, end?!;", "don't. WE'VE: ..."]
    check(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x " * 30_000), (3, "x " * 30_000), (4, "one two"), (4, "one two")]
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id long, text string, piece string, part int")
    used, least = check(docs)
    assert used <= least + 1
    check(docs, capacity=3)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_every_place_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([5, 64, 100, 4096]))
    lengths = np.minimum(capacity, 1 + rng.exponential(capacity / rng.choice([2, 8, 50]), 3000).astype(int))
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    plan = packing.Plan(histogram, capacity)
    filled = defaultdict(list)
    seen = defaultdict(list)
    for length, first, count, copies, base, offset in plan.table().tolist():
        seen[length] += range(first, first + count * copies)
        for i in range(count * copies):
            filled[base + i // copies].append((offset + i % copies * length, length))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(filled) <= max(1.05 * lengths.sum() / capacity + 2, (lengths * 2 > capacity).sum())


def test_nonnegative_fit_matches_projected_descent():
    rng = np.random.default_rng(3)
    a, b = rng.random((8, 20)), rng.random(8)
    x = packing.nonnegative_fit(a, b)
    y = np.zeros(20)
    step = 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(200_000):
        y = np.maximum(y - step * (a.T @ (a @ y - b)), 0)
    assert (x >= 0).all()
    assert np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-4


def test_words_give_the_library_s_ids_of_whole_texts():
    library = Tokenizer.from_file(default_path())
    encoder = packing.LibraryEncoder(default_path())
    pick = random.Random(8)
    parts = [
        "a", "Zz", "9", "é", "é", "ß", "İ", "日", "'s", "'", "’", "_", ".", ",!", "%%%", "<", "|", ">", "<|endoftext|>", "<|startoftext|>",
        " ", "  ", "\n", "\t", "\x0b", "\xa0", " ", "\x85", "…", "٣", "½", "Ⅷ", "_,", "(", ")", "\x1c", "≠", "ﬁ", "🙂", "‍",
    ]
    for _ in range(4000):
        text = "".join(pick.choice(parts) for _ in range(pick.randrange(1, 14)))
        own = b"".join(encoder(packing.words_of(text.encode())))
        assert np.frombuffer(own, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
