import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from runlens.llm import divergence
from runlens.llm.blocks import table

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"


def brute(rows):
    texts = defaultdict(list)
    for text, lang, source in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        texts[lang or ""].append((source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
    out = []
    for lang, docs in texts.items():
        df = Counter(t for _, terms in docs for t in set(terms))
        kept = sorted(t for t, n in df.items() if n >= 3)
        counts = defaultdict(Counter)
        for source, terms in docs:
            for c in (counts[source], counts[None]):
                c.update(t for t in terms if df[t] >= 3)

        def p(source):
            total = sum(counts[source].values()) + len(kept)
            return {t: 1 + 10**9 * (counts[source][t] + 1) // total for t in kept}

        sources = {s for s, _ in docs}
        share = {s: p(s) for s in [*sources, None]}
        for g in sources:
            pairs = [(-sum((share[g][t] - share[h][t]) ** 2 // share[h][t] for t in kept), h.encode(), h) for h in sources - {g}]
            own = [
                (-((share[g][t] - share[None][t]) ** 2 // share[None][t]), t.encode(), t)
                for t in kept if counts[g][t] and share[g][t] > share[None][t]
            ]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(own)[:200])):
                out += [(lang, g, part, item, -v, i) for i, (v, _, item) in enumerate(items, 1)]
    return sorted(out)


def found(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def test_whole_table_equals_plain_sums(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("text", "lang", "source").collect()]
    assert found(divergence.op13(spark, sf)) == brute(rows)


def test_small_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    words = ["alpha", "Beta", "ÄÖ", "x1y", "ä", "日本", "z" * 5000, "c", "d", "e"]
    rows = [
        (" ".join(rng.choice(words, rng.integers(0, 40))) + rng.choice(["", "!", "-A-"]), str(lang), str(source))
        for lang in ("en", "de") for source in ("s1", "s2", "ö", "") for _ in range(rng.integers(1, 9))
    ]
    rows += [(None, None, None), ("", "en", "none"), ("only 1 2", "fr", "a"), ("only", "fr", "b"), ("alpha " * 3000, "en", "s1"), ("beta", "en", None)]
    rows += rows[:3]
    docs = spark.createDataFrame([(i, *r, "t", 0) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    assert found(divergence.divergence(docs, block=7)) == brute(rows)
    assert found(divergence.divergence(docs)) == brute(rows)
    assert divergence.divergence(docs.limit(0)).collect() == []


def test_blocks_spill_sorted_runs():
    block = divergence.Block(waiting=17)
    for i in range(50):
        block.add([b"en", b"de"][i % 2], b"s%d" % (i % 3), b"b a c%d a" % i)
    block.count()
    assert block.size == 3 * 6
    rows = pa.Table.from_batches(list(block.spill(rows=10))).to_pylist()
    keys = [(r["lang"], r["term"]) for r in rows]
    assert keys == sorted(set(keys)) and block.size == 0
    of = {k: r for k, r in zip(keys, rows)}
    assert sorted(e["source"] for e in of["en", ""]["entries"]) == ["s0", "s1", "s2"]
    assert of["en", "a"]["docs"] == 25 and sum(e["n"] for e in of["en", "a"]["entries"]) == 50
    assert sum(e["n"] for e in of["de", "b"]["entries"]) == 25


def test_shares_are_exact_for_large_counts():
    for n, total in [(0, 1), (8 * 10**13, 9 * 10**13), (123456789012345, 3 * 10**14 // 4 * 4), (7, 8)]:
        if n < 9 * 10**13:
            assert divergence.shares(np.array([n]), np.array([total]))[0] == 1 + 10**9 * (n + 1) // total


def test_pair_sums_passed_on_early(spark):
    rows = [("en", [(f"s{i}", (i * k) % 5 + 1, 100 + i) for i in range(9)]) for k in range(1, 30)]
    kind = "lang string, entries array<struct<source: string, n: long, total: long>>"
    postings = spark.createDataFrame(rows, kind).coalesce(1)

    def sums(**limits):
        out = Counter()
        for r in divergence.corrections(postings, **limits).collect():
            out[r["source"], r["item"]] += r["gap"]
        return out

    assert sums(held=3, step=5) == sums()
