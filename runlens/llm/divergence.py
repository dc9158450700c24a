"""Source divergence audit: how far the term shares of the sources of a language lie apart, from one pass over the texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.blocks import bounded_batches, lean_worker, table
from runlens.session import keep

LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
MOST_RANK = 200
# Postings (term and source) that a block holds in memory before it is spilled as a sorted run.
BLOCK = 1_000_000
# Pair sums that a task holds before it passes them on.
PAIRS = 200_000
# Pairs of postings that one vectorised step takes.
STEP = 1 << 19
# Bytes that are no part of a term become spaces, capitals small letters.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
POSTINGS = "lang string, term string, docs long, entries array<struct<source: string, n: long>>"
ENTRIES = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))


def _heads(*columns: pa.Array) -> np.ndarray:
    """Places where one of the columns differs from the row before; the first place always."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for column in columns:
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _postings(lang: pa.Array, term: pa.Array, docs: np.ndarray, offsets: np.ndarray, source: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    inner = pa.StructArray.from_arrays([source, pa.array(n)], ["source", "n"])
    entries = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), inner).cast(ENTRIES)
    return pa.RecordBatch.from_arrays([lang, term, pa.array(docs), entries], ["lang", "term", "docs", "entries"])


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of ``n`` of each."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


class Block:
    """Postings of the documents since the last spill: occurrences of each term by group (language and source), and
    documents by language.

    Terms and groups have numbers in the block. Numbers of single occurrences wait in arrays until there are
    ``waiting`` of them, and are then counted; a key holds the group's or language's number above the term's.
    """

    def __init__(self, waiting: int = 1 << 20):
        self.waiting = waiting
        self.terms: defaultdict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.groups: dict[tuple[bytes, bytes], int] = {}
        self.langs: dict[bytes, int] = {}
        self.texts: list[tuple[int, int, np.ndarray]] = []
        self.pending = 0
        empty = np.zeros(0, np.int64)
        self.counts, self.docs = (empty, empty), (empty, empty)

    @property
    def size(self) -> int:
        return len(self.counts[0])

    def add(self, lang: bytes, source: bytes, text: bytes) -> None:
        group = self.groups.setdefault((lang, source), len(self.groups))
        found = text.translate(TERM_BYTES).split()
        numbers = np.fromiter(map(self.terms.__getitem__, found), np.int64, len(found))
        self.texts.append((group, self.langs.setdefault(lang, len(self.langs)), numbers))
        self.pending += len(found)
        if self.pending >= self.waiting:
            self.count()

    def count(self) -> None:
        size = np.array([len(numbers) for _, _, numbers in self.texts], np.int64)
        group, lang = (np.array([t[i] for t in self.texts], np.int64) for i in (0, 1))
        number = np.concatenate([t[2] for t in self.texts]) if len(size) else size
        self.texts, self.pending = [], 0
        # A document's occurrences of a term in one, then documents of a language.
        own, n = _summed(np.repeat(np.arange(len(size)), size) << 32 | number, np.ones(len(number), np.int64))
        doc, term = own >> 32, own & 0xFFFFFFFF
        parts = [(self.counts, group[doc] << 32 | term, n), (self.docs, lang[doc] << 32 | term, np.ones(len(own), np.int64))]
        self.counts, self.docs = (
            _summed(np.concatenate([held[0], keys]), np.concatenate([held[1], n])) for held, keys, n in parts
        )

    def spill(self, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
        """One run sorted by language and term, in batches; the term '' lists the sources of a language."""
        self.count()
        (keys, n), (_, docs) = self.counts, self.docs
        langs = {v: k for k, v in self.langs.items()}
        by_lang = sorted(langs, key=langs.__getitem__)
        place = np.argsort(np.array(by_lang, np.int64)) if by_lang else np.zeros(0, np.int64)
        lang_of = np.array([self.langs[lang] for lang, _ in self.groups], np.int64)
        source = pa.array([s for _, s in self.groups], pa.binary()).cast(pa.string())
        # The empty term is the first; it has each group once, with no occurrences.
        terms = pa.array([b"", *self.terms], pa.binary())
        by_term = pc.sort_indices(terms).to_numpy().astype(np.int64)
        rank = np.empty(len(terms), np.int64)
        rank[by_term] = np.arange(len(terms))
        group = np.append(np.arange(len(lang_of)), keys >> 32)
        number = np.append(np.zeros(len(lang_of), np.int64), (keys & 0xFFFFFFFF) + 1)
        n = np.append(np.zeros(len(lang_of), np.int64), n)
        where = place[lang_of[group]] * len(terms) + rank[number]
        order = np.argsort(where, kind="stable")
        where, group, n = where[order], group[order], n[order]
        heads = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else where
        bounds = np.append(heads, len(where))
        # Documents in the same order: the empty terms have none.
        doc_keys = self.docs[0]
        doc_where = place[doc_keys >> 32] * len(terms) + rank[(doc_keys & 0xFFFFFFFF) + 1]
        counted = np.zeros(len(heads), np.int64)
        counted[np.searchsorted(where[heads], doc_where)] = docs
        self.__init__(self.waiting)
        for at in range(0, len(heads), rows):
            some = where[heads[at : at + rows]]
            low, high = bounds[at], bounds[min(at + rows, len(heads))]
            lang = pa.array([langs[by_lang[i]] for i in (some // len(terms)).tolist()], pa.binary()).cast(pa.string())
            term = terms.take(pa.array(by_term[some % len(terms)])).cast(pa.string())
            yield _postings(lang, term, counted[at : at + rows], bounds[at : at + rows + 1] - low, source.take(pa.array(group[low:high])), n[low:high])


def runs(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sorted runs of postings (lang, term, docs, entries array<source, n>), one per block of documents."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        held = Block(min(block, 1 << 20))
        for batch in batches:
            columns = [batch.column(c).cast(pa.large_binary()) for c in ("lang", "source", "text")]
            for row in zip(*columns):
                held.add(*(v.as_buffer().to_pybytes() if v.is_valid else b"" for v in row))
                if max(held.size, len(held.terms)) >= block:
                    yield from held.spill()
        yield from held.spill()

    columns = [F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")]
    return bounded_batches(docs).select(*columns).mapInArrow(index, POSTINGS)


def folded(rows: pa.Table) -> pa.RecordBatch:
    """One row per (lang, term) of sorted ``rows``, its entries one per source."""
    lang, term, docs, entries = (rows.column(c).combine_chunks() for c in ("lang", "term", "docs", "entries"))
    heads = _heads(lang, term)
    number = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(term))))
    flat = entries.flatten()
    source = flat.field("source").dictionary_encode()
    of = np.repeat(number, np.diff(entries.offsets.to_numpy()))
    key = of * max(1, len(source.dictionary)) + source.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    one = order[first]
    return _postings(
        lang.take(pa.array(heads)),
        term.take(pa.array(heads)),
        np.add.reduceat(docs.to_numpy(), heads),
        np.searchsorted(of[one], np.arange(len(heads) + 1)),
        source.dictionary.take(source.indices.take(pa.array(one))),
        np.add.reduceat(flat.field("n").to_numpy()[order], first),
    )


def frequencies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, term, docs, entries array<source, n>) over the whole table, a row per term of a language.

    The runs are dealt to shards by a hash of language and term. A shard's sort merges the runs there through a heap, and
    spills as it must; the merged stream is folded with one term's postings held at a time. The term '' lists the
    sources of a language, those of texts without terms too.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        held: pa.RecordBatch | None = None  # the last term, which the next batch may go on with
        for batch in batches:
            if batch.num_rows:
                rows = folded(pa.Table.from_batches([batch] if held is None else [held, batch.cast(held.schema)]))
                if rows.num_rows > 1:
                    yield rows.slice(0, rows.num_rows - 1)
                held = rows.slice(rows.num_rows - 1)
        if held is not None:
            yield held

    return runs(docs, block).repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(merge, POSTINGS)


def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), exactly: division by parts, which stay longs up to 9e13 occurrences."""
    high = (n + 1) * 100_000
    return 1 + F.call_function("div", high, total) * 10_000 + F.call_function("div", high % total * 10_000, total)


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of positive numbers; p is at most SCALE + 1, so its square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As ``_share``."""
    high, rest = np.divmod((n + 1) * 100_000, total)
    return 1 + high * 10_000 + rest * 10_000 // total


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """As ``_gap``; numbers without sign divide faster."""
    return (((p - q) * (p - q)).view(np.uint64) // q.view(np.uint64)).view(np.int64)


def corrections(postings: DataFrame, held: int = PAIRS, step: int = STEP) -> DataFrame:
    """(lang, source, item, gap): for pairs of sources that share terms, what their sum of gaps differs from the one in
    which every term stands in one of the two only. ``postings``: lang, entries array<source, n, total> per term.

    Sums go modulo 2^64, as partial ones may leave the range of a long; the sum of all is exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        sums: dict[int, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            if sums:
                known = list(names)
                pairs = [(known[k >> 32], known[k & 0xFFFFFFFF]) for k in sums]
                wrapped = [(v + 2**63) % 2**64 - 2**63 for v in sums.values()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[0] for a, _ in pairs], pa.string()),
                        pa.array([a[1] for a, _ in pairs], pa.string()),
                        pa.array([b[1] for _, b in pairs], pa.string()),
                        pa.array(wrapped, pa.int64()),
                    ],
                    ["lang", "source", "item", "gap"],
                )
            sums.clear(), names.clear()

        def number(group: tuple[str, str]) -> int:
            return names.setdefault(group, len(names))

        for batch in batches:
            entries = batch.column("entries")
            size = np.diff(entries.offsets.to_numpy())
            flat = entries.flatten()
            langs = np.repeat(np.array(batch.column("lang").to_pylist(), object), size)
            group = np.fromiter(map(number, zip(langs, flat.field("source").to_pylist())), np.int64, len(langs))
            n, total = flat.field("n").to_numpy(), flat.field("total").to_numpy()
            p, none = shares(n, total), shares(np.zeros_like(n), total)
            first = np.cumsum(size) - size
            # Every posting with every one of its term, a stretch of postings at a time.
            width = np.repeat(size, size)
            ends = np.cumsum(width)
            at = 0
            while at < len(width):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, side="right")))
                a = np.repeat(np.arange(at, to), width[at:to])
                rank = np.arange(len(a)) - np.repeat(np.cumsum(width[at:to]) - width[at:to], width[at:to])
                b = np.repeat(np.repeat(first, size)[at:to], width[at:to]) + rank
                a, b = a[a != b], b[a != b]
                gain = gaps(p[a], p[b]) - gaps(p[a], none[b]) - gaps(none[a], p[b]) + gaps(none[a], none[b])
                code = (group[a] << 32) | group[b]
                order = np.argsort(code)
                code = code[order]
                if len(code):
                    edge = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                    for k, v in zip(code[edge].tolist(), np.add.reduceat(gain[order], edge).tolist()):
                        sums[k] = sums.get(k, 0) + v
                at = to
                if len(sums) > held:
                    yield from out()
                    group = np.fromiter(map(number, zip(langs, flat.field("source").to_pylist())), np.int64, len(langs))
        yield from out()

    return bounded_batches(postings).select("lang", "entries").mapInArrow(run, "lang string, source string, item string, gap long")


def divergence(docs: DataFrame, block: int = BLOCK, most: int = MOST_RANK) -> DataFrame:
    """lang, source, part, item, value, rank: for each group (lang, source) the other sources of the language by the sum
    of gaps over all kept terms (part ``pair``), and its own terms above the language's share, by gap (part ``term``, the
    first ``most``).

    A pair's sum is made of the gaps of either group's terms as though the other had none, counted per number of
    occurrences, and of corrections for the terms they share. Nulls: a null text, lang or source is ''. Ties go by the
    item's bytes. Very long texts add to one block as a whole. Repeated rows count each; an empty table gives no rows;
    other columns are not read.
    """
    wanted = (F.col("term") == "") | (F.col("docs") >= LEAST_DOCUMENTS)
    merged = keep(frequencies(docs, block).where(wanted), "frequencies")
    groups = merged.where("term = ''").select("lang", F.explode("entries.source").alias("source"))
    kept = merged.where("term <> ''").select("lang", "term", "entries")
    # Occurrences per group and their distribution: how many terms it has how often.
    everywhere = F.aggregate("entries", F.lit(0).cast("long"), lambda sum, e: sum + e["n"]).alias("lang_n")
    flat = kept.select("lang", "term", everywhere, F.explode("entries").alias("e")).select("lang", "term", "lang_n", "e.source", "e.n")
    held = flat.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times"))
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    sums = held.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("all_n"), F.sum("times").alias("own"))
    sized = groups.join(vocabulary, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["terms", "all_n", "own"])
    sized = keep(sized.withColumn("total", F.col("all_n") + F.col("terms")), "groups")
    held = keep(held, "distribution")
    return _pairs(kept, sized, held).unionByName(_terms(flat, sized, most))


def _pairs(kept: DataFrame, sized: DataFrame, held: DataFrame) -> DataFrame:
    some = sized.where("total > 0")
    # A term that a group lacks counts as 0 there.
    zero = some.select("lang", "source", F.lit(0).cast("long").alias("n"), (F.col("terms") - F.col("own")).alias("times"))
    spread = held.unionByName(zero.where("times > 0")).join(some.select("lang", "source", "total"), ["lang", "source"])
    spread = spread.select("lang", "source", "times", "n", _share(F.col("n"), F.col("total")).alias("p"), _share(F.lit(0), F.col("total")).alias("p0"))
    other = some.select("lang", F.col("source").alias("item"), _share(F.lit(0), F.col("total")).alias("q0"))
    met = spread.join(other, "lang").where("source <> item")
    summed = F.sum(F.col("gap").cast("decimal(38,0)")).alias("gap")

    def weighed(gap: Column) -> Column:
        return (F.col("times").cast("decimal(19,0)") * gap.cast("decimal(19,0)")).alias("gap")

    # Terms of the group itself, and those of the other one against its zeros.
    ours = met.select("lang", "source", "item", weighed(_gap(F.col("p"), F.col("q0"))))
    theirs = met.where("n > 0").select(
        "lang",
        F.col("item").alias("source"),
        F.col("source").alias("item"),
        weighed(_gap(F.col("q0"), F.col("p")) - _gap(F.col("q0"), F.col("p0"))),
    )
    base = ours.unionByName(theirs).groupBy("lang", "source", "item").agg(summed)
    lists = kept.where(F.size("entries") > 1).select("lang", "term", F.explode("entries").alias("e"))
    lists = lists.select("lang", "term", "e.source", "e.n").join(some.select("lang", "source", "total"), ["lang", "source"])
    lists = lists.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n", "total")).alias("entries"))
    shared = corrections(lists).groupBy("lang", "source", "item").agg(summed)
    both = base.unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("gap").alias("gap"))
    # Back into the range of a long, in which the whole sum is.
    turn = F.lit(Decimal(2**64)).cast("decimal(38,0)")
    left = F.pmod("gap", turn)
    value = F.when(left >= F.lit(Decimal(2**63)), left - turn).otherwise(left).cast("long")
    empty = sized.where("total = 0")
    none = empty.select("lang", "source").join(empty.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    rows = both.select("lang", "source", "item", value.alias("value")).unionByName(none.withColumn("value", F.lit(0).cast("long")))
    return _ranked(rows, "pair")


def _terms(flat: DataFrame, sized: DataFrame, most: int) -> DataFrame:
    whole = sized.groupBy("lang").agg((F.sum("all_n") + F.max("terms")).alias("lang_total"))
    rows = (
        flat.join(sized.select("lang", "source", "total"), ["lang", "source"])
        .join(whole, "lang")
        .withColumn("p", _share(F.col("n"), F.col("total")))
        .withColumn("q", _share(F.col("lang_n"), F.col("lang_total")))
        .where("p > q")
    )
    return _ranked(rows.select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value")), "term").where(F.col("rank") <= most)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def op13(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS terms FROM documents),
d1 AS (SELECT *, row_number() OVER () AS id FROM d),
occ AS (SELECT lang, source, id, unnest(terms) AS term FROM d1),
kept AS (SELECT lang, term, count(*) AS lang_n FROM occ GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
voc AS (SELECT lang, count(*) AS v, sum(lang_n) AS n FROM kept GROUP BY lang),
cnt AS (SELECT lang, source, term, count(*) AS c FROM occ JOIN kept USING (lang, term) GROUP BY lang, source, term),
tot AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 1) // (coalesce(tot.n, 0) + voc.v) AS HUGEINT) AS p,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (lang_n + 1) // (voc.n + voc.v) AS HUGEINT) AS q
  FROM g JOIN kept ON g.lang = kept.lang JOIN voc ON g.lang = voc.lang LEFT JOIN tot ON g.lang = tot.lang AND g.source = tot.source
    LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM n WHERE part = 'pair' OR rank <= 200"""
