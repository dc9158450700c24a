"""Packing of token sequences: length patterns with fitted repeat counts, then best fit for the rest."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens.llm.blocks import bounded_batches, slices, table
from runlens.llm.bpe import REMEMBERED, TAIL, WORDS, Chunks, default_path
from runlens.session import keep

CAPACITY = 4096
END_ID = 1
# Lengths are binned to this many steps for the fit; patterns have up to MOST_PARTS documents.
BINS = 64
MOST_PARTS = 4


# Words that go to the library together.
ROW = 2048


def words_of(text: bytes) -> list[bytes]:
    """Parts of a text that the tokenizer encodes on their own, whatever their case and the punctuation after them.

    It lower-cases too, but not before it looks for special tokens.
    """
    if b"<|" in text:
        return [w for c in text.split() for w in ([c] if b"<|" in c else words_of(c))]
    return TAIL.sub(r" \g<0>", text.lower().decode()).encode().split()


class LibraryEncoder:
    """Ids of new words by the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def __call__(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in words]
        out: list[bytes] = [b""] * len(words)
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        alone = [i for i, t in enumerate(texts) if not t.isalpha()]
        rows = [plain[at : at + ROW] for at in range(0, len(plain), ROW)]
        for own, found in zip(rows, self._encode([" ".join([texts[i] for i in row]) for row in rows])):
            # Many words in one text: a word of letters has one last id, whose token carries the word end.
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(own):
                alone += own
                continue
            flat, cuts = ids.tobytes(), (4 * ends).tolist()
            for i, a, b in zip(own, [0, *cuts], cuts):
                out[i] = flat[a:b]
        for at in range(0, len(alone), ROW):
            some = alone[at : at + ROW]
            for i, found in zip(some, self._encode([texts[i] for i in some])):
                out[i] = np.array(found.ids, "<u4").tobytes()
        return out

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and END_ID, cut only beyond ``capacity``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(LibraryEncoder(path), WORDS * remembered)
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                column = part.column("text").cast(pa.large_string())
                texts = [words_of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in column]
                chunks.learn(texts)
                row, number, start, length, crc = [], [], [], [], []
                for i, words in enumerate(texts):
                    ids = b"".join(map(chunks.known.__getitem__, words)) + last
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        row.append(i)
                        number.append(k)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id").take(pa.array(row, pa.int64())),
                        "piece": pa.array(number, pa.int32()),
                        "start": pa.array(start, pa.int64()),
                        "length": pa.array(length, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def nonnegative_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least ||a x - b||, by active sets."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-7 * max(1.0, np.abs(b).max()):
            break
        active[best] = True
        while True:
            some = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, some], b, rcond=None)[0]
            if (z > 1e-9).all():
                x[:] = 0
                x[some] = z
                break
            bad = z <= 1e-9
            ratio = x[some][bad] / np.maximum(x[some][bad] - z[bad], 1e-30)
            step = ratio.min() if len(ratio) else 0.0
            x[some] += step * (z - x[some])
            x[some[bad][ratio <= step]] = 0
            active[some[(x[some] <= 1e-9) & bad]] = False
            if not active.any():
                break
    return x


def patterns(bins: int = BINS, parts: int = MOST_PARTS) -> list[tuple[int, ...]]:
    """All multisets of up to ``parts`` bin sizes that fill a sequence of ``bins`` steps exactly."""
    found = []
    for n in range(1, parts + 1):
        found += [p + (bins - sum(p),) for p in combinations_with_replacement(range(1, bins + 1), n - 1) if bins - sum(p) >= (p[-1] if p else 1)]
    return found


class Plan:
    """Slots for every (length, number among equal lengths), from a histogram alone.

    A record (length, first, count, copies, base, offset) puts the pieces first ... first+count*copies-1 of a length
    into the sequences base ... base+count-1, ``copies`` in each, from ``offset``. Their number depends on the lengths
    there are, not on the number of pieces.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, bins: int = BINS, parts: int = MOST_PARTS):
        self.capacity = capacity
        self.left = {int(k): int(v) for k, v in histogram.items() if v > 0}
        self.used = dict.fromkeys(self.left, 0)
        self.records: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        # Gaps in ascending order; for each the (base, count) of sequences that have it.
        self.gaps: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = {}
        if self.left:
            self._patterns(max(1, -(-capacity // bins)), parts)
            self._best_fit()

    def _take(self, length: int, count: int, copies: int, base: int, offset: int) -> None:
        self.records.append((length, self.used[length], count, copies, base, offset))
        self.used[length] += count * copies
        self.left[length] -= count * copies

    def _leave(self, gap: int, base: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in self.open:
                insort(self.gaps, gap)
                self.open[gap] = []
            self.open[gap].append((base, count))

    def _patterns(self, step: int, parts: int) -> None:
        bins = -(-self.capacity // step)
        lengths: dict[int, list[int]] = {}
        for length in sorted(self.left):
            lengths.setdefault(-(-length // step), []).append(length)
        total = np.zeros(bins)
        for b, own in lengths.items():
            total[b - 1] = sum(self.left[x] for x in own)
        chosen = [p for p in patterns(bins, parts) if all(total[b - 1] for b in p)]
        if not chosen:
            return
        a = np.zeros((bins, len(chosen)))
        for i, p in enumerate(chosen):
            np.add.at(a[:, i], np.array(p) - 1, 1)
        repeats = np.rint(nonnegative_fit(a, total)).astype(int)
        for i in np.argsort(-repeats, kind="stable"):
            want, slots = int(repeats[i]), [b for b in chosen[i]]
            while want > 0:
                # The longest pieces that each bin still has, for as many sequences as they last.
                row, times = [], want
                need: dict[int, int] = {}
                for b in slots:
                    own = lengths[b]
                    while own and not self.left[own[-1]]:
                        own.pop()
                    if not own:
                        times = 0
                        break
                    row.append(own[-1])
                    need[own[-1]] = need.get(own[-1], 0) + 1
                if times:
                    times = min([want, *(self.left[x] // n for x, n in need.items())])
                    if not times:  # the last few of a length: two lengths of one bin in one sequence
                        row, times = self._mixed(slots, lengths), 1
                if not times or not row:
                    break
                base, offset = self.sequences, 0
                for length in row:
                    self._take(length, times, 1, base, offset)
                    offset += length
                self.sequences += times
                self._leave(self.capacity - offset, base, times)
                want -= times

    def _mixed(self, slots: list[int], lengths: dict[int, list[int]]) -> list[int]:
        taken: dict[int, int] = {}
        row = []
        for b in slots:
            some = [x for x in reversed(lengths[b]) if self.left[x] > taken.get(x, 0)]
            if not some:
                return []
            row.append(some[0])
            taken[some[0]] = taken.get(some[0], 0) + 1
        return row

    def _best_fit(self) -> None:
        for length in sorted(self.left, reverse=True):
            while self.left[length]:
                at = bisect_left(self.gaps, length)
                if at == len(self.gaps):
                    copies = min(self.capacity // length, self.left[length])
                    count = self.left[length] // copies
                    self._take(length, count, copies, self.sequences, 0)
                    self._leave(self.capacity - copies * length, self.sequences, count)
                    self.sequences += count
                    continue
                gap = self.gaps[at]
                base, there = self.open[gap].pop()
                copies = min(gap // length, self.left[length])
                count = min(there, self.left[length] // copies)
                self._take(length, count, copies, base, self.capacity - gap)
                if count < there:
                    self.open[gap].append((base + count, there - count))
                if not self.open[gap]:
                    del self.open[gap], self.gaps[at]
                self._leave(gap - copies * length, base, count)

    def table(self) -> np.ndarray:
        """Records in the order of (length, first)."""
        return np.array(sorted(self.records), np.int64).reshape(-1, 6)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``.

    The driver gets a count per length, ``capacity`` at most, and plans with those. ``remembered`` bounds what a task
    keeps of the words it has encoded; results do not depend on it. Nulls: a null text is empty and
    gives the one id END_ID; a null id stays null. Repeated rows are packed each; an empty table gives no rows; other
    columns are not read.
    """
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Written, so that a piece keeps its part when a task runs again.
    rows = keep(pieces(docs, path, capacity, remembered).withColumn("part", F.spark_partition_id()), "pieces")
    counts = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(histogram, capacity).table()
    spread = np.int64(1) << np.int64(44)
    heads = plan[:, 0] * spread + plan[:, 1]
    own = W.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        rows.withColumn("rank", F.row_number().over(own) - 1)
        .join(before, ["part", "length"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("number"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at = np.searchsorted(heads, length * spread + number, side="right") - 1
            _, first, _, copies, base, offset = plan[at].T
            within = number - first
            yield pa.RecordBatch.from_pydict(
                {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
                | {"sequence_id": pa.array(base + within // copies), "offset": pa.array(offset + within % copies * length)}
            )

    return numbered.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
