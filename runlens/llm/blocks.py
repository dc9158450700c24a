"""Texts as byte arrays inside Arrow tasks: bounded blocks, words, hashes, exact row passing."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that one vectorised step takes; a longer text is a step of its own.
BLOCK_BYTES = 1 << 20
# Bytes whose polynomial is summed up at once; its arrays stay in the processor's cache.
HASHED_BYTES = 1 << 16
# Bytes of one batch of rows between the JVM and Python.
BATCH = 8 << 20
WHITE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
IS_WHITE = np.isin(np.arange(256), list(WHITE))
# ASCII bytes that are no letter and no digit also part words in classifiers.
IS_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df`` after its session is told to hand rows to Python in batches of ``BATCH`` bytes.

    A worker then holds few texts at once, however long they are.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return df


def id_hash(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


_lean = _warm = False


def _told(threshold: int, trim: int) -> None:
    with contextlib.suppress(OSError, AttributeError):  # another C library: nothing to tell it
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, threshold)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, trim)  # M_TRIM_THRESHOLD


def lean_worker() -> None:
    """Make this process give freed arrays back to the system, as idle workers stay and share an executor's memory.

    Arrow takes its memory from malloc, and malloc maps all larger pieces on their own instead of keeping them.
    """
    global _lean
    if not _lean:
        _lean = True
        pa.set_memory_pool(pa.system_memory_pool())
        _told(1 << 18, 1 << 18)


def warm_worker(warm: bool = True) -> None:
    """Let a lean worker keep up to 128 MB of freed arrays for the next ones, as fresh memory costs more than a step on it; or no longer."""
    global _warm
    lean_worker()
    if _warm != warm:
        _warm = warm
        _told(*((1 << 25, 1 << 27) if warm else (1 << 18, 1 << 18)))


def slices(batch: pa.RecordBatch, column: int | str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of ``batch`` with at most ``most`` bytes of text, or one row."""
    lean_worker()
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and where each begins; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[places[0] : places[-1]], places - places[0]


def word_places(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end (bytes) of each word, and the number of the first word of each text, with the total last."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.ones(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    name = str(base)
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, BLOCK_BYTES), base, np.uint64)
        steps[0] = 1
        grown = np.multiply.accumulate(steps)
        if n > BLOCK_BYTES:
            return grown[:n]
        _powers[name] = grown
    return _powers[name][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range (a polynomial over its bytes, then mixed)."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + HASHED_BYTES, side="right")))
        n = int(ends[to - 1]) - low
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[low : low + n].astype(np.uint64) + np.uint64(1)) * _power(BASE, n), out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * _power(BASE_INVERSE, n)[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


# Bytes of a range that are taken eight at a time; what is longer takes the polynomial.
SHORT = 64
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SALTS = mix(np.arange(1, SHORT + 2, dtype=np.uint64) * np.uint64(BASE))


def chunk_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes at a time: cheaper than ``word_hashes`` for words, and other values."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = np.zeros(len(data) // 8 + 2, np.uint64)
    words.view(np.uint8)[: len(data)] = data
    lengths = ends - starts

    def chunk(at: np.ndarray, length: np.ndarray) -> np.ndarray:
        word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        # Two steps, as a shift by 64 bits has no defined result.
        found = (words[word] >> shift) | ((words[word + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        return found & MASKS[np.minimum(length, 8)]

    out = mix(chunk(starts, lengths) ^ SALTS[np.minimum(lengths, SHORT)])
    left = np.flatnonzero(lengths > 8)
    for done in range(8, SHORT, 8):
        left = left[lengths[left] > done]
        if not len(left):
            return out
        out[left] = mix(out[left] * np.uint64(BASE) + chunk(starts[left] + done, lengths[left] - done))
    left = left[lengths[left] > SHORT]
    if len(left):
        out[left] = word_hashes(data, starts[left], ends[left])
    return out


def row_scores(df: DataFrame, compute: Callable[[pa.RecordBatch], dict[str, pa.Array]], schema: str) -> DataFrame:
    """Rows of ``df`` (whose text column is ``text``) through ``compute``, block by block; rows keep their order and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict(compute(part))

    return bounded_batches(df).mapInArrow(run, schema)
