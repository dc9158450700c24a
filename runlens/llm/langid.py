"""Language ID: each text is a mixture of languages, inferred by expectation-maximisation over its words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.blocks import IS_BREAK, LOWER, bounded_batches, fresh_name, id_hash, row_scores, slices, table, text_bytes, word_places

BITS = 16
FOLDS = 3
HELD_OUT = 1
ALPHA = 0.5
ROUNDS = 8
# Largest language set of one text, and the price of one more language in units of log(words).
MOST_LANGUAGES = 4
PENALTY = 2.0
LEAST_SHARE = 0.01
UNKNOWN = "und"
HAS_LETTER = r"\p{L}"
IS_DIGIT = np.array([48 <= b < 58 for b in range(256)])
BREAKS = IS_BREAK | IS_DIGIT


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # (n-gram bucket, language)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each byte's 3-gram (byte before, byte, byte after; all but letters are one break), word begins and ends, first word of each text."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_places(data, offsets, BREAKS)
    data = np.where(BREAKS[data], np.uint8(32), LOWER[data]).astype(np.uint32)
    around = np.full(len(data) + 2, 32, np.uint32)
    around[1:-1] = data
    code = (around[:-2] << np.uint32(16)) | (around[1:-1] << np.uint32(8)) | around[2:]
    # The neighbour of a text's edge belongs to another text.
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    code[heads] = (code[heads] & np.uint32(0xFFFF)) | np.uint32(32 << 16)
    code[tails] = (code[tails] & np.uint32(0xFFFF00)) | np.uint32(32)
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(32 - BITS)).astype(np.int32), starts, ends, first


def train(docs: DataFrame) -> Model:
    """n-gram counts of all rows with a language outside the held-out fold; the driver gets 65 536 counts a language at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                found, starts, ends, first = grams(part.column("text"))
                names = part.column("lang").to_pylist()
                inside = np.zeros(len(found) + 1, np.int32)
                np.add.at(inside, starts, 1)
                np.subtract.at(inside, ends, 1)
                inside = np.cumsum(inside[:-1]) > 0
                kinds = sorted(set(names))
                number = {k: i for i, k in enumerate(kinds)}
                of_doc = np.array([number[n] for n in names])
                size = np.diff(text_bytes(part.column("text"))[1])
                of_byte = np.repeat(of_doc, size)
                for kind, i in number.items():
                    counts = np.bincount(found[inside & (of_byte == i)], minlength=1 << BITS)
                    totals[kind] = totals.get(kind, 0) + counts
        for kind, counts in totals.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([kind] * len(some), pa.string()),
                    "bucket": pa.array(some.astype(np.int32)),
                    "n": pa.array(counts[some].astype(np.int64)),
                }
            )

    rows = (
        bounded_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_hash(F.col("doc_id")) % FOLDS != HELD_OUT))
        .select("text", F.col("lang").cast("string").alias("lang"))
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((1 << BITS, len(languages)))
    for i, language in enumerate(languages):
        own = rows[rows["lang"] == language]
        counts[own["bucket"].to_numpy(), i] = own["n"].to_numpy()
    return Model(languages, np.log((counts + ALPHA) / (counts.sum(0) + ALPHA * (1 << BITS))).astype(np.float32))


def _em(words: np.ndarray, share: np.ndarray, of: np.ndarray, heads: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions (language, text) after ``rounds`` steps from ``share``; a proportion of 0 stays 0."""
    sizes = np.diff(np.append(heads, words.shape[1])).astype(np.float32)
    for _ in range(rounds):
        weighed = words * share[:, of]
        weighed /= weighed.sum(0) + np.float32(1e-30)
        share = np.add.reduceat(weighed, heads, axis=1) / sizes
        share[share < 1e-9] = 0
    return share


def mixtures(model: Model, column: pa.Array) -> np.ndarray:
    """Proportions (text, language); a text without words has all 0.

    A word's likelihood under a language is the product over its n-grams. All languages are fitted first; then the
    sets of the 1, 2, ... most present ones are refitted, and the set of largest log-likelihood less
    PENALTY * languages * log(words) stays. A language fitted below LEAST_SHARE is in no set but the first.
    """
    found, starts, _, first = grams(column)
    n, kinds = len(first) - 1, len(model.languages)
    out = np.zeros((n, kinds), np.float32)
    full = np.flatnonzero(np.diff(first))
    if not len(full) or not kinds:
        return out
    breaks = BREAKS[text_bytes(column)[0]]
    words = np.empty((kinds, len(starts)), np.float32)
    for i in range(kinds):
        each = model.log_p[:, i][found]
        each[breaks] = 0
        words[i] = np.add.reduceat(each, starts)
    words -= words.max(0)
    np.exp(np.maximum(words, np.float32(-40), out=words), out=words)  # no denormal numbers, which are slow
    heads = first[:-1][full]
    sizes = np.diff(first)[full]
    of = np.repeat(np.arange(len(full)), sizes)
    share = _em(words, np.full((kinds, len(full)), 1 / kinds, np.float32), of, heads, ROUNDS)
    rank = np.argsort(np.argsort(-share, axis=0, kind="stable"), axis=0, kind="stable")
    chosen = (rank == 0).astype(np.float32)
    several = (share >= LEAST_SHARE).sum(0)
    mixed = np.flatnonzero(several > 1)
    if len(mixed):
        some = np.isin(of, mixed)
        words, share, rank, several, sizes = words[:, some], share[:, mixed], rank[:, mixed], several[mixed], sizes[mixed]
        of = np.repeat(np.arange(len(mixed)), sizes)
        heads = np.append(0, np.cumsum(sizes)[:-1])
        best = np.full(len(mixed), -np.inf)
        picked = np.zeros_like(share)
        for size in range(1, min(MOST_LANGUAGES, kinds) + 1):
            part = np.where(rank < size, np.maximum(share, np.float32(1e-6)), np.float32(0))
            part = _em(words, part / part.sum(0), of, heads, ROUNDS if size > 1 else 0)
            fit = np.add.reduceat(np.log((words * part[:, of]).sum(0) + np.float32(1e-30)), heads)
            fit = np.where(size <= several, fit - PENALTY * size * np.log(sizes + 1), -np.inf)
            better = fit > best
            best[better], picked[:, better] = fit[better], part[:, better]
        chosen[:, mixed] = picked
    out[full] = chosen.T
    return out


def _best(model: Model, shares: np.ndarray) -> tuple[list[str | None], np.ndarray]:
    """The language of largest proportion and that proportion."""
    if not model.languages:
        return [None] * len(shares), np.zeros(len(shares))
    best = shares.argmax(1)
    top = np.minimum(shares[np.arange(len(shares)), best].astype(float), 1.0)
    return [model.languages[b] if t > 0 else None for b, t in zip(best, top)], top


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, shares (language to proportion, of the selected set) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def compute(part: pa.RecordBatch) -> dict[str, pa.Array]:
        shares = mixtures(model, part.column("text"))
        names, top = _best(model, shares)
        ok = part.column("has_letter").to_numpy(zero_copy_only=False)
        maps = [
            [(model.languages[i], float(s[i])) for i in np.flatnonzero(s)] if o else [] for s, o in zip(shares, ok)
        ]
        return {
            "doc_id": part.column("doc_id"),
            "lang_pred": pa.array([(a or UNKNOWN) if o else UNKNOWN for a, o in zip(names, ok)], pa.string()),
            "score": pa.array(np.where(ok, top, 0.0)),
            "shares": pa.array(maps, pa.map_(pa.string(), pa.float64())),
        }

    rows = docs.select("doc_id", "text", has_letter("text").alias("has_letter"))
    return row_scores(rows, compute, f"doc_id {kind}, lang_pred string, score double, shares map<string,double>")


def has_letter(column: str) -> Column:
    return F.coalesce(F.col(column).rlike(HAS_LETTER), F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, shares of every row of ``docs``, learnt from the rows outside the held-out fold.

    Nulls: a null text, like one without a letter, is ``und`` with score 0; a null lang is not learnt from; a null id
    hashes as the empty text. If nothing was learnt every row is ``und``. Ties go to the smaller language name.
    Repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    found = identify(docs, train(docs))
    return found.select("doc_id", (id_hash(F.col("doc_id")) % FOLDS == HELD_OUT).alias("held_out"), "lang_pred", "score", "shares")


def with_language(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all their columns, whose text has a letter: the others have no language."""
    name = fresh_name(docs, "known")
    model = train(docs)
    if not model.languages:  # nothing to compare with: only texts without letters go
        return docs.where(has_letter("text"))

    @F.arrow_udf("boolean")
    def known(text: pa.Array) -> pa.Array:
        if not len(text):
            return pa.array([], pa.bool_())
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        return pa.concat_arrays([pa.array(mixtures(model, p.column(0)).sum(1) > 0, pa.bool_()) for p in slices(batch)])

    return docs.where(has_letter("text")).withColumn(name, known(F.col("text"))).where(F.col(name)).drop(name)


def op1(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))
