"""Token counts of whole texts: huge ones are encoded in overlapping chunks and spliced at stable boundaries."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.blocks import bounded_batches, slices, table
from runlens.llm.bpe import REMEMBERED, WORDS, Chunks
from runlens.session import keep

LIMIT = 1024
# Characters of a chunk; longer texts are cut, and neighbours share OVERLAP characters at first.
CHUNK = 1 << 15
OVERLAP = 256
# How far behind a boundary the split pattern may look: three characters for 'll or a run of white space. Special
# strings of the tokenizer are added to it.
LOOK_AHEAD = 4
# Bytes of text that the library gets at once.
AT_ONCE = 1 << 18
# Parts that the library gets in one text, and characters of a part on average above which texts are not parted.
ROW = 2048
LONG_PARTS = 64
# The split that byte-level files name by use_regex.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
# Its white space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A text's parts, each of one or more whole pieces: letters before an ASCII character that is none, punctuation before one
# that is a letter or digit, what else stands between white space, each of these with the space before it; white space.
PARTS = re.compile(
    r" ?[A-Za-zÀ-ÖØ-öø-ſ]+(?=[\x00-@\[-`{-\x7f]|\Z)| ?[!-&(-/:-@\[-`{-~]+(?=[A-Za-z0-9])"
    rf"| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
ENDS_WHITE = re.compile(rf"[{WHITE}]\Z")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Counter:
    """The library, with the boundaries of the pieces that its split pattern makes.

    The pattern runs from left to right and never looks behind a place where a piece ends, merges stay inside a piece,
    and special strings are found from left to right too. So a text from a piece's end on is split as it would be
    alone, and a boundary found in a text holds for every longer text, if at least ``margin`` characters follow it.

    Where the file splits as ``BYTE_LEVEL`` does, texts without special strings are parted by ``PARTS``, and the library
    gets each part once as long as it is remembered: a text's tokens are those of its parts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.margin = LOOK_AHEAD + max(map(len, added), default=0)
        content = json.loads(self.tokenizer.to_str())
        parted = content["normalizer"] is None and content["pre_tokenizer"] == BYTE_LEVEL and not any(re.search(rf"[{WHITE}]", a) for a in added)
        self.parts = Chunks(self.part_sizes, WORDS * REMEMBERED) if parted and not content["model"].get("dropout") else None
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        vocab = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for token, i in vocab.items() if token.startswith("Ġ")]] = True

    def sizes(self, texts: list[str]) -> list[int]:
        split = list(map(self.split, texts))
        own = [words for words in split if words is not None]
        if own:
            self.parts.learn(own)
        whole = iter(self.whole_sizes([t for t, words in zip(texts, split) if words is None]))
        return [next(whole) if words is None else sum(map(self.parts.known.__getitem__, words)) for words in split]

    def whole_sizes(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def split(self, text: str) -> list[str] | None:
        """Parts of a text, or None if the library must take the whole text or parts would save little."""
        if self.parts is None or self.special.search(text):
            return None
        parts = PARTS.findall(text)
        return parts if len(parts) * LONG_PARTS >= len(text) else None

    def part_sizes(self, parts: list[str]) -> list[int]:
        """Tokens of each part. Those that begin with a space, and have no other, are one text: there a token begins with a
        space if and only if a part does."""
        out = [0] * len(parts)
        spaced = [i for i, p in enumerate(parts) if p[0] == " " and not ENDS_WHITE.search(p)]
        alone = [i for i, p in enumerate(parts) if p[0] != " " or ENDS_WHITE.search(p)]
        rows = [spaced[at : at + ROW] for at in range(0, len(spaced), ROW)]
        joined = ["".join([parts[i] for i in row]) for row in rows]
        for row, found in zip(rows, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            heads = np.flatnonzero(self.spaced[found.ids])
            if len(heads) != len(row):
                alone += row
                continue
            for i, n in zip(row, np.diff(heads, append=len(found)).tolist()):
                out[i] = n
        for at in range(0, len(alone), ROW):
            some = alone[at : at + ROW]
            for i, n in zip(some, self.whole_sizes([parts[i] for i in some])):
                out[i] = n
        return out

    def pieces(self, text: str, *ranges: tuple[int, int]) -> tuple[int, list[dict[int, int]]]:
        """Number of tokens, and for each range of places the boundaries inside with the tokens before them."""
        parts = self.split(text)
        if not parts:
            return self.whole_pieces(text, *ranges)
        self.parts.learn([parts])
        places = np.cumsum([0, *map(len, parts)])
        before = np.cumsum([0, *map(self.parts.known.__getitem__, parts)])
        out = []
        for low, high in ranges:
            # All parts that the range touches; white space at their end would join what the next part parts.
            first, last = np.searchsorted(places, [low, high], side="right").tolist()
            first, last = min(max(first - 1, 0), len(parts)), max(min(last, len(parts)), 0)
            while last < len(parts) and last and ENDS_WHITE.search(parts[last - 1]):
                last += 1
            start, gone = int(places[first]), int(before[first])
            _, (inside,) = self.whole_pieces(text[start : places[last]], (low - start, high - start))
            out.append({start + p: gone + k for p, k in inside.items()})
        return int(before[-1]), out

    def whole_pieces(self, text: str, *ranges: tuple[int, int]) -> tuple[int, list[dict[int, int]]]:
        """The same with the library's own offsets of the whole text."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in found.word_ids], np.int64)
        begins = np.array([a for a, _ in found.offsets], np.int64)
        first = np.ones(len(words), bool)
        first[1:] = words[1:] != words[:-1]
        heads = np.flatnonzero(first)
        places = begins[heads]
        out = []
        for low, high in ranges:
            some = slice(*np.searchsorted(places, [low, high + 1]))
            out.append(dict(zip(places[some].tolist(), heads[some].tolist())))
        return len(words), out

    def splice(self, left: str, right: str, overlap: int) -> int | None:
        """Tokens of ``left`` less those of ``right`` before a common boundary of both, in the overlap widened from ``overlap`` to all of ``right``."""
        while True:
            overlap = min(overlap * 8, len(right))
            _, (theirs,) = self.pieces(left + right[:overlap], (len(left), len(left) + overlap - self.margin))
            _, (own,) = self.pieces(right, (0, overlap - self.margin))
            common = [p for p in own if p + len(left) in theirs]
            if common:
                return theirs[common[0] + len(left)] - own[common[0]]
            if overlap == len(right):
                return None


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def cut(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(row, doc_id, n_bytes, n_tokens, place, text, shared) of ``docs`` (row, doc_id, text).

    A text of at most ``chunk`` characters is one row with its tokens. A longer one gives a row without tokens for every
    chunk, with the chunk's text and the first ``overlap`` characters of the next, none after the last.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        schema = pa.schema(
            [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("place", pa.int32()), ("text", pa.string()), ("shared", pa.string())]
        )
        for batch in batches:
            for part in slices(batch, most=AT_ONCE):
                texts = [t or "" for t in part.column("text").to_pylist()]
                short = [t for t in texts if len(t) <= chunk]
                sizes = iter(counter.sizes(short))
                at, rows = [], []

                def out() -> pa.RecordBatch:
                    found = pa.RecordBatch.from_pylist(rows, schema=schema)
                    own = part.select(["row", "doc_id"]).take(pa.array(at, pa.int64()))
                    at.clear(), rows.clear()
                    return pa.RecordBatch.from_arrays([*own.columns, *found.columns], [*own.schema.names, *found.schema.names])

                for i, text in enumerate(texts):
                    n_bytes = len(text.encode())
                    if len(text) <= chunk:
                        at.append(i)
                        rows.append({"n_bytes": n_bytes, "n_tokens": next(sizes)})
                        continue
                    for place, low in enumerate(range(0, len(text), chunk)):
                        high = low + chunk
                        at.append(i)
                        rows.append({"n_bytes": n_bytes, "place": place, "text": text[low:high], "shared": text[high : high + overlap]})
                        if len(rows) >= 64:
                            yield out()
                if rows:
                    yield out()

    schema = f"row long, doc_id {kind}, n_bytes long, n_tokens long, place int, text string, shared string"
    return bounded_batches(docs).select("row", "doc_id", "text").mapInArrow(run, schema)


def encoded(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """(row, place, n, head, tail): tokens of each chunk with what it shares, and its boundaries in the overlap with the
    chunk before (from this chunk's begin) and with the next (from that one's begin), each with the tokens before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        reach = overlap - counter.margin
        for batch in batches:
            for part in slices(batch, most=AT_ONCE):
                out = []
                for row, place, text, shared in zip(*(part.column(c).to_pylist() for c in ("row", "place", "text", "shared"))):
                    n, (head, tail) = counter.pieces(text + shared, (0, reach), (len(text), len(text) + reach))
                    tail = {p - len(text): k for p, k in tail.items()} if shared else {}
                    out.append({"row": row, "place": place, "n": n, "head": list(head.items()), "tail": list(tail.items())})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    spots = pa.map_(pa.int32(), pa.int32())
    schema = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("n", pa.int64()), ("head", spots), ("tail", spots)])
    return chunks.select("row", "place", "text", "shared").mapInArrow(run, "row long, place int, n long, head map<int,int>, tail map<int,int>")


def seams(parts: DataFrame) -> DataFrame:
    """(row, place, gain) of every chunk but the first of its text: the tokens that the chunk before counts less its own
    before their first common boundary; null if they have none."""
    before = parts.select("row", (F.col("place") + 1).alias("place"), "tail")
    met = before.join(parts.select("row", "place", "head"), ["row", "place"])
    common = F.array_min(F.array_intersect(F.map_keys("head"), F.map_keys("tail")))
    return met.withColumn("common", common).select(
        "row", "place", (F.col("tail")[F.col("common")] - F.col("head")[F.col("common")]).cast("long").alias("gain")
    )


def widened(chunks: DataFrame, failed: DataFrame, path: str, overlap: int) -> DataFrame:
    """``failed`` (row, place) with the gain after widening the overlap up to the whole chunk, null if that fails too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            pairs = zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())
            gains = [counter.splice(a, b, overlap) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([*batch.select(["row", "place"]).columns, pa.array(gains, pa.int64())], ["row", "place", "gain"])

    left = chunks.select("row", (F.col("place") + 1).alias("place"), F.col("text").alias("left"))
    right = chunks.select("row", "place", F.col("text").alias("right"))
    pairs = failed.select("row", "place").join(left, ["row", "place"]).join(right, ["row", "place"])
    return pairs.mapInArrow(run, "row long, place int, gain long")


def united(chunks: DataFrame, stuck: DataFrame) -> DataFrame:
    """``chunks`` of the rows of ``stuck`` (row, place) after joining each stuck chunk to the one before, numbered anew."""
    own = chunks.join(stuck.select("row").distinct(), "row", "left_semi").join(
        stuck.select("row", "place", F.lit(1).alias("stuck")), ["row", "place"], "left"
    )
    per_text = F.sort_array(F.collect_list(F.struct("place", F.coalesce("stuck", F.lit(0)).alias("stuck"), "text", "shared")))
    grouped = own.groupBy("row").agg(per_text.alias("c"))  # one text's chunks, which one row held before
    heads = F.filter("c", lambda x: x["stuck"] == 0)
    last = F.size(heads)

    def joined(head, i):
        end = F.when(i + 1 < last, F.get(heads, i + 1)["place"]).otherwise(F.lit(2**31 - 1))
        inside = F.filter("c", lambda x: (x["place"] >= head["place"]) & (x["place"] < end))
        return F.struct(
            i.cast("int").alias("place"),
            F.array_join(F.transform(inside, lambda x: x["text"]), "").alias("text"),
            F.element_at(inside, -1)["shared"].alias("shared"),
        )

    return grouped.select("row", F.explode(F.transform(heads, joined)).alias("u")).select("row", "u.*")


def long_counts(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """(row, n_tokens) of the texts cut into ``chunks`` (row, place, text, shared).

    A text's tokens are those of its last chunk and the gains of all seams. Where neighbours find no common boundary in
    ``overlap`` characters, the overlap is widened up to the whole chunk; texts that still have such seams go through
    again with the chunks there joined, so each round has fewer chunks and the last possible one has one per text.
    """
    sums = None
    while True:
        parts = keep(encoded(chunks.repartition("row", "place"), path, overlap), "encoded")
        gains = keep(seams(parts), "seams")
        failed = gains.where("gain is null")
        if not failed.isEmpty():
            wide = keep(widened(chunks, failed, path, overlap), "widened")
            gains = gains.where("gain is not null").unionByName(wide)
        stuck = gains.where("gain is null").select("row", "place")
        done = parts.groupBy("row").agg(F.max_by("n", "place").alias("n")).join(
            gains.groupBy("row").agg(F.sum("gain").alias("gain"), F.max(F.col("gain").isNull()).alias("stuck")), "row", "left"
        )
        whole = done.where("not coalesce(stuck, false)").select("row", (F.col("n") + F.coalesce("gain", F.lit(0))).alias("n_tokens"))
        sums = whole if sums is None else sums.unionByName(whole)
        if stuck.isEmpty():
            return sums
        chunks = keep(united(chunks, stuck), "united")


def token_counts(
    docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``, as the tokenizers library counts the whole text.

    Texts up to ``chunk`` characters are encoded at once. Longer ones are cut into chunks that are dealt over the
    cluster and spliced; results do not depend on ``chunk`` or ``overlap``. The tokenizer must split from left to right
    without looking back, as byte-level ones do. Nulls: a null text is empty and has no tokens; a null id stays null.
    Repeated rows give repeated rows, as each row counts on its own; an empty table gives none; other columns are not
    read.
    """
    path = path or default_path()
    if overlap <= _counter(path).margin or chunk < overlap:
        raise ValueError("the overlap must be longer than the margin of a boundary and no longer than a chunk")
    rows = keep(cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), path, chunk, overlap), "cut")
    columns = ["doc_id", "n_bytes", "n_tokens"]
    counts = rows.where("n_tokens is not null").select(*columns)
    cuts = rows.where("n_tokens is null")
    if not cuts.isEmpty():
        found = long_counts(cuts.select("row", "place", "text", "shared"), path, overlap)
        texts = cuts.where("place = 0").select("row", "doc_id", "n_bytes")
        counts = counts.unionByName(texts.join(found, "row").select(*columns))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def op12(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
