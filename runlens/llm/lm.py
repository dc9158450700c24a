"""Language-model scores: a backoff automaton of smoothed n-grams, walked once from left to right."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.blocks import IS_WHITE, LOWER, bounded_batches, chunk_hashes, id_hash, mix, slices, table, text_bytes, warm_worker, word_places

FOLDS = 7
HELD_OUT = 2
ORDER = 3
# Weight of the shorter context, in tokens: p(w | context) = (count + WEIGHT * p(w | shorter)) / (count of context + WEIGHT).
WEIGHT = 200.0
# Words of one block of documents, and keys that one counting task gets, on average.
BLOCK_WORDS = 800_000
BUCKET_KEYS = 500_000
# Tokens that one walker reads; a longer text is read by several, each of which first reads the tokens before its own.
STRETCH = 64
# Rows of what blocks get that hold, in place of a length of n-grams, the training tokens and how many of them are distinct.
TOKENS, DISTINCT = -1, -2
# Bytes of text that are cut into words at a time.
PIECE = 1 << 17
START = np.uint64(0x5354415254)
END = np.uint64(0x454E44)
ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of start, words and end of every text, and where each text begins, with the total last."""
    data, offsets = text_bytes(column)
    found, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    # A piece of the texts at a time, whose arrays stay in the processor's cache.
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        small = LOWER[data[offsets[at] : offsets[to]]]
        starts, ends, first = word_places(small, offsets[at : to + 1] - offsets[at])
        found.append(chunk_hashes(small, starts, ends))
        counts.append(np.diff(first))
        at = to
    heads = np.append(0, np.cumsum(np.concatenate(counts) + 2))
    out = np.empty(heads[-1], np.uint64)
    inside = np.ones(heads[-1], bool)
    inside[heads[:-1]] = inside[heads[1:] - 1] = False
    out[inside] = np.concatenate(found)
    out[heads[:-1]], out[heads[1:] - 1] = START, END
    return out, heads


def ngrams(found: np.ndarray, heads: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 ... order, the key of the n-gram that ends at each place; 0 where the text has too few tokens before it."""
    keys = [found]
    for n in range(2, order + 1):
        grown = np.zeros_like(found)
        grown[1:] = mix(keys[-1][:-1] * ODD + found[1:])
        for i in range(n - 1):
            grown[np.minimum(heads[:-1] + i, heads[1:] - 1)] = 0
        keys.append(grown)
    return keys


@dataclass(frozen=True)
class Grams:
    """Distinct n-grams of one length in a block: keys (ascending), first places, and the number of the n-gram at each place.

    Places without an n-gram of this length hold a number that nobody reads.
    """

    kinds: np.ndarray
    first: np.ndarray
    at: np.ndarray

    def counts(self, train: np.ndarray) -> np.ndarray:
        """How often each stands in training texts; ``train`` tells per place how many training rows it stands for."""
        return np.bincount(self.at + 1, train, len(self.kinds) + 1)[1:].astype(np.int64)


def ascending(key: np.ndarray) -> np.ndarray:
    """The stable order of ``key``."""
    return ranked(key)[0]


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of ``key``, and its numbers in that order.

    Numbers with their places in the low bits are sorted, which takes a fifth of the time of sorting places by number. Large
    numbers lose their low bits to the places; where two differ in these only, that may mix them, and places are sorted.
    """
    bits = np.uint64(len(key).bit_length())
    places = (np.uint64(1) << bits) - np.uint64(1)
    fits = int(key.max(initial=0)).bit_length() + int(bits) <= 64
    tagged = key << bits if fits else key & ~places
    tagged |= np.arange(len(key), dtype=np.uint64)
    tagged.sort()
    out = tagged >> bits if fits else None
    tagged &= places
    order = tagged.view(np.int64)
    if out is None:
        out = key[order]
        if (out[1:] < out[:-1]).any():
            order = np.argsort(key, kind="stable")
            out = key[order]
    return order, out


def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of ``key``, ascending, the first place of each, and the number of the one at each place."""
    order, numbers = ranked(key)
    new = np.ones(len(key), bool)
    np.not_equal(numbers[1:], numbers[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    at = np.empty(len(key), np.int64)
    at[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(key)))
    return numbers[starts], order[starts], at


def grams_of(key: np.ndarray) -> Grams:
    kinds, first, at = numbered(key)
    if len(kinds) and kinds[0] == 0:
        return Grams(kinds[1:], first[1:], at - 1)
    return Grams(kinds, first, at)


@dataclass(frozen=True)
class Automaton:
    """States are contexts that training has seen: level n holds those of n tokens, level 0 the empty one.

    Level n has, per arc, ``arcs[n]`` = state * words + token (ascending), its log10 probability ``logs[n]`` and the state
    it leads to; arcs of state s begin at ``starts[n][s]``. Per state there is the failure arc: ``fail_to[n]``, the state
    without its oldest token, and the log10 weight ``fail_log[n]`` of going there. Arcs of the empty state are numbered by
    their token: every token has one.
    """

    words: int
    arcs: list[np.ndarray]
    starts: list[np.ndarray]
    logs: list[np.ndarray]
    to: list[np.ndarray]
    fail_to: list[np.ndarray]
    fail_log: list[np.ndarray]
    known: np.ndarray


def automaton(grams: list[Grams], counts: list[np.ndarray], total: int, distinct: int, weight: float) -> Automaton:
    """The states and arcs that the block's texts can reach, from the corpus's ``counts`` of their n-grams.

    An arc's probability is smoothed with that of the arc for the same token one level lower, which training has seen
    too: p(w | context) = (count + weight * p(w | shorter)) / (count of context + weight). A token without an arc takes
    the failure arc, which weighs weight / (count of context + weight).
    """
    order, words = len(grams), len(grams[0].kinds)
    p = (counts[0] + 1.0) / (total + distinct + 1)
    none = np.zeros(0, np.int64)
    arcs, starts, logs, to = [none], [none], [np.log10(p)], [np.arange(words)]
    fail_to, fail_log = [none], [np.zeros(0)]
    for n in range(1, order):
        # States of n tokens, and the n-grams of n + 1 tokens that are their arcs.
        lower, here = grams[n - 1], grams[n]
        fail_log.append(np.log10(weight / (counts[n - 1] + weight)))
        fail_to.append(grams[n - 2].at[lower.first] if n > 1 else np.zeros(words, np.int64))
        # What training has seen has a seen context and ends in a shorter one that it has seen.
        seen = np.flatnonzero(counts[n] > 0)
        ends = here.first[seen]
        state, shorter = lower.at[ends - 1], lower.at[ends]
        by, arc = ranked((state * words + grams[0].at[ends]).astype(np.uint64))
        arcs.append(arc.view(np.int64))
        starts.append(np.append(0, np.cumsum(np.bincount(state, minlength=len(lower.kinds)))))
        own = (counts[n][seen] + weight * p[shorter]) / (counts[n - 1][state] + weight)
        logs.append(np.log10(own[by]))
        p = np.zeros(len(here.kinds))
        p[seen] = own
        # The longest states have order - 1 tokens.
        to.append((seen if n + 1 < order else shorter)[by])
    return Automaton(words, arcs, starts, logs, to, fail_to, fail_log, counts[0] > 0)


def stretches(heads: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where walkers begin to read, begin to score and end, and the text of each; longest first.

    A state is made by the last order - 1 tokens alone, so a walker that first reads these arrives in the state of one that
    came all the way. The start of a text is read, not scored.
    """
    lengths = np.diff(heads) - 1
    parts = np.maximum(1, -(-lengths // STRETCH))
    text = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = heads[text] + 1 + number * STRETCH
    end = np.minimum(begin + STRETCH, heads[text + 1])
    read = np.maximum(heads[text], begin - (order - 1))
    by = np.argsort(read - end, kind="stable")
    return read[by], begin[by], end[by], text[by]


def arc_of(auto: Automaton, level: int, state: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The arc for each token among those of its state, or -1. Most states have one or two, so few are halved often."""
    arcs, wanted = auto.arcs[level], state * auto.words + token
    low, high = auto.starts[level][state], auto.starts[level][state + 1]
    out = np.full(len(state), -1)
    left = np.flatnonzero(low < high)
    low, high, wanted = low[left], high[left], wanted[left]
    while len(left):
        middle = (low + high) >> 1
        here = arcs[middle]
        same, less = here == wanted, here < wanted
        out[left[same]] = middle[same]
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        stay = np.flatnonzero(~same & (low < high))
        left, low, high, wanted = left[stay], low[stay], high[stay], wanted[stay]
    return out


def walk(tokens: np.ndarray, heads: np.ndarray, auto: Automaton) -> np.ndarray:
    """log10 probability of each text: walkers go from left to right, carry their state and add up what arcs weigh.

    ``tokens`` are the words' numbers. All walkers take a step at a time; those whose state has no arc for the token take
    failure arcs, down to the empty state at most, and try again there.
    """
    top = len(auto.arcs) - 1
    read, begin, end, text = stretches(heads, top + 1)
    level, state, sums = np.zeros(len(read), np.int64), np.zeros(len(read), np.int64), np.zeros(len(read))
    longest = int((end - read).max(initial=0))
    walking = np.searchsorted(read - end, -np.arange(longest), side="left")
    for step in range(longest):
        n = walking[step]
        place = read[:n] + step
        token, gained = tokens[place], np.zeros(n)
        now, node = level[:n].copy(), state[:n].copy()
        for high in range(top, 0, -1):
            there = np.flatnonzero(now == high)
            if not len(there):
                continue
            arc = arc_of(auto, high, node[there], token[there])
            found = arc >= 0
            hit, arc, miss = there[found], arc[found], there[~found]
            gained[hit] += auto.logs[high][arc]
            level[hit], state[hit] = min(high + 1, top), auto.to[high][arc]
            now[hit] = -1
            gained[miss] += auto.fail_log[high][node[miss]]
            node[miss] = auto.fail_to[high][node[miss]]
            now[miss] = high - 1
        there = np.flatnonzero(now == 0)
        gained[there] += auto.logs[0][token[there]]
        level[there], state[there] = np.where(auto.known[token[there]], min(1, top), 0), token[there]
        sums[:n] += np.where(place >= begin[:n], gained, 0.0)
    return np.bincount(text, sums, len(heads) - 1)


def token_count(docs: DataFrame) -> int:
    """Words and ends of the texts of ``docs``; nothing is hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = 0
        for batch in batches:
            for part in slices(batch, most=PIECE):
                data, offsets = text_bytes(part.column("text"))
                inside = ~IS_WHITE[data]
                borders = np.unique(offsets)
                borders = borders[(borders > 0) & (borders < len(data))]
                every += part.num_rows + int(np.count_nonzero(inside[:1])) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))
                # A word that begins where the text before ends in one.
                every += int(np.count_nonzero(inside[borders] & inside[borders - 1]))
        yield pa.RecordBatch.from_pydict({"n": pa.array([every], pa.int64())})

    return docs.select("text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def dealt(rows: DataFrame, blocks: int, kind: str) -> DataFrame:
    """Rows of ``rows`` (doc_id, text, held_out) in compressed packs, ``block`` by a hash of id and text.

    Rows that repeat id and text are sent once a batch with their number, so however often they stand in the table, their
    block stays small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by(["block", "doc_id", "held_out", "text"], use_threads=False)
            found = found.aggregate([([], "count_all")]).sort_by("block").combine_chunks()
            blocks_here = found.column("block").to_numpy()
            at = [0, *(np.flatnonzero(np.diff(blocks_here)) + 1).tolist(), len(blocks_here)]
            for a, b in zip(at[:-1], at[1:]):
                part = found.slice(a, b - a).combine_chunks()
                data, offsets = text_bytes(pa.concat_arrays([c.cast(pa.large_string()) for c in part.column("text").chunks]))
                texts = pa.compress(data.tobytes(), codec="zstd", asbytes=True) if len(data) else b""
                lists = {
                    "ids": part.column("doc_id").to_pylist(),
                    "held": part.column("held_out").to_pylist(),
                    "times": part.column("count_all").to_pylist(),
                    "sizes": np.diff(offsets).tolist(),
                }
                types = {"ids": part.schema.field("doc_id").type, "held": pa.bool_(), "times": pa.int64(), "sizes": pa.int64()}
                columns = {name: pa.array([values], pa.list_(types[name])) for name, values in lists.items()}
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array([int(blocks_here[a])], pa.int64()), **columns, "texts": pa.array([texts], pa.binary())}
                )

    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks).cast("long"))
    schema = f"block long, ids array<{kind}>, held array<boolean>, times array<long>, sizes array<long>, texts binary"
    return rows.withColumn("block", block).mapInArrow(run, schema)


def unpacked(packs: pa.Table) -> pa.Table:
    """doc_id, held_out, times and text of the packs' rows."""
    columns = {to: pa.chunked_array([c.values.slice(c.offsets[0].as_py(), c.offsets[-1].as_py() - c.offsets[0].as_py()) for c in packs.column(name).chunks])
               for name, to in (("ids", "doc_id"), ("held", "held_out"), ("times", "times"))}
    sizes = [np.array(s.as_py(), np.int64) for s in packs.column("sizes")]
    data = [pa.decompress(t.as_py(), int(s.sum()), codec="zstd", asbytes=True) if s.sum() else b"" for t, s in zip(packs.column("texts"), sizes)]
    offsets = np.append(0, np.cumsum(np.concatenate(sizes)))
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(b"".join(data)))
    return pa.table({**columns, "text": texts})


def lm_scores(docs: DataFrame, order: int = ORDER, weight: float = WEIGHT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Documents are dealt into blocks by a hash of id and text. Length by length, each block sends its distinct n-grams with
    their training counts to counting tasks, by ranges of a 64-bit hash, and gets back which of them other blocks have and
    what these add. An n-gram goes out only if others have both (n-1)-grams inside it: else no other block can have it, and
    the block's own count is the whole count. The counting tasks of the words also tell the numbers of all training tokens and
    of distinct ones, whose sums go to every block. So a block knows the part of the automaton that its texts can reach, builds
    and walks it. Nothing that grows with the corpus is on the driver or in one task, but for the list of bucket borders
    (8 bytes per 500 000 tokens).
    Nulls: a null text is empty (one token, the end); a null id is hashed as the empty text. Repeated rows count and score
    each; an empty table gives no rows; other columns are not read. A very long text is a block of its own size, read by many
    walkers. There are no ties: a score depends on the text and the training rows alone.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = bounded_batches(docs).select("doc_id", "text", (id_hash(F.col("doc_id")) % FOLDS == HELD_OUT).alias("held_out"))
    size = token_count(rows)
    blocks = max(1, -(-size // BLOCK_WORDS))
    buckets = max(1, -(-size // BUCKET_KEYS))
    lower = np.array([(2**64 * i) // buckets for i in range(buckets)], np.uint64)
    bounds = lower[1:]
    packs = dealt(rows, blocks, kind)

    def block_grams(packed: pa.Table, lengths: range) -> tuple[pa.Table, np.ndarray, dict[int, Grams], np.ndarray]:
        """The rows, where each begins, the n-grams of the given lengths (less one), and how often each place stands in training texts."""
        warm_worker()
        found = unpacked(packed)
        hashes, heads = tokens(found.column("text").combine_chunks())
        keys = ngrams(hashes, heads, lengths[-1] + 1)
        times = np.where(found.column("held_out").to_numpy(), 0, found.column("times").to_numpy())
        return found, heads, {n: grams_of(keys[n]) for n in lengths}, np.repeat(times, np.diff(heads))

    def sender(length: int):
        def send(packed: pa.Table, sums: pa.Table | None = None) -> pa.Table:
            found = {"block": [], "bucket": [], "n": [], "keys": [], "numbers": [], "counts": []}
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            if packed.num_rows:
                _, _, grams, train = block_grams(packed, range(max(0, length - 1), length + 1))
                here = grams[length]
                asked = np.arange(len(here.kinds))
                if sums is not None:
                    # Another block has the n-gram only if it has both shorter ones inside it.
                    shorter, met = grams[length - 1], np.zeros(len(grams[length - 1].kinds), bool)
                    for numbers, n in zip(sums.column("numbers"), sums.column("n").to_pylist()):
                        met[np.cumsum(_unpacked(numbers.as_py(), n)).astype(np.int64)] = True
                    asked = np.flatnonzero(met[shorter.at[here.first]] & met[shorter.at[here.first - 1]])
                kinds, own = here.kinds[asked], here.counts(train)[asked]
                at = np.concatenate([[0], np.searchsorted(kinds, bounds), [len(kinds)]])
                for i in np.flatnonzero(np.diff(at)).tolist():
                    part = slice(at[i], at[i + 1])
                    keys = _packed(np.diff(kinds[part], prepend=lower[i]))
                    row = (packed.column("block")[0].as_py(), i, len(kinds[part]), keys, _packed(np.diff(asked[part], prepend=0)), _packed(own[part]))
                    for name, value in zip(found, row):
                        found[name].append(value)
            return pa.table({name: pa.array(values, t) for (name, values), t in zip(found.items(), types)})

        return (lambda packed: send(packed)) if not length else send

    def add(found: pa.Table) -> pa.Table:
        """The n-grams of each block that others have too, by their numbers there, and what those add to their counts.

        One more row, without block, tells how many training tokens the bucket has, and how many of its n-grams training has.
        """
        warm_worker()
        each = found.column("n").to_pylist()
        low = lower[found.column("bucket")[0].as_py()]
        keys = [low + np.cumsum(_unpacked(v.as_py(), n)) for v, n in zip(found.column("keys"), each)]
        own = np.concatenate([_unpacked(v.as_py(), n) for v, n in zip(found.column("counts"), each)]).astype(np.int64)
        kinds, _, inverse = numbered(np.concatenate(keys))
        # Whole numbers of float64 are exact up to 2^53.
        whole = np.bincount(inverse, own, len(kinds)).astype(np.int64)
        more = whole[inverse] - own
        met = (np.bincount(inverse, minlength=len(kinds)) > 1)[inverse]
        at = np.cumsum([0] + each)
        whole[kinds == START] = 0
        out = {"block": [None], "n": [0], "numbers": [None], "more": [None], "tokens": [int(whole.sum())], "distinct": [int(np.count_nonzero(whole))]}
        for a, b, block, packed in zip(at[:-1], at[1:], found.column("block").to_pylist(), found.column("numbers")):
            some = met[a:b]
            if some.any():
                numbers = np.cumsum(_unpacked(packed.as_py(), b - a))[some]
                for name, value in zip(out, (block, len(numbers), _packed(np.diff(numbers, prepend=np.uint64(0))), _packed(more[a:b][some]), None, None)):
                    out[name].append(value)
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table({name: pa.array(values, t) for (name, values), t in zip(out.items(), types)})

    def score(packed: pa.Table, sums: pa.Table) -> pa.Table:
        if not packed.num_rows:
            # A block that no text fell to.
            types = [packed.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.table({name: pa.array([], t) for name, t in zip(scored_as, types)})
        found, heads, by_length, train = block_grams(packed, range(order))
        grams = [by_length[n] for n in range(order)]
        counts = [g.counts(train) for g in grams]
        total = distinct = 0
        for length, n, numbers, more in zip(sums.column("length").to_pylist(), sums.column("n").to_pylist(), sums.column("numbers"), sums.column("more")):
            if length < 0:
                total, distinct = (n, distinct) if length == TOKENS else (total, n)
                continue
            at = np.cumsum(_unpacked(numbers.as_py(), n)).astype(np.int64)
            counts[length][at] += _unpacked(more.as_py(), n).astype(np.int64)
        words, at = grams[0].at, heads[:-1]
        scored = np.ones(heads[-1], bool)
        scored[at] = False
        # The start is a context that training has seen once a text, but no token: total and distinct leave it out.
        bases = np.where(scored, np.log10((counts[0] + 1.0) / (total + distinct + 1))[words], 0.0)
        logs = walk(words, heads, automaton(grams, counts, total, distinct, weight))
        out = {
            "doc_id": found.column("doc_id"),
            "held_out": found.column("held_out"),
            "n_tokens": pa.array(np.diff(heads) - 1),
            "n_known": pa.array(np.add.reduceat((scored & (counts[0] > 0)[words]).astype(np.int64), at)),
            "train_tokens": pa.array(np.full(len(at), total, np.int64)),
            "base_score": pa.array(np.add.reduceat(bases, at)),
            "score": pa.array(logs),
        }
        return pa.table(out).take(pa.array(np.repeat(np.arange(len(at)), found.column("times").to_numpy())))

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored_as = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    sent_as = "block long, bucket long, n long, keys binary, numbers binary, counts binary"
    blocked = packs.groupBy("block")
    sums = []
    for length in range(order):
        if length:
            sent = blocked.cogroup(sums[-1].groupBy("block")).applyInArrow(sender(length), sent_as)
        else:
            sent = blocked.applyInArrow(sender(0), sent_as)
        found = sent.groupBy("bucket").applyInArrow(add, "block long, n long, numbers binary, more binary, tokens long, distinct long")
        if not length:
            totals = found.where("block is null").agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct"))
        sums.append(found.where("block is not null").drop("tokens", "distinct"))
    # Every block gets the two numbers, as rows of their own.
    whole = docs.sparkSession.range(blocks).crossJoin(totals).selectExpr(
        "id as block", f"stack(2, {TOKENS}, coalesce(tokens, 0), {DISTINCT}, coalesce(distinct, 0)) as (length, n)", "cast(null as binary) as numbers", "cast(null as binary) as more"
    )
    every = reduce(DataFrame.unionByName, [*(part.withColumn("length", F.lit(i)) for i, part in enumerate(sums)), whole])
    return blocked.cogroup(every.groupBy("block")).applyInArrow(score, schema)


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, lowest first, as many as the largest needs, compressed: high planes are nearly equal."""
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + b"".join(_squeezed(np.ascontiguousarray(p).tobytes()) for p in planes)


def _squeezed(plane: bytes) -> bytes:
    """A plane with its length in front; as it is where compression does not help."""
    small = pa.compress(plane, codec="zstd", asbytes=True)
    return (len(small) if len(small) < len(plane) else 0).to_bytes(4, "little") + (small if len(small) < len(plane) else plane)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    out, at = np.zeros((8, n), np.uint8), 1
    for plane in range(data[0]):
        size = int.from_bytes(data[at : at + 4], "little")
        end = at + 4 + (size or n)
        found = data[at + 4 : end]
        out[plane] = np.frombuffer(pa.decompress(found, n, codec="zstd", asbytes=True) if size else found, np.uint8)
        at = end
    return np.ascontiguousarray(out.T).view("<u8").ravel()


def op6(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))
