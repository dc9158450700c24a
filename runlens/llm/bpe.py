"""BPE encoding and decoding: merges applied over an index from each pair to all its places."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runlens.llm.blocks import bounded_batches, slices, table

# Distinct chunks in each of the two generations that a task remembers; a chunk that is not met in one goes.
REMEMBERED = 150_000
# Words that it remembers for each of these, where chunks are parted into words first.
WORDS = 2
# Their bytes (or characters) in a generation, which long ones reach first.
HELD = 8 << 20
# Bytes of text whose new words are merged together.
AT_ONCE = 4 << 20
END = "</w>"
PRINTABLE = re.compile(rb"[!-~]+\Z")
# The split pattern of the tokenizer file, for lower-case ASCII.
ASCII_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
# Letters that are their own normal form, and whose small form is one letter too.
LETTERS = re.compile(r"[a-zÀ-ÖØ-öø-įı-ſА-Яа-я]+\Z")
# Punctuation (no apostrophe) between a letter or digit and the end of a chunk, which the tokenizer makes a word of its own.
# Letters whose small form ends in a mark (as of U+0130) and rarer scripts stay with their punctuation.
TAIL = re.compile(r"[!-&(-/:-@\[-`{-~](?<=[a-z0-9À-ÖØ-öø-įı-ſА-Яа-я].)[!-&(-/:-@\[-`{-~]*(?=\s|\Z)")
# Bytes of UTF-8 that begin the combining marks U+0300 to U+036F.
MARKS = re.compile(rb"[\xcc\xcd]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter by which byte-level files write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def words_of(text: bytes) -> list[bytes]:
    """Parts of a text that the tokenizer encodes on their own, whatever their case and the punctuation after them.

    It lower-cases too, but not before it looks for special tokens and puts letters and marks together: H and U+0331
    stay two, h and U+0331 become one.
    """
    if b"<|" in text or MARKS.search(text):
        return [w for c in text.split() for w in ([c] if b"<|" in c or MARKS.search(c) else words_of(c))]
    return TAIL.sub(r" \g<0>", text.lower().decode()).encode().split()


class PairMerger:
    """Merges of a BPE file, for many words at once.

    All symbols of all words stand in one linked array. An index maps each mergeable pair, by its rank, to the places
    where it stands; a heap holds the active ranks. The lowest rank is applied to all its places, and the pairs that
    arise there enter the index. A pair made of a merged symbol has a higher rank than that merge, as every symbol of
    the file comes from one merge; the constructor checks this.
    """

    def __init__(self, vocab: dict[str, int], merges: list[list[str]]):
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.final = np.array([vocab.get(c + END, -1) for c in letters], np.int64)
        made = {a + b: rank for rank, (a, b) in enumerate(merges)}
        if len(made) != len(merges) or any(made.get(x, -1) >= rank for rank, pair in enumerate(merges) for x in pair):
            raise ValueError("a symbol has two merges, or a merge uses a later one")
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = left << 32 | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.order[place], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word after the other, and where each begins, with the total last."""
        sizes = np.array([len(w) for w in words], np.int64)
        if not len(words) or not sizes.sum():
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        heads = np.append(0, np.cumsum(sizes))
        codes = np.frombuffer(b"".join(words), np.uint8)
        last = np.zeros(len(codes), bool)
        last[heads[1:][sizes > 0] - 1] = True
        symbol = np.where(last, self.final[codes], self.inner[codes])
        if (symbol < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        n = len(symbol)
        after = np.where(last, -1, np.arange(1, n + 1))
        before = np.arange(-1, n - 1)
        before[heads[:-1][sizes > 0]] = -1

        index: dict[int, np.ndarray] = {}
        later: dict[int, list[int]] = {}
        at = np.flatnonzero(~last)
        rank = self.ranks(symbol[at], symbol[at + 1])
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        bounds = np.append(np.flatnonzero(np.diff(rank, prepend=-1)), len(rank))
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            index[int(rank[s])] = at[s:e]
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            a, b, m = self.left[r], self.right[r], self.merged[r]
            places = index.pop(r, None)
            if r in later:
                arisen = np.array(later.pop(r), np.int64)
                places = np.unique(arisen if places is None else np.concatenate([places, arisen]))
            # A place is stale when an earlier merge took one of its symbols.
            places = places[(symbol[places] == a) & (after[places] >= 0)]
            places = places[symbol[after[places]] == b]
            if a == b and len(places) > 1:
                places = self._apart(places, after)
            if not len(places):
                continue
            gone = after[places]
            beyond = after[gone]
            symbol[places] = m
            symbol[gone] = -1
            after[places] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = places[inside]
            prior = before[places]
            near = np.concatenate([prior[prior >= 0], places[inside]])
            new = self.ranks(symbol[near], symbol[after[near]])
            some = new >= 0
            for k, p in zip(new[some].tolist(), near[some].tolist()):
                if k in later:
                    later[k].append(p)
                else:
                    later[k] = [p]
                    if k not in index:
                        heapq.heappush(heap, k)
        alive = symbol >= 0
        return symbol[alive], np.append(0, np.cumsum(alive))[heads]

    @staticmethod
    def _apart(places: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of overlapping places of a pair of equal symbols the first, third, ... of each run."""
        out, taken = [], -1
        for p in places.tolist():
            if p != taken:
                out.append(p)
                taken = int(after[p])
        return np.array(out, np.int64)


def joined(parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    ids, names = zip(*parts) if parts else ((), ())
    return b"".join(ids), b"".join(names)


class Chunks:
    """What ``encode`` gives for parts of texts that are encoded on their own, remembered; it gets the new ones.

    The word tokenizer splits at white space and has no merge or normal form across it, so there a text's ids are those of
    its runs without ASCII white space.
    """

    def __init__(self, encode: Callable[[list], list], remembered: int = REMEMBERED):
        self.encode, self.remembered = encode, remembered
        # Those of late, and the generation before them.
        self.known: dict = {}
        self.older: dict = {}
        self.held = 0

    def learn(self, texts: list[list]) -> None:
        here = set()
        for chunks in texts:
            here.update(chunks)
        new = here.difference(self.known)
        if len(self.known) + len(new) > self.remembered or self.held > HELD:
            self.older, self.known, self.held, new = self.known, {}, 0, here
        self.held += sum(map(len, new))
        older = self.older
        self.known.update({c: older[c] for c in new if c in older})
        rows = [c for c in new if c not in older]
        self.known.update(zip(rows, self.encode(rows)))


class PairEncoder:
    """Chunks to ids and decoded text (UTF-8, a space before each token) by the pair occurrence index, for a tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.merger = PairMerger(content["model"]["vocab"], content["model"]["merges"])
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        names = self.special | content["model"]["vocab"]
        self.names = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = b" " + name.encode()
        self.bytes = str.maketrans({c: chr(b) for b, c in enumerate(byte_letters())})
        # Only its normal form and its split into words are used.
        self.tokenizer = Tokenizer.from_file(path)

    def split(self, chunk: bytes) -> list[bytes | str]:
        """Words of a chunk in bytes; special tokens as text."""
        if chunk.isalpha():
            return [chunk.lower()]
        if PRINTABLE.match(chunk) and b"<|" not in chunk:
            return ASCII_WORDS.findall(chunk.lower())
        if LETTERS.match(text := chunk.decode()):
            return [text.lower().encode()]
        words = []
        for part in self.cut.split(text):
            if part in self.special:
                words.append(part)
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part)
                words += [w.translate(self.bytes).encode("latin-1") for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return words

    def __call__(self, chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
        split = [self.split(c) for c in chunks]
        plain = list({w for words in split for w in words if type(w) is bytes})
        ids, heads = self.merger.encode(plain)
        flat, places = ids.astype("<u4").tobytes(), heads.tolist()
        names = list(map(self.names.__getitem__, ids.tolist()))
        own = {s: (np.array([i], "<u4").tobytes(), self.names[i]) for s, i in self.special.items()}
        own.update((w, (flat[4 * a : 4 * b], b"".join(names[a:b]))) for w, a, b in zip(plain, places[:-1], places[1:]))
        return [own[words[0]] if len(words) == 1 else joined([own[w] for w in words]) for words in split]


def bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``.

    Nulls: a null text is empty (no ids, empty decoded text); a null id stays null. Repeated rows give repeated rows,
    an empty table none; other columns are not read. The file at ``path`` must be at that place on every executor.
    """
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(PairEncoder(path), WORDS * REMEMBERED)
        for batch in batches:
            for part in slices(batch, most=AT_ONCE):
                texts = [words_of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part.column("text").cast(pa.large_string())]
                chunks.learn(texts)
                counts, ids, decoded = [], [], []
                for words in texts:
                    flat, names = joined(list(map(chunks.known.__getitem__, words)))
                    counts.append(len(flat) // 4)
                    ids.append(hashlib.sha256(flat).hexdigest())
                    decoded.append(hashlib.sha256(names[1:]).hexdigest())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_tokens": pa.array(counts, pa.int64()),
                        "ids_sha256": pa.array(ids, pa.string()),
                        "decoded_sha256": pa.array(decoded, pa.string()),
                    }
                )

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5(spark, sf_dir):
    return bpe_round_trip(table(spark, sf_dir, "documents"))
