import random
import re

import pytest
from tokenizers import Tokenizer

from runlens.llm import bpe, tokencount
from runlens.llm.blocks import table
from runlens.llm.registry import QUERIES

SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokencount.default_path())


def brute(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_whole_table(spark, sf, library):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in QUERIES["op12_token_counts"](spark, sf).collect()}
    assert len(found) == len(docs)
    for row in docs:
        n = brute(library, row["text"])
        assert tuple(found[row["doc_id"]]) == (row["doc_id"], len((row["text"] or "").encode()), n, n > 1024)


def long_texts():
    pick = random.Random(3)
    words = ["the", "don't", "we'll", "  ", "\n\n", "naïve", "日本語", "12345", "<|endoftext|>", "<|endof", "…", "'", "ſ", "a" * 30, "\t "]
    yield "x" * 5000
    yield " " * 3000 + "end" + " " * 3000
    yield "<|endoftext|>" * 300
    yield "日" * 2000 + "本 " * 400
    yield "'" * 1500 + "'ll" * 900
    yield ("word " * 100 + "y" * 1500) * 4
    for _ in range(25):
        yield "".join(pick.choice(words) + pick.choice(["", " "]) for _ in range(pick.randrange(300, 1500)))


@pytest.mark.parametrize("chunk,overlap", [(300, 40), (97, 20), (1000, 64)])
def test_splices_equal_the_library(spark, library, chunk, overlap):
    rows = [(i, t, "x") for i, t in enumerate(long_texts())]
    found = tokencount.token_counts(spark.createDataFrame(rows, SCHEMA), chunk=chunk, overlap=overlap)
    assert {r["doc_id"]: r["n_tokens"] for r in found.collect()} == {i: brute(library, t) for i, t, _ in rows}


def test_widening_is_needed_and_enough(library):
    counter = tokencount.Counter(tokencount.default_path())
    left, right = "some words " * 20 + "a" * 60, "a" * 300 + " and more words " * 20
    near, far = counter.pieces(left + right[:40], (len(left), len(left) + 40 - counter.margin)), counter.splice(left, right, 40)
    assert near[1] == [{}]
    assert far + brute(library, right) == brute(library, left + right)
    assert counter.splice("b" * 50, "b" * 90, 20) is None


def test_odd_rows(spark, library):
    rows = [(1, None, "a"), (None, "one two", "b"), (1, "", "c"), (1, "z " * 400, "d"), (1, "z " * 400, "e"), (None, "z" * 900, "f")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = tokencount.token_counts(docs, limit=1, chunk=100, overlap=50)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), brute(library, t), brute(library, t) > 1) for i, t, _ in rows]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert tokencount.token_counts(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        tokencount.token_counts(docs, chunk=100, overlap=10)


def test_each_part_is_encoded_once(library):
    counter = tokencount.Counter(tokencount.default_path())
    asked = []
    encode = counter.parts.encode
    counter.parts.encode = lambda parts: asked.extend(parts) or encode(parts)
    texts = ["some words, and some words", "(words) and, some words.\nsome don't", ""]
    assert counter.sizes(texts) == counter.sizes(texts) == [brute(library, t) for t in texts]
    assert sorted(asked) == sorted({p for t in texts for p in tokencount.PARTS.findall(t)})
    assert counter.sizes(["a <|endoftext|> b"]) == [brute(library, "a <|endoftext|> b")]


def test_parts_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(tokencount, "LONG_PARTS", 1000)
    counter = tokencount.Counter(tokencount.default_path())
    pick = random.Random(5)
    letters = [*"abzAZ019'.,(!$ \n\t ", "é", "ß", "ſ", "α", "日", "١", "²", "́", "\x1c", "\x85", "\xa0", " ", "　", "\x00", "×", "'s", "'ll", "“", "🤗", "᠎", "<|", "|>"]
    for _ in range(3000):
        text = "".join(pick.choice(letters) for _ in range(pick.randrange(40)))
        low = pick.randrange(len(text) + 5)
        ranges = (0, low), (low, low + pick.randrange(-4, 20)), (low, len(text) + 3)
        assert counter.sizes([text]) == [brute(library, text)], text
        assert counter.pieces(text, *ranges) == counter.whole_pieces(text, *ranges), (text, ranges)


def test_white_space_of_the_split(library):
    white = set(re.findall(f"[{tokencount.WHITE}]", "".join(map(chr, range(0x3100)))))
    for c in map(chr, range(0x3100)):
        pieces = [span for _, span in library.pre_tokenizer.pre_tokenize_str(f"!{c}{c}!")]
        assert (c in white) == (c == " " or pieces == [(0, 1), (1, 2), (2, 3), (3, 4)]), hex(ord(c))


def test_other_files_are_counted_whole():
    path = bpe.default_path()
    counter = tokencount.Counter(path)
    assert counter.parts is None and counter.sizes(["Some words, words"]) == [brute(Tokenizer.from_file(path), "Some words, words")]
