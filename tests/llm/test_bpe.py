import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from runlens.llm import bpe
from runlens.llm.blocks import table

ODD = [
    "", None, "Hello  world's it's\n\tfoo123 ,.!? é ́x <|endoftext|>y 'S a b\x1cc​d 　 日本 ", "İ K ß ŉ ΑΣ ΣΑΣ.", "　", "a　b",
    "<|startoftext|><|endoftext|>x<|", "aaaa aaaaa aaaaaa abababab ===== ------- !!!!!!!", "x" * 9000, "'re'll's don't WE'VE", "\x00\x7f \x85 a\x85b", "🤗🤗 é ñ ñ",
]


def want(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.default_path())


def check(docs, tokenizer):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = bpe.bpe_round_trip(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(tokenizer, texts[r.doc_id]), texts[r.doc_id][:80]


def test_odd_texts(spark, tokenizer):
    rows = list(enumerate(ODD)) + [(None, "no id"), (0, "")]
    check(spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string"), tokenizer)


def test_documents(spark, sf, tokenizer):
    check(table(spark, sf, "documents"), tokenizer)


def test_empty_table(spark):
    assert bpe.bpe_round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_forgetting_changes_nothing(tokenizer):
    encoder = bpe.PairEncoder(bpe.default_path())
    small = bpe.Chunks(encoder, remembered=3)
    for text in ["one two three four five", "six one two", "seven"]:
        chunks = text.encode().split()
        small.learn([chunks])
        assert b"".join(small.known[c][0] for c in chunks) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_case_and_punctuation_share_a_word(tokenizer):
    asked = []

    def encode(words):
        asked.extend(words)
        return encoder(words)

    encoder = bpe.PairEncoder(bpe.default_path())
    chunks = bpe.Chunks(encode)
    text = "Élan élan, ÉLan Word word. WORD!! (word) don't DON'T. 'tis H̱ ẖ x<|endoftext|>Y. foo.\x1cbar a. b"
    words = bpe.words_of(text.encode())
    chunks.learn([words])
    assert asked.count(b"word") == 1 and b"WORD" not in asked and b"word." not in asked
    ids, names = bpe.joined([chunks.known[w] for w in words])
    found = tokenizer.encode(text, add_special_tokens=False).ids
    assert ids == np.array(found, "<u4").tobytes()
    assert names[1:].decode() == tokenizer.decode(found, skip_special_tokens=False)


def test_letters_and_marks(spark, tokenizer):
    letters = [chr(c) for c in range(0x41, 0x530)] + list("ẞẖΣ日١²")
    marks = ["", "̇", "̱", "̌", "̈", "̊", ".", ",", "'s", "'", "<", "̸", "\x1c", "\x85", " "]
    rows = [(i, f"a{x}{m} {x}{m}B {x}{m}. {x}!{m}") for i, (x, m) in enumerate((x, m) for x in letters for m in marks)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer)


def test_long_chunks_end_a_generation(monkeypatch):
    monkeypatch.setattr(bpe, "HELD", 100)
    chunks = bpe.Chunks(lambda words: list(map(len, words)))
    for i in range(20):
        chunks.learn([[b"%d" % i * 60]])
    assert len(chunks.known) + len(chunks.older) <= 4
