import zlib

import numpy as np
import pyarrow as pa

from runlens.llm import langid
from runlens.llm.blocks import table

SCHEMA = "doc_id long, text string, lang string, known string, score string"


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.language_id(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def model():
    texts = ["the cat sat on the mat with the hat", "der hund und die katze sind nicht schön"]
    counts = np.zeros((1 << langid.BITS, 2))
    for i, t in enumerate(texts):
        counts[:, i] = np.bincount(langid.grams(pa.array([t]))[0], minlength=1 << langid.BITS)
    return langid.Model(["en", "xx"], np.log((counts + 0.5) / (counts.sum(0) + 0.5 * (1 << langid.BITS))).astype(np.float32))


def test_mixture_matches_plain_em():
    """Against EM written out word by word for one text."""
    m = model()
    text = "the cat und der hund sat on die mat the hat " * 4
    words = text.split()
    like = []
    for w in words:
        codes = langid.grams(pa.array([w]))[0]
        like.append(np.exp(m.log_p[codes].sum(0) - m.log_p[codes].sum(0).max()))
    like = np.array(like, float)
    share = np.full(2, 0.5)
    for _ in range(langid.ROUNDS):
        r = like * share
        share = (r / r.sum(1, keepdims=True)).mean(0)
    fits = []
    for size in (1, 2):
        part = np.where(np.argsort(np.argsort(-share)) < size, share, 0)
        part /= part.sum()
        for _ in range(langid.ROUNDS if size > 1 else 0):
            r = like * part
            part = (r / r.sum(1, keepdims=True)).mean(0)
        fits.append((np.log((like * part).sum(1) + 1e-30).sum() - langid.PENALTY * size * np.log(len(words) + 1), part))
    got = langid.mixtures(m, pa.array([text, "", None, "1 2 !"]))
    assert np.allclose(got[0], max(fits, key=lambda f: f[0])[1], atol=1e-3)
    assert got[0].min() > 0.2
    assert not got[1:].any()


def test_texts_do_not_see_their_neighbours():
    m = model()
    texts = ["the cat", "die katze", "sat on", "Ünd"]
    together = langid.mixtures(m, pa.array(texts))
    assert np.allclose(together, np.concatenate([langid.mixtures(m, pa.array([t])) for t in texts]))


def test_odd_rows(spark):
    english, german = "the house and the garden were in the town", "das haus und der garten waren nicht schön"
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !!", "de"), (103, "日本", None), (None, english, None), (1, english, "en"), (104, english * 20_000, None)]
    docs = spark.createDataFrame([(i, t, lang, "clash", "clash") for i, t, lang in rows], SCHEMA)
    got = {(r.doc_id, r.lang_pred) for r in langid.language_id(docs).collect()}
    assert {(100, "und"), (101, "und"), (102, "und"), (1, "en"), (2, "de"), (104, "en"), (None, "en")} <= got
    assert (103, "und") not in got
    left = langid.with_language(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, *_ in rows if i not in (100, 101, 102))


def test_nothing_to_learn_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some words", None, None, None), (2, "", None, None, None)], SCHEMA)
    assert {r.lang_pred for r in langid.language_id(docs).collect()} == {"und"}
    assert [r.doc_id for r in langid.with_language(docs).collect()] == [1]
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.language_id(empty).collect() == []
    assert langid.with_language(empty).collect() == []
