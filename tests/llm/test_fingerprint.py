import hashlib

from runlens.llm import fingerprint
from runlens.llm.blocks import table


def check(docs, rows):
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(fingerprint.fingerprints(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [i for i, _ in ordered]
    by_text = {}
    for k, (r, (_, text)) in enumerate(zip(got, ordered)):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert r.near_next == alike(r.fingerprint, got[(k + 1) % len(got)].fingerprint)
        assert r.near_edited == alike(r.fingerprint, r.edited_fingerprint)
    return got


def alike(a, b):
    a, b = ({int(x[i : i + 8], 16) for i in range(0, len(x), 8)} for x in (a, b))
    bins = len({x >> 26 for x in a | b})
    return len(a & b) / bins if bins else 1.0


def test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    got = check(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sum(r.near_edited for r in got) > 20 * sum(r.near_next for r in got)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 1000}" for i in range(60_000))
    rows = [(None, "no id here"), (-4, ""), (1, None), (2, " \n\t"), (3, "one"), (5, "x" * 50_000), (9, "é ü 日本 🤗 " * 30), (10, long), (11, long + "end"), (12, "a " * 4000)]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, bucket string, sig string")
    got = {r.doc_id: r for r in check(docs, rows)}
    assert got[10].near_next > 0.9
    assert got[3].fingerprint and not got[1].fingerprint


def test_order_and_repeats_matter(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[200:] + words[:200]), " ".join(words + words), " ".join(words[:390] + ["new"] + words[390:])]
    got = fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    prints = [r.fingerprint for r in got]
    assert alike(prints[0], prints[3]) > 0.85
    assert alike(prints[0], prints[1]) < 0.7
    assert alike(prints[0], prints[2]) < 0.6


def test_equal_rows_and_single_row(spark):
    rows = [(7, "same text twice"), (7, "same text twice"), (7, "same text twice")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    one = check(spark.createDataFrame([(1, "alone")], "doc_id long, text string"), [(1, "alone")])
    assert one[0].near_next == 1.0


def test_empty_table(spark):
    assert fingerprint.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_plan_has_no_python(spark, sf):
    plan = fingerprint.fingerprints(table(spark, sf, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
