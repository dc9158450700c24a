import re
from itertools import permutations

from runlens.llm import audit
from runlens.llm.blocks import table

DOCS = "doc_id long, text string, lang string, mask string, N int"
LABELS = "doc_id long, quality int, toxic int, part string"


def brute(rows, labels):
    def words(t):
        return [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = []
    for doc_id, text, lang in rows:
        t = text or ""
        w = words(t)
        copy = doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u, _ in rows)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": copy,
        }
        docs.append((lang or "", fails, doc_id in good, doc_id in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        credit = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                failing = sum(d[1][f] for d in own)
                only = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                credit[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), only, sum(d[2] for d in gone), sum(d[3] for d in gone), f,
                ]
        for key, values in out.items():
            if key[0] == part:
                values[-1] = credit[values[-1]]
    return out


def found(df):
    rows = df.collect()
    assert len(rows) == len({tuple(r)[:3] for r in rows})
    return {tuple(r)[:3]: list(r)[3:] for r in rows}


def test_whole_table_equals_plain_filtering(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    marks = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    assert found(audit.op11(spark, sf)) == brute(rows, marks)


def test_odd_rows(spark):
    long = "word " * 300
    rows = [
        (1, None, None), (2, "", ""), (3, "", "en"), (None, "", "en"), (4, long, "en"), (4, long, "en"), (5, long, "de"),
        (6, "A B# C", "de"), (7, " ".join(f"w{i}" for i in range(250)), "en"), (7, "X" * 20_000, "en"), (None, long, None),
    ]
    labels = [(4, 1, 0), (4, 0, 1), (5, None, 1), (None, 1, 1), (7, 1, None), (9, 1, 1), (6, 1, 1)]
    docs = spark.createDataFrame([(*r, "m", 1) for r in rows], DOCS)
    marks = spark.createDataFrame([(*r, "p") for r in labels], LABELS)
    assert found(audit.filter_audit(docs, marks)) == brute(rows, labels)
    assert audit.filter_audit(docs.limit(0), marks).collect() == []
    assert found(audit.filter_audit(docs, marks.limit(0))) == brute(rows, [])
