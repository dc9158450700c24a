"""Nested metrics, key escaping and status codes."""

import pytest
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions import keys, nested


def stats_frame(spark, rows):
    schema = spark.createDataFrame([], schemas.STATS).schema
    full = [{f.name: row.get(f.name) for f in schema.fields} for row in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in full], schema)


def goal(*clusters, depth=1, size=1):
    rules = [{"clusterStateStats": None if c is None else [{"instantiationStats": list(range(n))} for n in c]} for c in clusters]
    return {"depth": depth, "lctxSize": size, "forwardStateStats": {"ruleStateStats": rules}}


def test_metrics(spark):
    rule = lambda b, ok: {"rule": {"builder": b}, "successful": ok}
    rows = [
        {
            "declaration": "a",
            "ruleStats": [rule("forward", True), rule("forward", None), rule("forward", False), rule("x", True)],
            "goalStats": [goal([2, 0], depth=4, size=9), goal([5], None, depth=2), {"depth": 7, "lctxSize": 1, "forwardStateStats": None}],
        },
        {"declaration": "b", "ruleStats": [], "goalStats": []},
        {"declaration": "c", "ruleStats": None, "goalStats": None},
    ]
    got = {r["declaration"]: r for r in nested.with_metrics(stats_frame(spark, rows)).collect()}
    pick = lambda r: tuple(r[c] for c in ["forward_success", "forward_total", "max_instantiations", "max_depth", "max_lctx_size"])
    assert pick(got["a"]) == (1, 3, 5, 7, 9)
    assert pick(got["b"]) == (0, 0, None, None, None)
    assert pick(got["c"]) == (None, None, None, None, None)


@pytest.mark.parametrize(
    "parts, escaped",
    [
        ([("Foo", None), ("bar", None)], "Foo.bar."),
        ([("A", None), (None, 3)], "A.\\3."),
        ([("a.b", None)], "a\\db."),
        ([("a\\d", None)], "a\\\\d."),
        ([("x\ny", None), ("\\", None)], "x\\ny.\\\\."),
        ([("a\\\\.\\n", None)], "a\\\\\\\\\\d\\\\n."),
    ],
)
def test_keys_round_trip(spark, parts, escaped):
    df = spark.createDataFrame([(parts,)], f"p {keys.PARTS_TYPE}")
    row = df.select(keys.escape_key(F.col("p")).alias("e"), keys.parse_key(keys.escape_key(F.col("p"))).alias("back")).first()
    assert row["e"] == escaped
    assert [tuple(x) for x in row["back"]] == parts


def test_key_views(spark):
    row = spark.range(1).select(
        keys.normalize_key(F.lit("A.\\3.b\\dc..")).alias("plain"),
        keys.file_safe(F.lit("A.b_c'1")).alias("safe"),
        keys.file_safe(F.lit("A..b")).alias("empty_part"),
        keys.path_prefixes(F.lit("A.b.c")).alias("paths"),
        keys.module_of_path(F.lit("file:/data/run/A/b/c.result"), "/data/run", ".result").alias("module"),
        keys.first_part(F.lit("Lib.x")).alias("first"),
    ).first()
    assert row["plain"] == "A.3.b.c"
    assert row["safe"] and not row["empty_part"]
    assert row["paths"] == ["/A", "/A/b", "/A/b/c"]
    assert (row["module"], row["first"]) == ("A.b.c", "Lib")


def test_status_codes(spark):
    df = spark.createDataFrame([("S",), ("E",), ("?",)], "status string")
    got = {r["status"]: r["status_class"] for r in schemas.decode_status(df).collect()}
    assert got == {"S": "success", "E": "exception", "?": None}
    back = schemas.encode_status(schemas.decode_status(df).drop("status")).select("status").collect()
    assert sorted(str(r["status"]) for r in back) == ["E", "None", "S"]
