"""Statistics files: JSON lines, the variant in the file name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.schemas import STATS

BROKEN = "_corrupt_record"


def variant_of_file(name: Column, marker: str) -> Column:
    """Variant from ``<module>.<marker>.<variant>.jsonl``."""
    return F.regexp_extract(name, rf"^.*\.{marker}\.(.*)\.jsonl$", 1)


def parse_stats(lines: DataFrame, variant: Column, schema: str = STATS) -> DataFrame:
    """Statistics rows with ``variant`` and ``_corrupt_record`` (the text of a broken line).

    Blank lines are passed over.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    record = F.from_json("value", f"{schema}, {BROKEN} string", options)
    rows = lines.filter(F.trim("value") != "").select(variant.alias("variant"), record.alias("r"))
    return rows.select("variant", "r.*")


def read_stats(spark: SparkSession, path, marker: str = "stats", schema: str = STATS) -> DataFrame:
    """All statistics files below ``path``, broken lines kept with their text."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{marker}.*.jsonl")
    lines = reader.text(path).select("value", F.col("_metadata.file_name").alias("file_name"))
    return parse_stats(lines, variant_of_file(F.col("file_name"), marker), schema)


def good_rows(stats: DataFrame) -> DataFrame:
    return stats.filter(F.col(BROKEN).isNull()).drop(BROKEN)


def load_totals(stats: DataFrame) -> DataFrame:
    """Rows read and lines that could not be decoded."""
    return stats.agg(
        F.count_if(F.col(BROKEN).isNull()).alias("rows"), F.count_if(F.col(BROKEN).isNotNull()).alias("errors")
    )


def as_runs(stats: DataFrame, unit: str = "declaration", value: str = "total", ok: str = "goalSolved") -> DataFrame:
    """Statistics rows in the run columns ``unit, value, ok``; other columns stay."""
    return stats.withColumnsRenamed({unit: "unit", value: "value", ok: "ok"})


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows, matched by column name; missing columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_table(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet with zstd, in folders per ``by``."""
    df.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)


def read_table(spark: SparkSession, path, view: str | None = None, merge: bool = False) -> DataFrame:
    """A Parquet table; ``merge`` unites differing file schemas, ``view`` names it for SQL."""
    df = spark.read.option("mergeSchema", str(merge).lower()).parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df
