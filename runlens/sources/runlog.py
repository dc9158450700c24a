"""Run logs and name lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.keys import escape_key, module_of_folder, parse_key

LOG_END = r"^([^:]*) : ([0-9]+)$"


def parse_log(lines: DataFrame) -> DataFrame:
    """Log lines as ``module, kind, code``: ``Mod`` is a start, ``Mod : code`` an end.

    A line with a colon of any other form is an error; empty lines are passed over.
    """
    value = F.col("value")
    ended = value.contains(":")
    bad = F.raise_error(F.concat(F.lit("unexpected line format: "), value))
    module = F.when(~ended, value).when(value.rlike(LOG_END), F.regexp_extract(value, LOG_END, 1)).otherwise(bad)
    code = F.when(ended, F.regexp_extract(value, LOG_END, 2).try_cast("int"))
    return lines.filter(value != "").select(
        module.alias("module"), F.when(ended, "end").otherwise("start").alias("kind"), code.alias("code")
    )


def started(log: DataFrame) -> DataFrame:
    return log.filter(F.col("kind") == "start").select("module")


def ended(log: DataFrame) -> DataFrame:
    return log.filter(F.col("kind") == "end").select("module", "code")


def read_log(spark: SparkSession, path) -> DataFrame:
    return parse_log(spark.read.text(path))


def log_text(log: DataFrame) -> DataFrame:
    """Log lines of start and end events."""
    end = F.format_string("%s : %d", "module", "code")
    return log.select(F.when(F.col("kind") == "end", end).otherwise(F.col("module")).alias("value"))


def append_log(log: DataFrame, path: str) -> None:
    log_text(log).write.mode("append").text(path)


def problem_log_text(variant_index: Column, unit: Column, text: Column, status: Column, ms: Column, hb: Column) -> Column:
    """One problem as a line of ``name=value`` pairs; a missing value is left out."""
    fields = {"at": F.current_timestamp(), "variant": variant_index, "unit": unit, "status": status, "ms": ms, "hb": hb, "text": text}
    return F.concat_ws(" ", *[F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in fields.items()])


def append_problems(problems: DataFrame, path: str, as_text: bool = False) -> None:
    """Append ``variant_index, unit, text, status, ms, hb`` with the time of writing.

    Parquet rows by default, the text form with ``as_text``.
    """
    if as_text:
        cols = [F.col(c) for c in ("variant_index", "unit", "text", "status", "ms", "hb")]
        problems.select(problem_log_text(*cols).alias("value")).write.mode("append").text(path)
    else:
        problems.withColumn("started", F.current_timestamp()).write.mode("append").parquet(path)


def save_names(names: DataFrame, path: str) -> None:
    """Write ``module, key`` as one escaped key per line, a folder per module."""
    names.select("module", escape_key(F.col("key")).alias("value")).write.partitionBy("module").text(path)


def load_names(spark: SparkSession, path) -> DataFrame:
    """Name lists written by ``save_names``: ``module, key``."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(
        module_of_folder(F.col("_metadata.file_path")).alias("module"), parse_key(F.col("value")).alias("key")
    )


def write_count(df: DataFrame, path: str) -> None:
    """Write the number of rows as a text of one line."""
    df.agg(F.count("*").cast("string").alias("value")).write.text(path)
