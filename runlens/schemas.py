"""Schemas of the tables and the status codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "variant string, unit string, ok boolean, value bigint"

STATS = """declaration string, total bigint, search bigint, script bigint, ruleSetConstruction bigint,
ruleSelection bigint, forwardState bigint, configParsing bigint, syntax string, file string, goalSolved boolean,
ruleStats array<struct<rule:struct<builder:string>,successful:boolean>>,
goalStats array<struct<depth:bigint,lctxSize:bigint,forwardStateStats:struct<ruleStateStats:array<struct<
clusterStateStats:array<struct<instantiationStats:array<bigint>>>>>>>>"""

# Status codes and their classes.
STATUS = {
    "S": "success",
    "N": "nonProp",
    "F": "typeCheckFail",
    "U": "typeUnequal",
    "T": "nonterminate",
    "G": "subGoals",
    "E": "exception",
}


def status_table(spark: SparkSession) -> DataFrame:
    """The seven codes with their classes; a dimension of fixed size."""
    return spark.createDataFrame(list(STATUS.items()), "code string, class string")


def decode_status(df: DataFrame, code: str = "status", into: str = "status_class") -> DataFrame:
    """Class of a status code; NULL for an unknown code."""
    dim = status_table(df.sparkSession).select(F.col("code").alias(code), F.col("class").alias(into))
    return df.join(F.broadcast(dim), code, "left")


def encode_status(df: DataFrame, status_class: str = "status_class", into: str = "status") -> DataFrame:
    """Code of a status class; NULL for an unknown class."""
    dim = status_table(df.sparkSession).select(F.col("class").alias(status_class), F.col("code").alias(into))
    return df.join(F.broadcast(dim), status_class, "left")


def is_success(status: Column) -> Column:
    return status == F.lit("S")
