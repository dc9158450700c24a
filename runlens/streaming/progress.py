"""Run progress from a growing run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.sources.runlog import parse_log
from runlens.streaming.tail import tail


def progress(log: DataFrame) -> DataFrame:
    """Per module: whether it started and ended, its exit code, and whether it is still running.

    Works on batch and streaming logs; the state is one row per module.
    """
    started = F.max(F.col("kind") == "start")
    ended = F.max(F.col("kind") == "end")
    return log.groupBy("module").agg(
        started.alias("started"), ended.alias("ended"), F.max("code").alias("code"), (~ended).alias("running")
    )


def track(spark: SparkSession, log_path: str, out_path: str, checkpoint: str | None = None) -> None:
    """Take in the lines appended to the log files since the last call and add the changed modules to the table at ``out_path``.

    Files may grow and new ones may come; what was read before is not read again. What was taken in is noted beside the
    table unless ``checkpoint`` names another place.
    """
    states = progress(parse_log(tail(spark, log_path)))

    def save(batch: DataFrame, number: int) -> None:
        # A batch that runs again writes the same folder again, so no row is doubled.
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    run = (
        states.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint or f"{out_path}/_state")
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    run.awaitTermination()


def current(spark: SparkSession, out_path: str) -> DataFrame:
    """The state of every module in a table written by ``track``: what any batch has seen of it."""
    rows = spark.read.parquet(out_path)
    merged = rows.groupBy("module").agg(F.max("started").alias("started"), F.max("ended").alias("ended"), F.max("code").alias("code"))
    return merged.withColumn("running", ~F.col("ended"))
