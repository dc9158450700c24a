"""Incremental ingest of statistics files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.schemas import STATS
from runlens.sources.stats import parse_stats, variant_of_file


def stats_stream(
    spark: SparkSession, path: str, marker: str = "stats", schema: str = STATS, variant: Column | None = None
) -> DataFrame:
    """New statistics files below ``path`` as a stream; by default the variant is in the file name."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if variant is None:
        reader = reader.option("pathGlobFilter", f"*.{marker}.*.jsonl")
        variant = variant_of_file(F.col("_metadata.file_name"), marker)
    lines = reader.text(path).select("value", variant.alias("_variant"))
    return parse_stats(lines, F.col("_variant"), schema)


def append_new(stream: DataFrame, out_path: str, checkpoint: str | None = None) -> None:
    """Append all rows not yet taken in to the Parquet table at ``out_path``, each row once.

    What was taken in is noted beside the table unless ``checkpoint`` names another place.
    """
    checkpoint = checkpoint or f"{out_path}/_state"
    run = (
        stream.writeStream.format("parquet")
        .option("path", out_path)
        .option("compression", "zstd")
        .option("checkpointLocation", checkpoint)
        .partitionBy("variant")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
