"""Text lines with a repeatable place in their file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = ["path", "block", "seq"]


def read_lines(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """``value`` with ``path, block, seq``: the order of lines inside a file.

    Files are found in subfolders too. Large files are read in blocks by many tasks; ``block`` is the
    block's offset, and ``seq`` grows by one per line inside a block.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )
