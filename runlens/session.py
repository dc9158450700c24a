"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Skewed join partitions are split at run time, and small shuffle partitions merged.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
# Rows that one task should sort: beyond that many per shuffle partition of the session, rows take more tasks.
TASK_ROWS = 250_000


def build(app: str = "runlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the cluster names it.

    A folder of our own is set only for local sessions that name none: on a cluster a
    machine-local folder would lose data with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="runlens-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session with another value of ``key`` for the writes inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


# Paths handed out inside ``scratch``, innermost last.
_owned: list[list[str]] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the working folder that no other call gets."""
    path = f"{work_dir(spark)}/runlens-{tag}-{uuid.uuid4().hex}"
    if _owned:
        _owned[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owns the intermediate tables written inside it and removes them at the end.

    Leave it only when the results are written or collected: until then they read those tables.
    """
    _owned.append([])
    try:
        yield
    finally:
        paths = _owned.pop()
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(name)}")


def keep(df: DataFrame, tag: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the working folder, in folders per ``by``, and read it back.

    This cuts lineage, survives lost executors, fixes values such as partition ids, and lets
    later steps prune columns and see real sizes.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, rows: int | None) -> int | None:
    """How many tasks ``rows`` take, where those are more than the session's shuffle partitions; else None."""
    tasks = -(-(rows or 0) // TASK_ROWS)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def _table_name(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def keep_bucketed(df: DataFrame, tag: str, key: str, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Like ``keep``, in buckets of ``key``, each sorted by it: as many as the session has shuffle partitions, or as ``rows`` take.

    Joins and groupings on ``key`` of such tables, and of parts of them, need no shuffle of the rows if all were given
    the same ``rows``.
    """
    spark = df.sparkSession
    buckets = tasks_for(spark, rows) or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, tag)
    name = _table_name(path)
    writer = df.repartition(buckets, key).write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key)
    (writer.partitionBy(*by) if by else writer).saveAsTable(name)
    return spark.table(name).select(*df.columns)
