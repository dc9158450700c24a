"""Modules with a time limit: a timer per module turns one that never ends into ``timed out``."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RUNNING, ENDED, TIMED_OUT = "running", "ended", "timed out"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATES = "module string, state string, started long, ended long, code int"


def outcome(started: int | None, ended: int | None, limit: int, clock: int) -> str:
    """The state of a module at ``clock``, all in milliseconds: an end after the limit comes too late."""
    if ended is not None and (started is None or ended <= started + limit):
        return ENDED
    return TIMED_OUT if started is not None and started + limit <= clock else RUNNING


class Limit(StatefulProcessor):
    """Keeps the first start and the first end of a module; its timer stands at the start and the limit."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "started long, ended long, code int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:  # the clock's own rows
            return
        started, ended, code = self.seen.get() if self.seen.exists() else (None, None, None)
        before = started
        for row in rows:
            if row.kind == "start":
                started = row.ms if started is None else min(started, row.ms)
            elif row.kind == "end":
                first = (row.ms, row.code is None, row.code or 0)
                if ended is None or first < (ended, code is None, code or 0):
                    ended, code = row.ms, row.code
        self.seen.update((started, ended, code))
        state = outcome(started, ended, self.limit, timerValues.getCurrentWatermarkInMs())
        if before is not None and (before != started or state != RUNNING):
            self.handle.deleteTimer(before + self.limit)
        if started is not None and state == RUNNING:
            self.handle.registerTimer(started + self.limit)
        yield Row(module=key[0], state=state, started=started, ended=ended, code=code)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        started, ended, code = self.seen.get()
        yield Row(module=key[0], state=TIMED_OUT, started=started, ended=ended, code=code)


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Timers need this state store; the session's own choice is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def states(log: DataFrame, limit_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """Each change of a module's state, from a stream of ``module, kind, code, at``; rows may come ``delay`` late.

    The clock is the watermark: the latest time in the log less ``delay``. A row without module only moves the clock.
    """
    rows = log.withWatermark("at", delay).select("module", "kind", "code", "at", F.unix_millis("at").alias("ms"))
    return rows.groupBy("module").transformWithState(Limit(1000 * limit_seconds), STATES, "Update", "EventTime")


def track_limits(log: DataFrame, out_path: str, limit_seconds: int, delay: str = "0 seconds", checkpoint: str | None = None) -> None:
    """Take in all new rows of ``log`` and add the changed modules to the table at ``out_path``."""
    checkpoint = checkpoint or f"{out_path}/_state"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    with _rocks(log.sparkSession):
        run = (
            states(log, limit_seconds, delay)
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(save)
            .start()
        )
        run.awaitTermination()


def current_limits(spark: SparkSession, out_path: str) -> DataFrame:
    """``module, state, started, ended, code`` of every module in a table of ``track_limits``: its last state."""
    rows = spark.read.schema(f"{STATES}, batch long").parquet(out_path)
    # A timer fires after the rows of its batch.
    latest = F.max_by(F.struct("state", "started", "ended", "code"), F.struct("batch", F.col("state") != RUNNING))
    return rows.groupBy("module").agg(latest.alias("s")).select(
        "module", "s.state", F.timestamp_millis("s.started").alias("started"), F.timestamp_millis("s.ended").alias("ended"), "s.code"
    )
