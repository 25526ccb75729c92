"""Event streams: debounced runs, idempotent arrivals and the material lifecycle as state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trestle.operators.history import TRANSITIONS

#: Changes become final with a minute's others, when the watermark passes its end.
TIMER_MICROS = 60_000_000
QUIET = "350 milliseconds"
LIFECYCLE = "key string, status string, revision int, rejected int, at bigint"


def debounced_runs(events: DataFrame, ts: str = "ts", gap: str = QUIET, by: list[str] | None = None) -> DataFrame:
    """One row per burst of events: a run starts when no event came for ``gap``. For batch tables and, with a watermark, for streams."""
    runs = events.groupBy(*(by or []), F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n_events"))
    return runs.select(*(by or []), F.col("w.start").alias("first_event"), F.col("w.end").alias("run_at"), "n_events")


def new_arrivals(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Each key once, however often it arrives within the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


class Lifecycle(StatefulProcessor):
    """The state of one key: its status, revision and rejected changes, and the changes that wait for the watermark.

    A change waits until nothing earlier can come any more, so changes that arrive out of order are applied in order (by time, then
    by number). A change that repeats a number is one change; what comes later than the watermark allows is dropped by Spark
    before it gets here. A key that is quiet keeps three values and no waiting change.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, revision int, rejected int")
        self.waiting = handle.getMapState("waiting", "ts bigint, seq bigint", "action string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r.at, r.seq), (r.action,))
            self.handle.registerTimer((r.at // TIMER_MICROS + 1) * TIMER_MICROS // 1000)  # one timer for the changes of a minute
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted((tuple(k), v[0]) for k, v in self.waiting.iterator() if k[0] <= upto)
        if not due:
            return
        status, revision, rejected = self.now.get() if self.now.exists() else (None, 0, 0)
        for k, action in due:
            to, allowed = TRANSITIONS.get(action, (None, ()))
            if to is not None and status in allowed:
                status, revision = to, revision + 1
            else:
                rejected += 1
            self.waiting.removeKey(k)
        self.now.update((status, revision, rejected))
        yield Row(key=str(key[0]), status=status, revision=revision, rejected=rejected, at=due[-1][0][0])

    def close(self) -> None:
        pass


def lifecycle(changes: DataFrame, key: str = "key", action: str = "action", ts: str = "ts", order: str = "seq", delay: str = "1 hour") -> DataFrame:
    """The status of each key whenever changes of it become final: key, status, revision, rejected and at (microseconds of the last change).

    For streams of changes: create, update, archive and restore, each a revision where it is allowed. The last row of a key is its
    state. Needs the RocksDB state store (use_rocksdb).
    """
    rows = changes.withWatermark(ts, delay).select(F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("at"), F.col(order).cast("bigint").alias("seq"), F.col(action).alias("action"), ts)
    return rows.groupBy("key").transformWithState(Lifecycle(), LIFECYCLE, "append", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """A set-up step: keyed state lies on the executors' disks and in checkpoints, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
