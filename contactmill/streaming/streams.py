"""Structured Streaming twins of the batch state operators.

Event time may be a day late; what comes later is dropped, which bounds the state. Timestamps without zone are cast, for
a watermark needs one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from contactmill.operators.breaker import BASE, CAP, CLOSED, LIMIT, fold

LATE = "1 day"


def read_events(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, with `ts` as a zoned timestamp."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def dedupe(events: DataFrame, keys: list[str], at: str = "ts", late: str = LATE) -> DataFrame:
    """Each key once within the lateness."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, keys: list[str], size: str, at: str = "ts", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Count and sum of each key in each window."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = events.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, keys: list[str], gap: str, at: str = "ts", late: str = LATE) -> DataFrame:
    """Runs of activity of each key, parted by gaps."""
    out = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


class InOrder(StatefulProcessor):
    """Events of a key (us, flag) are kept until the watermark has passed them and then taken in order of time, so results don't
    depend on how events are dealt over batches. A subclass folds them (`take`) over a state of long numbers; a key's
    state is dropped `keep` seconds after its last event."""

    names: tuple[str, ...] = ()
    key = "key"
    keep = 0.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us long, flag boolean")
        self.state = handle.getValueState("state", ", ".join(f"{n} long" for n in self.names))
        self.armed = handle.getValueState("armed", "ms long")

    def take(self, key: tuple, events: list[tuple[int, bool]], state: tuple | None) -> tuple[list[tuple], tuple, int]:
        """Rows, the state after the events, and the microsecond from which `keep` counts."""
        raise NotImplementedError

    def columns(self) -> list[str]:
        raise NotImplementedError

    def _arm(self, us: int) -> None:
        """A timer for the first event that waits, unless an earlier one is set."""
        ms = us // 1000 + 1
        if not self.armed.exists() or self.armed.get()[0] > ms:
            self.armed.update((ms,))
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = [(int(us), bool(flag)) for part in rows for us, flag in zip(part["us"], part["flag"], strict=True)]
        if new:
            self.pending.appendList(new)
            self._arm(min(us for us, _ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((r[0], r[1]) for r in self.pending.get())
        ready = [e for e in waiting if e[0] <= passed]
        if not ready:
            # The timer of a state's end, or one that an earlier release has served.
            if not waiting and self.state.exists() and self.state.get()[-1] <= passed:
                self.state.clear()
            return
        rows, state, last = self.take(key, ready, self.state.get()[:-1] if self.state.exists() and self.state.get()[-1] > ready[0][0] else None)
        end = last + int(self.keep * 1_000_000)
        self.state.update((*state, end))
        self.handle.registerTimer(end // 1000 + 1)
        self.armed.clear()
        if rest := waiting[len(ready) :]:
            self.pending.put(rest)
            self._arm(rest[0][0])
        else:
            self.pending.clear()
        if rows:
            yield pd.DataFrame(rows, columns=self.columns())

    def close(self) -> None:
        pass


def _in_order(events: DataFrame, key: str, flag: Column, processor: InOrder, added: str, late: str) -> DataFrame:
    rows = events.withWatermark("ts", late).select(F.col(key).cast("long").alias(key), "ts", F.unix_micros("ts").alias("us"), F.coalesce(flag, F.lit(False)).alias("flag"))
    processor.key = key
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} long, ts timestamp, {added}", "append", "EventTime")


def _stamp(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


class Due(InOrder):
    names = ("last", "end")

    def __init__(self, days: int) -> None:
        self.keep = days * 86400

    def columns(self) -> list[str]:
        return [self.key, "ts", "due"]

    def take(self, key, events, state):
        last, rows = (state[0] if state else None), []
        for us, _ in events:
            rows.append((key[0], _stamp(us), last is None or us - last > self.keep * 1_000_000))
            last = us
        return rows, (last,), last


def due(events: DataFrame, key: str, days: int = 7, late: str = LATE) -> DataFrame:
    """R2: for each event (key, ts) whether the key was due: never seen before, or longer ago than the time to live, after
    which its state is dropped. Events come out once the watermark has passed them."""
    return _in_order(events, key, F.lit(False), Due(days), "due boolean", late)


#: Parts by hash of the key that stored keys lie in.
KEY_PARTS = 64


def persist(spark: SparkSession, path: str, keys: list[str], order: str, parts: int = KEY_PARTS) -> Callable[[DataFrame, int], None]:
    """A writer for `run_once` that appends each batch's first row of every key that isn't stored yet, as soon as it is
    found. Keys lie in folders by hash, and a batch reads only those of its own keys. A batch that is repeated after a failure
    stores nothing twice."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy(*keys).agg(F.min(order).alias(order)).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).persist()
        try:
            touched = [r[0] for r in rows.select("part").distinct().collect()]  # at most `parts` numbers
            try:
                stored = spark.read.schema(rows.schema).parquet(path).where(F.col("part").isin(touched))
                new = rows.join(stored.select("part", *keys), ["part", *keys], "left_anti")
            except AnalysisException:  # nothing stored yet
                new = rows
            new.write.mode("append").partitionBy("part").parquet(path)
        finally:
            rows.unpersist()

    return each


def persisted(spark: SparkSession, path: str) -> DataFrame:
    """What `persist` has stored."""
    return spark.read.parquet(path).drop("part")


class Breaker(InOrder):
    names = ("run", "trips", "until", "end")

    def __init__(self, limit: int, base: int, cap: int, keep: float) -> None:
        self.limit, self.base, self.cap, self.keep = limit, base, cap, keep

    def columns(self) -> list[str]:
        return [self.key, "ts", "state", "trips"]

    def take(self, key, events, state):
        found, after = fold([us for us, _ in events], [bad for _, bad in events], tuple(state) if state else CLOSED, self.limit, self.base, self.cap)
        return [(key[0], _stamp(events[i][0]), what, trips) for i, what, trips in found], after, max(events[-1][0], after[2])


def breaker(events: DataFrame, key: str, limit: int = LIMIT, base: int = BASE, cap: int = CAP, keep: float = 86400, late: str = LATE) -> DataFrame:
    """A circuit for each key: `limit` failures in a row open it for base * 2^trips seconds, `cap` at most; the first
    event after that closes it on success or opens it again. `events`: (key, ts, failed). One row for each change. A key
    without events for `keep` seconds, or while its circuit is open if that is longer, is forgotten. Events come out once the watermark has passed
    them, in order, failures last among those of one time."""
    return _in_order(events, key, F.col("failed"), Breaker(limit, base, cap, keep), "state string, trips long", late)


#: The state store that keyed state with timers needs.
_STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_once(stream: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process all there is and stop. Output goes to Parquet in `folder`, or to `each` batch by batch (R1: foreachBatch)."""
    conf = stream.sparkSession.conf
    before = conf.get(_STORE[0], None)
    conf.set(*_STORE)
    try:
        w = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
        q = w.foreachBatch(each).start() if each else w.format("parquet").option("path", f"{folder}/out").start()
        q.awaitTermination()
    finally:
        conf.unset(_STORE[0]) if before is None else conf.set(_STORE[0], before)
