"""Streams whose state moves on by timers while no row comes: memory over empty ticks, alarms on silence.

State lies in Spark's RocksDB store and is keyed, a few values a key, so it grows with places and feeds, not with rows. A
restart with the same ``folder`` goes on where the last run stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from waymark.sources.sinks import shared_folder

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_with_timers(df: DataFrame, folder: str, each: Callable[[DataFrame, int], None], live: str | None = None):
    """Starts a stream with timers; without ``live`` (a trigger interval) it reads what is there and ends."""
    spark = df.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # a query keeps the provider with which it starts
    try:
        writer = df.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(each)
        query = writer.trigger(processingTime=live).start() if live else writer.trigger(availableNow=True).start()
        if not live:
            query.awaitTermination()
        return query
    finally:
        spark.conf.set(_PROVIDER, before)


def _kept(df: DataFrame, folder: str | None) -> DataFrame:
    """Runs ``df`` over what is there; all rows that this and earlier runs with ``folder`` have given."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark, "stream")
    run_with_timers(df, folder, lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/rows/batch={i}"))
    return spark.read.schema(df.schema).parquet(f"{folder}/rows").select(*df.columns)


class _TickMemory(StatefulProcessor):
    """Closes a key's ticks one after another as the watermark passes them, whether rows came or not."""

    def __init__(self, tick_ms: int, day_ms: int, capacity: float, full: float, mix: float, cap: int, names: list[str]):
        self.tick, self.day, self.capacity, self.full, self.mix, self.cap, self.names = tick_ms, day_ms, capacity, full, mix, cap, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "next long, congestion double, steps long")
        self.pending = handle.getMapState("pending", "tick long", "weight double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        weights: dict[int, float] = {}
        for pdf in rows:
            for tick, weight in (pdf["weight"].groupby(pdf["moment_ms"] // self.tick).sum()).items():
                weights[int(tick)] = weights.get(int(tick), 0.0) + float(weight)
        if self.memory.exists():
            first = self.memory.get()[0]
        else:
            first = min(weights) * self.tick // self.day * self.day // self.tick  # the first tick of that day
            self.memory.update((first, 0.0, 0))
            self.handle.registerTimer((first + 1) * self.tick)
        for tick, weight in weights.items():
            if tick >= first:  # a tick that is closed stays as it was
                at = (tick,)
                self.pending.updateValue(at, ((self.pending.getValue(at)[0] if self.pending.containsKey(at) else 0.0) + weight,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, (tick, congestion, steps) = timerValues.getCurrentWatermarkInMs(), self.memory.get()
        waiting = {t[0]: w[0] for t, w in self.pending.iterator()}
        out = []
        while (tick + 1) * self.tick <= now:
            if tick * self.tick % self.day < self.tick:
                congestion, steps = 0.0, 0
            weight = waiting.get(tick)
            load = min(1.0, (weight or 0.0) / self.capacity)
            out.append((*key, tick, congestion, self.mix * congestion + (1 - self.mix) * load, steps, weight is not None))
            if weight is not None:
                self.pending.removeKey((tick,))
            congestion, steps = load, 0 if (weight or 0.0) / self.capacity > self.full else min(steps + 1, self.cap)
            tick += 1
        self.memory.update((tick, congestion, steps))
        self.handle.registerTimer((tick + 1) * self.tick)
        yield pd.DataFrame(out, columns=[*self.names, "tick", "congestion", "mixed", "since_critical", "seen"])

    def close(self) -> None:
        pass


def advancing_memory(
    stream: DataFrame, keys: list[str], moment: str, weight: Column, tick_minutes: int, late: str = "0 seconds",
    capacity: float = 4.0, full: float = 0.85, mix: float = 0.7, cap: int = 20, day_minutes: int = 1440, folder: str | None = None,
) -> DataFrame:
    """(keys, tick, congestion, mixed, since_critical, seen) of every closed tick of every key, as ``station_memory`` has it in batch.

    A tick's load is the sum of ``weight`` over ``capacity``, at most 1; over ``full`` it is critical. What a key remembers
    (the previous tick's load, its mix with the present one, the ticks since the last critical one) moves on at ticks
    without rows as well, by a timer at the end of each, and begins anew each day. A key begins with the day of its first row; ticks
    are closed when the watermark, ``late`` behind the newest row of all keys, has passed them, and later rows change nothing.
    """
    named = stream.withWatermark(moment, late).select(*keys, moment, F.unix_millis(moment).alias("moment_ms"), weight.cast("double").alias("weight"))
    schema = ", ".join(f"`{k}` {named.schema[k].dataType.simpleString()}" for k in keys) + ", tick long, congestion double, mixed double, since_critical long, seen boolean"
    processor = _TickMemory(tick_minutes * 60_000, day_minutes * 60_000, capacity, full, mix, cap, keys)
    return _kept(named.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime"), folder)


class _Silence(StatefulProcessor):
    """Tells of each span of ``levels`` milliseconds in which a key had no row, once it has passed."""

    def __init__(self, levels: list[tuple[str, int]], by_event: bool, names: list[str]):
        self.levels, self.by_event, self.names = levels, by_event, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", "newest long, told int, timer long")

    def _now(self, values) -> int:
        return values.getCurrentWatermarkInMs() if self.by_event else values.getCurrentProcessingTimeInMs()

    def _passed(self, key, newest: int, told: int, until: int, out: list) -> int:
        """Appends the levels that ``until`` has passed and that have not been told yet."""
        while told < len(self.levels) and until - newest >= self.levels[told][1]:
            name, span = self.levels[told]
            out.append((*key, newest, name, newest + span))
            told += 1
        return told

    def _wait(self, newest: int, told: int, old: int) -> None:
        if old:
            self.handle.deleteTimer(old)
        at = newest + self.levels[told][1] if told < len(self.levels) else 0
        if at:
            self.handle.registerTimer(at)
        self.state.update((newest, told, at))

    def _frame(self, out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[*self.names, "newest_ms", "level", "alarm_ms"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list = []
        arrived = sorted({int(m) for pdf in rows for m in pdf["moment_ms"]}) if self.by_event else [self._now(timerValues) for pdf in rows if len(pdf)][:1]
        newest, told, timer = self.state.get() if self.state.exists() else (arrived[0], 0, 0)
        for moment in arrived:
            if moment > newest:
                self._passed(key, newest, told, moment, out)
                newest, told = moment, 0
        self._wait(newest, told, timer)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list = []
        newest, told, _ = self.state.get()
        told = self._passed(key, newest, told, self._now(timerValues), out)
        self._wait(newest, told, 0)
        yield self._frame(out)

    def close(self) -> None:
        pass


def silence_alarms(stream: DataFrame, keys: list[str], moment: str, levels: dict[str, float], late: str = "0 seconds", by_event: bool = True) -> DataFrame:
    """A stream of alarms (keys, newest_ms, level, alarm_ms): a feed has had no row for a level's minutes.

    By event time the clock is the watermark, which the other feeds move; by processing time it is the wall clock, so an alarm
    also comes while nothing comes from any feed. Each level is told once for a silence; a row ends it.
    """
    ordered = sorted(((n, round(m * 60_000)) for n, m in levels.items()), key=lambda x: x[1])
    named = (stream.withWatermark(moment, late) if by_event else stream).select(*keys, moment, F.unix_millis(moment).alias("moment_ms"))
    schema = ", ".join(f"`{k}` {named.schema[k].dataType.simpleString()}" for k in keys) + ", newest_ms long, level string, alarm_ms long"
    return named.groupBy(*keys).transformWithStateInPandas(_Silence(ordered, by_event, keys), schema, "Append", "EventTime" if by_event else "ProcessingTime")


def silence_log(stream: DataFrame, keys: list[str], moment: str, levels: dict[str, float], late: str = "0 seconds", folder: str | None = None) -> DataFrame:
    """The alarms by event time over what is there."""
    return _kept(silence_alarms(stream, keys, moment, levels, late), folder)


class StreamWatch(StreamingQueryListener):
    """Whether streams themselves still run: when each last took in rows, and how it ended.

    Add it with ``spark.streams.addListener``. ``level(now)`` gives for each running or failed stream the first level of
    ``levels`` (name, seconds) that the time since its last rows has reached, ``failed`` for one that ended with an error.
    """

    def __init__(self, levels: dict[str, float]):
        self.levels = sorted(levels.items(), key=lambda x: -x[1])
        self.newest: dict[str, float] = {}
        self.errors: dict[str, str] = {}

    @staticmethod
    def _seconds(stamp: str) -> float:
        return pd.Timestamp(stamp).timestamp()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.newest[str(event.runId)] = self._seconds(event.timestamp)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows > 0:
            self.newest[str(p.runId)] = self._seconds(p.timestamp)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.newest.pop(str(event.runId), None)
        if event.exception:
            self.errors[str(event.runId)] = event.exception

    def level(self, now: float) -> dict[str, str]:
        found = {run: next((name for name, span in self.levels if now - seen >= span), "ok") for run, seen in self.newest.items()}
        return found | dict.fromkeys(self.errors, "failed")
