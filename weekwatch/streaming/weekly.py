"""Weekly case counts from an event stream and the open episode of every place."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

EPISODE_SCHEMA = "place bigint, kind string, start_week date, end_week date, weeks bigint, total_cases bigint, peak_cases bigint"
STATE_SCHEMA = "start_week date, end_week date, weeks bigint, total bigint, peak bigint"


def weekly_counts(events: DataFrame, delay: str = "7 days", ts: str = "ts") -> DataFrame:
    """(place, kind, week_start, cases); weeks start on Sundays because 1970-01-04 was one."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, "7 days", "7 days", "3 days"), "place", "kind")
        .agg(F.count(F.lit(1)).alias("cases"))
        .select("place", "kind", F.col("window.start").cast("date").alias("week_start"), "cases")
    )


def _close(key: tuple, s: tuple) -> dict:
    return {"place": key[0], "kind": key[1], "start_week": s[0], "end_week": s[1], "weeks": s[2], "total_cases": s[3], "peak_cases": s[4]}


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Small helper run per (place, kind): extends, closes or opens its one episode."""
    rows = pd.concat(list(frames)).sort_values("week_start") if not state.hasTimedOut else pd.DataFrame()
    current = tuple(state.get) if state.exists else None
    closed = []
    for week, cases, high in rows[["week_start", "cases", "high"]].itertuples(index=False) if len(rows) else []:
        week = pd.Timestamp(week).date()
        next_to = current is not None and (week - current[1]).days == 7
        if current is not None and not (high and next_to):
            closed.append(_close(key, current))
            current = None
        if high:
            current = (
                (current[0], week, current[2] + 1, current[3] + int(cases), max(current[4], int(cases)))
                if current is not None
                else (week, week, 1, int(cases), int(cases))
            )
    if current is None:
        if state.exists:
            state.remove()
    else:
        state.update(current)
    yield pd.DataFrame(closed, columns=["place", "kind", "start_week", "end_week", "weeks", "total_cases", "peak_cases"])


def closed_episodes(weeks: DataFrame) -> DataFrame:
    """Episodes that ended, from a stream of (place, kind, week_start, cases, high).

    Weeks of a place must arrive in order, as the closed windows of weekly_counts do; the open
    episode stays in the state store.
    """
    return weeks.groupBy("place", "kind").applyInPandasWithState(
        _advance, EPISODE_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


# --- open and closed episodes ------------------------------------------------------------------

OPEN_SCHEMA = "place bigint, kind string, start_index int, end_index int, start_year int, start_week int, weeks bigint, total_cases double, peak_cases double, open boolean"
_EPISODE = "start_index int, end_index int, start_year int, start_week int, weeks bigint, total double, peak double, expires bigint"
_DAY_MS = 86_400_000


class _Episodes(StatefulProcessor):
    """The one episode of a place and kind: open in the state, closed by a week out of it, a gap, or a timer."""

    def __init__(self, patience_days: int):
        self.patience = patience_days * _DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.episode = handle.getValueState("episode", _EPISODE)
        self.newest = handle.getValueState("newest", "week_index int")

    def _row(self, key: tuple, e: tuple, is_open: bool) -> Row:
        return Row(place=key[0], kind=key[1], start_index=e[0], end_index=e[1], start_year=e[2], start_week=e[3], weeks=e[4], total_cases=e[5], peak_cases=e[6], open=is_open)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = tuple(self.episode.get()) if self.episode.exists() else None
        last = self.newest.get()[0] if self.newest.exists() else None
        before, out = held, []
        for r in sorted(rows, key=lambda r: r["week_index"]):
            week, cases = r["week_index"], float(r["cases"])
            if last is not None and week <= last:
                continue  # a week that was counted before
            if held is not None and not (r["state"] == 1 and week == held[1] + 1):
                out.append(self._row(key, held, False))
                held = None
            if r["state"] == 1:
                until = int(r["week_start"].timestamp() * 1000) + self.patience
                held = (held[0], week, held[2], held[3], held[4] + 1, held[5] + cases, max(held[6], cases), until) if held else (week, week, r["epi_year"], r["epi_week"], 1, cases, cases, until)
            last = week
        if last is not None:
            self.newest.update((last,))
        if before is not None and held != before:
            self.handle.deleteTimer(before[7])
        if held is None:
            if before is not None:
                self.episode.clear()
        elif held != before:
            self.episode.update(held)
            self.handle.registerTimer(held[7])
            out.append(self._row(key, held, True))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.episode.exists():
            return iter(())
        held = tuple(self.episode.get())
        self.episode.clear()
        return iter([self._row(key, held, False)])

    def close(self) -> None:
        pass


def episodes_so_far(weeks: DataFrame, patience_days: int = 28, delay: str = "7 days") -> DataFrame:
    """Episodes as they stand after each batch, from a stream of (place, kind, week_start timestamp, week_index, epi_year, epi_week, cases, state).

    In update mode a row of (place, kind, start_index) replaces the ones before it: open while its last week is the newest of its
    place, closed by a later week or when the watermark passes `patience_days` after that week. Weeks of a place
    come in order, in one batch in any order; a week that is not newer than the last one counted is left out. Needs the RocksDB state store.
    """
    known = weeks.where(F.col("state").isNotNull()).withWatermark("week_start", delay)
    return known.groupBy("place", "kind").transformWithState(
        statefulProcessor=_Episodes(patience_days), outputStructType=OPEN_SCHEMA, outputMode="update", timeMode="eventTime"
    )


@contextmanager
def rocksdb_states(spark: SparkSession):
    """The state store that processors with timers need, while a stream is started."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
