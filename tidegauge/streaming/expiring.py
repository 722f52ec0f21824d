"""State that ends by itself: silence as an event, retention by days, and payloads forgotten after their time.

A call to the state store costs far more than a row, so a key's rows of one batch are folded first and its state is
read and written once: spans and days, which are few as they end; payloads are keys of their own. All timers run on the watermark, so a job over the same rows
gives the same answer; a time to live on the machine's clock would not. They need the RocksDB state store, which :func:`finished` sets for the query that it runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegauge.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SILENCE = "key long, kind string, last_us long, at_us long"
EXPIRED = "key long, day int, entries long"
DAY_MS = 86_400_000


class _Silence(StatefulProcessor):
    """``silent`` once a key has had no row for the gap, ``back`` at its next row; both only when the watermark has passed them.

    Times that the watermark has not passed are held as spans within which no gap is, (first, last) each, as nothing is said inside of one.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last_us long, is_silent boolean, firsts array<long>, lasts array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, silent, spans = self._held()
        for batch in rows:
            times = np.unique(batch["at_us"].to_numpy(dtype="int64"))
            cuts = np.flatnonzero(np.diff(times) > self.gap)
            spans = self._merged(spans + list(zip(times[np.r_[0, cuts + 1]].tolist(), times[np.r_[cuts, len(times) - 1]].tolist())) if len(times) else spans)
        yield from self._walk(key[0], last, silent, spans, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._walk(key[0], *self._held(), timerValues.getCurrentWatermarkInMs())

    def _held(self) -> tuple[int | None, bool, list[tuple[int, int]]]:
        if not self.state.exists():
            return None, False, []
        last, silent, firsts, lasts = self.state.get()
        return last, silent, list(zip(firsts, lasts))

    def _merged(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for first, last in sorted(spans):
            if out and first - out[-1][1] <= self.gap:
                out[-1] = (out[-1][0], max(out[-1][1], last))
            else:
                out.append((first, last))
        return out

    def _walk(self, key: int, last: int | None, silent: bool, spans: list[tuple[int, int]], mark: int) -> Iterator[pd.DataFrame]:
        out, passed, within = [], 0, False
        for first, end in spans:
            if first // 1000 >= mark:
                break
            if last is not None and first - last > self.gap:
                if not silent:
                    out.append((key, "silent", last, last + self.gap))
                out.append((key, "back", last, first))
            within = end // 1000 >= mark  # the watermark is inside of it, so the key is not silent
            at = first if within else end
            last, silent = at if last is None else max(at, last), False
            if within:
                break
            passed += 1
        rest = spans[passed:]
        if last is not None and not silent and not within and (last + self.gap) // 1000 < mark:
            out.append((key, "silent", last, last + self.gap))
            silent = True
        self.state.update((last, silent, [s[0] for s in rest], [s[1] for s in rest]))
        waits = [rest[0][1 if within else 0] // 1000 + 1] if rest else []
        if last is not None and not silent and not within:
            waits.append((last + self.gap) // 1000 + 1)
        if waits:
            self.handle.registerTimer(max(min(waits), mark + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "kind", "last_us", "at_us"])

    def close(self) -> None:
        pass


def silences(rows: DataFrame, key: str, at: str, hours: float, delay: str = jobs.DELAY) -> DataFrame:
    """``(key, kind, last_us, at_us)``: when each key fell silent, that is ``hours`` after its last row, and when it was back.

    Times are microseconds since 1970. Rows with a null key or time take no part; a key that never came is not silent.
    """
    marked = rows.dropna(subset=[key, at]).withWatermark(at, delay)
    named = marked.select(F.col(key).cast("long").alias("key"), F.unix_micros(at).alias("at_us"), at)
    return named.groupBy("key").transformWithStateInPandas(_Silence(int(hours * 3_600_000_000)), SILENCE, "append", "EventTime")


class _Retention(StatefulProcessor):
    """Counts entries by day; a day that ended longer ago than its time is given out and goes."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "days array<int>, entries array<long>")

    def _ends(self, day: int) -> int:
        return (day + 1 + self.days) * DAY_MS

    def _held(self) -> dict[int, int]:
        return dict(zip(*self.counts.get())) if self.counts.exists() else {}

    def _keep(self, held: dict[int, int], mark: int) -> None:
        """All days of a key in one write, and a timer for the first that ends."""
        if held:
            self.counts.update((list(held), list(held.values())))
            self.handle.registerTimer(max(self._ends(min(held)), mark + 1))
        else:
            self.counts.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark, held, out = timerValues.getCurrentWatermarkInMs(), self._held(), []
        for batch in rows:
            for day, n in zip(*(x.tolist() for x in np.unique(batch["day"].to_numpy(), return_counts=True))):
                if self._ends(day) <= mark:  # came after its day had gone
                    out.append((key[0], day, n))
                else:
                    held[day] = held.get(day, 0) + n
        self._keep(held, mark)
        if out:
            yield pd.DataFrame(out, columns=["key", "day", "entries"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark, held = timerValues.getCurrentWatermarkInMs(), self._held()
        out = [(key[0], day, n) for day, n in sorted(held.items()) if self._ends(day) <= mark]
        if out:
            self._keep({day: n for day, n in held.items() if self._ends(day) > mark}, mark)
            yield pd.DataFrame(out, columns=["key", "day", "entries"])

    def close(self) -> None:
        pass


def expired_days(rows: DataFrame, key: str, at: str, days: int, delay: str = jobs.DELAY) -> DataFrame:
    """``(key, day, entries)`` of each day's rows of a key, when the day ended ``days`` days ago and its rows go; ``day`` counts from 1970."""
    marked = rows.dropna(subset=[key, at]).withWatermark(at, delay)
    named = marked.select(F.col(key).cast("long").alias("key"), F.unix_date(F.col(at).cast("date")).alias("day"), at)
    return named.groupBy("key").transformWithStateInPandas(_Retention(days), EXPIRED, "append", "EventTime")


class _Fresh(StatefulProcessor):
    """When a payload of a key was given out; once its time has run out it is new again. One timer ends it, which looks at nothing else."""

    def __init__(self, live_us: int):
        self.live = live_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at_us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        times = np.unique(np.concatenate([np.unique(batch["at_us"].to_numpy(dtype="int64")) for batch in rows]))
        out, nth = [], np.searchsorted(times, self.seen.get()[0] + self.live) if self.seen.exists() else 0
        while nth < len(times):
            out.append((*key, int(times[nth])))
            nth = np.searchsorted(times, out[-1][2] + self.live)
        if out:
            self.seen.update((out[-1][2],))
            self.handle.registerTimer((out[-1][2] + self.live) // 1000 + 1)
            yield pd.DataFrame(out, columns=["key", "fingerprint", "at_us"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.seen.exists() and (self.seen.get()[0] + self.live) // 1000 < timerValues.getCurrentWatermarkInMs():
            self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def first_payloads(rows: DataFrame, key: str, at: str, fingerprint: str, days: float = 14, delay: str = jobs.DELAY) -> DataFrame:
    """``(key, fingerprint, at_us)`` of payloads that a key had not sent before, or not within ``days`` of when they were last given out.

    Within a batch rows are taken in order of time; a row that comes in a later batch than one after it is measured against that one.
    """
    marked = rows.dropna(subset=[key, at, fingerprint]).withWatermark(at, delay)
    named = marked.select(F.col(key).cast("long").alias("key"), F.unix_micros(at).alias("at_us"), F.col(fingerprint).alias("fingerprint"), at)
    return named.groupBy("key", "fingerprint").transformWithStateInPandas(_Fresh(int(days * 1000 * DAY_MS)), "key long, fingerprint string, at_us long", "append", "EventTime")


def finished(stream: DataFrame, name: str) -> DataFrame:
    """As :func:`jobs.finished`, with the state store that timers need."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, ROCKS)
    try:
        return jobs.finished(stream, name)
    finally:
        conf.set(key, before)
