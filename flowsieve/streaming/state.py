"""Keyed state of a live job: the block list by address, and the cooldown by channel.

Both have two levels. Requests are first combined by key and tick in a windowed aggregation in the JVM, which is dealt by (key, time) and
combines before its shuffle, so a key with a large share of all requests is spread; a tick's requests leave
together once the watermark has passed it, so they reach the keyed state in time order whatever the batches were. The
keyed state is one value a key in the state store; a batch touches and writes only the keys it changes, and a
restarted query goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowsieve.options import Options
from flowsieve.streaming.flows import STATE_STORE, TICK_US, before_end, event_time

CHANGES = "ip string, change string, at_us bigint, flow_id bigint, expires_at_us bigint, reason string, source string"
_NAMES = [c.split()[0] for c in CHANGES.split(", ")]
_NUMBERS = {c.split()[0] for c in CHANGES.split(", ") if c.endswith("bigint")}
ACCEPTED = "channel string, ts_us bigint, flow_id bigint, ip string, reason string, source string"
BLOCK, UNBLOCK, EXPIRE = "block", "unblock", "expire"


def operations(blocks: DataFrame, unblocks: DataFrame | None = None) -> DataFrame:
    """Block rows and unblock requests (ip, ts_us) as rows of one stream."""
    ops = blocks.select("ip", F.lit(BLOCK).alias("change"), F.col("blocked_at_us").alias("ts_us"), "flow_id", "expires_at_us", "reason", "source")
    if unblocks is None:
        return ops
    free = {c: F.lit(None).cast(t).alias(c) for c, t in (("expires_at_us", "bigint"), ("reason", "string"), ("source", "string"))}
    return ops.unionByName(unblocks.select("ip", F.lit(UNBLOCK).alias("change"), "ts_us", F.lit(0).cast("bigint").alias("flow_id"), *free.values()))


def last_wins(held: dict | None, row: dict) -> bool:
    """Whether a row replaces the state: by time, unblocks after blocks of the same time, then by flow."""
    rank = lambda r: (r["at_us"], r["change"] == UNBLOCK, r["flow_id"])
    return held is None or rank(row) > rank(held)


class _Blocks(StatefulProcessor):
    """One address: its last block or unblock. Timers drop it when a block has expired, or when no earlier row can come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("block", CHANGES)

    def _held(self) -> dict | None:
        return dict(zip(_NAMES, self.state.get())) if self.state.exists() else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, changed = self._held(), []
        for row in pd.concat(list(rows)).sort_values("at_us").to_dict("records"):      # a row per tick
            row = {n: None if pd.isna(row[n]) else int(row[n]) if n in _NUMBERS else row[n] for n in _NAMES}
            if last_wins(held, row):
                held = row
                changed.append(row)
        if not changed:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        until = held["at_us"] if held["change"] == UNBLOCK else held["expires_at_us"]
        if until is not None and until < timerValues.getCurrentWatermarkInMs() * 1000:      # no earlier row can come
            changed += self._gone(held)
            self.state.clear()
        else:
            self.state.update(tuple(held[n] for n in _NAMES))
            if until is not None:
                self.handle.registerTimer(int(until) // 1000 + 1)
        yield pd.DataFrame(changed, columns=_NAMES).astype({"expires_at_us": "Int64"})

    @staticmethod
    def _gone(held: dict) -> list[dict]:
        return [held | {"change": EXPIRE, "at_us": held["expires_at_us"]}] if held["change"] == BLOCK else []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        self.state.clear()
        gone = self._gone(held) if held is not None else []
        if gone:
            yield pd.DataFrame(gone, columns=_NAMES).astype({"expires_at_us": "Int64"})

    def close(self) -> None:
        pass


def block_changes(ops: DataFrame, delay: str, tick_us: int = TICK_US) -> DataFrame:
    """The change log of the block list: one row for every block, unblock and expiry that takes effect.

    `ops` is a stream of `operations`. A tick's rows of an address count as their last one.
    """
    ops.sparkSession.conf.set(*STATE_STORE)
    row = F.struct(F.col("ts_us").alias("at_us"), "change", "flow_id", "expires_at_us", "reason", "source")
    last = F.max_by(row, F.struct("ts_us", F.col("change") == UNBLOCK, "flow_id")).alias("s")
    ticks = (event_time(ops, delay).filter(before_end()).groupBy("ip", F.window("event_time", f"{tick_us} microseconds").alias("tick"))
             .agg(last).select("ip", F.window_time("tick").alias("event_time"), "s.*"))
    return ticks.groupBy("ip").transformWithStateInPandas(
        statefulProcessor=_Blocks(), outputStructType=CHANGES, outputMode="append", timeMode="eventTime")


def standing(changes: DataFrame, now_us: int) -> DataFrame:
    """The blocks in force at a time, from the change log: those whose last block or unblock is a block that lasts."""
    last = F.max_by(F.struct("change", F.col("at_us").alias("blocked_at_us"), "flow_id", "expires_at_us", "reason", "source"),
                    F.struct("at_us", F.col("change") == UNBLOCK, "flow_id")).alias("s")
    state = changes.filter(F.col("change") != EXPIRE).groupBy("ip").agg(last).select("ip", "s.*")
    lasting = F.col("expires_at_us").isNull() | (F.col("expires_at_us") > F.lit(now_us))
    return state.filter((F.col("change") == BLOCK) & lasting).drop("change")


def kept_times(last_us: int | None, times: np.ndarray, gap_us: int) -> np.ndarray:
    """Places of the sorted distinct times that pass the cooldown: one search a kept time."""
    at = 0 if last_us is None else int(np.searchsorted(times, last_us + gap_us))
    kept = []
    while at < len(times):
        kept.append(at)
        at = max(at + 1, int(np.searchsorted(times, times[at] + gap_us)))
    return np.array(kept, dtype=np.int64)


class _Cooldown(StatefulProcessor):
    """One channel: the time last accepted."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values("ts_us")
        before = self.last.get()[0] if self.last.exists() else None
        passed = asked.iloc[kept_times(before, asked["ts_us"].to_numpy(), self.gap_us)]
        if len(passed):
            self.last.update((int(passed["ts_us"].iloc[-1]),))
            yield passed[[c.split()[0] for c in ACCEPTED.split(", ")]]

    def close(self) -> None:
        pass


def accepted_stream(requests: DataFrame, opts: Options, delay: str, tick_us: int = TICK_US) -> DataFrame:
    """The notification requests that pass the cooldown of their channel, in append mode.

    Requests at one time count as that of the least flow. With a cooldown of 0 all requests pass.
    """
    timed = event_time(requests, delay).filter(before_end())
    if opts.cooldown_us == 0:
        return timed.drop("event_time")
    requests.sparkSession.conf.set(*STATE_STORE)
    first = F.min_by(F.struct("flow_id", "ip", "reason", "source"), "flow_id").alias("r")
    times = (timed.groupBy("channel", "ts_us", F.window("event_time", f"{tick_us} microseconds").alias("tick")).agg(first)
             .select("channel", F.window_time("tick").alias("event_time"), "ts_us", "r.*"))
    return times.groupBy("channel").transformWithStateInPandas(
        statefulProcessor=_Cooldown(opts.cooldown_us), outputStructType=ACCEPTED, outputMode="append", timeMode="eventTime")
