"""Flow assembly on a packet stream, in two levels of state.

Packets are first summed into atoms, one per flow key and distinct time, by a windowed aggregation in the JVM. Its state is
dealt by (key, time), so a key with a large share of all packets is spread over the tasks, and its partial sums shrink the
shuffle. An atom leaves when the watermark has passed its tick. The second level holds open segments only and never sees a
packet. Its state is dealt into BUCKETS groups of flows, each one table: a task reads and writes a bucket once a batch, and all its
flows are cut together by array searches, one step a segment of the flow with the most. A batch rewrites the buckets it touches.

The result does not depend on arrival order within the allowed delay and equals the batch result. A segment is emitted by a
later atom that breaks it, or by a timer once all ticks up to its timeout have been delivered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowsieve.operators.filters import accept, valid_ports
from flowsieve.operators.flows import FIRST, KEY, SUMS, first_ids, flow_key, oriented, packet_sums
from flowsieve.options import Options

SEGMENT = "start_us bigint, last_us bigint, " + ", ".join(f"{n} bigint" for n in SUMS + FIRST)
OUTPUT = "lo string, hi string, protocol int, " + SEGMENT
SEGMENT_NAMES = [c.split()[0] for c in SEGMENT.split(", ")]
TICK_US = 1_000_000      # atoms leave when the watermark has passed their tick
BUCKETS = 512            # groups of flows that share a state value; fixed for the life of a checkpoint
# keyed state with timers needs this state store
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
# a packet at this time or later only marks the end of a bounded input
END_OF_INPUT = "9000-01-01"


def event_time(packets: DataFrame, delay: str) -> DataFrame:
    return packets.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)


def before_end() -> Column:
    """Drops end-of-input markers after they moved the watermark (it reads the event time, so it stays there)."""
    return F.col("event_time") < F.lit(END_OF_INPUT).cast("timestamp")


def filter_stream(packets: DataFrame, opts: Options, delay: str) -> DataFrame:
    """The packet filters of the batch job on a stream with a watermark."""
    return accept(event_time(packets, delay).filter(before_end()), opts)


def atoms(packets: DataFrame, tick_us: int = TICK_US) -> DataFrame:
    """One row per flow key and distinct time, with its tick's event time; an aggregation in the JVM, dealt by key and time."""
    tick = F.window("event_time", f"{tick_us} microseconds")
    summed = (flow_key(packets.filter(valid_ports())).groupBy(*KEY, "ts_us", tick.alias("tick"))
              .agg(*packet_sums(), *first_ids(F.lit(True))))
    return summed.select(*KEY, F.window_time("tick").alias("event_time"), "ts_us", *SUMS, *FIRST)


def _searched(t: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For every line the first place in [low, high) of the ascending times there that lies after `wanted`, or high."""
    low, high = low.copy(), high.copy()
    while (todo := np.flatnonzero(low < high)).size:
        middle = (low[todo] + high[todo]) // 2
        before = t[middle] <= wanted[todo]
        low[todo] = np.where(before, middle + 1, low[todo])
        high[todo] = np.where(before, high[todo], middle)
    return low


class Segments:
    """Cuts atoms into segments, from open segments on."""

    def __init__(self, idle_us: int, active_us: int):
        self.idle_us, self.active_us = idle_us, active_us

    def fold(self, held: dict | None, rows: pd.DataFrame) -> tuple[list[dict], dict | None]:
        """(closed segments, the open one) of one flow."""
        key = dict.fromkeys(KEY[:2], "") | {KEY[2]: 0}
        before = None if held is None else pd.DataFrame([key | held], columns=[*KEY, *SEGMENT_NAMES])
        closed, opened = self.fold_all(before, rows.assign(**key))
        told = [{n: None if pd.isna(r[n]) else int(r[n]) for n in SEGMENT_NAMES} for r in pd.concat([closed, opened]).to_dict("records")]
        return told[:len(closed)], told[-1] if len(opened) else None

    def fold_all(self, held: pd.DataFrame | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """(closed segments, open ones) of many flows. Atoms of a flow have distinct times, later than those folded before."""
        keys = rows[KEY] if held is None else pd.concat([held[KEY], rows[KEY]], ignore_index=True)
        flow = keys.groupby(KEY, dropna=False, sort=False).ngroup().to_numpy()
        known = 0 if held is None else len(held)
        flows = int(flow.max()) + 1 if len(flow) else 0
        names = keys.iloc[np.unique(flow, return_index=True)[1]].reset_index(drop=True)
        order = np.lexsort((rows["ts_us"].to_numpy(dtype="int64"), flow[known:]))
        t, of = rows["ts_us"].to_numpy(dtype="int64")[order], flow[known:][order]
        upto = np.concatenate((np.zeros((1, len(SUMS)), "int64"), np.cumsum(rows[SUMS].to_numpy(dtype="int64")[order], axis=0)))
        first, no_first = _ids(rows)
        first, no_first = first[order], no_first[order]
        # places before which a flow begins or the idle timeout cuts
        breaks = np.append(np.flatnonzero((np.diff(of) != 0) | (np.diff(t) > self.idle_us)) + 1, len(t))
        at, end = (np.searchsorted(of, np.arange(flows), side) for side in ("left", "right"))
        is_open, start, last = np.zeros(flows, bool), np.zeros(flows, "int64"), np.zeros(flows, "int64")
        sums, ids, no_ids = np.zeros((flows, len(SUMS)), "int64"), np.zeros((flows, len(FIRST)), "int64"), np.ones((flows, len(FIRST)), bool)
        if known:
            mine = flow[:known]
            is_open[mine], start[mine], last[mine] = True, held["start_us"].to_numpy("int64"), held["last_us"].to_numpy("int64")
            sums[mine] = held[SUMS].to_numpy(dtype="int64")
            ids[mine], no_ids[mine] = _ids(held)
        table = lambda f: _segments(names.iloc[f], start[f], last[f], sums[f], ids[f], no_ids[f])
        closed = []
        while (todo := np.flatnonzero(at < end)).size:
            here = at[todo]
            over = is_open[todo] & ((t[here] - last[todo] > self.idle_us) | (t[here] - start[todo] > self.active_us))
            if over.any():
                closed.append(table(todo[over]))
            new, place = todo[over | ~is_open[todo]], here[over | ~is_open[todo]]
            is_open[new], start[new], sums[new], ids[new], no_ids[new] = True, t[place], 0, first[place], no_first[place]
            stop = _searched(t, here, breaks[np.searchsorted(breaks, here, "right")], start[todo] + self.active_us)
            last[todo] = t[stop - 1]
            sums[todo] += upto[stop] - upto[here]
            at[todo] = stop
        none = table(np.zeros(0, "int64"))
        return pd.concat(closed, ignore_index=True) if closed else none, table(np.flatnonzero(is_open))

    def deadline(self, held):
        """The time after which an open segment takes no packet; `held` is one segment or a frame of them."""
        return np.minimum(held["last_us"] + self.idle_us, held["start_us"] + self.active_us)


def _ids(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The first packet ids, and where there is none."""
    found = rows[FIRST].astype("Int64")
    return found.fillna(0).to_numpy(dtype="int64"), found.isna().to_numpy()


def _segments(keys: pd.DataFrame, start, last, sums, ids, no_ids) -> pd.DataFrame:
    values = {"start_us": start, "last_us": last} | {n: sums[:, k] for k, n in enumerate(SUMS)}
    values |= {n: pd.arrays.IntegerArray(ids[:, k].copy(), no_ids[:, k].copy()) for k, n in enumerate(FIRST)}
    return pd.concat([keys.reset_index(drop=True), pd.DataFrame(values)], axis=1)


class _OpenSegments(StatefulProcessor):
    def __init__(self, rule: Segments, tick_us: int):
        self.rule, self.tick_us = rule, tick_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "segments binary")

    def _advance(self, rows: pd.DataFrame | None, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Folds the atoms, emits what is closed, and sets one timer for the open segment that ends first."""
        held = _unpacked(self.open.get()[0]) if self.open.exists() else None
        was_open, closed = held is not None, []
        if rows is not None:
            done, held = self.rule.fold_all(held, rows)
            closed.append(done)
        # all atoms before this time have been delivered
        complete = watermark_ms * 1000 // self.tick_us * self.tick_us
        if held is not None:
            over = self.rule.deadline(held) < complete
            closed.append(held[over])
            held = held[~over]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is not None and len(held):
            self.open.update((_packed(held),))
            passed = (int(self.rule.deadline(held).min()) // self.tick_us + 1) * self.tick_us
            self.handle.registerTimer(-(-passed // 1000))
        elif was_open:
            self.open.clear()
        closed = [c for c in closed if len(c)]
        if closed:
            yield pd.concat(closed, ignore_index=True)[[*KEY, *SEGMENT_NAMES]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance(pd.concat(list(rows), ignore_index=True), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _packed(segments: pd.DataFrame) -> bytes:
    import pyarrow as pa
    table, sink = pa.Table.from_pandas(segments, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(value: bytes) -> pd.DataFrame:
    import pyarrow as pa
    return pa.ipc.open_stream(bytes(value)).read_pandas()


def assemble_stream(packets: DataFrame, opts: Options, delay: str = "10 seconds", tick_us: int = TICK_US) -> DataFrame:
    """Completed flows of a packet stream, in append mode."""
    packets.sparkSession.conf.set(*STATE_STORE)
    live = event_time(packets, delay).filter(before_end())
    dealt = atoms(live, tick_us).withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)))
    segments = dealt.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_OpenSegments(Segments(opts.idle_us, opts.active_us), tick_us), outputStructType=OUTPUT,
        outputMode="append", timeMode="eventTime")
    return oriented(segments)


def idle_stream(packets: DataFrame, opts: Options, delay: str = "10 seconds") -> DataFrame:
    """Idle timeout only: Spark's own session windows, no Python state."""
    live = flow_key(event_time(packets, delay).filter(before_end() & valid_ports()))
    gap = F.session_window("event_time", f"{opts.idle_us} microseconds")
    return (live.groupBy(*KEY, gap.alias("session"))
            .agg(F.min("ts_us").alias("session_start"), F.max("ts_us").alias("session_end"), F.count("*").alias("packets"))
            .drop("session"))
