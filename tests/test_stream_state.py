"""Streams: two-level flow state, keyed block and cooldown state, early probes, quarantine, live counts, growing logs."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowsieve.catalog import streams
from flowsieve.operators.flows import FIRST, SUMS
from flowsieve.options import Options
from flowsieve.schemas import PACKETS
from flowsieve.session import scratch_path
from flowsieve.sources import tail
from flowsieve.streaming import flows, kpis, late, probes, state

SECOND = 1_000_000


# --- flow segments from atoms ---

def atoms_of(times):
    rows = pd.DataFrame({"ts_us": times, **{n: [1] * len(times) for n in SUMS}, **{n: list(range(len(times))) for n in FIRST}})
    return rows.astype({n: "Int64" for n in FIRST})


def by_rule(times, idle, active):
    out = []
    for t in sorted(times):
        if not out or t - out[-1][-1] > idle or t - out[-1][0] > active:
            out.append([])
        out[-1].append(t)
    return [(s[0], s[-1], len(s)) for s in out]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 300), min_size=1, max_size=60), st.integers(0, 30), st.integers(0, 80), st.lists(st.integers(0, 300), max_size=4))
def test_segments_do_not_depend_on_batches(times, idle, active, cuts):
    rule, held, closed = flows.Segments(idle, active), None, []
    edges = [-1, *sorted(cuts), 301]
    for low, high in zip(edges, edges[1:]):
        part = [t for t in times if low < t <= high]
        if part:
            random.Random(high).shuffle(part)
            done, held = rule.fold(held, atoms_of(part))
            closed += done
    found = [(s["start_us"], s["last_us"], s["lo_packets"]) for s in [*closed, held]]
    assert found == by_rule(times, idle, active)


def test_hot_key_is_dealt_by_time(spark):
    path = scratch_path(spark, "hot")
    rows = spark.range(3000).selectExpr(*[f"CAST({e} AS {f.dataType.simpleString()}) AS {f.name}" for f, e in zip(
        PACKETS, [{"packet_id": "id", "ts_us": "id * 1000", "src_ip": "'10.0.0.5'", "dst_ip": "'10.0.0.6'", "src_port": "40000", "dst_port": "80",
                   "protocol": "6", "tcp_flags": "16", "size": "60"}.get(f.name, "NULL") for f in PACKETS])])
    rows.write.parquet(path)
    live = flows.event_time(spark.readStream.schema(PACKETS).parquet(path), "1 second")
    seen = []
    query = (flows.atoms(live).withColumn("task", F.spark_partition_id()).writeStream.outputMode("append").trigger(availableNow=True)
             .option("checkpointLocation", scratch_path(spark, "progress")).foreachBatch(
                 lambda df, n: seen.extend(df.groupBy("task").agg(F.sum("lo_packets").alias("n")).collect())).start())
    query.awaitTermination()
    assert len({r["task"] for r in seen}) == 8 and max(r["n"] for r in seen) < 1000


# --- keyed state ---

def file_stream(spark, schema, parts):
    """A stream of one file a batch."""
    path = scratch_path(spark, "input")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, spark, out=None, checkpoint=None, batches=None):
    out, checkpoint = out or scratch_path(spark, "out"), checkpoint or scratch_path(spark, "progress")
    query = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


OPS = "ip string, change string, ts_us bigint, flow_id bigint, expires_at_us bigint, reason string, source string"
END = [("end", "block", 253_402_300_000 * SECOND, 0, None, "", "")]


def op(ip, change, at, flow=0, until=None):
    return (ip, change, at * SECOND, flow, None if until is None else until * SECOND, "r", "s")


def test_block_state_changes_and_restart(spark):
    path, out, checkpoint = (scratch_path(spark, n) for n in ("ops", "changes", "progress"))

    def more(rows):
        spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(path)
        return run(state.block_changes(stream, "5 seconds"), spark, out, checkpoint)

    more([op("a", "block", 100, 1, 140), op("b", "block", 101, 2, 400), op("c", "block", 102, 3), op("a", "block", 100, 9, 140)])
    changes = more([op("b", "unblock", 120), op("z", "block", 130, 5, 500)])     # a new query goes on from the checkpoint
    assert {(r["ip"], r["change"], r["flow_id"]) for r in changes.collect()} >= {("a", "block", 9), ("b", "block", 2), ("c", "block", 3)}
    changes = more([op("b", "block", 126, 7, 420), op("y", "block", 200, 6, 500)])
    changes = more(END)
    log = [(r["ip"], r["change"], r["at_us"] // SECOND, r["flow_id"]) for r in changes.collect() if r["ip"] != "end"]
    # every change once, and the expiry of each last block once; c has no end
    assert sorted(log) == sorted([("a", "block", 100, 9), ("a", "expire", 140, 9), ("b", "block", 101, 2), ("b", "unblock", 120, 0),
                                  ("b", "block", 126, 7), ("b", "expire", 420, 7), ("c", "block", 102, 3), ("y", "block", 200, 6),
                                  ("y", "expire", 500, 6), ("z", "block", 130, 5), ("z", "expire", 500, 5)])
    assert {r["ip"] for r in state.standing(changes, 410 * SECOND).collect()} == {"b", "c", "y", "z"}
    assert {r["ip"] for r in state.standing(changes.filter("ip <> 'b' OR flow_id < 7"), 130 * SECOND).collect()} == {"a", "c", "y", "z"}


ASKED = "channel string, ts_us bigint, flow_id bigint, ip string, reason string, source string"


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 200), min_size=1, max_size=50), st.integers(1, 40), st.integers(0, 200))
def test_kept_times(times, gap, cut):
    want, last = [], None
    for t in sorted(times):
        if last is None or t - last >= gap:
            want.append(t)
            last = t
    early, rest = np.array(sorted(t for t in times if t <= cut)), np.array(sorted(t for t in times if t > cut))
    first = early[state.kept_times(None, early, gap)].tolist() if len(early) else []
    assert first + (rest[state.kept_times(first[-1] if first else None, rest, gap)].tolist() if len(rest) else []) == want


@pytest.mark.parametrize("cuts", [[14], [2, 5, 9, 14]])
def test_cooldown_state_does_not_depend_on_batches(spark, cuts):
    ends = [100, 130, 95, 160, 128, 131, 190, 140, 250, 200, 249, 246, 300, 260]
    rows = [("desk", t * SECOND, n, f"172.20.0.{n}", "r", "s") for n, t in enumerate(ends)]
    parts = [rows[a:b] for a, b in zip([0, *cuts], cuts)] + [[("desk", END[0][2], 0, "", "", "")]]
    opts = Options(notify_cooldown=30)
    found = run(state.accepted_stream(file_stream(spark, ASKED, parts), opts, "60 seconds"), spark).collect()
    want, last = [], None
    for t, n in sorted((t, n) for n, t in enumerate(ends)):
        if last is None or t - last >= 30:
            want.append((t, n))
            last = t
    assert sorted((r["ts_us"] // SECOND, r["flow_id"]) for r in found) == want


# --- early probes ---

def packet(n, at, src, sport, dst, dport, flags):
    values = {"packet_id": n, "ts_us": int(at * SECOND), "src_ip": src, "dst_ip": dst, "src_port": sport, "dst_port": dport, "protocol": 6,
              "tcp_flags": flags, "size": 60}
    return tuple(values.get(f.name) for f in PACKETS)


def test_a_probe_is_blocked_before_its_flow_ends(spark):
    parts = [[packet(1, 10, "172.16.0.9", 5000, "10.0.0.1", 2323, 2), packet(2, 10.5, "172.16.0.9", 5000, "10.0.0.1", 2323, 2)]]
    parts += [[packet(10 + n, 20 + 20 * n, "172.16.0.8", 6000, "10.0.0.2", 443, 16)] for n in range(8)]
    opts = Options(prevent_mode=True)
    packets = file_stream(spark, PACKETS, parts)
    ended = flows.assemble_stream(packets, opts, "5 seconds").select(
        "flow_id", F.col("last_us").alias("ts_us"), F.lit("flow").alias("action"), F.col("src_ip").alias("attacker_ip"), F.lit("").alias("reason"),
        F.lit(0.0).alias("confidence"), F.lit("model").alias("source"))
    seen = {}
    both = probes.united(ended, packets, opts, "5 seconds")
    both.writeStream.foreachBatch(lambda df, n: [seen.setdefault((r["source"], r["action"], r["attacker_ip"]), []).append(n) for r in df.collect()]) \
        .option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen[("honeypot", "block", "172.16.0.9")]) == 1        # the repeated SYN is one contact
    assert seen[("honeypot", "block", "172.16.0.9")][0] + 3 <= seen[("model", "flow", "172.16.0.9")][0]


# --- quarantine ---

def test_on_time_and_quarantined_rows_add_up(spark):
    folder, source = scratch_path(spark, "split"), scratch_path(spark, "packets")
    splitter = late.Splitter(spark, folder, 5 * SECOND)
    rng, newest, want, rows_in = np.random.default_rng(3), None, set(), 0
    schema = "packet_id bigint, ts_us bigint"
    splitter.schema = spark.createDataFrame([], schema).schema
    for n in range(110):
        times = [int((n * 2 + rng.integers(-9, 3)) * SECOND) for _ in range(3)] if n % 17 else []
        ids = [n * 10 + k for k in range(len(times))]
        want |= {i for i, t in zip(ids, times) if newest is not None and t <= newest - 5 * SECOND}
        newest = max([t for t in times] + ([newest] if newest is not None else []), default=None)
        rows_in += len(times)
        batch = spark.createDataFrame(list(zip(ids, times)), schema).coalesce(1)
        splitter.handle(batch, n)
        if n % 25 == 0:
            splitter.handle(batch, n)       # a retried batch
    assert {r["packet_id"] for r in splitter.quarantine().collect()} == want and want
    assert splitter.on_time().count() + splitter.quarantine().count() == rows_in
    assert len(splitter._marks(1000)) == late.KEEP_MARKS
    read = run(splitter.on_time_stream(50).select("packet_id"), spark)
    assert read.count() == rows_in - len(want)


# --- live counts ---

def test_live_counts_are_upserted_and_folded(spark):
    schema = "type string, action string, ts_us bigint"
    parts = [[("decision", a, (n * 7 + k) % 60 * SECOND) for k, a in enumerate(["allow", "block", "alert"])] for n in range(7)]
    counts = kpis.LiveCounts(spark, scratch_path(spark, "kpis"), compact_every=3)
    stream = file_stream(spark, schema, parts).withColumn("event_time", F.timestamp_micros("ts_us"))
    counts.start(stream, "10 seconds", "1 hour").awaitTermination()
    want = {}
    for _, action, ts in [r for p in parts for r in p]:
        key = ts // (10 * SECOND) * 10 * SECOND
        want.setdefault(key, dict.fromkeys(("allow", "block", "alert"), 0))[action] += 1
    found = {r["window_us"]: {"allow": r["allows"], "block": r["blocks"], "alert": r["alerts"]} for r in counts.current().collect()}
    assert found == want and len(counts._folders()) <= 4
    counts.handle(spark.createDataFrame([(0, 99, 99, 99, 99, 99)], kpis._SCHEMA), 3)      # an old batch again changes nothing
    assert {r["window_us"]: r["allows"] for r in counts.current().collect()} == {k: v["allow"] for k, v in want.items()}


# --- growing logs ---

def follow(spark, folder, out, checkpoint):
    spark.dataSource.register(tail.LogTail)
    lines = spark.readStream.format("log_tail").option("glob", "*.log").option("bytesPerPartition", 64).load(folder)
    return sorted((os.path.basename(r["file"]), r["value"]) for r in run(lines, spark, out, checkpoint).collect())


def test_a_log_is_followed_through_appends_rotation_and_truncation(spark, tmp_path):
    out, checkpoint = scratch_path(spark, "lines"), scratch_path(spark, "progress")
    log, other = tmp_path / "a.log", tmp_path / "b.log"
    long = "x" * 200
    log.write_text(f"one\ntwo\n{long}\nhal")
    (tmp_path / "c.txt").write_text("not followed\n")
    want = [("a.log", "one"), ("a.log", "two"), ("a.log", long)]
    assert follow(spark, str(tmp_path), out, checkpoint) == sorted(want)
    with log.open("a") as f:
        f.write("f\nthree\r\n\né\n")
    other.write_text("first\n")
    want += [("a.log", "half"), ("a.log", "three"), ("a.log", ""), ("a.log", "é"), ("b.log", "first")]
    assert follow(spark, str(tmp_path), out, checkpoint) == sorted(want)
    log.write_text("anew\n")                      # truncated
    other.write_text("other\nand more lines\n")   # replaced by a longer one
    want += [("a.log", "anew"), ("b.log", "other"), ("b.log", "and more lines")]
    assert follow(spark, str(tmp_path), out, checkpoint) == sorted(want)
    assert follow(spark, str(tmp_path), out, checkpoint) == sorted(want)


def test_pieces_hold_every_line_once(tmp_path):
    rng = random.Random(4)
    lines = ["y" * rng.choice([0, 1, 5, 63, 64, 65, 300]) for _ in range(80)]
    (tmp_path / "p.log").write_text("".join(line + "\n" for line in lines))
    for size in (1, 7, 64, 1000, 10 ** 6):
        reader = tail.TailReader(str(tmp_path), "*", size)
        read = [(r["position"], r["value"]) for p in reader.partitions({}, reader.latestOffset()) for b in reader.read(p) for r in b.to_pylist()]
        assert [v for _, v in sorted(read)] == lines


def test_the_number_of_pieces_is_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "PIECES", 5)
    lines = {f"{n}.log": [f"{n} {i}" for i in range(100 * n)] for n in range(4)}
    for name, own in lines.items():
        (tmp_path / name).write_text("".join(line + "\n" for line in own))
    reader = tail.TailReader(str(tmp_path), "*", 8)
    pieces = reader.partitions({}, reader.latestOffset())
    read = [r["value"] for p in pieces for b in reader.read(p) for r in b.to_pylist()]
    assert len(pieces) <= 5 + len(lines) and sorted(read) == sorted(line for own in lines.values() for line in own)


# --- streams whose cost must not grow with keys, files or repeated reads ---

def test_many_flows_are_cut_at_once():
    rng = np.random.default_rng(4)
    times = {None if k == 0 else f"k{k}": rng.integers(0, 300, 40).tolist() for k in range(6)}
    rule, held, closed = flows.Segments(12, 50), None, []
    for low, high in ((-1, 90), (90, 100), (100, 301)):
        part = pd.DataFrame([(k, "h", 6, t) for k, ts in times.items() for t in set(ts) if low < t <= high],
                            columns=["lo", "hi", "protocol", "ts_us"]).sample(frac=1, random_state=high)
        done, held = rule.fold_all(held, part.assign(**dict.fromkeys(SUMS, 1), lo_first=part["ts_us"], hi_first=None))
        closed.append(done)
        held = flows._unpacked(flows._packed(held))
    found = pd.concat([*closed, held])
    assert (found["lo_first"] == found["start_us"]).all() and found["hi_first"].isna().all()
    for k, ts in times.items():
        mine = found[found["lo"].isna() if k is None else found["lo"] == k]
        assert sorted(zip(mine["start_us"], mine["last_us"], mine["lo_packets"])) == by_rule(set(ts), 12, 50)


def test_state_values_are_bounded_by_buckets(spark, monkeypatch):
    monkeypatch.setattr(flows, "BUCKETS", 4)
    rows = spark.range(300).selectExpr(*[f"CAST({e} AS {f.dataType.simpleString()}) AS {f.name}" for f, e in zip(
        PACKETS, [{"packet_id": "id", "ts_us": "id * 1000", "src_ip": "concat('10.0.1.', id % 100)", "dst_ip": "'10.0.0.6'", "src_port": "40000",
                   "dst_port": "80", "protocol": "6", "tcp_flags": "16", "size": "60"}.get(f.name, "NULL") for f in PACKETS])])
    path, seen = scratch_path(spark, "buckets"), []
    rows.coalesce(1).write.parquet(path)
    end = rows.limit(1).withColumn("ts_us", F.unix_micros(F.lit(flows.END_OF_INPUT).cast("timestamp")))
    end.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(path)
    made = flows.assemble_stream(stream, Options(flow_idle_timeout=20, flow_active_timeout=50), "1 second")
    query = (made.writeStream.trigger(availableNow=True).option("checkpointLocation", scratch_path(spark, "progress"))
             .foreachBatch(lambda df, n: seen.extend(df.select("fwd_packets", "bwd_packets").collect())).start())
    query.awaitTermination()
    assert len(seen) == 100 and sum(r["fwd_packets"] + r["bwd_packets"] for r in seen) == 300
    updated = [op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"] if op["operatorName"].startswith("transformWithState")]
    assert updated and max(updated) < 100, updated        # a value and a timer for each bucket, not for each flow


def test_slices_are_written_in_time_order(spark):
    day, path = 86_400 * SECOND, scratch_path(spark, "slices")
    streams._slices(spark.range(40).select((F.col("id") * 17 % 40 * day).alias("at")).repartition(7), "at", path)
    files = spark.read.parquet(path).groupBy("_metadata.file_path", "_metadata.file_modification_time").agg(
        F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n")).orderBy("file_modification_time").collect()
    assert [(r["low"] // day, r["high"] // day, r["n"]) for r in files] == [(0, 9, 10), (10, 19, 10), (20, 29, 10), (30, 39, 10)]
