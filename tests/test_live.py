"""The live job: ordered cooldown, retried batches, expiry, unblocking, callbacks."""

import os

import pytest
from pyspark.sql import functions as F

from flowsieve.options import Options
from flowsieve.session import scratch_path, shared_dir
from flowsieve.streaming import live

SECOND = 1_000_000
OPTS = Options(flow_idle_timeout=20, flow_active_timeout=50, prevent_mode=True, notify_channel="desk", notify_cooldown=30,
               block_timeout=100)
VERDICT = ("flow_id bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, start_us bigint, last_us bigint, "
           "fwd_packets bigint, bwd_packets bigint, fwd_bytes bigint, bwd_bytes bigint, syn_count bigint, ack_count bigint, fin_count bigint, rst_count bigint, "
           "label string, confidence double, novelty boolean, alert boolean, probability array<double>, anomaly_score double")


def flow(n, ip, last):
    return (n, ip, "10.9.9.9", 40001, 443, 6, (last - 2) * SECOND, last * SECOND, 5, 5, 500, 400, 1, 8, 1, 0, "ANOMALY", 0.99, False, True,
            [0.99, 0.01], 0.1)


@pytest.fixture
def job(spark):
    return live.Live(spark, scratch_path(spark, "live-test"), OPTS, _verdicts, delay_us=5 * SECOND)


def _verdicts(flows):
    from flowsieve.schemas import FEATURES
    have = set(flows.columns)
    return flows.withColumns({f: F.lit(0.0) for f in FEATURES if f not in have})


def run(spark, job, batches):
    for n, rows in enumerate(batches):
        job.handle(spark.createDataFrame(rows, VERDICT), n)


def sent(job):
    return sorted((r["ts_us"] // SECOND, r["flow_id"]) for r in job.outbox().collect())


def rule(times, gap):
    kept = []
    for t, n in sorted(times):
        if not kept or t - kept[-1][0] >= gap:
            kept.append((t, n))
    return kept


# ends of flows as they complete: up to 55 seconds behind the newest one seen
ENDS = [100, 130, 95, 160, 128, 131, 190, 140, 250, 200, 249, 246, 300, 260]


@pytest.mark.parametrize("cuts", [[14], [1, 2, 5, 9, 14], [3, 4, 11, 14]])
def test_cooldown_does_not_depend_on_batches(spark, cuts):
    job = live.Live(spark, scratch_path(spark, "live-test"), OPTS, _verdicts, delay_us=5 * SECOND)
    rows = [flow(n, f"172.20.0.{n}", end) for n, end in enumerate(ENDS)]
    run(spark, job, [rows[a:b] for a, b in zip([0, *cuts], cuts)])
    job.flush()
    assert sent(job) == rule([(end, n) for n, end in enumerate(ENDS)], 30)
    job.flush()
    assert len(sent(job)) == len(rule([(end, n) for n, end in enumerate(ENDS)], 30))
    with pytest.raises(RuntimeError):
        job.handle(spark.createDataFrame([flow(99, "172.20.0.99", 400)], VERDICT), 50)


def test_retry_expiry_versions_and_scratch(spark, job):
    batches = [[flow(1, "172.20.0.1", 100)], [], [flow(2, "172.20.0.2", 150)], [flow(3, "172.20.0.3", 290)]]
    run(spark, job, batches)
    events, notes = job.events().count(), job.outbox().count()
    job.handle(spark.createDataFrame(batches[3], VERDICT), 3)
    assert (job.events().count(), job.outbox().count()) == (events, notes)
    # the horizon is 290 - 55 = 235: the first block expired at 200, the second expires at 250
    assert {r["ip"] for r in job.blocks.current().collect()} == {"172.20.0.2", "172.20.0.3"}
    assert job.blocks.versions() == [2, 3]
    assert not [n for n in os.listdir(shared_dir(spark)) if n.startswith("scope-")]


def test_half_finished_batch_is_repeated(spark, job):
    seen = []

    def fails_once(rows):
        seen.append(rows.count())
    job.on_block = fails_once
    whole = job._notifications

    def stops(*args, **kwargs):
        raise OSError("lost")
    job._notifications = stops
    batch = spark.createDataFrame([flow(1, "172.20.0.1", 100)], VERDICT)
    with pytest.raises(OSError):
        job.handle(batch, 0)
    job._notifications = whole
    job.handle(batch, 0)
    job.handle(batch, 0)
    assert seen == [1, 1]
    assert job.events().filter("type = 'decision'").count() == 1
    assert job.blocks.current().count() == 1


def test_failing_callback_does_not_stop_the_job(spark, job):
    def broken(rows):
        raise ValueError("no")
    job.on_block = job.on_probe = broken
    run(spark, job, [[flow(1, "172.20.0.1", 100)]])
    assert job.blocks.current().count() == 1


def test_unblock_on_the_live_table(spark, job):
    run(spark, job, [[flow(1, "172.20.0.1", 100), flow(2, "172.20.0.2", 101)]])
    job.unblock(spark.createDataFrame([("172.20.0.1", 110 * SECOND), ("172.20.0.2", 90 * SECOND)], "ip string, ts_us bigint"))
    assert [r["ip"] for r in job.blocked(120 * SECOND).collect()] == ["172.20.0.2"]
    job.handle(spark.createDataFrame([flow(3, "172.20.0.1", 115)], VERDICT), 1)
    assert sorted(r["ip"] for r in job.blocked(120 * SECOND).collect()) == ["172.20.0.1", "172.20.0.2"]


def test_a_batch_is_computed_once(spark, job):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(n):
        runs.add(1)
        return n

    rows = spark.createDataFrame([flow(n, f"172.20.0.{n}", 100 + n) for n in range(6)], VERDICT)
    job.handle(rows.withColumn("fwd_bytes", counted.asNondeterministic()("fwd_bytes")), 0)
    assert runs.value == 6
