import random

import pytest
from pyspark.sql import functions as F

from flowsieve import Options
from flowsieve.operators import features, filters, flows, thinning
from flowsieve.schemas import PACKETS

S = 1_000_000


def table(spark, rows):
    return spark.createDataFrame(rows, PACKETS)


def packet(i, seconds, src="10.0.0.1", sport=12345, dst="10.0.0.2", dport=80, flags=16, size=40, protocol=6):
    return (i, round(seconds * S), src, dst, protocol, sport, dport, flags, size)


def reply(i, seconds, flags=16, **more):
    return packet(i, seconds, "10.0.0.2", 80, "10.0.0.1", 12345, flags, **more)


def by_hand(rows, opts):
    """The rule itself, packet by packet."""
    open_flows, done = {}, []
    for p in sorted(rows, key=lambda r: (r[1], r[0])):
        pid, ts, src, dst, proto, sport, dport, flags, size = p
        if sport < 0 or dport < 0:
            continue
        key = (frozenset([(src, sport), (dst, dport)]), proto)
        f = open_flows.get(key)
        if f and (ts - f["last_us"] > opts.idle_us or ts - f["start_us"] > opts.active_us):
            done.append(open_flows.pop(key))
            f = None
        if not f:
            f = open_flows[key] = dict(flow_id=pid, src=(src, sport), start_us=ts, last_us=ts, fwd=0, bwd=0, syn=0)
        f["fwd" if (src, sport) == f["src"] else "bwd"] += 1
        f["syn"] += 1 if proto == 6 and flags & 2 else 0
        f["last_us"] = ts
    return sorted((f["flow_id"], f["src"][0], f["src"][1], f["start_us"], f["last_us"], f["fwd"], f["bwd"], f["syn"])
                  for f in done + list(open_flows.values()))


def shown(df):
    return sorted(tuple(r) for r in df.select(
        "flow_id", "src_ip", "src_port", "start_us", "last_us", "fwd_packets", "bwd_packets", "syn_count").collect())


def test_direction_flags_and_duration(spark):
    rows = [reply(21, 4.0, flags=0x12, size=60), packet(22, 4.5, flags=0x11, size=52), reply(23, 4.75, flags=0x14, size=40),
            packet(24, 6.0, flags=0x08, size=90), reply(25, 8.0, flags=0x01, size=44)]
    f = features.extract(flows.assemble(table(spark, rows), Options())).first()
    assert (f.fwd_packets, f.bwd_packets, f.syn_count, f.ack_count, f.fin_count, f.rst_count) == (3, 2, 1, 3, 2, 1)
    assert f.flow_duration == pytest.approx(4.0) and f.dst_port == 12345 and f.packets_per_second == pytest.approx(1.25)


def test_first_packet_orients_and_ports_guard(spark):
    rows = [reply(5, 0.0, flags=17), packet(6, 0.1, flags=4), packet(7, 0.1, sport=-1)]
    f = flows.assemble(table(spark, rows), Options()).collect()
    assert [(r.src_ip, r.src_port, r.fwd_packets, r.bwd_packets, r.fin_count, r.rst_count) for r in f] == [("10.0.0.2", 80, 1, 1, 1, 1)]


def test_timeouts_are_strict(spark):
    opts = Options(flow_idle_timeout=1, flow_active_timeout=100)
    assert flows.assemble(table(spark, [packet(1, 0), packet(2, 1)]), opts).count() == 1
    assert flows.assemble(table(spark, [packet(1, 0), packet(2, 1.000001)]), opts).count() == 2
    opts = Options(flow_idle_timeout=60, flow_active_timeout=1)
    assert flows.assemble(table(spark, [packet(i, i / 10) for i in range(11)]), opts).count() == 1
    assert flows.assemble(table(spark, [packet(i, i / 10) for i in range(12)]), opts).count() == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_random_traffic_with_a_hot_key_on_both_paths(spark, seed):
    rng = random.Random(seed)
    rows, busy = [], 400
    for i in range(1200):
        if i < busy:   # a third of all packets on one key, with equal times
            src, dst = ("10.0.0.1", "10.0.0.2") if rng.random() < .5 else ("10.0.0.2", "10.0.0.1")
            ends = dict(src=src, dst=dst, sport=1 if src.endswith("1") else 2, dport=2 if src.endswith("1") else 1)
            ts = rng.randrange(0, 300)
        else:
            a, b = rng.randrange(8), rng.randrange(4)
            ends = dict(src=f"10.1.0.{a}", dst=f"10.2.0.{b}", sport=1000 + a, dport=80)
            if rng.random() < .4:
                ends = dict(src=ends["dst"], dst=ends["src"], sport=80, dport=1000 + a)
            ts = rng.randrange(0, 2000) / 2
        rows.append(packet(i, ts, flags=rng.choice([2, 16, 18, 4]), protocol=rng.choice([6, 6, 6, 17]) if i >= busy else 6, **ends))
    rng.shuffle(rows)
    opts = Options(flow_idle_timeout=6, flow_active_timeout=20)
    want = by_hand(rows, opts)
    assert shown(flows.assemble(table(spark, rows), opts)) == want
    for limit, tick in ((100, 7.0), (10, 1000.0)):
        split = opts.updated({"hot_key_rows": limit, "tick_seconds": tick})
        assert shown(flows.assemble(table(spark, rows), split)) == want
    assert sum(r[5] + r[6] for r in want) == len(rows)


@pytest.mark.parametrize("strict", [True, False])
def test_thinning_paths_agree_with_the_rule(spark, strict):
    rng = random.Random(7)
    times = {g: sorted({rng.randrange(0, 3000) for _ in range(n)}) for g, n in (("a", 400), ("b", 3), ("c", 60))}
    df = spark.createDataFrame([(g, t) for g, ts in times.items() for t in ts], "g string, t bigint")
    want = []
    for g, ts in times.items():
        last = None
        for t in ts:
            if last is None or (t - last > 25 if strict else t - last >= 25):
                want.append((g, t))
                last = t
    fold = thinning.fold_chain(df, ["g"], 25, strict)
    double = thinning.doubled_chain(df, ["g"], 25, strict, 40)
    mixed = thinning.greedy_chain(df, ["g"], 25, strict, 10, 50)
    for got in (fold, double, mixed):
        assert sorted((r.g, r.t) for r in got.collect()) == sorted(want)


def test_filters(spark):
    rows = [packet(1, 0), packet(2, 0, protocol=1, sport=0, dport=0), packet(3, 0, dst="224.0.0.251", protocol=17),
            packet(4, 0, src="169.254.1.1"), packet(5, 0, dst="255.255.255.255"), packet(6, 0, sport=-1, dport=-1),
            packet(7, 0, src="fe80::1"), packet(8, 0, dst="ff02::fb"), packet(9, 0, src="not an address")]
    df = table(spark, rows)
    ids = lambda d: sorted(r.packet_id for r in d.collect())
    assert ids(filters.drop_noise(df, Options())) == [1, 2, 6, 9]
    assert ids(filters.drop_noise(df, Options(drop_link_local=False))) == [1, 2, 4, 6, 7, 9]
    assert ids(filters.accept(df, Options())) == [1, 9]
    assert ids(filters.accept(df, Options(include_icmp=True))) == [1, 2, 9]
    assert ids(filters.accept(df, Options(port_allowlist=[443]))) == []
    ports = spark.createDataFrame([(80,), (70000,)], "port int")
    assert ids(filters.port_table_filter(df.filter("packet_id < 3"), ports)) == [1]
    assert filters.port_table_filter(df, ports.filter("port < 0")).count() == 9


def test_zero_duration_rate_is_finite(spark):
    f = features.extract(flows.assemble(table(spark, [packet(1, 5), packet(2, 5)]), Options())).first()
    assert f.flow_duration == 0.0 and f.packets_per_second == pytest.approx(2e6)


def test_minmax(spark):
    rows = spark.createDataFrame([(float(d), p, s, 7) for d, p, s in ((1, 1, 0), (2, 5, 2), (3, 9, 5))],
                                 "flow_duration double, total_fwd_packets int, syn_count int, protocol int")
    names = ["flow_duration", "total_fwd_packets", "syn_count", "protocol"]
    scaled = features.minmax_apply(rows, features.minmax_fit(rows, names)).orderBy("flow_duration").collect()
    assert (scaled[0].total_fwd_packets, scaled[2].total_fwd_packets, scaled[0].syn_count, scaled[2].syn_count) == (0, 1, 0, 1)
    assert [r.protocol for r in scaled] == [0, 0, 0]
