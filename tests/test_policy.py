import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from flowsieve import Options, schemas
from flowsieve.functions import addresses, text
from flowsieve.operators import blocks, explain, metrics, notify, policy, selection
from flowsieve.plans.detection import decide_flows
from flowsieve.sources import blocks as block_files
from flowsieve.sources import corpus, events

FLOW = ("flow_id bigint, src_ip string, syn_count bigint, bwd_packets bigint, rst_count bigint, label string, "
        "confidence double, alert boolean, novelty boolean, probe boolean")


def outcome(spark, opts=Options(), **values):
    row = dict(flow_id=1, src_ip="10.0.0.1", syn_count=1, bwd_packets=2, rst_count=0, label="BENIGN", confidence=0.99,
               alert=False, novelty=False, probe=False) | values
    df = spark.createDataFrame([tuple(row.values())], FLOW)
    return policy.decide(df, opts).select("decision.*").first()


# around every limit: 100 SYNs, confidence 0.90
@pytest.mark.parametrize("values, action, source", [
    (dict(syn_count=99, bwd_packets=0), "allow", "model"), (dict(syn_count=100, bwd_packets=0), "block", "rule"),
    (dict(syn_count=101, bwd_packets=0), "block", "rule"), (dict(syn_count=101, bwd_packets=101), "allow", "model"),
    (dict(label="ANOMALY", confidence=0.8999, alert=True), "alert", "model"),
    (dict(label="ANOMALY", confidence=0.9, alert=True), "block", "model"),
    (dict(label="ANOMALY", confidence=0.9001, alert=True), "block", "model"),
    (dict(label="ANOMALY", confidence=0.9001, alert=True, probe=True), "block", "honeypot"),
    (dict(confidence=0.7, alert=True, novelty=True), "alert", "novelty"), (dict(confidence=0.7), "allow", "model")])
def test_rules(spark, values, action, source):
    d = outcome(spark, **values)
    assert (d.action, d.source, d.attacker_ip) == (action, source, "10.0.0.1")
    if source == "rule":
        assert d.confidence == 1.0 and f"{values['syn_count']} SYNs" in d.reason


def test_whitelist_comes_first(spark):
    d = outcome(spark, Options(whitelist=["10.0.0.1"]), label="ANOMALY", confidence=1.0, alert=True, probe=True)
    assert (d.action, d.source, d.confidence) == ("allow", "whitelist", 1.0)


def test_probes_block_their_source_only(spark):
    seen = [(40, 900, "192.0.2.77", 161), (41, 901, "198.51.100.3", 8081)]
    probes = spark.createDataFrame(seen, "flow_id bigint, ts_us bigint, ip string, port int")
    opts = Options(whitelist=["198.51.100.3"])
    found = policy.decide(policy.probe_verdicts(probes), opts).select("decision.*").collect()
    assert sorted((d.attacker_ip or "", d.action, d.source) for d in found) == [
        ("192.0.2.77", "block", "honeypot"), ("198.51.100.3", "allow", "whitelist")]


def test_class_ties_and_missing_detector(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.2, 0.8])], "flow_id bigint, probability array<double>")
    rows = policy.verdicts(df, Options(), None).orderBy("flow_id").collect()
    assert [(r.label, r.alert, r.novelty) for r in rows] == [("ANOMALY", True, None), ("BENIGN", False, None)]
    with pytest.raises(ValueError):
        policy.classify(df, classes=["DoS", "BENIGN"])
    other = policy.classify(df, classes=["BENIGN", "ANOMALY"]).orderBy("flow_id").collect()
    assert [r.label for r in other] == ["BENIGN", "ANOMALY"]


def test_blocks_life_cycle(spark):
    rows = spark.createDataFrame([("a", 0, 1), ("a", 50, 2), ("a", 500, 3), ("b", 10, 4)], "ip string, blocked_at_us bigint, flow_id bigint")
    rows = rows.withColumns({"expires_at_us": F.col("blocked_at_us") + 100, "reason": F.lit("r"), "source": F.lit("s")})
    opts = Options(block_timeout=0.0001)
    spans = blocks.intervals(rows, opts).orderBy("flow_id").collect()
    assert [r.end_us for r in spans] == [50, 150, 600, 110]
    packets = spark.createDataFrame([(i, t, ip) for i, (t, ip) in enumerate([(0, "a"), (149, "a"), (150, "a"), (599, "a"), (10, "c"), (110, "b")])],
                                    "packet_id bigint, ts_us bigint, src_ip string")
    hit = blocks.enforce(packets, blocks.intervals(rows, opts), opts).orderBy("packet_id").collect()
    assert [r.dropped for r in hit] == [True, True, False, True, False, False]
    forever = rows.withColumn("expires_at_us", F.lit(None).cast("bigint"))
    hit = blocks.enforce(packets, blocks.intervals(forever, opts), opts).orderBy("packet_id").collect()
    assert [r.dropped for r in hit] == [True, True, True, True, False, True]
    state = blocks.with_unblocks(rows, spark.createDataFrame([("b", 10)], "ip string, ts_us bigint"))
    assert [(r.ip, r.remaining_us) for r in blocks.active(state, 550).collect()] == [("a", 50)]
    assert blocks.active(state, 600).count() == 0
    asked = spark.createDataFrame([("a",), ("z",)], "ip string")
    assert {r.ip: r.present for r in blocks.unblocked(state, asked).collect()} == {"a": True, "z": False}


def test_block_file(spark, tmp_path):
    good = '{"1.2.3.4": {"blocked_at": 1.0, "expires_at": 9999999999}, "5.6.7.8": {"blocked_at": 1.0, "expires_at": 1.0}, "::1": {"blocked_at": 2.0, "expires_at": null}}'
    (tmp_path / "good.json").write_text(good)
    (tmp_path / "bad.json").write_text("{not json")
    state = block_files.scan_json(spark, str(tmp_path / "good.json"))
    assert sorted(r.ip for r in blocks.active(state, 10_000_000).collect()) == ["1.2.3.4", "::1"]
    assert block_files.scan_json(spark, str(tmp_path / "bad.json")).count() == 0


def test_cooldown(spark):
    rows = spark.createDataFrame([("x", t, i, "9.9.9.9", "r", "s") for i, t in enumerate([0, 0, 99, 100, 150, 205])],
                                 "channel string, ts_us bigint, flow_id bigint, ip string, reason string, source string")
    got = lambda df: sorted((r.ts_us, r.flow_id) for r in df.collect())
    opts = Options(notify_cooldown=0.0001, notify_channel="x")
    assert got(notify.accepted(rows, opts)) == [(0, 0), (100, 3), (205, 5)]
    clock = spark.createDataFrame([("x", 60)], "channel string, last_us bigint")
    assert got(notify.accepted(rows, opts, clock=clock)) == [(205, 5)]
    assert len(got(notify.accepted(rows, Options(notify_cooldown=-1, notify_channel="x")))) == 6
    made = rows.withColumnRenamed("ts_us", "blocked_at_us")
    assert notify.requests(made, Options()).count() == 0


def test_message(spark):
    df = spark.createDataFrame([("1.2.3.4", "why", "model"), ("1.2.3.4", None, None)], "ip string, reason string, source string")
    rows = df.select(text.notification_text(F.col("ip"), F.col("reason"), F.col("source"), F.timestamp_micros(F.lit(0)))).collect()
    assert rows[0][0] == "**IP BLOCKED:** 1.2.3.4\nReason: why\nSource: model | 1970-01-01 00:00:00"
    assert rows[1][0] == "**IP BLOCKED:** 1.2.3.4\nSource: 1970-01-01 00:00:00"


def test_general_number_is_like_percent_g(spark):
    values = [0.0, 1.0, 80.0, 0.1, 1e-5, 123456.0, 1234567.0, 999999.5, 1e6, 3.14159265, 0.0001234567, -2.5, 1e22, 65535.0, 2000000.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(text.general_number(F.col("v"))).collect()] == [f"{v:g}" for v in values]


def test_addresses_agree_with_the_standard_library(spark):
    rng = random.Random(3)
    items = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(200)]
    items += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(100)]
    items += ["::", "::1", "1::", "fe80::1", "febf::2", "fec0::1", "ff02::1", "FF02::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "169.254.0.1",
              "239.255.255.255", "240.0.0.1", "223.9.9.9", "255.255.255.255", "2001:db8::1:0:0:1"]
    bad = ["", "x", "1.2.3", "1.2.3.256", "01.2.3.4x", ":::", "1::2::3", "12345::", "1:2:3:4:5:6:7", "224.0.0", "ff02", "1:2:3:4:5:6:7:8:9"]
    df = spark.createDataFrame([(i,) for i in items + bad], "ip string")
    ip = F.col("ip")
    rows = df.select("ip", addresses.ip_family(ip).alias("f"), F.coalesce(addresses.is_multicast_or_broadcast(ip), F.lit(False)).alias("m"),
                     F.coalesce(addresses.is_link_local(ip), F.lit(False)).alias("l")).collect()
    for r in rows:
        if r.ip in bad:
            assert (r.f, r.m, r.l) == (None, False, False), r.ip
        else:
            a = ipaddress.ip_address(r.ip)
            assert (r.f, r.m, r.l) == (f"v{a.version}", a.is_multicast or r.ip == "255.255.255.255", a.is_link_local), r.ip


def test_explanations(spark):
    phi = [0.3, -0.2, 0.005, 0.3] + [0.0] * 7
    df = spark.createDataFrame([(phi, [float(i) for i in range(11)]), ([0.0] * 11, [0.0] * 11)], "phi array<double>, v array<double>")
    rows = df.select(explain.top_text(F.col("phi")).alias("t"), explain.readable_text(F.col("phi"), F.col("v")).alias("r"),
                     explain.readable_text(F.col("phi")).alias("p")).collect()
    assert rows[0].t == "toward ANOMALY: total_fwd_packets=+0.300, flow_duration=+0.300, dst_port=+0.005 | toward BENIGN:  protocol=-0.200"
    assert rows[0].r == "duration=0 → ATTACK-like (strong) · packets sent=3 → ATTACK-like (strong) · protocol=1 → NORMAL (strong)"
    assert rows[0].p.startswith("duration → ATTACK-like (strong)")
    assert rows[1].t == explain.NEUTRAL and rows[1].r == "duration=0 → neutral · protocol=0 → neutral · dest port=0 → neutral"


def test_event_lines(spark):
    lines = spark.createDataFrame([(1, '{"layer":"L7","type":"honeypot.probe","ts":1.5,"ip":"1.1.1.1","port":2323}'), (2, "{broken"), (3, "  "),
                                   (4, '{"layer":"L4","type":"verdict","ts":2.5,"flow":{"honeypot":"1.1.1.1"}}')], "n bigint, value string")
    rows = events.decode(lines, keep=["n"]).orderBy("n").collect()
    assert [(r.n, r.type, r.port) for r in rows] == [(1, "honeypot.probe", 2323), (4, "verdict", None)]
    assert rows[1].flow.honeypot == "1.1.1.1"
    assert [r.n for r in events.recent(lines, 3, ["n"]).collect()] == [4]


def test_probe_and_flow_are_both_decided(spark):
    row = dict(flow_id=1, protocol=6, src_ip="10.9.9.9", dst_ip="10.0.0.2", src_port=1, dst_port=2323, start_us=0, last_us=10, fwd_packets=1,
               bwd_packets=1, fwd_bytes=1, bwd_bytes=1, syn_count=1, ack_count=1, fin_count=0, rst_count=0, label="BENIGN", confidence=0.9,
               anomaly_score=0.0)
    df = spark.createDataFrame([row]).withColumns({"alert": F.lit(False), "novelty": F.lit(False), "protocol": F.col("protocol").cast("int"),
                                                   "dst_port": F.col("dst_port").cast("int")})
    for name in ("flow_duration", "total_fwd_packets", "total_bwd_packets", "total_fwd_bytes", "total_bwd_bytes", "packets_per_second"):
        df = df.withColumn(name, F.lit(0.0))
    done = decide_flows(df, Options(prevent_mode=True, notify_channel="x"))
    assert sorted((r.action, r.source) for r in done.decisions.collect()) == [("allow", "model"), ("block", "honeypot")]
    assert [r.ip for r in done.blocks.collect()] == ["10.9.9.9"] and done.notifications.count() == 1
    assert sorted(r.type for r in done.events.collect()) == ["decision", "decision", "flow.features", "honeypot.probe", "verdict", "verdict"]
    assert decide_flows(df, Options()).blocks.count() == 0


def test_metrics_with_an_empty_class(spark):
    df = spark.createDataFrame([("m", "BENIGN", "BENIGN", 1.0, 0.5)] * 3, "model string, label string, predicted string, confidence double, threshold double")
    m = metrics.model_metrics(metrics.confusion(df)).first()
    assert (m.accuracy, m.macro_f1, m.weighted_f1) == (1.0, 1.0, 1.0)
    r = metrics.alert_rates(df).first()
    assert (r.benign_false_alert_rate, r.attack_alert_recall, r.safe_flow_rate, r.attack_alert_precision) == (0.0, 0.0, 1.0, 0.0)


def test_exact_quantiles_and_caps(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.gauss(0, 1), rng.lognormvariate(0, 6), 3.0]) for _ in range(5001)]
    df = spark.createDataFrame([(v, i % 2 * 1.0, None if i % 3 else float("nan")) for i, v in enumerate(values)], "a double, b double, c double")
    ordered = sorted(values)
    for p in (0.5, 0.01, 0.99):
        place = (len(ordered) - 1) * p
        want = ordered[int(place)] + (ordered[min(int(place) + 1, 5000)] - ordered[int(place)]) * (place - int(place))
        for small in (10_000, 50):
            got = selection.quantiles(df, ["a", "b", "c"], p, small)
            assert got["a"] == pytest.approx(want, rel=1e-12) and got["c"] is None
            assert got["b"] == {0.5: 0.0, 0.01: 0.0, 0.99: 1.0}[p]
    rows = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("g"), (F.col("id") % 7 * 1000).alias("draw"))
    kept = selection.cap_per_group(rows, ["g"], 50)
    assert [r["count"] for r in kept.groupBy("g").count().collect()] == [50, 50, 50]
    want = sorted(sorted(((r.draw, r.row_id) for r in rows.collect() if r.g == 0)))[:50]
    assert sorted((r.draw, r.row_id) for r in kept.filter("g = 0").collect()) == want
    assert selection.cap_per_group(rows, ["g"], 5000).count() == 1000


def test_options(tmp_path):
    (tmp_path / "o.json").write_text('{"flow_idle_timeout": 5, "unknown": 1}')
    opts = Options.load(str(tmp_path / "o.json"), env={"FLOWSIEVE_FLOW_IDLE_TIMEOUT": "7", "FLOWSIEVE_HONEYPOT_PORTS": "23, 2323",
                                                       "FLOWSIEVE_PREVENT_MODE": "yes"})
    assert (opts.flow_idle_timeout, opts.honeypot_ports, opts.prevent_mode) == (5, [23, 2323], True)
    assert Options.load(env={}) == Options()


def test_enforce_equals_brute_force_on_overlapping_intervals(spark):
    import random
    from flowsieve.operators import blocks
    from flowsieve.options import Options
    rng = random.Random(8)
    made = [(f"a{rng.randint(0, 2)}", start := rng.randint(0, 900), start + rng.choice([1, 30, 90])) for _ in range(60)] + [("a1", 950, None)]
    packets = [(i, f"a{rng.randint(0, 3)}", rng.randint(0, 1000)) for i in range(800)]
    intervals = spark.createDataFrame(made, "ip string, blocked_at_us long, end_us long")
    found = blocks.enforce(spark.createDataFrame(packets, "packet_id long, src_ip string, ts_us long"), intervals,
                           Options().updated({"block_timeout": 0.00005})).collect()
    assert len(found) == len(packets)
    for r in found:
        assert r["dropped"] == any(ip == r["src_ip"] and a <= r["ts_us"] and (b is None or r["ts_us"] < b) for ip, a, b in made)


def test_feature_without_numbers_scales_to_null(spark):
    from flowsieve.operators import features
    rows = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    scaled = features.minmax_apply(rows, features.minmax_fit(rows, ["a", "b"])).collect()
    assert [tuple(r) for r in scaled] == [(0.0, None), (1.0, None)]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    names = schemas.CORPUS.names
    line = lambda order, row: ",".join(str(row.get(n, n)) for n in order)
    first, other = names, ["extra", *reversed(names[1:])]        # the other file lacks the first column
    rows = [{n: i * 100 + k for k, n in enumerate(names)} | {"Label": " benign " if i % 2 else "DDoS"} for i in range(6)]
    (tmp_path / "a_cleaned.csv").write_text("\n".join([",".join(first), *[line(first, r) for r in rows[:3]]]) + "\n")
    (tmp_path / "b_cleaned.csv").write_text("\n".join([", ".join(other), *[line(other, r) for r in rows[3:]]]) + "\n")
    (tmp_path / "c_cleaned.csv").write_text("")
    found = {(r["source_file"], r[names[1]]): r.asDict() for r in corpus.scan_csv(spark, str(tmp_path)).collect()}
    assert len(found) == 6
    for i, row in enumerate(rows):
        name = "a_cleaned.csv" if i < 3 else "b_cleaned.csv"
        want = {n: str(row[n]) for n in names} | {"source_file": name} | ({} if i < 3 else {names[0]: None})
        got = found[name, str(row[names[1]])]
        assert {k: v and v.strip() for k, v in got.items()} == {k: v and v.strip() for k, v in want.items()}
    numbered = corpus.training_rows(spark, str(tmp_path), seed=5).collect()
    assert len({r["row_id"] for r in numbered}) == 6 and all(0 <= r["draw"] < selection.DRAWS for r in numbered)
    (tmp_path / "d_cleaned.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        corpus.scan_csv(spark, str(tmp_path))
