import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wiretide.operators import datasets, drift, eve, features, fusion, incidents, metrics, models, packets, temporal, validate

T0 = 1_700_000_000_000_000


def fuse(spark, **signals):
    base = {"k": 0.0, "c": 0.6, "a": 0.0, "r": 0.0, "s": 0.0, "x": 0.0, "d": 0.0} | signals
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{n} double" for n in base))
    return fusion.fuse_risk(df, "k", "c", "a", "r", "s", "x", "d").first()


def test_fusion_vectors(spark):
    one = fuse(spark, k=0.91, c=0.93, a=0.30)
    assert one["verdict"] == "known_attack" and "HIGH_KNOWN_ATTACK_PROBABILITY" in one["reason_codes"]
    two = fuse(spark, k=0.12, c=0.51, a=0.94)
    assert two["verdict"] == "suspicious_unknown" and "ISOLATION_OUTLIER" in two["reason_codes"]
    three = fuse(spark, k=0.30, c=0.55, a=0.25, x=0.25)
    assert three["severity"] != "critical" and three["final_risk_score"] < 50
    four = fuse(spark, k=0.10, c=0.48, a=0.25, r=0.91)
    assert four["verdict"] == "suspicious_unknown" and "HIGH_RECONSTRUCTION_ERROR" in four["reason_codes"] and "ISOLATION_OUTLIER" not in four["reason_codes"]
    five = fuse(spark, k=1.1)
    assert five["error_code"] == "signal_range" and five["verdict"] == "processing_error"
    with pytest.raises(ValueError):
        fusion.FusionConfig(known_weight=0.5)


def test_empirical_cdf_vector(spark):
    df = spark.createDataFrame([(v,) for v in (0.1, 0.1, 0.3, 0.7)], "v double")
    knots = sorted((r["value"], r["probability"]) for r in metrics.empirical_cdf(df, "v").collect())
    assert knots == [(0.1, 0.5), (0.3, 0.75), (0.7, 1.0)]
    at = lambda s: spark.range(1).select(fusion.knot_percentile(F.lit(s), [k for k, _ in knots], [p for _, p in knots]).alias("p")).first()["p"]
    assert [at(s) for s in (0.0, 0.1, 0.2, 0.3, 0.7)] == pytest.approx([0, 0.5, 0.625, 0.75, 1.0])


def test_empirical_cdf_knots(spark):
    df = spark.range(10_000).select(((F.col("id") * 7919) % 10_000 / 10_000).alias("v"))
    knots = metrics.empirical_cdf(df, "v", 101).collect()
    assert len(knots) <= 101 and all(abs(k["value"] - k["probability"]) < 0.001 for k in knots)


def test_drift_vector(spark):
    rows = [(i, "s", 0.1 if i < 8 else 0.8) for i in range(16)]
    got = drift.drift_events(spark.createDataFrame(rows, "i int, s string, value double"), ["s"], "i", threshold=0.3, window=8).collect()
    assert len(got) == 1 and got[0]["reference_mean"] == pytest.approx(0.1) and got[0]["recent_mean"] == pytest.approx(0.8)


def loop_drift(values, window, limit):
    out, on = [], False
    for i in range(len(values)):
        if i + 1 < 2 * window:
            continue
        a, b = sum(values[i - 2 * window + 1 : i - window + 1]) / window, sum(values[i - window + 1 : i + 1]) / window
        if abs(b - a) >= limit and not on:
            on = True
            out.append(i)
        elif abs(b - a) < limit * 0.6:
            on = False
    return out


def test_drift_against_a_loop(spark):
    rng = random.Random(1)
    values = [rng.random() * (0.3 if (i // 40) % 2 else 1) for i in range(600)]
    got = drift.drift_events(spark.createDataFrame(list(enumerate(values)), "i int, value double").withColumn("s", F.lit("a")), ["s"], "i", threshold=0.2, window=8)
    assert sorted(r["i"] for r in got.collect()) == loop_drift(values, 8, 0.2)
    many = spark.createDataFrame([(i, v, s) for s in ("a", None) for i, v in enumerate(values)], "i int, value double, s string")
    blocks = drift.drift_events(many, ["s"], "i", threshold=0.2, window=8, block=20)
    assert sorted(r["i"] for r in blocks.collect()) == sorted(2 * loop_drift(values, 8, 0.2))


def test_flow_rate_by_block(spark):
    """Blocks of any size give the same rates, over pauses, bursts and times that run back."""
    rng = random.Random(5)
    at, rows = 0, []
    for i in range(700):
        at += rng.choice((0, 100_000, 2_000_000, 70_000_000 if i % 90 == 0 else 1, -5_000_000 if i % 110 == 0 else 5))
        rows.append((i, at, "a" if i % 3 else None))
    df = spark.createDataFrame(rows, "arrival int, ts_us long, model_version string")
    rates = [{r["arrival"]: r["flow_rate"] for r in drift.rolling_flow_rate(df, most=12, block=b).collect()} for b in (10_000, 50, 12)]
    assert len(rates[0]) == 700 and rates[0] == rates[1] == rates[2]


def loop_temporal(rows, window, short, skew, most):
    """The features of rows in order of arrival, by plain state per key."""
    state, marks, done, out = {}, {}, set(), {}
    for event, key, ts, ip, port, proto, ms in rows:
        if event in done:
            continue
        done.add(event)
        wm = max(ts, marks.get(key, ts))
        held = [r for r in state.get(key, []) if r[0] >= wm - window - skew]
        prior = [r for r in held if wm - window <= r[0] <= wm]
        if ts >= wm - skew:
            held = sorted([*held, (ts, ip, port, proto, ms <= 1000)], key=lambda r: r[0])[-most:]
        state[key], marks[key] = held, wm
        active = [r for r in held if wm - window <= r[0] <= wm]
        brief = [r for r in active if r[0] >= wm - short]
        times = sorted(r[0] for r in active)
        gaps = [(b - a) / 1000 for a, b in zip(times, times[1:])]
        mean = sum(gaps) / len(gaps) if gaps else 0
        std = math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) if len(gaps) > 1 else 0
        ips, n, p = Counter(r[1] for r in active), len(active), len(prior)
        entropy = -sum(c / n * math.log(c / n) for c in ips.values()) / math.log(len(ips)) if len(ips) > 1 else 0
        out[event] = [
            math.log1p(len(brief)), math.log1p(n), math.log1p(len({r[1] for r in brief})), math.log1p(len(ips)), math.log1p(len({r[2] for r in brief})), math.log1p(len({r[2] for r in active})), float(p > 0 and ip not in {r[1] for r in prior}),
            1 - sum(r[2] == port for r in prior) / p if p else 0, 1 - sum(r[3] == proto for r in prior) / p if p else 0, entropy, math.log1p(mean), math.log1p(std), std / max(mean + std, 1e-9), sum(r[4] for r in active) / n if n else 0, float(p == 0), float(ts < wm),
        ]
    return out


def temporal_rows(n=600, seed=3):
    rng, clock, rows = random.Random(seed), T0, []
    for i in range(n):
        clock += rng.choice([0, 100_000, 2_000_000, 9_000_000])
        ts = clock - rng.choice([0, 0, 0, 1_000_000, 4_000_000, 30_000_000])
        rows.append((f"e{i if rng.random() > 0.05 else max(0, i - 1)}", ("s", f"10.0.0.{rng.randrange(3)}"), ts, f"10.0.1.{rng.randrange(5)}", rng.choice([53, 443, None]), rng.choice(["tcp", "udp"]), rng.choice([10.0, 5000.0])))
    return rows


def temporal_frame(spark, rows):
    return spark.createDataFrame([(e, k[0], k[1], ts, ip, port, proto, ms, i) for i, (e, k, ts, ip, port, proto, ms) in enumerate(rows)], "event_id string, sensor_id string, src_ip string, ts_us long, dst_ip string, dst_port int, protocol string, duration_ms double, arrival long")


@pytest.mark.parametrize("most", [2048, 4])
def test_temporal_against_a_loop(spark, most):
    rows = temporal_rows()
    want = loop_temporal(rows, 60_000_000, 10_000_000, 5_000_000, most)
    got = {r["event_id"]: [r[f] for f in temporal.FEATURES] for r in temporal.temporal_features(temporal_frame(spark, rows), most=most).collect()}
    assert set(got) == set(want)
    for e in want:
        assert got[e] == pytest.approx(want[e], abs=1e-9), e


@pytest.mark.parametrize(("window", "short", "skew", "most"), [(60, 10, 5, 2048), (60, 10, 5, 7), (30, 30, 30, 5), (20, 5, 40, 3), (60, 10, 0, 50), (400, 100, 50, 60)])
def test_frame_against_a_loop(window, short, skew, most):
    rows = temporal_rows(1500, seed=most)
    want = loop_temporal(rows, window * 10**6, short * 10**6, skew * 10**6, most)
    frames, marks, seen = {}, {}, set()
    for i, (event, key, ts, ip, port, proto, ms) in enumerate(rows):
        if event in seen:
            continue
        seen.add(event)
        marks[key] = max(ts, marks.get(key, ts))
        frame = frames.setdefault(key, temporal.Frame(window * 10**6, short * 10**6, skew * 10**6, most))
        if i % 97 == 0:  # goes on from what another one remembers
            other = frame
            frame = frames[key] = temporal.Frame(window * 10**6, short * 10**6, skew * 10**6, most)
            frame.load(other.rows[other.low :], marks[key] if not other.rows else max(r[0] for r in other.rows))
        assert frame.observe((ts, i, ip, port, proto, ms <= 1000), marks[key]) == pytest.approx(want[event], abs=1e-9), i


def test_frame_searches_only_for_rows_out_of_order(monkeypatch):
    """A row that comes in order is put at the end without a search, and a frame keeps nothing but the rows of its window."""
    calls = []
    real = temporal.bisect.bisect
    monkeypatch.setattr(temporal.bisect, "bisect", lambda *a, **k: calls.append(1) or real(*a, **k))
    frame = temporal.Frame(60, 10, 5, 2048)
    for i in range(1000):
        frame.observe((i, i, "a", 1, "tcp", True), i)
    assert not calls
    frame.observe((997, 1000, "a", 1, "tcp", True), 999)
    assert len(calls) == 1
    assert sum(len(v) for v in vars(frame).values() if isinstance(v, list)) < 300


def test_one_source_is_many_blocks(spark):
    """A source with all the rows, over block borders: blocks of one window, and of one that holds all."""
    rows = [(f"e{i}", ("s", "10.0.0.1"), ts, *rest) for i, (_, _, ts, *rest) in enumerate(temporal_rows(900))]
    want = loop_temporal(rows, 60_000_000, 10_000_000, 5_000_000, 2048)
    frame = temporal_frame(spark, rows)
    for block in (1, 10**6):
        out = temporal.temporal_features(frame, keep=("arrival",), block=block)
        got = {r["event_id"]: [r[f] for f in temporal.FEATURES] for r in out.collect()}
        assert set(got) == set(want) and all(got[e] == pytest.approx(want[e], abs=1e-9) for e in want)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert temporal.temporal_features(frame.where("false")).count() == 0


def test_portable_features_vector(spark):
    df = spark.createDataFrame([(1, 10.0, 1, 1, 10, 10, "TCP", 443), (2, 10.0, 1, 1, 10, 10, "TCP", None)], "i int, duration_ms double, packets_forward long, packets_reverse long, bytes_forward long, bytes_reverse long, protocol string, dst_port int")
    a, b = features.portable_features(df, "i").orderBy("i").collect()
    assert a["protocol_tcp"] == a["port_well_known"] == a["service_web"] == 1 and b["destination_port_missing"] == 1 and b["port_well_known"] == b["port_registered"] == b["port_dynamic"] == 0
    assert len(a) == 25


def grouped(spark, **change):
    old = {"source_hosts": ["a"], "destination_hosts": ["b"], "signature_ids": ["1"], "reason_codes": ["R"], "attack_stages": ["reconnaissance", "needs_review"], "severities": ["low", "medium"], "risks": [10.0, 20.0]}
    new = {"source_host": "x", "destination_host": "y", "signature_ids": ["9"], "reason_codes": ["Q"], "attack_stage": "needs_review", "severity": "low", "risk": 1.0} | change
    kinds = "incident struct<source_hosts: array<string>, destination_hosts: array<string>, signature_ids: array<string>, reason_codes: array<string>, attack_stages: array<string>, severities: array<string>, risks: array<double>>, alert struct<source_host: string, destination_host: string, signature_ids: array<string>, reason_codes: array<string>, attack_stage: string, severity: string, risk: double>"
    r = incidents.grouping_reasons()
    row = spark.createDataFrame([(tuple(old.values()), tuple(new.values()))], kinds).select(r.alias("r"), incidents.should_group(r).alias("g")).first()
    return row["r"][1:], row["g"]


def test_grouping_rules(spark):
    assert grouped(spark) == ([], False)
    for change, reason in (({"source_host": "a"}, "same source host"), ({"destination_host": "b"}, "shared destination"), ({"signature_ids": ["1"]}, "common signature"), ({"reason_codes": ["R"]}, "common reason"), ({"attack_stage": "reconnaissance"}, "similar attack stage (reconnaissance)"), ({"risk": 30.0}, "repeated escalation"), ({"severity": "high"}, "repeated escalation")):
        assert grouped(spark, **change) == ([reason], True)


def fold_rows():
    reasons = ["PORT_SWEEP", "DESTINATION_FANOUT", "DESTINATION_FANOUT", "PORT_SWEEP", "UNRELATED_SIGNAL"]
    return [(f"a{i}", T0 + i * 1_000_000, f"10.0.0.{i + 1}", f"192.0.2.{d}", [], [r], "reconnaissance" if r == "PORT_SWEEP" else "unclassified_anomaly", s, risk) for i, (r, d, s, risk) in enumerate(zip(reasons, (100, 100, 101, 102, 103), ("low", "medium", "high", "high", "critical"), (20.0, 30.0, 40.0, 50.0, 60.0)))]


FOLD = "alert_id string, ts_us long, src_ip string, dst_ip string, signature_ids array<string>, reason_codes array<string>, attack_stage string, severity string, risk double"


def test_incident_fold_vector(spark):
    alerts = spark.createDataFrame(fold_rows(), FOLD)
    got = incidents.assign_incidents(alerts).orderBy("ts_us").collect()
    assert len({r["incident_id"] for r in got}) == 1 and got[-1]["title"] == "Correlated network activity"
    members = alerts.join(incidents.assign_incidents(alerts).select("alert_id", "incident_id"), "alert_id").withColumn("acknowledged", F.lit(False))
    roll = incidents.incident_rollup(members).first()
    assert roll["escalation_count"] >= 1 and roll["attack_stages"] == ["reconnaissance", "unclassified_anomaly"] and roll["severity"] == "critical" and roll["alert_count"] == 5
    later = alerts.unionByName(alerts.withColumns({"alert_id": F.concat("alert_id", F.lit("x")), "ts_us": F.col("ts_us") + 3_600_000_000}))
    assert incidents.assign_incidents(later).select("incident_id").distinct().count() == 2


def plain_fold(alerts):
    """(alert, first alert of its incident, reasons, title), looking through all open incidents for each alert."""
    open_, made, out = [], 0, []
    rank = incidents.SEVERITIES.index
    for alert, ts, src, dst, sigs, codes, stage, severity, risk in sorted(alerts, key=lambda a: (a[1], a[0])):
        open_ = [x for x in open_ if x["at"] >= ts - incidents.GAP_US]
        best, why = None, []
        for inc in sorted(open_, key=lambda x: (-x["at"], -x["n"])):
            found = ["same source host"] * (src in inc["src"]) + ["shared destination"] * (dst in inc["dst"]) + ["common signature"] * bool(inc["sig"] & set(sigs)) + ["common reason"] * bool(inc["why"] & set(codes))
            found += [f"similar attack stage ({stage})"] * (stage not in incidents.GENERIC_STAGES and stage in inc["stage"])
            s, r = inc["sev"], inc["risk"]
            found += ["repeated escalation"] * (len(r) == 2 and (r[0] < r[1] < risk or s[0] < s[1] < rank(severity)))
            if len(found) > len(why):
                best, why = inc, found
        if best is None:
            best, made, why = {"id": alert, "n": made, "src": set(), "dst": set(), "sig": set(), "why": set(), "stage": set(), "sev": [], "risk": [], "title": f"Activity from {src}"}, made + 1, ["initial alert"]
            open_.append(best)
        else:
            why = ["time proximity", *why]
            best["title"] = best["title"] if src in best["src"] else "Correlated network activity"
        best["at"] = ts
        for k, v in (("src", {src}), ("dst", {dst}), ("sig", sigs), ("why", codes), ("stage", {stage})):
            best[k] |= set(v)
        best["sev"], best["risk"] = [*best["sev"][-1:], rank(severity)], [*best["risk"][-1:], risk]
        out.append((alert, best["id"], why, best["title"]))
    return out


def fold_data(n, hosts, seed, flat=False, steps=(0, 1, 60, 200, 700)):
    rng, ts, out = random.Random(seed), T0, []
    for i in range(n):
        ts += rng.choice(steps) * 1_000_000
        h = rng.randrange(hosts)
        out.append((f"a{i:05}", ts, f"10.0.{h}.{rng.randrange(3)}", f"192.0.{h}.{rng.randrange(3)}", [f"g{h}"] * rng.randrange(2), [f"R{h}"] if rng.random() < 0.3 else [], rng.choice(["needs_review", f"stage{h}"]),
                    "low" if flat else rng.choice(incidents.SEVERITIES), 5.0 if flat else float(rng.randrange(20))))
    return out


@pytest.mark.parametrize(("hosts", "flat", "large"), [(2, False, 10**9), (30, False, 10**9), (30, False, 1), (30, True, 1), (1000, True, 20)])
def test_incident_members_against_a_scan(spark, hosts, flat, large):
    rows = fold_data(400, hosts, hosts, flat)
    got = incidents.assign_incidents(spark.createDataFrame(rows, FOLD), large=large).collect()
    want = {a: (first, why, title) for a, first, why, title in plain_fold(rows)}
    ids = {r["alert_id"]: r["incident_id"] for r in got}
    assert {r["alert_id"]: (ids[want[r["alert_id"]][0]], list(r["reasons"]), r["title"]) for r in got} == {a: (ids[first], why, title) for a, (first, why, title) in want.items()}
    assert len({ids[f] for f, *_ in want.values()}) == len({f for f, *_ in want.values()})


def test_large_sessions_fall_into_components(spark):
    rows = fold_data(300, 40, 5, True, steps=(1,))  # one session
    frame = spark.createDataFrame(rows, FOLD)
    dated = incidents.sessions(frame)
    parts = {r["alert_id"]: r["_part"] for r in incidents._parts(dated, ["session"], 1).collect()}
    links = {}
    label = {r[0]: r[0] for r in rows}
    for alert, _, src, dst, sigs, codes, stage, *_ in rows:  # all within the gap
        for link in [src, dst, *sigs, *codes] + [stage] * (stage != "needs_review"):
            other = links.setdefault(link, alert)
            low, high = sorted((label[other], label[alert]))
            label = {k: low if v == high else v for k, v in label.items()}
    assert parts == label and len(set(parts.values())) > 10
    rising = [(*r[:8], float(i)) for i, r in enumerate(rows)]  # an escalation may link any two
    assert {r["_part"] for r in incidents._parts(incidents.sessions(spark.createDataFrame(rising, FOLD)), ["session"], 1).collect()} == {""}


def test_session_of_one_component_stays_whole(spark):
    rows = [(*r[:5], ["R"], *r[6:]) for r in fold_data(300, 40, 5, True, steps=(1,))]
    assert {r["_part"] for r in incidents._parts(incidents.sessions(spark.createDataFrame(rows, FOLD)), ["session"], 1).collect()} == {""}


@pytest.mark.parametrize("seed", range(4))
def test_crossed_sessions_against_a_scan(spark, seed):
    rng, rows = random.Random(seed), []
    for s in range(60):
        ts = T0
        for _ in range(rng.randrange(2, 9)):
            ts += rng.choice((0, 1, 300, 500, 700)) * 1_000_000
            rows.append((s, rng.choice("ab"), ts, float(rng.randrange(5)), rng.choice(("low", "medium"))))
    want = set()
    for s in range(60):
        own = [(c, t, (risk, incidents.SEVERITIES.index(sev))) for k, c, t, risk, sev in rows if k == s]
        for i in (0, 1):
            ends = [(c, t, v[i]) for c, t, v in own if any(c == c2 and t - incidents.GAP_US <= t2 <= t and v2[i] < v[i] for c2, t2, v2 in own)]
            for c, t, v in own:
                near = [(c2, v2) for c2, t2, v2 in ends if t - incidents.GAP_US <= t2 <= t]
                if any(c2 != c for c2, _ in near) and min(v2 for _, v2 in near) < v[i]:
                    want.add(s)
    told = spark.createDataFrame(rows, "session long, component string, ts_us long, risk double, severity string")
    assert {r["session"] for r in incidents._crossed(told, ["session"]).collect()} == want and 0 < len(want) < 60


def test_context_is_rebuilt_from_members(spark):
    """Going on from the rebuilt context assigns the next alert as the fold does, by the same reasons."""
    rows = fold_data(60, 3, 9, steps=(1, 60))
    frame = spark.createDataFrame(rows, FOLD)
    members = frame.join(incidents.assign_incidents(frame.where("alert_id < 'a00059'")).select("alert_id", "incident_id"), "alert_id")
    context = incidents.incident_context(members).where(F.col("updated_us") >= rows[-1][1] - incidents.GAP_US)
    old = F.struct(*[F.col(c) for c in ("source_hosts", "destination_hosts", "signature_ids", "reason_codes", "attack_stages", "severities", "risks")])
    new = frame.where("alert_id = 'a00059'").select(F.struct(F.col("src_ip").alias("source_host"), F.col("dst_ip").alias("destination_host"), "signature_ids", "reason_codes", "attack_stage", "severity", "risk").alias("alert"))
    judged = context.select("updated_us", "incident_id", old.alias("incident")).crossJoin(new).withColumn("why", incidents.grouping_reasons())
    told = judged.where(incidents.should_group(F.col("why"))).orderBy(F.size("why").desc(), F.desc("updated_us")).first()
    want = {a: (first, why) for a, first, why, _ in plain_fold(rows)}["a00059"]
    assert sorted(told["why"]) == sorted(want[1])
    assert told["incident_id"] == members.where(F.col("alert_id") == want[0]).first()["incident_id"]


def test_validation(spark):
    now = dt.datetime(2026, 1, 1)
    good = ("e", "s", now, now, "10.0.0.1", "10.0.0.2", 1, 2, "TCP", 1.0, 1, 1, 1, 1, 5.0, 9.0, 4)
    schema = "event_id string, sensor_id string, timestamp_start timestamp, timestamp_end timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, duration_ms double, packets_forward long, packets_reverse long, bytes_forward long, bytes_reverse long, packet_length_min double, packet_length_max double, ip_version int"
    bad = {"timestamp_order": {3: now - dt.timedelta(1)}, "src_ip": {4: "nope"}, "ip_version": {5: "::1"}, "dst_port": {7: 70_000}, "duration_ms": {9: float("nan")}, "packets_forward": {10: -1}, "packet_length_min_order": {14: 10.0}, "sensor_id": {1: ""}}
    rows = [good] + [tuple(change.get(i, v) for i, v in enumerate(good)) for change in bad.values()]
    got = [r["error_code"] for r in validate.validate_flow(spark.createDataFrame(rows, schema)).collect()]
    assert got == [None, *bad]
    fine, apart = validate.split(validate.validate_flow(spark.createDataFrame(rows, schema)))
    assert (fine.count(), apart.count()) == (1, len(bad))
    assert validate.validate_flow(spark.createDataFrame([good], schema).drop("src_ip")).first()["error_code"] == "missing_src_ip"


@pytest.mark.parametrize("value", [float("nan"), float("inf"), -1.0, 86_400_001.0])
def test_registry_range(spark, value):
    df = spark.range(1).select(*[F.lit(1.0).alias(f) for f in features.REGISTRY if f != "duration_ms"], F.lit(value).alias("duration_ms"))
    assert validate.registry_range_check(df).first()["error_code"] == "duration_ms"


EVE = [
    '{"timestamp":"2026-01-01T00:00:00.000000+0000","event_type":"alert","src_ip":"10.0.0.1","src_port":50000,"dest_ip":"10.0.0.2","dest_port":443,"proto":"TCP","alert":{"signature_id":1,"signature":"Scan","category":"recon","severity":2}}',
    '{"timestamp":"2026-01-01T00:00:01Z","event_type":"tls","flow_id":7,"src_ip":"10.0.0.1","tls":{"version":"TLS 1.3","sni":"private.example"}}',
    '{"timestamp":"2026-01-01T00:00:02Z","event_type":"dns","flow_id":7,"dns":{"type":"query","queries":[{"rrname":"q.example","rrtype":"A"}]}}',
    '{"timestamp":"2026-01-01T00:00:03Z","event_type":"stats"}', '{"timestamp":"2026-01-01T00:00', '{"timestamp":"2026-01-01T00:00:00","event_type":"flow","flow_id":1,"flow":{"state":"new"}}',
    '{"timestamp":"2026-01-01T00:00:00Z","event_type":"http","flow_id":1}', '[1]',
]


def test_eve_lines(spark):
    got = eve.parse_eve(spark.createDataFrame([(x,) for x in EVE], "value string")).collect()
    assert [r["kind"] for r in got] == ["alert", "tls", "dns", "ignored", "error", "error", "error", "error"]
    assert got[0]["community_flow_id"] == "1:B4H0bMN0Rih3qr9C82AA7esBYLM=" and got[0]["severity"] == "high"
    assert "private.example" not in str(got[1]) and len(got[1]["metadata"]["tls_sni_sha256"]) == 64 and got[1]["community_flow_id"].startswith("native-flow:")
    assert got[2]["metadata"]["dns_rrtype"] == "A" and "q.example" not in str(got[2])
    h = eve.health(eve.parse_eve(spark.createDataFrame([(x,) for x in [*EVE, EVE[0]]], "value string"))).first()
    assert (h["parsed_events"], h["malformed_events"], h["duplicate_events"]) == (4, 4, 1)


def test_packets(spark):
    rows = [(1.0, 60, "10.0.0.9", 443, "10.0.0.1", 50000, "TCP", 0x12, 2), (0.5, 50, "10.0.0.1", 50000, "10.0.0.9", 443, "TCP", 0x02, 1), (2.0, 100, "10.0.0.1", 50000, "10.0.0.9", 443, "TCP", 0x18, 3)]
    f = packets.packets_to_flows(spark.createDataFrame(rows, "ts double, size int, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, tcp_flags int, seq long")).collect()
    assert len(f) == 1
    r = f[0]
    assert (r["src_ip"], r["packets_forward"], r["packets_reverse"], r["bytes_forward"], r["direction_basis"]) == ("10.0.0.1", 2, 1, 150, "tcp_syn_without_ack")
    assert r["first_packet_sizes"] == [50, 60, 100] and r["first_packet_directions"] == [1, -1, 1] and r["iat_mean"] == 750.0 and (r["tcp_syn_count"], r["tcp_ack_count"], r["tcp_psh_count"]) == (2, 2, 1)


def test_cic_adapter(spark):
    rows = [("1000", "2", "1", "20", "10", "80", "BENIGN"), ("2000", "2", "0", "20", "0", "80", "DoS Hulk"), ("0", "1", "1", "1", "1", "22", "FTP-Patator")]
    df = spark.createDataFrame(rows, "`Flow Duration` string, ` Total Fwd Packets` string, `Tot Bwd Pkts` string, `TotLen Fwd Pkts` string, `Total Length of Bwd Packets` string, `Dst Port` string, `Label` string")
    c, notes = datasets.canonicalize(df, "cic")
    got = c.collect()
    assert [r["label"] for r in got] == ["benign", "dos", "brute_force"] and got[0]["duration_ms"] == 1.0 and got[2]["byte_rate"] is None and notes
    with pytest.raises(ValueError):
        datasets.canonicalize(df.drop("Dst Port"), "cic")
    header = df.unionByName(spark.createDataFrame([tuple(df.columns)], df.schema))
    assert datasets.drop_repeated_headers(header).count() == 3


def test_models_separate_outliers(spark):
    rng = random.Random(7)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)] + [(1000 + i, rng.gauss(8, 0.5), rng.gauss(-8, 0.5)) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, a double, b double").cache()
    far = lambda out, c, sign: min(sign * r[c] for r in out if r["id"] >= 1000) > sorted(sign * r[c] for r in out if r["id"] < 1000)[380]
    assert far(models.IsolationForest(["a", "b"], trees=30).fit(df.where("id < 1000"), "id").decision(df).collect(), "decision", -1)
    mean, cov = models.robust_covariance(df, ["a", "b"])
    assert far(df.select("id", models.mahalanobis(["a", "b"], mean, cov).alias("d")).collect(), "d", 1)
    assert far(models.local_outlier_factor(df, df.where("id < 1000"), ["a", "b"], "id", k=10).collect(), "lof", 1)
    assert far(models.Autoencoder(["a", "b"], hidden=(3, 1, 3)).fit(df.where("id < 1000"), epochs=3).errors(df).collect(), "reconstruction_error", 1)


def test_running_sums_do_not_need_exchange_reuse(spark):
    """Ranking, quantiles and the distribution over several ranges of scores, with and without exchange reuse, against plain Python."""
    from wiretide.operators import metrics

    rng = random.Random(4)
    data = [(i, round(rng.gauss(0, 1), 2), rng.random() < 0.3) for i in range(6000)]
    frame = spark.createDataFrame(data, "id long, score double, truth boolean").repartition(7)
    ordered = sorted(s for _, s, _ in data)
    pos, neg = [s for _, s, t in data if t], [s for _, s, t in data if not t]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg[:400]) / (len(pos) * 400)
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            run = metrics._cumulative(frame.groupBy("score").agg(F.count("*").alias("c"))).collect()
            assert max(r["until"] for r in run) == 6000 and all(r["until"] == sum(x <= r["score"] for x in ordered) for r in run[:40])
            assert metrics.higher_quantile(frame, "score", 0.97).first()["value"] == ordered[-(-5999 * 97 // 100)]
            assert abs(metrics.ranking_scores(frame, "score", "truth").first()["roc_auc"] - auc) < 0.03
            t = {r["score"]: (r["tp"], r["fp"]) for r in metrics.by_threshold(frame, "score", "truth").collect()}
            assert all(t[s] == (sum(x >= s for x in pos), sum(x >= s for x in neg)) for s in list(t)[:40])
        finally:
            spark.conf.set("spark.sql.exchange.reuse", "true")


def test_incident_detail_and_ingest_results(spark):
    from wiretide.operators import incidents
    from wiretide.sources import sinks

    members = spark.createDataFrame(
        [("i", f"a{n}", n, "s", "d", ["R"], "scan", "low", float(n), False, "known_attack", "c1" if n else None) for n in range(3)] + [("j", "a9", 9, "s", "d", ["R"], "scan", "low", 1.0, False, "known_attack", "c2")],
        "incident_id string, alert_id string, ts_us long, src_ip string, dst_ip string, reason_codes array<string>, attack_stage string, severity string, risk double, acknowledged boolean, verdict string, community_flow_id string",
    )
    told = spark.createDataFrame([("c1", "s1", "high", 5), ("c1", "s1", "high", 5), ("c2", "s2", "low", 6), (None, "s3", "low", 7)], "community_flow_id string, signature_event_id string, signature_severity string, ts_us long")
    notes = spark.createDataFrame([("i", 1, 4, "seen"), ("j", 2, 4, "other")], "incident_id string, note_id long, ts_us long, text string")
    head, timeline = incidents.incident_detail(members, told, notes, "i")
    assert [(r["alert_count"], r["signatures"], r["notes"]) for r in head.collect()] == [(3, 1, 1)]
    assert [(r["kind"], r["ref"]) for r in timeline.collect()] == [("alert", "a0"), ("alert", "a1"), ("alert", "a2"), ("note", "1"), ("signature", "s1")]
    assert incidents.incident_detail(members, told, notes, "none")[1].count() == 0
    batch = spark.createDataFrame([("d1", 1, "known_attack"), ("d1", 2, "benign"), ("d2", 3, "benign"), ("d3", 4, "benign")], "detection_id string, arrival long, verdict string")
    got = {r["detection_id"]: (r["alert_id"], r["is_new"]) for r in sinks.ingest_result(batch, spark.createDataFrame([("d3", "known_attack")], "detection_id string, verdict string")).collect()}
    assert got == {"d1": ("alert-d1", True), "d2": (None, True), "d3": ("alert-d3", False)}
    candidates = sinks.export_rows(batch.withColumn("verdict", F.lit("=1+1")), ("verdict", "detection_id"))
    assert {r["verdict"] for r in candidates.collect()} == {"'=1+1"}


def test_replayed_envelopes_are_parsed_once(spark):
    from wiretide.plans.offline import m36

    told = m36(spark, "/root/testdata/sf0.001")
    assert "from_json" not in told._jdf.queryExecution().optimizedPlan().toString() and told.count() == 1


def test_signatures_of_incidents_each_once(spark):
    rng = random.Random(4)
    members = [(f"i{rng.randrange(4)}", rng.choice(["c1", "c2", "c3", None])) for _ in range(40)]
    signatures = [(rng.choice(["c1", "c2", "c3", "c4", None]), f"s{rng.randrange(12)}", "low", T0) for _ in range(40)]
    told = incidents.incident_signatures(spark.createDataFrame(members, "incident_id string, community_flow_id string"), spark.createDataFrame(signatures, "community_flow_id string, signature_event_id string, signature_severity string, ts_us long"))
    assert sorted((r["incident_id"], r["signature_event_id"]) for r in told.collect()) == sorted({(i, s) for i, c in members for c2, s, *_ in signatures if c is not None and c == c2})
    assert told._jdf.queryExecution().optimizedPlan().nodeName() == "Union"  # what meets isn't made distinct as a whole


def test_blocks_put_ties_in_order(spark):
    from wiretide.operators.drift import blocked

    rng = random.Random(5)
    rows = [(k, rng.randrange(6), f"a{i}") for i, k in enumerate(rng.choices("ab", k=200))]
    got = blocked(spark.createDataFrame(rows, "k string, t long, id string"), ["k"], "t", 2, 7, then=("id",)).where("_own").collect()
    for k in "ab":
        assert [r["id"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["_n"])] == [i for _, _, i in sorted(r for r in rows if r[0] == k)]
    assert max(r["_block"] for r in got) > 5


def test_capped_sample_ranks_few_rows(spark):
    from wiretide.operators import datasets as ds

    df = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"))
    h = F.xxhash64(F.lit(9), F.col("id"))
    want = {(r["k"], r["id"]) for k in (None, 1, 2) for r in df.where(F.col("k").eqNullSafe(F.lit(k))).orderBy(h, "id").limit(100).collect()}
    told = ds.capped_sample(df, "id", 100, by="k", seed=9)
    assert {(r["k"], r["id"]) for r in told.collect()} == want and len(want) == 300
    assert "left_semi" in told._jdf.queryExecution().optimizedPlan().toString().lower().replace("leftsemi", "left_semi")  # what is ranked is what the bins leave
