"""Queries over windows, drift, incidents, joins, aggregates and the read layer, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretide.operators import correlate, drift, features, incidents, metrics, queries as q, temporal
from wiretide.plans.basics import _STAGE, rounded
from wiretide.plans.flowview import FLOW, SCORED, flows, read, scored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _seq():
    return F.col("arrival") * 10_000_000_000 + F.col("n")


_SEQ = "arrival * 10000000000 + n"
_PG = "CASE protocol WHEN 'TCP' THEN 'tcp' WHEN 'UDP' THEN 'udp' WHEN 'ICMP' THEN 'icmp' ELSE 'other' END"
_WIN, _SHORT, _SKEW = 86_400, 21_600, 43_200


def _sequenced(spark, d):
    return flows(spark, d).withColumn("arrival", _seq())


@query("w1_temporal_features", f"""WITH {FLOW},
e AS (SELECT *, {_SEQ} AS seq, {_PG} AS pg, coalesce(dst_port, -1) AS port, max(ts_us) OVER (PARTITION BY sensor_id, src_ip ORDER BY {_SEQ} ROWS UNBOUNDED PRECEDING) AS wm FROM flow),
p AS (SELECT e.event_id AS id, e.seq AS me, e.wm, e.dst_ip AS my_ip, e.port AS my_port, e.pg AS my_pg, e.ts_us < e.wm AS late, r.seq, r.ts_us, r.dst_ip, r.port, r.pg, r.duration_ms <= 1000 AS brief
  FROM e LEFT JOIN e r ON e.sensor_id = r.sensor_id AND e.src_ip = r.src_ip AND r.seq <= e.seq AND r.ts_us >= r.wm - {_SKEW}000000 AND r.ts_us >= e.wm - {_WIN}000000),
s AS (SELECT *, ts_us >= wm - {_SHORT}000000 AS short, seq < me AS prior, (ts_us - lag(ts_us) OVER (PARTITION BY id ORDER BY ts_us, seq)) / 1000.0::DOUBLE AS gap FROM p),
h AS (SELECT id, -sum(c * 1.0::DOUBLE / n * ln(c * 1.0::DOUBLE / n)) / ln(count(*)) AS entropy FROM (SELECT id, dst_ip, count(*) AS c, sum(count(*)) OVER (PARTITION BY id) AS n FROM s WHERE seq IS NOT NULL GROUP BY id, dst_ip) GROUP BY id HAVING count(*) > 1),
a AS (SELECT id, any_value(late) AS late, count(seq) AS n, count(seq) FILTER (short) AS ns, count(DISTINCT dst_ip) AS di, count(DISTINCT dst_ip) FILTER (short) AS ds, count(DISTINCT port) AS pi, count(DISTINCT port) FILTER (short) AS ps,
  count(seq) FILTER (prior) AS np, count(seq) FILTER (prior AND dst_ip = my_ip) AS same_ip, count(seq) FILTER (prior AND port = my_port) AS same_port, count(seq) FILTER (prior AND pg = my_pg) AS same_pg,
  coalesce(avg(gap), 0) AS m, CASE WHEN count(gap) > 1 THEN stddev_pop(gap) ELSE 0 END AS sd, count(seq) FILTER (brief) AS briefs FROM s GROUP BY id)
SELECT a.id AS event_id, round(ln(1 + ns), 6) AS source_flows_10s_log1p, round(ln(1 + n), 6) AS source_flows_60s_log1p, round(ln(1 + ds), 6) AS unique_destinations_10s_log1p, round(ln(1 + di), 6) AS unique_destinations_60s_log1p,
  round(ln(1 + ps), 6) AS unique_destination_ports_10s_log1p, round(ln(1 + pi), 6) AS unique_destination_ports_60s_log1p, (np > 0 AND same_ip = 0)::INT::DOUBLE AS destination_novelty_60s,
  round(CASE WHEN np > 0 THEN 1 - same_port::DOUBLE / np ELSE 0 END, 6) AS service_port_rarity_60s, round(CASE WHEN np > 0 THEN 1 - same_pg::DOUBLE / np ELSE 0 END, 6) AS protocol_rarity_60s,
  round(coalesce(entropy, 0), 6) AS destination_fanout_entropy_60s, round(ln(1 + m), 6) AS connection_interval_mean_log1p_ms_60s, round(ln(1 + sd), 6) AS connection_interval_std_log1p_ms_60s,
  round(sd / greatest(m + sd, 1e-9), 6) AS connection_burstiness_60s, round(CASE WHEN n > 0 THEN briefs::DOUBLE / n ELSE 0 END, 6) AS short_lived_ratio_60s, (np = 0)::INT::DOUBLE AS temporal_cold_start, late::INT::DOUBLE AS temporal_late_event
FROM a LEFT JOIN h ON a.id = h.id""")
def w1(spark, d):
    return rounded(temporal.temporal_features(_sequenced(spark, d), _WIN, _SHORT, _SKEW), 6)


_THRESHOLDS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in drift.THRESHOLDS.items())


@query("w3_drift_events", f"""WITH RECURSIVE {SCORED}, m AS (SELECT sensor_id, n, row_number() OVER w AS i, avg(anomaly_score) OVER (w ROWS BETWEEN 31 PRECEDING AND 16 PRECEDING) AS a, avg(anomaly_score) OVER (w ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS b
  FROM scored WINDOW w AS (PARTITION BY sensor_id ORDER BY n)),
t AS (SELECT *, CASE WHEN i >= 32 AND abs(b - a) >= 0.1 THEN 1 WHEN i >= 32 AND abs(b - a) < 0.06 THEN 0 END AS turn FROM m),
u AS (SELECT *, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT sensor_id, n, round(a, 6) AS reference_mean, round(b, 6) AS recent_mean FROM u WHERE turn = 1 AND before = 0""")
def w3(spark, d):
    found = drift.drift_events(scored(spark, d).select("sensor_id", "n", "anomaly_score"), ["sensor_id"], "n", "anomaly_score", 0.1, 16)
    return rounded(found.select("sensor_id", "n", "reference_mean", "recent_mean"), 6)


def _detections(spark, d):
    return _sequenced_scored(spark, d).withColumns({"detection_id": F.col("event_id"), "model_version": F.col("sensor_id")})


def _sequenced_scored(spark, d):
    return scored(spark, d).withColumn("arrival", _seq())


@query("w5_rolling_flow_rate", f"""WITH {FLOW}, o AS (SELECT sensor_id, event_id, {_SEQ} AS seq, ts_us FROM flow),
b AS (SELECT *, CASE WHEN ts_us < lag(ts_us) OVER (PARTITION BY sensor_id ORDER BY seq) THEN 1 ELSE 0 END AS back FROM o),
g AS (SELECT *, sum(back) OVER (PARTITION BY sensor_id ORDER BY seq) AS part FROM b),
i AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, part ORDER BY seq) AS i FROM g),
j AS (SELECT a.event_id, a.ts_us, count(*) AS n, min(r.ts_us) AS low FROM i a JOIN i r ON a.sensor_id = r.sensor_id AND a.part = r.part AND r.i <= a.i AND r.i > a.i - 256 AND r.ts_us >= a.ts_us - 60000000 GROUP BY a.event_id, a.ts_us)
SELECT event_id, round(ln(1 + least(CASE WHEN n < 2 THEN n::DOUBLE ELSE (n - 1) / greatest((ts_us - low) / 1e6, 0.001) END, 10000)) / ln(10001), 6) AS flow_rate FROM j""")
def w5(spark, d):
    return rounded(drift.rolling_flow_rate(_sequenced(spark, d).select("event_id", "sensor_id", "arrival", "ts_us"), by=("sensor_id",)).select("event_id", "flow_rate"), 6)


@query("w4_drift_signals")
def w4(spark, d):
    return drift.runtime_drift(_detections(spark, d), window=16).select("model_version", "signal", "detection_id", "event_id", F.round("magnitude", 6).alias("magnitude"))


_RATE = f"""o AS (SELECT sensor_id, event_id, {_SEQ} AS seq, ts_us FROM flow),
b0 AS (SELECT *, CASE WHEN ts_us < lag(ts_us) OVER (PARTITION BY sensor_id ORDER BY seq) THEN 1 ELSE 0 END AS back FROM o),
g0 AS (SELECT *, sum(back) OVER (PARTITION BY sensor_id ORDER BY seq) AS part FROM b0),
i0 AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, part ORDER BY seq) AS i FROM g0),
j0 AS (SELECT a.event_id, a.ts_us, count(*) AS n, min(r.ts_us) AS low FROM i0 a JOIN i0 r ON a.sensor_id = r.sensor_id AND a.part = r.part AND r.i <= a.i AND r.i > a.i - 256 AND r.ts_us >= a.ts_us - 60000000 GROUP BY a.event_id, a.ts_us),
rate AS (SELECT event_id, ln(1 + least(CASE WHEN n < 2 THEN n::DOUBLE ELSE (n - 1) / greatest((ts_us - low) / 1e6, 0.001) END, 10000)) / ln(10001) AS flow_rate FROM j0)"""


@query("w4_drift_begins", f"""WITH {SCORED}, {_RATE},
v AS (SELECT sensor_id, event_id, {_SEQ} AS seq, anomaly_score, confidence, flow_rate, ln(1 + duration_ms) / ln(86400001) AS fd, ln(1 + bytes_forward + bytes_reverse) / ln(2e15 + 1) AS fb, packet_length_mean / 65535 AS fp,
  avg((verdict <> 'benign')::INT::DOUBLE) OVER (PARTITION BY sensor_id ORDER BY {_SEQ} ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS ar FROM scored JOIN rate USING (event_id)),
u AS ({" UNION ALL ".join(f"SELECT sensor_id, event_id, seq, '{name}' AS signal, {value}::DOUBLE AS value, {drift.THRESHOLDS[name]}::DOUBLE AS most FROM v" for name, value in {"anomaly_score": "anomaly_score", "known_class_confidence": "confidence", "flow_rate": "flow_rate", "feature_duration": "fd", "feature_bytes_total": "fb", "feature_packet_length_mean": "fp", "alert_rate": "ar"}.items())}),
m AS (SELECT *, row_number() OVER w AS i, avg(value) OVER (w ROWS BETWEEN 31 PRECEDING AND 16 PRECEDING) AS a, avg(value) OVER (w ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS b FROM u WINDOW w AS (PARTITION BY sensor_id, signal ORDER BY seq)),
t AS (SELECT *, CASE WHEN i >= 32 AND abs(b - a) >= most THEN 1 WHEN i >= 32 AND abs(b - a) < most * 0.6 THEN 0 END AS turn FROM m),
x AS (SELECT *, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY sensor_id, signal ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT sensor_id AS model_version, signal, event_id AS detection_id, round(abs(b - a), 6) AS magnitude FROM x WHERE turn = 1 AND before = 0""")
def w4b(spark, d):
    return rounded(drift.runtime_drift(_detections(spark, d), window=16).select("model_version", "signal", "detection_id", "magnitude"), 6)


@query("w4_alert_rate", f"WITH {SCORED} SELECT event_id, round(avg((verdict <> 'benign')::INT) OVER (PARTITION BY sensor_id ORDER BY {_SEQ} ROWS BETWEEN 63 PRECEDING AND CURRENT ROW), 6) AS value FROM scored")
def w4a(spark, d):
    return rounded(drift.runtime_signals(_detections(spark, d)).where("signal = 'alert_rate'").select(F.col("detection_id").alias("event_id"), "value"), 6)


_ALERTS = SCORED + f""",
alert0 AS (SELECT *, {_STAGE} AS attack_stage FROM scored WHERE verdict <> 'benign'),
alert AS (SELECT *, 'alert-' || event_id AS alert_id, final_risk_score AS risk, n % 7 = 0 AS acknowledged FROM alert0)"""


def _alerts(spark, d):
    return incidents.alerts_of(scored(spark, d))


@query("m28_sessions", f"""WITH {_ALERTS}, g AS (SELECT sensor_id, alert_id, ts_us, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY sensor_id ORDER BY ts_us, alert_id) <= 600000000 THEN 0 ELSE 1 END AS fresh FROM alert),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY sensor_id ORDER BY ts_us, alert_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT sensor_id, session::BIGINT AS session, count(*) AS n, min(ts_us) AS low, max(ts_us) AS high FROM s GROUP BY sensor_id, session""")
def m28s(spark, d):
    return incidents.sessions(_alerts(spark, d), ("sensor_id",)).groupBy("sensor_id", "session").agg(F.count("*").alias("n"), F.min("ts_us").alias("low"), F.max("ts_us").alias("high"))


@query("m28_incident_fold")
def m28(spark, d):
    return incidents.assign_incidents(_alerts(spark, d), ("sensor_id",))


def _members(spark, d):
    return _alerts(spark, d).withColumn("incident_id", F.concat_ws("/", "sensor_id", F.floor(F.col("ts_us") / 86_400_000_000)))


@query("a8_incident_rollup", f"""WITH {_ALERTS}, m AS (SELECT *, sensor_id || '/' || (ts_us // 86400000000) AS incident_id, CASE severity WHEN 'informational' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS rank FROM alert),
l AS (SELECT *, lag(risk) OVER w AS r1, lag(risk, 2) OVER w AS r2, lag(rank) OVER w AS s1, lag(rank, 2) OVER w AS s2 FROM m WINDOW w AS (PARTITION BY incident_id ORDER BY ts_us, alert_id))
SELECT incident_id, array_to_string(list_sort(list(DISTINCT src_ip)), ',') AS source_hosts, array_to_string(list_sort(list(DISTINCT attack_stage)), ',') AS attack_stages, array_to_string(list_sort(list_distinct(flatten(list(reason_codes)))), ',') AS reason_codes,
  count(*) AS alert_count, count(*) FILTER (acknowledged) AS acknowledged_alerts, max(risk) AS max_risk, ['informational', 'low', 'medium', 'high', 'critical'][max(rank) + 1] AS severity,
  count(*) FILTER ((r2 < r1 AND r1 < risk) OR (s2 < s1 AND s1 < rank)) AS escalation_count, max(ts_us) AS updated_us FROM l GROUP BY incident_id""")
def a8(spark, d):
    r = incidents.incident_rollup(_members(spark, d))
    return r.select("incident_id", *[F.array_join(c, ",").alias(c) for c in ("source_hosts", "attack_stages", "reason_codes")], "alert_count", "acknowledged_alerts", "max_risk", "severity", "escalation_count", "updated_us")


@query("a9_explanation_context", f"""WITH {_ALERTS} SELECT sensor_id || '/' || (ts_us // 86400000000) AS incident_id, arg_max(verdict, (risk, ts_us, alert_id)) AS verdict, max(risk) AS final_risk_score, max(anomaly_score) AS anomaly_score, max(signature_score) AS signature_score,
  round(avg(duration_ms), 6) AS mean_duration_ms, sum(bytes_forward + bytes_reverse)::BIGINT AS total_bytes FROM alert GROUP BY 1""")
def a9(spark, d):
    return incidents.explanation_context(_members(spark, d)).withColumn("mean_duration_ms", F.round("mean_duration_ms", 6))


@query("x12_render_explanation", f"""WITH {SCORED}, r AS (SELECT *, upper(array_to_string(reason_codes, ' ')) AS r FROM scored)
SELECT event_id, 'Verdict: ' || replace(verdict, '_', ' ') || ' (risk ' || printf('%.1f', floor(final_risk_score * 10 + 0.5) / 10) || ' of 100).'
  || CASE WHEN len(reason_codes) > 0 THEN ' Evidence: ' || array_to_string(reason_codes, ', ') || '.' ELSE ' No evidence stands out.' END || CASE WHEN signature_severity IS NOT NULL THEN ' Signatures: ' || signature_severity || '.' ELSE '' END
  || ' Looks like ' || CASE WHEN r LIKE '%SCAN%' OR r LIKE '%PORT%' OR r LIKE '%FANOUT%' THEN 'scanning: one host tries many services' WHEN r LIKE '%BRUTE%' OR r LIKE '%AUTH%' OR r LIKE '%LOGIN%' THEN 'authentication: repeated tries to log in'
    WHEN r LIKE '%EXFIL%' OR r LIKE '%EGRESS%' OR r LIKE '%BYTES%' THEN 'egress: unusually much data leaves the network' WHEN verdict = 'known_attack' THEN 'a match of a signature or of a learnt family' ELSE 'unusual traffic of no known family' END
  || '. Next: check who owns the hosts and what they did before and after. Scores are statistics and may reflect harmless change; this text starts no action.' AS text FROM r""")
def x12(spark, d):
    s = scored(spark, d)
    names = F.array_compact(F.array("signature_severity"))
    return s.select("event_id", incidents.render_explanation(F.col("verdict"), F.col("final_risk_score"), incidents.sanitize_evidence(F.col("reason_codes")), names).alias("text"))


_HINT = "CASE WHEN r LIKE '%SCAN%' OR r LIKE '%PORT%' OR r LIKE '%FANOUT%' THEN 'scanning' WHEN r LIKE '%BRUTE%' OR r LIKE '%AUTH%' OR r LIKE '%LOGIN%' THEN 'authentication' WHEN r LIKE '%EXFIL%' OR r LIKE '%EGRESS%' OR r LIKE '%BYTES%' THEN 'egress' WHEN verdict = 'known_attack' THEN 'known' ELSE 'unusual' END"


@query("x12_behavior_hint", f"WITH {SCORED}, r AS (SELECT *, upper(array_to_string(reason_codes, ' ')) AS r FROM scored) SELECT {_HINT} AS hint, count(*) AS n FROM r GROUP BY 1")
def x12h(spark, d):
    hint = incidents.behavior_hint(F.col("reason_codes"), F.replace("verdict", F.lit("_"), F.lit(" ")))
    short = F.when(hint.contains("scanning"), "scanning").when(hint.contains("authentication"), "authentication").when(hint.contains("egress"), "egress").when(hint.contains("match"), "known").otherwise("unusual")
    return scored(spark, d).groupBy(short.alias("hint")).agg(F.count("*").alias("n"))


@query("m30_current_state", "SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS event_id FROM events GROUP BY user_id")
def m30(spark, d):
    e = read(spark, d, "events").withColumnRenamed("event_type", "status")
    return incidents.current_state(e, "user_id", "status", "event_id")


@query("m30_real_changes", "SELECT user_id, event_id, event_type AS status, p AS previous FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def m30c(spark, d):
    e = read(spark, d, "events").withColumnRenamed("event_type", "status")
    return incidents.real_changes(e, "user_id", "status", "event_id").select("user_id", "event_id", "status", "previous")


@query("u7_explode_members", "SELECT user_id AS incident_id, event_id // 3 AS alert_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id // 3 ORDER BY user_id, event_id) AS r FROM events) WHERE r = 1")
def u7(spark, d):
    e = read(spark, d, "events").groupBy(F.col("user_id").alias("incident_id")).agg(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: F.floor(x / 3)).alias("alert_ids"))
    return incidents.explode_members(e).select("incident_id", "alert_id")


# Joins --------------------------------------------------------------------------------------------

_SIG = """,
sig AS (SELECT 's' || n AS signature_event_id, n AS event_seq, CASE WHEN n % 3 = 0 THEN 'x' || n ELSE 'c' || (k % 500) END AS community_flow_id, CASE WHEN n % 2 = 0 THEN src_ip ELSE dst_ip END AS src_ip, CASE WHEN n % 2 = 0 THEN src_port ELSE dst_port END AS src_port,
  CASE WHEN n % 2 = 0 THEN dst_ip ELSE src_ip END AS dst_ip, CASE WHEN n % 2 = 0 THEN dst_port ELSE src_port END AS dst_port, protocol, ts_us + (n % 5 - 2) * 1500000 AS ts_us, coalesce(signature_severity, 'informational') AS signature_severity FROM flow),
fl AS (SELECT event_id, n AS flow_seq, 'c' || (n % 700) AS community_flow_id, src_ip, src_port, dst_ip, dst_port, protocol, ts_us AS start_us, end_us FROM flow)"""


def _signatures(spark, d):
    f = flows(spark, d)
    even = F.col("n") % 2 == 0
    pick = lambda a, b: F.when(even, F.col(a)).otherwise(F.col(b))
    return f.select(
        F.concat(F.lit("s"), "n").alias("signature_event_id"), F.col("n").alias("event_seq"), F.when(F.col("n") % 3 == 0, F.concat(F.lit("x"), "n")).otherwise(F.concat(F.lit("c"), F.col("k") % 500)).alias("community_flow_id"), pick("src_ip", "dst_ip").alias("src_ip"), pick("src_port", "dst_port").alias("src_port"),
        pick("dst_ip", "src_ip").alias("dst_ip"), pick("dst_port", "src_port").alias("dst_port"), "protocol", (F.col("ts_us") + (F.col("n") % 5 - 2) * 1_500_000).alias("ts_us"), F.coalesce("signature_severity", F.lit("informational")).alias("signature_severity"),
    )


def _flow_side(spark, d):
    return flows(spark, d).select("event_id", F.col("n").alias("flow_seq"), F.concat(F.lit("c"), F.col("n") % 700).alias("community_flow_id"), "src_ip", "src_port", "dst_ip", "dst_port", "protocol", F.col("ts_us").alias("start_us"), F.unix_micros("timestamp_end").alias("end_us"))


_J1 = "j1 AS (SELECT signature_event_id, arg_min(f.event_id, flow_seq) AS flow_event_id FROM sig s JOIN fl f USING (community_flow_id) GROUP BY signature_event_id)"
_J2 = """j2 AS (SELECT signature_event_id, arg_min(f.event_id, (abs(s.ts_us - f.start_us), f.flow_seq)) AS flow_event_id FROM {0} s JOIN fl f ON s.protocol = f.protocol AND least((s.src_ip, s.src_port), (s.dst_ip, s.dst_port)) = least((f.src_ip, f.src_port), (f.dst_ip, f.dst_port))
  AND greatest((s.src_ip, s.src_port), (s.dst_ip, s.dst_port)) = greatest((f.src_ip, f.src_port), (f.dst_ip, f.dst_port)) AND s.ts_us BETWEEN f.start_us - 3000000 AND f.end_us + 3000000
  WHERE s.src_port IS NOT NULL AND s.dst_port IS NOT NULL AND f.dst_port IS NOT NULL GROUP BY signature_event_id)"""


@query("j1_correlate_by_id", f"WITH {FLOW}{_SIG}, {_J1} SELECT * FROM j1")
def j1(spark, d):
    return correlate.correlate_by_id(_signatures(spark, d), _flow_side(spark, d))


@query("j2_correlate_by_endpoints", f"WITH {FLOW}{_SIG}, {_J2.format('sig')} SELECT * FROM j2")
def j2(spark, d):
    return correlate.correlate_by_endpoints(_signatures(spark, d), _flow_side(spark, d))


@query("j3_best_signature", f"""WITH {FLOW}{_SIG}, {_J1}, rest AS (SELECT * FROM sig WHERE signature_event_id NOT IN (SELECT signature_event_id FROM j1)), {_J2.format('rest')}, m AS (FROM j1 UNION ALL FROM j2)
SELECT flow_event_id, arg_max(signature_event_id, (CASE signature_severity WHEN 'informational' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END, -event_seq)) AS signature_event_id FROM m JOIN sig USING (signature_event_id) GROUP BY flow_event_id""")
def j3(spark, d):
    s = _signatures(spark, d)
    return correlate.best_signature(correlate.correlate(s, _flow_side(spark, d)), s).select("flow_event_id", "signature_event_id")


@query("j4_orient_flows", f"""WITH {FLOW} SELECT event_id, CASE WHEN n % 5 = 0 THEN dst_ip ELSE src_ip END AS src_ip, CASE WHEN n % 5 = 0 THEN packets_reverse ELSE packets_forward END AS packets_forward, n % 5 = 0 AS swapped, CASE WHEN n % 5 = 2 THEN 'direction_mismatch' END AS error_code FROM flow WHERE dst_port IS NOT NULL""")
def j4(spark, d):
    f = flows(spark, d).where("dst_port is not null")
    m = F.col("n") % 5
    records = f.where(m < 3).select("event_id", F.col("n").alias("event_seq"), F.when(m == 0, F.col("src_ip")).when(m == 1, F.col("dst_ip")).otherwise("192.0.2.1").alias("to_ip"), F.when(m == 0, F.col("src_port")).otherwise(F.col("dst_port")).alias("to_port"))
    return correlate.orient(f, records).select("event_id", "src_ip", "packets_forward", "swapped", "error_code")


@query("j12_train_test_overlap", f"WITH {FLOW}, t AS (SELECT *, n % 5 = 0 AS test FROM flow) SELECT count(*) AS rows, count(*) FILTER (EXISTS (SELECT 1 FROM t b WHERE NOT b.test AND b.packets_forward = a.packets_forward AND b.bytes_reverse = a.bytes_reverse AND b.protocol = a.protocol)) AS overlapping FROM t a WHERE test")
def j12(spark, d):
    from wiretide.operators.datasets import row_overlap

    f = flows(spark, d)
    return row_overlap(f.where("n % 5 <> 0"), f.where("n % 5 = 0"), ["packets_forward", "bytes_reverse", "protocol"]).select("rows", "overlapping")


# Aggregates and the read layer --------------------------------------------------------------------


@query("a1_host_summary", f"WITH {SCORED} SELECT src_ip AS host, count(*) AS flows, count(DISTINCT dst_ip) AS destinations, bool_or(verdict = 'known_attack' AND severity = 'critical') AS alerting FROM scored GROUP BY src_ip")
def a1(spark, d):
    s = scored(spark, d)
    return q.host_summary(s, s.where("verdict = 'known_attack' and severity = 'critical'"))


@query("a2_status_counts", f"WITH {_ALERTS} SELECT 'flows' AS \"table\", count(*) AS n FROM flow UNION ALL SELECT 'alerts', count(*) FROM alert UNION ALL SELECT 'sensors', count(DISTINCT sensor_id) FROM flow")
def a2(spark, d):
    f = flows(spark, d)
    return q.status_counts({"flows": f, "alerts": _alerts(spark, d), "sensors": f.select("sensor_id").distinct()})


@query("a4_severity_counts", f"WITH {_ALERTS} SELECT s AS severity, count(severity) AS n FROM (SELECT unnest(['low', 'medium', 'high', 'critical', 'none']) AS s) LEFT JOIN alert ON s = severity GROUP BY s")
def a4(spark, d):
    return q.counts_of(_alerts(spark, d), "severity", ("low", "medium", "high", "critical", "none"))


@query("a5_observed_flow_rate", f"WITH {FLOW} SELECT round(count(*) / greatest((max(ts_us) - min(ts_us)) / 1e6, 1), 9) AS rate FROM flow")
def a5(spark, d):
    return rounded(q.observed_flow_rate(flows(spark, d)))


@query("a6_risk_histogram", f"WITH {_ALERTS} SELECT b::BIGINT AS bin, count(risk) AS n FROM range(0, 100, 20) r(b) LEFT JOIN alert ON risk >= b AND risk < b + 20 GROUP BY b")
def a6(spark, d):
    return q.risk_histogram(_alerts(spark, d))


@query("a7_host_drilldown", f"""WITH {_ALERTS}, f AS (SELECT unnest([src_ip, dst_ip]) AS host, ts_us FROM flow), g AS (SELECT host, count(*) AS flows, max(ts_us) AS latest_us FROM f GROUP BY host),
a AS (SELECT unnest([src_ip, dst_ip]) AS host, risk FROM alert), b AS (SELECT host, count(*) AS alerts, max(risk) AS peak_risk FROM a GROUP BY host) SELECT host, flows, latest_us, coalesce(alerts, 0) AS alerts, coalesce(peak_risk, 0) AS peak_risk FROM g LEFT JOIN b USING (host)""")
def a7(spark, d):
    return q.host_drilldown(flows(spark, d), _alerts(spark, d))


_TP = "WITH {0}, r AS (SELECT label AS truth, CASE WHEN n % 6 = 0 THEN 'benign' WHEN n % 11 = 0 THEN 'dos' ELSE label END AS pred, known_p, confidence, n, ts_us, dst_port, protocol FROM flow)".format(FLOW)


def _predicted(spark, d):
    return flows(spark, d).withColumns({"truth": F.col("label"), "pred": F.when(F.col("n") % 6 == 0, "benign").when(F.col("n") % 11 == 0, "dos").otherwise(F.col("label"))})


_LABELS = ["benign", "dos", "port_scan", "brute_force", "botnet", "unseen"]


@query("a10_confusion_matrix", f"{_TP}, l AS (SELECT unnest({_LABELS}) AS l) SELECT a.l AS truth, b.l AS pred, count(r.n) AS n FROM l a CROSS JOIN l b LEFT JOIN r ON r.truth = a.l AND r.pred = b.l GROUP BY ALL")
def a10(spark, d):
    return metrics.confusion_matrix(_predicted(spark, d), _LABELS)


_REPORT = _TP + """, l AS (SELECT DISTINCT truth AS label FROM r UNION SELECT DISTINCT pred FROM r), c AS (SELECT label, count(*) FILTER (truth = label AND pred = label)::DOUBLE AS tp, count(*) FILTER (truth = label) AS support, count(*) FILTER (pred = label) AS predicted FROM l, r GROUP BY label),
p AS (SELECT label, support, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM c), rep AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM p)"""


@query("a11_classification_report", f"{_REPORT} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM rep")
def a11(spark, d):
    return rounded(metrics.classification_report(_predicted(spark, d)))


@query("a11_summary_scores", f"{_REPORT} SELECT round(sum(recall * support) / sum(support), 9) AS accuracy, round(avg(recall) FILTER (support > 0), 9) AS balanced_accuracy, round(avg(f1) FILTER (support > 0), 9) AS macro_f1_observed, round(sum(f1) FILTER (label IN {tuple(_LABELS)}) / {len(_LABELS)}, 9) AS macro_f1_fixed, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM rep")
def a11s(spark, d):
    return rounded(metrics.summary_scores(_predicted(spark, d), labels=_LABELS))


@query("a12_ece", f"{_TP}, b AS (SELECT ceil(round(confidence * 10, 9)) AS b, count(*) AS n, avg(confidence) AS c, avg((truth = pred)::INT) AS y FROM r GROUP BY 1) SELECT round(sum(CASE WHEN b > 0 THEN n * abs(c - y) ELSE 0 END) / sum(n), 9) AS ece FROM b")
def a12(spark, d):
    return rounded(metrics.expected_calibration_error(_predicted(spark, d).withColumn("ok", F.col("truth") == F.col("pred")), "confidence", "ok"))


@query("a13_brier", f"{_TP} SELECT round(avg(pow(known_p - (truth <> 'benign')::INT, 2)), 9) AS brier FROM r")
def a13(spark, d):
    return rounded(metrics.brier(_predicted(spark, d).withColumn("y", (F.col("truth") != "benign").cast("int")), "known_p", "y"))


@query("a14_ranking_scores", f"""{_TP}, s AS (SELECT known_p AS s, count(*) FILTER (truth <> 'benign') AS pos, count(*) FILTER (truth = 'benign') AS neg FROM r GROUP BY 1), t AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM s)
SELECT round(sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 9) AS roc_auc, round(sum(pos * tp::DOUBLE / (tp + fp)) / sum(pos), 9) AS pr_auc FROM t""")
def a14(spark, d):
    return rounded(metrics.ranking_scores(_predicted(spark, d).withColumn("y", F.col("truth") != "benign"), "known_p", "y"))


@query("a15_pr_curve_summary", f"{_TP} SELECT count(DISTINCT known_p) AS thresholds, min(known_p) AS least, max(known_p) AS largest FROM r")
def a15(spark, d):
    return metrics.pr_curve_summary(flows(spark, d), "known_p")


@query("a16_false_alert_rate", f"{_TP} SELECT round(count(*) FILTER (truth = 'benign' AND pred <> 'benign') / ((max(ts_us) - min(ts_us)) / 3.6e9), 9) AS per_hour, round(count(*) FILTER (truth = 'benign' AND pred <> 'benign') * 10000.0::DOUBLE / count(*) FILTER (truth = 'benign'), 9) AS per_10k_benign FROM r")
def a16(spark, d):
    return rounded(metrics.false_alert_rate(_predicted(spark, d), "truth", "pred", "ts_us"))


@query("a17_known_unknown", f"""WITH {SCORED} SELECT count(*) FILTER (label = 'botnet') AS unknown, count(*) FILTER (label <> 'botnet') AS known, count(*) FILTER (verdict = 'needs_review') AS needs_review, round(count(*) FILTER (label = 'benign' AND verdict <> 'benign')::DOUBLE / count(*) FILTER (label = 'benign'), 9) AS benign_fpr,
  round(count(*) FILTER (label = 'botnet' AND verdict IN ('known_attack', 'suspicious_unknown'))::DOUBLE / count(*) FILTER (label = 'botnet'), 9) AS unknown_detect, round(count(*) FILTER (label = 'botnet' AND verdict <> 'benign')::DOUBLE / count(*) FILTER (label = 'botnet'), 9) AS unknown_detect_or_review FROM scored""")
def a17(spark, d):
    return rounded(metrics.known_unknown(scored(spark, d), "label", "verdict", F.col("label") == "botnet"))


@query("a20_feature_drift", f"WITH {FLOW}, s AS (SELECT avg(duration_ms) FILTER (n % 2 = 0) AS m1, var_pop(duration_ms) FILTER (n % 2 = 0) AS v1, avg(duration_ms) FILTER (n % 2 = 1) AS m2, var_pop(duration_ms) FILTER (n % 2 = 1) AS v2 FROM flow) SELECT 'duration_ms' AS feature, round(abs(m2 - m1) / sqrt((v1 + v2) / 2), 6) AS shift, 0::BIGINT AS missing_reference, 0::BIGINT AS missing_comparison FROM s")
def a20(spark, d):
    f = flows(spark, d)
    return rounded(drift.feature_drift(f.where("n % 2 = 0"), f.where("n % 2 = 1"), ["duration_ms"]), 6)


@query("a21_latency_percentiles", f"WITH {FLOW}, p AS (SELECT quantile_cont(duration_ms, [0.5, 0.9, 0.95, 0.97, 0.99]) AS p FROM flow) SELECT round(p[1], 6) AS p50, round(p[2], 6) AS p90, round(p[3], 6) AS p95, round(p[4], 6) AS p97, round(p[5], 6) AS p99 FROM p")
def a21(spark, d):
    return rounded(metrics.latency_percentiles(flows(spark, d), "duration_ms"), 6)


@query("a22_higher_quantile", f"WITH {FLOW}, r AS (SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) AS i, count(*) OVER () AS n FROM flow) SELECT duration_ms AS value FROM r WHERE i = ceil((n - 1) * 0.97) + 1")
def a22(spark, d):
    return metrics.higher_quantile(flows(spark, d), "duration_ms", 0.97)


@query("a23_stage_profile", f"WITH {FLOW}, s AS (SELECT protocol, sum(iat_std) AS total_ms, sum(iat_std) / count(*) AS ms_per_flow FROM flow GROUP BY protocol) SELECT protocol, total_ms, round(ms_per_flow, 9) AS ms_per_flow, round(total_ms / sum(total_ms) OVER (), 9) AS share FROM s")
def a23(spark, d):
    return rounded(metrics.stage_profile(flows(spark, d).withColumn("one", F.lit(1)), "protocol", "iat_std", "one"))


@query("a24_empirical_cdf", f"""WITH {FLOW}, r AS (SELECT iso_s AS v, row_number() OVER (ORDER BY iso_s) - 1 AS i, count(*) OVER () AS n, cume_dist() OVER (ORDER BY iso_s) AS p FROM flow)
SELECT v AS value, max(round(p, 9)) AS probability FROM r WHERE i IN (SELECT round_even(j * (SELECT any_value(n) - 1 FROM r) / 32.0::DOUBLE, 0)::BIGINT FROM range(33) g(j)) GROUP BY v""")
def a24(spark, d):
    return rounded(metrics.empirical_cdf(flows(spark, d), "iso_s", 33))


@query("a25_empirical_percentile", f"""WITH {FLOW}, ref AS (SELECT iso_s, sum(c) OVER (ORDER BY iso_s) AS c FROM (SELECT iso_s, count(*) AS c FROM flow WHERE n % 2 = 0 GROUP BY iso_s))
SELECT event_id, round(coalesce(c, 0)::DOUBLE / (SELECT max(c) FROM ref), 9) AS percentile FROM flow f ASOF LEFT JOIN ref ON f.rec_s >= ref.iso_s""")
def a25(spark, d):
    f = flows(spark, d)
    return rounded(metrics.empirical_percentile(f.where("n % 2 = 0").select(F.col("iso_s").alias("x")), f.select("event_id", F.col("rec_s").alias("x")), "x", "event_id"))


@query("a26_error_buckets", f"""{_TP}, d AS (SELECT 'protocol' AS dimension, protocol AS category, truth, pred FROM r UNION ALL SELECT 'port', CASE WHEN dst_port IS NULL THEN 'missing' WHEN dst_port < 1024 THEN 'well_known' WHEN dst_port < 49152 THEN 'registered' ELSE 'dynamic' END, truth, pred FROM r)
SELECT dimension, category, count(*) AS n, round(count(*) FILTER (truth = 'benign' AND pred <> 'benign')::DOUBLE / nullif(count(*) FILTER (truth = 'benign'), 0), 9) AS false_positive_rate, round(count(*) FILTER (truth <> 'benign' AND pred = 'benign')::DOUBLE / nullif(count(*) FILTER (truth <> 'benign'), 0), 9) AS miss_rate FROM d GROUP BY ALL HAVING count(*) >= 5""")
def a26(spark, d):
    return rounded(metrics.error_buckets(_predicted(spark, d), {"protocol": F.col("protocol"), "port": features.port_range(F.col("dst_port"))}, "truth", "pred"))


@query("a27_run_summary", f"WITH {FLOW} SELECT protocol, round(avg(iat_std), 9) AS iat_std_mean, min(iat_std) AS iat_std_min, max(iat_std) AS iat_std_max FROM flow GROUP BY protocol")
def a27(spark, d):
    return rounded(metrics.run_summary(flows(spark, d), "protocol", ["iat_std"]))


@query("a28_queue_growth", "WITH h AS (SELECT epoch(date_trunc('hour', ts)) AS t, count(*) AS c FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY t) AS i, count(*) OVER () AS n FROM h) SELECT round(regr_slope(c, t), 12) AS slope FROM r WHERE i > n // 2")
def a28(spark, d):
    h = read(spark, d, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("double").alias("t")).agg(F.count("*").alias("c"))
    return rounded(metrics.queue_growth(h, "t", "c"), 12)


@query("a31_runtime_metrics", f"WITH {SCORED} SELECT 'verdict' AS metric, verdict AS label, count(*) AS n FROM scored GROUP BY ALL UNION ALL SELECT 'severity', severity, count(*) FROM scored GROUP BY ALL UNION ALL SELECT 'reason', r, count(*) FROM (SELECT unnest(reason_codes) AS r FROM scored) GROUP BY ALL")
def a31(spark, d):
    return q.runtime_metrics(scored(spark, d))


@query("a31_throughput", f"WITH {FLOW} SELECT ts_us // 60000000 * 60000000 AS start_us, count(*) AS n FROM flow GROUP BY 1")
def a31t(spark, d):
    return q.throughput(flows(spark, d))


@query("w6_escalation_count", f"""WITH {_ALERTS}, l AS (SELECT src_ip, risk, lag(risk) OVER w AS a, lag(risk, 2) OVER w AS b FROM alert WINDOW w AS (PARTITION BY src_ip ORDER BY ts_us, alert_id)) SELECT src_ip, count(*) FILTER (b < a AND a < risk) AS rising FROM l GROUP BY src_ip""")
def w6(spark, d):
    members = _alerts(spark, d).withColumns({"incident_id": F.col("src_ip"), "severity": F.lit("low")})
    return incidents.incident_rollup(members).select(F.col("incident_id").alias("src_ip"), F.col("escalation_count").alias("rising"))


@query("q1_alerts_page", f"WITH {_ALERTS} SELECT alert_id, event_id, risk, severity FROM alert WHERE verdict = 'known_attack' ORDER BY ts_us DESC, alert_id LIMIT 50 OFFSET 10")
def q1(spark, d):
    page, _ = q.alerts_page(_alerts(spark, d), 50, 10, verdict="known_attack")
    return page.select("alert_id", "event_id", "risk", "severity")


@query("q1_alert_count", f"WITH {_ALERTS} SELECT count(*) AS total FROM alert WHERE protocol = 'UDP'")
def q1c(spark, d):
    return q.alerts_page(_alerts(spark, d), protocol="udp")[1]


@query("q2_flows_page", f"WITH {FLOW} SELECT event_id, src_ip, dst_ip FROM flow WHERE src_ip = '10.20.0.7' OR dst_ip = '10.20.0.7' ORDER BY ts_us DESC, event_id LIMIT 30")
def q2(spark, d):
    return q.flows_page(flows(spark, d), 30, host="10.20.0.7")[0].select("event_id", "src_ip", "dst_ip")


@query("q3_flow_detail", f"""WITH {SCORED}, s AS (SELECT 'c' || (k % 500) AS c, count(*) AS n FROM flow WHERE signature_severity IS NOT NULL GROUP BY 1) SELECT event_id, verdict, CASE WHEN verdict <> 'benign' THEN 'alert-' || event_id END AS alert_id, coalesce(s.n, 0) AS signatures FROM scored LEFT JOIN s ON s.c = 'c' || (k % 500)""")
def q3(spark, d):
    s = scored(spark, d)
    own = s.select("event_id", F.concat(F.lit("c"), F.col("k") % 500).alias("community_flow_id"))
    det = s.select(F.concat(F.lit("d"), "event_id").alias("detection_id"), F.col("event_id").alias("flow_event_id"), "verdict")
    alerts = det.where("verdict <> 'benign'").select("detection_id", F.concat(F.lit("alert-"), "flow_event_id").alias("alert_id"))
    sig = s.where("signature_severity is not null").select(F.concat(F.lit("c"), F.col("k") % 500).alias("community_flow_id"), F.col("event_id").alias("signature_id"), F.lit("n").alias("signature_name"), "signature_severity")
    return q.flow_detail(own, det, alerts, sig).select("event_id", "verdict", "alert_id", F.size("signatures").cast("long").alias("signatures"))


@query("w9_top_hosts", f"WITH {FLOW} SELECT dst_ip, count(*) AS n FROM flow GROUP BY dst_ip ORDER BY n DESC, dst_ip LIMIT 5")
def w9(spark, d):
    return q.top_values(flows(spark, d), "dst_ip")


@query("w10_recent_timeline", f"WITH {_ALERTS} SELECT alert_id, ts_us FROM alert ORDER BY ts_us DESC, alert_id LIMIT 24")
def w10(spark, d):
    return q.recent_ascending(_alerts(spark, d), "ts_us", "alert_id").select("alert_id", "ts_us")


@query("w12_ledger", "SELECT event_id, user_id FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id LIMIT 200")
def w12(spark, d):
    return q.ledger(read(spark, d, "events"), "ts", "event_id", event_type="view").select("event_id", "user_id")


@query("m31_retraining_candidates", f"WITH {_ALERTS} SELECT 'f' || n AS feedback_id, alert_id, verdict AS original_verdict, round(packet_rate, 9) AS packet_rate, dst_port::DOUBLE AS destination_port FROM alert WHERE n % 10 = 0 AND n % 20 = 0")
def m31(spark, d):
    a = _alerts(spark, d)
    feedback = a.where("n % 10 = 0").select(F.concat(F.lit("f"), "n").alias("feedback_id"), "alert_id", F.col("verdict").alias("original_verdict"), (F.col("n") % 20 == 0).alias("eligible_for_retraining"), F.when(F.col("n") % 20 == 0, "benign_new_behaviour").otherwise("false_positive").alias("disposition"))
    alerts = a.select("alert_id", F.col("event_id").alias("detection_id"))
    det = a.select(F.col("event_id").alias("detection_id"), F.col("event_id").alias("flow_event_id"))
    return rounded(q.retraining_candidates(feedback, alerts, det, flows(spark, d)).select("feedback_id", "alert_id", "original_verdict", "packet_rate", "destination_port"))


@query("t7_rising_edges", "WITH h AS (SELECT epoch_us(date_trunc('hour', ts)) AS t, count(*) AS c FROM events GROUP BY 1), f AS (SELECT *, c / 10.0 >= 0.8 AS f FROM h), e AS (SELECT *, f AND NOT coalesce(lag(f) OVER (ORDER BY t), false) AS e FROM f) SELECT count(*) FILTER (f) AS full_hours, count(*) FILTER (e) AS edges FROM e")
def t7(spark, d):
    h = read(spark, d, "events").groupBy(F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("t")).agg(F.count("*").alias("c"))
    return q.rising_edges(h, F.col("c"), F.lit(10), 0.8, "t").agg(F.count_if("full").alias("full_hours"), F.count_if("edge").alias("edges"))


@query("u4_ordered_distinct", f"WITH {SCORED} SELECT event_id, array_to_string(list_concat(reason_codes, list_filter(['MODEL_DISAGREEMENT', 'NEW'], lambda v: NOT list_contains(reason_codes, v))), ',') AS reasons FROM scored")
def u4(spark, d):
    return scored(spark, d).select("event_id", F.array_join(incidents.ordered_union(F.col("reason_codes"), F.array(F.lit("MODEL_DISAGREEMENT"), F.lit("NEW"))), ",").alias("reasons"))


