"""Queries over single contracts: exports, ingest results, incident detail, guards, and scalars over a table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretide.functions import scalars as x
from wiretide.operators import datasets, features, fusion, incidents, ops, queries as q, validate
from wiretide.plans.basics import anonymized, rounded
from wiretide.plans.flowview import FLOW, flows, read, scored
from wiretide.plans.relational import _ALERTS, _SIG, _alerts, _signatures
from wiretide.sources import sinks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# Scalars ------------------------------------------------------------------------------------------


@query("x2_is_community_id", """WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '1:' || base64(unhex(sha1(CAST(event_id AS VARCHAR)))) WHEN 1 THEN '2:' || base64(unhex(sha1(CAST(event_id AS VARCHAR)))) WHEN 2 THEN '1:' || base64(unhex(md5(CAST(event_id AS VARCHAR)))) WHEN 3 THEN '1:no' END AS v FROM events)
SELECT event_id, coalesce(regexp_matches(v, '^1:[A-Za-z0-9+/]{27}=$'), false) AS valid FROM v""")
def x2(spark, d):
    t, m = F.col("event_id").cast("string"), F.col("event_id") % 5
    digest = F.base64(F.unhex(F.sha1(t)))
    v = F.when(m == 0, F.concat(F.lit("1:"), digest)).when(m == 1, F.concat(F.lit("2:"), digest)).when(m == 2, F.concat(F.lit("1:"), F.base64(F.unhex(F.md5(t))))).when(m == 3, "1:no")
    return read(spark, d, "events").select("event_id", x.is_community_id(v).alias("valid"))


_NAMES = (" tcp", "Udp", "icmp", "47", "300", "-1", "no such", "ICMP")


@query("x4_protocol_number", f"WITH v AS (SELECT event_id, upper(trim({list(_NAMES)}[event_id % {len(_NAMES)} + 1])) AS v FROM events) SELECT event_id, CASE v WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 WHEN 'ICMP' THEN 1 ELSE CASE WHEN try_cast(v AS INTEGER) BETWEEN 0 AND 255 THEN try_cast(v AS INTEGER) END END AS number FROM v")
def x4(spark, d):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % len(_NAMES) + 1).cast("int"))
    return read(spark, d, "events").select("event_id", x.protocol_number(name).alias("number"))


@query("x10_clean_evidence", r"""WITH v AS (SELECT event_id, 'host 10.1.' || (user_id % 300) || '.7' || chr(7) || chr(10) || '  said ' || coalesce(props, '') || ' v1.2.3' AS v FROM events)
SELECT event_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(v, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '\b(?:\d{1,3}\.){3}\d{1,3}\b', '[redacted-address]', 'g'), '\s+', ' ', 'g')), 1, 60) AS text FROM v""")
def x10(spark, d):
    v = F.concat(F.lit("host 10.1."), F.col("user_id") % 300, F.lit(".7\a\n  said "), F.coalesce("props", F.lit("")), F.lit(" v1.2.3"))
    return read(spark, d, "events").select("event_id", x.clean_evidence(v, 60).alias("text"))


@query("x11_sanitize_evidence", f"WITH {_ALERTS} SELECT alert_id, array_to_string(list_concat(list_transform(reason_codes, lambda r: r || ' from [redacted-address]'), [repeat('x', 200)]), '|') AS reasons FROM alert")
def x11(spark, d):
    reasons = F.concat(F.transform("reason_codes", lambda r: F.concat(r, F.lit("\t from 10.9.8.7"))), F.array(F.repeat(F.lit("x"), F.lit(300))))
    return _alerts(spark, d).select("alert_id", F.array_join(incidents.sanitize_evidence(reasons), "|").alias("reasons"))


@query("x13_version_hash", f"""WITH {_ALERTS} SELECT alert_id, sha256(alert_id || chr(0) || (n % 5) || chr(0) || '{{"severity":"' || severity || '","alerts":' || n || '}}') AS hash FROM alert""")
def x13(spark, d):
    payload = F.struct("severity", F.col("n").alias("alerts"))
    return _alerts(spark, d).select("alert_id", incidents.version_hash(F.col("alert_id"), (F.col("n") % 5).cast("string"), payload).alias("hash"))


@query("f7_contextual_score", f"WITH {FLOW} SELECT event_id, CASE WHEN n % 9 = 0 THEN 0.0 ELSE round(least((k % 40)::DOUBLE / 25, 1), 9) END::DOUBLE AS score FROM flow")
def f7(spark, d):
    ports = F.when(F.col("n") % 9 == 0, "many").otherwise((F.col("k") % 40).cast("string"))
    return rounded(flows(spark, d).select("event_id", features.contextual_score(F.create_map(F.lit("distinct_destination_ports"), ports)).alias("score")))


@query("m4_anomaly_score", f"WITH {FLOW} SELECT event_id, round(greatest(least(greatest(iso_s * 1.3, 0), 1), least(greatest(rec_s * 1.3, 0), 1)), 9) AS score FROM flow")
def m4(spark, d):
    return rounded(flows(spark, d).select("event_id", fusion.anomaly_score(F.col("iso_s"), F.col("rec_s"), 1.3).alias("score")))


# Validation ---------------------------------------------------------------------------------------


@query("v2_validate_signature", f"""WITH {FLOW} SELECT event_id, CASE WHEN n % 11 = 0 THEN 'raw_event_hash' WHEN signature_severity IS NULL THEN 'severity' WHEN n % 13 = 0 THEN 'source' WHEN n % 17 = 0 THEN 'signature_id' END AS error_code FROM flow""")
def v2(spark, d):
    n, f = F.col("n"), flows(spark, d)
    made = f.select("event_id", F.when(n % 11 == 0, "ABC").otherwise(F.sha2("event_id", 256)).alias("raw_event_hash"), F.col("signature_severity").alias("severity"), F.when(n % 13 == 0, "other").otherwise("suricata").alias("source"), F.when(n % 17 == 0, "").otherwise("2001").alias("signature_id"))
    return validate.validate_signature(made).select("event_id", "error_code")


@query("v6_validate_observation", f"""WITH {FLOW} SELECT event_id, CASE WHEN n % 11 = 0 THEN 'sensor_id' WHEN n % 13 = 0 THEN 'timestamp' WHEN n % 17 = 0 THEN 'ip_version' WHEN n % 19 = 0 THEN 'duration_ms' WHEN n % 23 = 0 THEN 'bytes_forward' WHEN n % 29 = 0 THEN 'dst_port' END AS error_code FROM flow""")
def v6(spark, d):
    n, f = F.col("n"), flows(spark, d)
    made = f.withColumns({
        "sensor_id": F.when(n % 11 == 0, "").otherwise(F.col("sensor_id")), "timestamp": F.when(n % 13 != 0, F.col("timestamp_start")), "dst_ip": F.when(n % 17 == 0, "1.2.3").otherwise(F.col("dst_ip")),
        "duration_ms": F.when(n % 19 == 0, float("nan")).otherwise(F.col("duration_ms")), "bytes_forward": F.when(n % 23 == 0, -1).otherwise(F.col("bytes_forward")), "dst_port": F.when(n % 29 == 0, 70_000).otherwise(F.col("dst_port")),
    })
    return validate.validate_observation(made, ipv6=False).select("event_id", "error_code")


# Sources, sinks, ingest ---------------------------------------------------------------------------


@query("s7_payload_limit", "SELECT doc_id, coalesce(strlen(text) > 2000, false) AS over FROM documents")
def s7(spark, d):
    return read(spark, d, "documents").select("doc_id", F.coalesce(sinks.over_limit(F.col("text"), 2000), F.lit(False)).alias("over"))


@query("s8_ingest_result", f"""WITH {_ALERTS} SELECT 'd' || (n // 2) AS detection_id, CASE WHEN coalesce(max(verdict) FILTER (n % 6 = 0), arg_min(verdict, n)) <> 'benign' THEN 'alert-d' || (n // 2) END AS alert_id, NOT bool_or(n % 6 = 0) AS is_new FROM scored GROUP BY n // 2""")
def s8(spark, d):
    """A batch in which each detection comes twice, against a store that has a third of them."""
    s = scored(spark, d).select(F.concat(F.lit("d"), F.floor(F.col("n") / 2)).alias("detection_id"), F.col("n").alias("arrival"), "verdict")
    return sinks.ingest_result(s, s.where("arrival % 6 = 0").select("detection_id", "verdict"))


@query("s8_upsert_sensors", f"WITH {FLOW} SELECT sensor_id, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*)::BIGINT AS flows FROM flow GROUP BY sensor_id")
def s8s(spark, d):
    f = flows(spark, d)
    stored = f.where("n % 2 = 0").groupBy("sensor_id").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("flows"))
    return sinks.upsert_sensors(stored, f.where("n % 2 <> 0"))


@query("s10_export_alerts", f"""WITH {_ALERTS} SELECT alert_id, {anonymized('src_ip', b'salt')} AS src_ip, {anonymized('dst_ip', b'salt')} AS dst_ip, protocol, severity, verdict, CAST(to_json(reason_codes) AS VARCHAR) AS reason_codes FROM alert""")
def s10(spark, d):
    a = _alerts(spark, d)
    view = q.alerts_view(a.select("alert_id", F.col("event_id").alias("detection_id"), "risk", "acknowledged"), a.select(F.col("event_id").alias("detection_id"), F.col("event_id").alias("flow_event_id"), "severity", "verdict", "reason_codes"), flows(spark, d).withColumnRenamed("event_id", "flow_event_id"))
    return sinks.export_alerts(view, b"salt").select("alert_id", "src_ip", "dst_ip", "protocol", "severity", "verdict", "reason_codes")


# Joins --------------------------------------------------------------------------------------------


@query("j5_alerts_view", f"WITH {_ALERTS} SELECT a.alert_id, 'd' || a.event_id AS detection_id, f.sensor_id, f.bytes_forward, a.severity FROM alert a JOIN flow f USING (event_id) WHERE f.n % 3 <> 1")
def j5(spark, d):
    a = _alerts(spark, d)
    detections = a.select(F.concat(F.lit("d"), "event_id").alias("detection_id"), F.col("event_id").alias("flow_event_id"), "severity")
    return q.alerts_view(a.select("alert_id", F.concat(F.lit("d"), "event_id").alias("detection_id")), detections, flows(spark, d).where("n % 3 <> 1").withColumnRenamed("event_id", "flow_event_id")).select("alert_id", "detection_id", "sensor_id", "bytes_forward", "severity")


_MEMBERS = f"""{_ALERTS}{_SIG}, member AS (SELECT sensor_id || '/' || (ts_us // 86400000000) AS incident_id, 'c' || (n % 700) AS community_flow_id, * FROM alert),
told AS (SELECT DISTINCT incident_id, signature_event_id, s.signature_severity, s.ts_us AS signature_us FROM member m JOIN sig s USING (community_flow_id))"""


def _incident_members(spark, d):
    return _alerts(spark, d).withColumns({"incident_id": F.concat_ws("/", "sensor_id", F.floor(F.col("ts_us") / 86_400_000_000)), "community_flow_id": F.concat(F.lit("c"), F.col("n") % 700)})


@query("j7_incident_signatures", f"WITH {_MEMBERS} SELECT incident_id, count(*) AS signatures, count(DISTINCT signature_severity) AS severities, min(signature_us) AS first_us, max(signature_us) AS last_us FROM told GROUP BY incident_id")
def j7(spark, d):
    told = incidents.incident_signatures(_incident_members(spark, d), _signatures(spark, d))
    return told.groupBy("incident_id").agg(F.count("*").alias("signatures"), F.count_distinct("signature_severity").alias("severities"), F.min("signature_us").alias("first_us"), F.max("signature_us").alias("last_us"))


_FIRST = "(SELECT min(incident_id) FROM member)"


@query("q4_incident_timeline", f"""WITH {_MEMBERS}, one AS (SELECT incident_id, ts_us, 'alert' AS kind, alert_id AS ref, severity || ' ' || verdict AS text FROM member UNION ALL SELECT incident_id, signature_us, 'signature', signature_event_id, signature_severity FROM told
  UNION ALL SELECT incident_id, ts_us + 1, 'note', CAST(n AS VARCHAR), 'note of ' || alert_id FROM member WHERE n % 10 = 0)
SELECT ts_us, kind, ref, text FROM one WHERE incident_id = {_FIRST}""")
def q4(spark, d):
    members = _incident_members(spark, d)
    notes = members.where("n % 10 = 0").select("incident_id", F.col("n").alias("note_id"), (F.col("ts_us") + 1).alias("ts_us"), F.concat(F.lit("note of "), "alert_id").alias("text"))
    first = members.agg(F.min("incident_id").alias("i")).first()["i"] or ""
    return incidents.incident_detail(members, _signatures(spark, d), notes, first)[1].select("ts_us", "kind", "ref", "text")


@query("q4_incident_detail", f"""WITH {_MEMBERS} SELECT incident_id, count(*) AS alert_count, max(risk) AS max_risk, (SELECT count(*) FROM told t WHERE t.incident_id = m.incident_id) AS signatures, count(*) FILTER (n % 10 = 0) AS notes FROM member m WHERE incident_id = {_FIRST} GROUP BY incident_id""")
def q4d(spark, d):
    members = _incident_members(spark, d)
    notes = members.where("n % 10 = 0").select("incident_id", F.col("n").alias("note_id"), "ts_us", F.lit("").alias("text"))
    first = members.agg(F.min("incident_id").alias("i")).first()["i"] or ""
    return incidents.incident_detail(members, _signatures(spark, d), notes, first)[0].select("incident_id", "alert_count", "max_risk", "signatures", "notes")


@query("j10_durable_latency", f"WITH {FLOW} SELECT event_id AS flow_event_id, greatest((ts_us + (n % 7 - 2) * 250000 - ts_us) / 1000.0::DOUBLE, 0) AS latency_ms FROM flow WHERE n % 4 <> 0")
def j10(spark, d):
    f = flows(spark, d)
    detections = f.select(F.col("event_id").alias("flow_event_id"), "sensor_id", (F.col("ts_us") + (F.col("n") % 7 - 2) * 250_000).alias("observed_us"))
    return ops.durable_latencies(f.select("event_id", "sensor_id", "ts_us"), detections, f.where("n % 4 = 0").select(F.col("event_id").alias("flow_event_id")))


@query("j11_frozen_sources", "SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS sha256 FROM events WHERE event_id % 12 = 0 OR event_id % 12 = 3")
def j11(spark, d):
    e = read(spark, d, "events").select("event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("sha256"))
    return datasets.frozen_sources(e, e.where("event_id % 12 in (0, 3)").unionByName(e.where("event_id % 12 = 0"))).select("event_id", "sha256")


@query("m34_candidate_view", """WITH c AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY event_id) AS decisions FROM events WHERE event_type <> 'view' GROUP BY user_id)
SELECT user_id AS candidate_id, coalesce(n, 0)::BIGINT AS reviews, coalesce(decisions, '') AS decisions FROM c LEFT JOIN r USING (user_id)""")
def m34(spark, d):
    e = read(spark, d, "events").withColumnRenamed("user_id", "candidate_id")
    reviews = e.where("event_type <> 'view'").select("candidate_id", F.col("event_id").alias("reviewed_us"), F.lit("r").alias("reviewer"), F.col("event_type").alias("decision"))
    view = q.candidate_view(e.select("candidate_id").distinct(), reviews)
    return view.select("candidate_id", F.size("reviews").cast("long").alias("reviews"), F.array_join(F.transform("reviews", lambda r: r["decision"]), ",").alias("decisions"))


@query("m35_evidence_verify", "SELECT CAST(event_id AS VARCHAR) AS path, CASE WHEN event_id % 7 = 0 THEN 'missing' WHEN event_id % 11 = 0 THEN 'unlisted' WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN 'changed' ELSE 'match' END AS status FROM events WHERE NOT (event_id % 7 = 0 AND event_id % 11 = 0)")
def m35(spark, d):
    n = F.col("event_id")
    e = read(spark, d, "events").select(n.cast("string").alias("path"), n, F.sha2(n.cast("string"), 256).alias("sha256"))
    files = e.where(n % 7 != 0).select("path", F.when(n % 5 == 0, 9).otherwise(8).alias("length"), F.when(n % 3 == 0, "0").otherwise(F.col("sha256")).alias("sha256"))
    return ops.evidence_verify(files, e.where(n % 11 != 0).select("path", F.lit(8).alias("length"), "sha256"))
