"""Queries over scalars, validation, features and fusion, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretide.functions import scalars as x
from wiretide.operators import features, fusion, validate
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


def _r(columns, digits: int = 9) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def rounded(df, digits: int = 9):
    """Doubles to so many digits, for comparison with another engine."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_HEX = "printf('%02x%02x%02x%02x', split_part({0}, '.', 1)::INT, split_part({0}, '.', 2)::INT, split_part({0}, '.', 3)::INT, split_part({0}, '.', 4)::INT)"
_NUM = "CASE protocol WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 WHEN 'ICMP' THEN 1 END"
_ENDS = f"{_HEX.format('src_ip')} || printf('%04x', src_port) AS a, {_HEX.format('dst_ip')} || printf('%04x', dst_port) AS b, {_NUM} AS num"


@query("x1_community_id", f"""WITH {FLOW}, e AS (SELECT event_id, {_ENDS} FROM flow)
SELECT event_id, CASE WHEN b IS NOT NULL AND num IS NOT NULL THEN '1:' || base64(unhex(sha1(unhex('0000' || least(a, b)[1:8] || greatest(a, b)[1:8] || printf('%02x00', num) || least(a, b)[9:12] || greatest(a, b)[9:12])))) END AS community_id,
  (b IS NOT NULL AND num IS NOT NULL) AS valid FROM e""")
def x1(spark, d):
    c = x.community_id(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("protocol"), ipv6=False)
    return flows(spark, d).select("event_id", c.alias("community_id")).withColumn("valid", x.is_community_id(F.col("community_id")))


@query("x3_canonical_flow_key", f"""WITH {FLOW}, e AS (SELECT event_id, {_ENDS} FROM flow) SELECT event_id, CASE WHEN b IS NOT NULL THEN least(a, b) END AS low, CASE WHEN b IS NOT NULL THEN greatest(a, b) END AS high, num AS protocol FROM e""")
def x3(spark, d):
    key = x.canonical_flow_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("protocol"), ipv6=False)
    return flows(spark, d).select("event_id", key.alias("key")).select("event_id", "key.*")


@query("x5_icmp_ports", """SELECT event_id, event_id % 20 AS kind, CASE event_id % 20 WHEN 0 THEN 8 WHEN 8 THEN 0 WHEN 9 THEN 10 WHEN 10 THEN 9 WHEN 13 THEN 14 WHEN 14 THEN 13 WHEN 15 THEN 16 WHEN 16 THEN 15 WHEN 17 THEN 18 WHEN 18 THEN 17 ELSE 3 END AS other,
  NOT (event_id % 20 IN (0, 8, 9, 10, 13, 14, 15, 16, 17, 18)) AS one_way FROM events""")
def x5(spark, d):
    kind = F.col("event_id") % 20
    return read(spark, d, "events").select("event_id", kind.alias("kind"), x.icmp_ports(F.lit(1), kind, F.lit(3)).alias("p")).select("event_id", "kind", F.col("p.dst_port").alias("other"), "p.one_way")


@query("x6_uuid5", """WITH h AS (SELECT event_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('flow:' || event_id)) AS h FROM events)
SELECT event_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%02x', ('0x' || h[17:18])::INT & 63 | 128) || h[19:20] || '-' || h[21:32] AS id FROM h""")
def x6(spark, d):
    return read(spark, d, "events").select("event_id", x.uuid5(F.concat(F.lit("flow:"), F.col("event_id").cast("string"))).alias("id"))


_KEY = b"export-salt".ljust(64, b"\0")
_PADS = ["".join(f"{b ^ p:02x}" for b in _KEY) for p in (0x36, 0x5C)]


@query("x7_anonymize_ip", f"WITH {FLOW} SELECT event_id, 'ip_' || sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(src_ip))))[1:16] AS src FROM flow")
def x7(spark, d):
    return flows(spark, d).select("event_id", x.anonymize_ip(F.col("src_ip"), b"export-salt").alias("src"))


def anonymized(column: str, salt: bytes) -> str:
    """SQL of anonymize_ip(): a keyed digest, HMAC written out."""
    inner, outer = ("".join(f"{b ^ p:02x}" for b in salt.ljust(64, b"\0")) for p in (0x36, 0x5C))
    return f"'ip_' || sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({column}))))[1:16]"


_WS = "[ \\t\\n\\x0B\\f\\r\\x{1C}-\\x{1F}\\x{85}\\x{A0}]+"


@query("x8_csv_safe", f"""WITH v AS (SELECT doc_id, trim(regexp_replace(CASE doc_id % 5 WHEN 0 THEN '=' || text WHEN 1 THEN '@' || text ELSE text END, '{_WS}', ' ', 'g'), ' ') AS v FROM documents)
SELECT doc_id, coalesce(CASE WHEN regexp_matches(v, '^[=+@-]') THEN '''' || v ELSE v END, '') AS cell FROM v""")
def x8(spark, d):
    t, m = F.col("text"), F.col("doc_id") % 5
    return read(spark, d, "documents").select("doc_id", x.csv_safe(F.when(m == 0, F.concat(F.lit("="), t)).when(m == 1, F.concat(F.lit("@"), t)).otherwise(t)).alias("cell"))


@query("x8_csv_safe_whole", f"""WITH v AS (SELECT doc_id, trim(regexp_replace(CASE doc_id % 5 WHEN 0 THEN '=' || text WHEN 1 THEN '@' || text ELSE text END, '{_WS}', ' ', 'g'), ' ') AS v FROM documents)
SELECT doc_id, sha256(coalesce(CASE WHEN regexp_matches(v, '^[=+@-]') THEN '''' || v ELSE v END, '')) AS digest FROM v""")
def x8_whole(spark, d):
    t, m = F.col("text"), F.col("doc_id") % 5
    cell = x.csv_safe(F.when(m == 0, F.concat(F.lit("="), t)).when(m == 1, F.concat(F.lit("@"), t)).otherwise(t))
    return read(spark, d, "documents").select("doc_id", F.sha2(cell.cast("binary"), 256).alias("digest"))


@query("x9_redact_log", f"""WITH a AS (SELECT doc_id, regexp_replace(' ' || text || ' client 10.1.2.3 password=hunter2', '[\\x00-\\x1f\\x7f]+', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '(?i)(authorization|api[_-]?key|password|secret|token)(\\s*[:=]\\s*)([^\\s,;]+)', '\\1\\2[redacted]', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '(^|[^\\w:\\d.])(\\d{{1,3}}\\.){{3}}\\d{{1,3}}([^\\w:]|$)', '\\1[ip-redacted]\\3', 'g') AS t FROM b)
SELECT doc_id, sha256(substr(trim(regexp_replace(t, '{_WS}', ' ', 'g'), ' '), 1, 1000000)) AS digest FROM c""")
def x9(spark, d):
    text = F.concat(F.lit(" "), F.col("text"), F.lit(" client 10.1.2.3 password=hunter2"))
    return read(spark, d, "documents").select("doc_id", F.sha2(x.redact_log(text, 1_000_000).cast("binary"), 256).alias("digest"))


_EV = f"upper(array_to_string(list_sort(reason_codes), ' ') || ' ' || coalesce(signature_severity, '') || ' ')"
_STAGE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains({_EV}, '{t}')" for t in terms) + f" THEN '{s}'" for s, terms in x.STAGE_TERMS.items()) + " WHEN verdict = 'known_attack' THEN 'known_threat_activity' WHEN verdict = 'suspicious_unknown' THEN 'unclassified_anomaly' ELSE 'needs_review' END"


@query("x14_attack_stage", f"WITH {SCORED} SELECT event_id, {_STAGE} AS stage FROM scored")
def x14(spark, d):
    return scored(spark, d).select("event_id", x.attack_stage(F.col("reason_codes"), F.col("signature_severity"), F.lit(""), F.col("verdict")).alias("stage"))


@query("x15_severity_rank", f"WITH {SCORED} SELECT severity, CASE severity WHEN 'informational' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS rank, count(*) AS n FROM scored GROUP BY ALL")
def x15(spark, d):
    return scored(spark, d).groupBy("severity", x.severity_rank(F.col("severity")).alias("rank")).agg(F.count("*").alias("n"))


_LABEL = "CASE WHEN regexp_replace(raw, '[^a-z0-9]', '', 'g') IN ('benign', 'normal', 'normaltraffic', '0', 'background') THEN 'benign' " + " ".join("WHEN " + " OR ".join(f"contains(raw, '{m}')" for m in marks) + f" THEN '{f}'" for f, marks in x.LABEL_FAMILIES.items()) + " ELSE coalesce(nullif(trim(regexp_replace(raw, '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unlabeled') END"
_MADE = "DDoS attack,Normal Traffic,FTP-Patator,Web Attack - XSS,PortScan,DoS Hulk, BENIGN ,Bot,Heartbleed,Odd Thing!,--,C&C-FileDownload".split(",")


@query("x17_normalize_label", f"WITH r AS (SELECT event_id, lower(trim({_MADE}[event_id % {len(_MADE)} + 1])) AS raw FROM events) SELECT event_id, {_LABEL} AS label FROM r")
def x17(spark, d):
    made = F.element_at(F.array(*map(F.lit, _MADE)), (F.col("event_id") % len(_MADE) + 1).cast("int"))
    return read(spark, d, "events").select("event_id", x.normalize_label(made).alias("label"))


@query("x20_parse_timestamp", "SELECT event_id, epoch_us(date_trunc('second', ts)) AS us FROM events")
def x20(spark, d):
    ts = F.col("ts").cast("timestamp")
    text = F.when(F.col("event_id") % 2 == 0, F.date_format(ts, "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    return read(spark, d, "events").select("event_id", F.unix_micros(x.parse_timestamp(text)).alias("us"))


@query("x21_iso_timestamp", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN epoch_us(date_trunc('second', ts)) ELSE epoch_us(date_trunc('second', ts)) - 7200000000 END AS us FROM events")
def x21(spark, d):
    base = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, base).when(F.col("event_id") % 3 == 1, F.concat(base, F.lit("Z"))).otherwise(F.concat(base, F.lit("+0200")))
    return read(spark, d, "events").select("event_id", F.unix_micros(x.iso_timestamp(text)).alias("us"))


@query("x25_index_digest", "SELECT sensor, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS digest FROM (SELECT event_id, user_id AS sensor FROM events) GROUP BY sensor")
def x25(spark, d):
    return read(spark, d, "events").groupBy(F.col("user_id").alias("sensor")).agg(x.index_digest(F.col("event_id")).alias("digest"))


@query("v1_validate_flow", f"""WITH {FLOW} SELECT coalesce(CASE WHEN dst_port IS NULL THEN 'dst_port' WHEN n % 101 = 0 THEN 'duration_ms' WHEN n % 103 = 0 THEN 'packets_forward' WHEN n % 107 = 0 THEN 'src_ip' END, 'ok') AS error_code, count(*) AS n FROM flow GROUP BY 1""")
def v1(spark, d):
    f = flows(spark, d)
    broken = f.withColumns({"duration_ms": F.when(F.col("n") % 101 == 0, float("nan")).otherwise(F.col("duration_ms")), "packets_forward": F.when(F.col("n") % 103 == 0, -1).otherwise(F.col("packets_forward")), "src_ip": F.when(F.col("n") % 107 == 0, "10.0.0.256").otherwise(F.col("src_ip"))})
    broken = broken.drop("packet_length_mean", "packet_rate", "iat_mean", "byte_rate", "timestamp_end").withColumn("timestamp_end", F.col("timestamp_start"))
    return validate.validate_flow(broken, ipv6=False).groupBy(F.coalesce("error_code", F.lit("ok")).alias("error_code")).agg(F.count("*").alias("n"))


@query("v3_validate_detection", f"WITH {SCORED} SELECT coalesce(CASE WHEN n % 50 = 1 THEN 'class_probabilities' END, 'ok') AS error_code, count(*) AS n FROM scored GROUP BY 1")
def v3(spark, d):
    p = F.create_map(F.lit("benign"), 1 - F.col("known_p"), F.lit("dos"), F.col("known_p") * F.when(F.col("n") % 50 == 1, 0.0).otherwise(1.0) + F.when(F.col("n") % 50 == 1, 2.0).otherwise(0.0))
    return validate.validate_detection(scored(spark, d).drop("error_code").withColumn("class_probabilities", p)).groupBy(F.coalesce("error_code", F.lit("ok")).alias("error_code")).agg(F.count("*").alias("n"))


@query("v5_registry_range", f"""WITH {FLOW} SELECT coalesce(CASE WHEN n % 41 = 0 THEN 'iat_std' WHEN dst_port IS NULL THEN 'destination_port' END, 'ok') AS error_code, count(*) AS n FROM flow GROUP BY 1""")
def v5(spark, d):
    f = features.registry_features(flows(spark, d).withColumn("iat_std", F.when(F.col("n") % 41 == 0, float("inf")).otherwise(F.col("iat_std"))))
    return validate.registry_range_check(f).groupBy(F.coalesce("error_code", F.lit("ok")).alias("error_code")).agg(F.count("*").alias("n"))


@query("v8_filters", f"WITH {SCORED} SELECT event_id, src_ip, dst_ip, severity FROM scored WHERE (src_ip = '198.51.100.7' OR dst_ip = '198.51.100.7') AND protocol = 'TCP' AND verdict = 'known_attack'")
def v8(spark, d):
    return validate.matching(scored(spark, d), host="198.51.100.7", protocol=" tcp", verdict="known_attack").select("event_id", "src_ip", "dst_ip", "severity")


@query("v9_text_search", f"WITH {SCORED} SELECT event_id FROM scored WHERE contains(lower(concat_ws(' ', src_ip, dst_ip, protocol, array_to_string(reason_codes, ' '), dst_port)), 'isolation')")
def v9(spark, d):
    return validate.text_search(scored(spark, d), "Isolation ", ["src_ip", "dst_ip", "protocol", "reason_codes", "dst_port"]).select("event_id")


_REG = [*features.REGISTRY[:13]]


@query("f1_registry_features", f"""WITH {FLOW} SELECT event_id, {", ".join(f"round({c}::DOUBLE, 9) AS {c}" for c in _REG)}, dst_port::DOUBLE AS destination_port, round(bytes_forward::DOUBLE / greatest(bytes_reverse, 1), 9) AS forward_reverse_byte_ratio,
  round(tcp_syn_count::DOUBLE / greatest(tcp_ack_count, 1), 9) AS syn_ack_ratio, (packets_forward + packets_reverse)::DOUBLE AS packets_total, (bytes_forward + bytes_reverse)::DOUBLE AS bytes_total FROM flow""")
def f1(spark, d):
    return rounded(features.registry_features(flows(spark, d), "event_id"))


_SEC, _PK, _BY = "greatest(duration_ms / 1000, 1e-6)", "(packets_forward + packets_reverse)::DOUBLE", "(bytes_forward + bytes_reverse)::DOUBLE"
_PG = "CASE protocol WHEN 'TCP' THEN 'tcp' WHEN 'UDP' THEN 'udp' WHEN 'ICMP' THEN 'icmp' ELSE 'other' END"
_SG = "CASE " + " ".join(f"WHEN dst_port IN {v} THEN '{k}'" for k, v in features.SERVICE_PORTS.items()) + " ELSE 'other' END"


@query("f2_portable_features", f"""WITH {FLOW} SELECT event_id, round(ln(1 + duration_ms), 9) AS duration_log1p_ms, round(ln(1 + {_PK}), 9) AS packets_total_log1p, round(packets_forward / greatest({_PK}, 1), 9) AS packets_forward_fraction,
  round(ln(1 + {_BY}), 9) AS bytes_total_log1p, round(bytes_forward / greatest({_BY}, 1), 9) AS bytes_forward_fraction, round(ln(1 + {_PK} / {_SEC}), 9) AS packet_rate_log1p_derived, round(ln(1 + {_BY} / {_SEC}), 9) AS byte_rate_log1p_derived,
  round(ln(1 + {_BY} / greatest({_PK}, 1)), 9) AS packet_length_mean_log1p_derived, round(ln(1 + bytes_forward::DOUBLE) - ln(1 + bytes_reverse::DOUBLE), 9) AS forward_reverse_byte_log_ratio,
  {", ".join(f"({_PG} = '{p}')::INT::DOUBLE AS protocol_{p}" for p in ("tcp", "udp", "icmp", "other"))}, (dst_port IS NULL)::INT::DOUBLE AS destination_port_missing,
  coalesce(dst_port < 1024, false)::INT::DOUBLE AS port_well_known, coalesce(dst_port >= 1024 AND dst_port < 49152, false)::INT::DOUBLE AS port_registered, coalesce(dst_port >= 49152, false)::INT::DOUBLE AS port_dynamic,
  {", ".join(f"({_SG} = '{s}')::INT::DOUBLE AS service_{s}" for s in (*features.SERVICE_PORTS, "other"))} FROM flow""")
def f2(spark, d):
    return rounded(features.portable_features(flows(spark, d), "event_id"))


@query("f9_robust_preprocess", f"""WITH {FLOW}, q AS (SELECT quantile_cont(duration_ms, [0.005, 0.25, 0.5, 0.75, 0.995]) AS a, quantile_cont(byte_rate, [0.005, 0.25, 0.5, 0.75, 0.995]) AS b FROM flow)
SELECT event_id, round((least(greatest(duration_ms, a[1]), a[5]) - a[3]) / (a[4] - a[2]), 6) AS duration_ms, round((least(greatest(byte_rate, b[1]), b[5]) - b[3]) / (b[4] - b[2]), 6) AS byte_rate FROM flow, q""")
def f9(spark, d):
    f = flows(spark, d).select("event_id", "duration_ms", "byte_rate")
    return rounded(features.robust_transform(f, features.robust_fit(f, ["duration_ms", "byte_rate"])), 6)


@query("f10_standard_scale", f"WITH {FLOW}, q AS (SELECT avg(duration_ms) AS m, stddev_pop(duration_ms) AS s FROM flow) SELECT event_id, round((duration_ms - m) / s, 6) AS duration_ms FROM flow, q")
def f10(spark, d):
    f = flows(spark, d).select("event_id", "duration_ms")
    return rounded(features.standard_transform(f, features.standard_fit(f, ["duration_ms"])), 6)


@query("m5_anomaly_percentile", f"""WITH {SCORED} SELECT event_id, round(CASE WHEN anomaly_score < 0.1 THEN 0 WHEN anomaly_score >= 0.7 THEN 1 WHEN anomaly_score < 0.3 THEN 0.5 + (anomaly_score - 0.1) / 0.2 * 0.25 ELSE 0.75 + (anomaly_score - 0.3) / 0.4 * 0.25 END, 9) AS p FROM scored""")
def m5(spark, d):
    return rounded(scored(spark, d).select("event_id", fusion.knot_percentile(F.col("anomaly_score"), [0.1, 0.3, 0.7], [0.5, 0.75, 1.0]).alias("p")))


@query("m6_open_set_score", f"""WITH {SCORED}, p AS (SELECT event_id, anomaly_score, list_reverse_sort([1 - known_p, known_p * 0.75, known_p * 0.25]) AS p FROM scored)
SELECT event_id, round(anomaly_score * least(greatest(1 - p[1], 1 - (p[1] - p[2]), -list_sum(list_transform(p, lambda v: v * ln(greatest(v, 1e-12)))) / ln(3), 0), 1), 9) AS s FROM p""")
def m6(spark, d):
    p = F.array(1 - F.col("known_p"), F.col("known_p") * 0.75, F.col("known_p") * 0.25)
    return rounded(scored(spark, d).select("event_id", fusion.open_set_score(F.col("anomaly_score"), p).alias("s")))


@query("m7_fuse_risk", f"WITH {SCORED} SELECT event_id, final_risk_score, verdict, severity, array_to_string(reason_codes, ',') AS reasons FROM scored")
def m7(spark, d):
    return scored(spark, d).select("event_id", "final_risk_score", "verdict", "severity", F.array_join("reason_codes", ",").alias("reasons"))


@query("m2_m3_normalize_scores", f"WITH {FLOW} SELECT event_id, round(least(greatest((0.1 - iso_s) / 0.25 * 0.7, 0), 1), 9) AS iso, round(least(greatest((rec_s - 0.2) / 0.5 * 0.7, 0), 1), 9) AS rec, round(1 / (1 + exp((iso_s - 0.1) / 0.2)), 9) AS logistic FROM flow")
def m2(spark, d):
    iso, rec = F.col("iso_s"), F.col("rec_s")
    return rounded(flows(spark, d).select("event_id", fusion.normalize_isolation(iso, 0.1, -0.15).alias("iso"), fusion.normalize_reconstruction(rec, 0.2, 0.7).alias("rec"), fusion.logistic_isolation(iso, 0.1, 0.2).alias("logistic")))


@query("m1_class_decision", f"WITH {FLOW}, p AS (SELECT event_id, known_p, [known_p * (n % 3) / 3, known_p * (3 - n % 3) / 3] AS a FROM flow) SELECT event_id, round(known_p, 9) AS known_p, round(greatest(1 - known_p, a[1], a[2]), 9) AS confidence, CASE WHEN a[1] >= a[2] THEN 'botnet' ELSE 'dos' END AS known_label FROM p")
def m1(spark, d):
    k, m = F.col("known_p"), F.col("n") % 3
    p = F.create_map(F.lit("benign"), 1 - k, F.lit("botnet"), k * m / 3, F.lit("dos"), k * (3 - m) / 3)
    return rounded(fusion.class_decision(flows(spark, d).drop("confidence").withColumn("class_probabilities", p)).select("event_id", "known_p", "confidence", "known_label"))


@query("m8_build_detection", f"""WITH {SCORED}, h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('wiretide-detection:' || event_id || ':1.0.0')) AS h FROM scored)
SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%02x', ('0x' || h[17:18])::INT & 63 | 128) || h[19:20] || '-' || h[21:32] AS detection_id, event_id AS flow_event_id, end_us AS us,
  CASE WHEN known_p >= 0.72 THEN label END AS known_attack_label, final_risk_score, verdict FROM h""")
def m8(spark, d):
    det = fusion.build_detection(scored(spark, d).withColumn("known_label", F.col("label")))
    return det.select("detection_id", "flow_event_id", F.unix_micros("timestamp").alias("us"), "known_attack_label", "final_risk_score", "verdict")
