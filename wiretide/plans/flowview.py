"""Flow-shaped input from the events table, for queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wiretide.operators import fusion

PORTS = (53, 443, 22, 25, 445, 5432, 50000)
PROTOCOLS = {"click": "TCP", "purchase": "TCP", "view": "UDP", "signup": "ICMP"}
ATTACKS = ("dos", "port_scan", "brute_force", "botnet")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow an event; arrival is the order in which flows come in, in which some are late."""
    e = read(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    port, protocol = F.lit(None).cast("int"), F.lit("GRE")
    for i, p in enumerate(PORTS):
        port = F.when(F.col("k") % 8 == i, p).otherwise(port)
    for event_type, name in PROTOCOLS.items():
        protocol = F.when(F.col("event_type") == event_type, name).otherwise(protocol)
    uid = F.col("user_id")
    one = e.withColumns({"k": k, "ts_us": F.unix_micros(F.col("ts").cast("timestamp"))})
    two = one.select(
        F.col("event_id").alias("n"), "k", F.col("event_id").cast("string").alias("event_id"), (F.col("event_id") + F.when(F.col("event_id") % 37 == 0, 400).otherwise(0)).alias("arrival"),
        F.concat(F.lit("sensor-"), uid % 4).alias("sensor_id"), "ts_us",
        F.concat(F.lit("10.20."), F.floor(uid / 256), F.lit("."), uid % 256).alias("src_ip"), F.concat(F.lit("198.51.100."), F.col("k") % 60 + 1).alias("dst_ip"),
        (40000 + F.col("k") % 20000).cast("int").alias("src_port"), port.alias("dst_port"), protocol.alias("protocol"), (F.col("value") * 20).alias("duration_ms"),
        (F.col("k") + 1).alias("packets_forward"), (F.col("k") % 7).alias("packets_reverse"), F.floor(F.col("value") * 100).cast("bigint").alias("bytes_forward"), (F.col("k") % 11 * 64).alias("bytes_reverse"),
        (F.col("k") % 5).alias("tcp_syn_count"), (F.col("k") % 4).alias("tcp_ack_count"), (F.col("k") % 3).alias("tcp_rst_count"),
        ((F.col("k") % 100) / F.lit(100.0)).alias("known_p"), ((F.col("event_id") % 97) / F.lit(96.0)).alias("iso_s"), (uid % 13 / F.lit(12.0)).alias("rec_s"),
        F.when(F.col("event_id") % 9 == 0, F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), (F.col("event_id") % 4 + 1).cast("int"))).alias("signature_severity"),
    )
    packets, size, seconds = F.col("packets_forward") + F.col("packets_reverse"), F.col("bytes_forward") + F.col("bytes_reverse"), F.greatest(F.col("duration_ms") / 1000, F.lit(1e-6))
    return two.withColumns({
        "packet_rate": packets / seconds, "byte_rate": size / seconds, "packet_length_mean": size / packets, "packet_length_std": (F.col("k") % 50).cast("double"),
        "iat_mean": F.col("duration_ms") / packets, "iat_std": (F.col("k") % 20).cast("double"),
        "timestamp_start": F.timestamp_micros("ts_us"), "timestamp_end": F.timestamp_micros(F.col("ts_us") + (F.col("duration_ms") * 1000).cast("bigint")),
        "confidence": F.greatest("known_p", 1 - F.col("known_p")), "label": F.when(F.col("k") % 3 == 0, F.element_at(F.array(*map(F.lit, ATTACKS)), (F.col("n") % 4 + 1).cast("int"))).otherwise("benign"),
    })


def _case(column: str, pairs: dict, otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {v}" for k, v in pairs.items()) + f" ELSE {otherwise} END"


FLOW = f"""
flow0 AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
flow1 AS (SELECT event_id AS n, k, CAST(event_id AS VARCHAR) AS event_id, event_id + CASE WHEN event_id % 37 = 0 THEN 400 ELSE 0 END AS arrival,
  'sensor-' || (user_id % 4) AS sensor_id, epoch_us(ts) AS ts_us, '10.20.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip, '198.51.100.' || (k % 60 + 1) AS dst_ip,
  CAST(40000 + k % 20000 AS INTEGER) AS src_port, CAST({_case("k % 8", dict(enumerate(PORTS)), "NULL")} AS INTEGER) AS dst_port,
  {_case("event_type", {f"'{k}'": f"'{v}'" for k, v in PROTOCOLS.items()}, "'GRE'")} AS protocol, value * 20 AS duration_ms,
  k + 1 AS packets_forward, k % 7 AS packets_reverse, CAST(floor(value * 100) AS BIGINT) AS bytes_forward, k % 11 * 64 AS bytes_reverse,
  k % 5 AS tcp_syn_count, k % 4 AS tcp_ack_count, k % 3 AS tcp_rst_count,
  (k % 100)::DOUBLE / 100 AS known_p, (event_id % 97)::DOUBLE / 96 AS iso_s, (user_id % 13)::DOUBLE / 12 AS rec_s,
  CASE WHEN event_id % 9 = 0 THEN ['low', 'medium', 'high', 'critical'][event_id % 4 + 1] END AS signature_severity FROM flow0),
flow AS (SELECT *, (packets_forward + packets_reverse) / greatest(duration_ms / 1000, 1e-6) AS packet_rate, (bytes_forward + bytes_reverse) / greatest(duration_ms / 1000, 1e-6) AS byte_rate,
  (bytes_forward + bytes_reverse)::DOUBLE / (packets_forward + packets_reverse) AS packet_length_mean, (k % 50)::DOUBLE AS packet_length_std,
  duration_ms / (packets_forward + packets_reverse) AS iat_mean, (k % 20)::DOUBLE AS iat_std, ts_us + CAST(trunc(duration_ms * 1000) AS BIGINT) AS end_us,
  greatest(known_p, 1 - known_p) AS confidence, CASE WHEN k % 3 = 0 THEN {list(ATTACKS)}[n % 4 + 1] ELSE 'benign' END AS label FROM flow1)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with fused risk: fixed classifier and anomaly scores stand in for the models."""
    from wiretide.operators.features import signature_score

    f = flows(spark, sf_dir).withColumns({"signature_score": signature_score(F.col("signature_severity")), "contextual_score": (F.col("k") % 25) / F.lit(25.0), "anomaly_score": F.greatest("iso_s", "rec_s")})
    return fusion.fuse_risk(f.withColumn("disagreement", F.abs(F.col("known_p") - F.col("anomaly_score"))), "known_p", "confidence", "iso_s", "rec_s", "signature_score", "contextual_score", "disagreement")


SCORED = FLOW + """,
score0 AS (SELECT *, CASE signature_severity WHEN 'low' THEN 0.45 WHEN 'medium' THEN 0.65 WHEN 'high' THEN 0.85 WHEN 'critical' THEN 1.0 ELSE 0.0 END::DOUBLE AS signature_score,
  (k % 25)::DOUBLE / 25 AS contextual_score, greatest(iso_s, rec_s) AS anomaly_score FROM flow),
score1 AS (SELECT *, abs(known_p - anomaly_score) AS disagreement FROM score0),
score2 AS (SELECT *, floor(least(100 * (0.43::DOUBLE * known_p + 0.27::DOUBLE * anomaly_score + 0.20::DOUBLE * signature_score + 0.10::DOUBLE * contextual_score) + 8 * disagreement, 100) * 100 + 0.5) / 100 AS final_risk_score,
  list_filter([CASE WHEN signature_score >= 0.5 THEN 'SURICATA_SIGNATURE_MATCH' END, CASE WHEN known_p >= 0.72 THEN 'HIGH_KNOWN_ATTACK_PROBABILITY' END,
    CASE WHEN iso_s >= 0.7 THEN 'ISOLATION_OUTLIER' END, CASE WHEN rec_s >= 0.7 THEN 'HIGH_RECONSTRUCTION_ERROR' END, CASE WHEN confidence < 0.58 THEN 'LOW_CLASSIFIER_CONFIDENCE' END,
    CASE WHEN contextual_score >= 0.65 THEN 'UNUSUAL_DESTINATION_FANOUT' END, CASE WHEN disagreement >= 0.5 THEN 'MODEL_DISAGREEMENT' END], lambda x: x IS NOT NULL) AS reason_codes FROM score1),
scored AS (SELECT *, CASE WHEN signature_score >= 0.5 OR (known_p >= 0.72 AND confidence >= 0.58) THEN 'known_attack' WHEN anomaly_score >= 0.7 AND known_p < 0.72 THEN 'suspicious_unknown'
    WHEN final_risk_score <= 30 AND anomaly_score < 0.7 THEN 'benign' ELSE 'needs_review' END AS verdict,
  CASE WHEN final_risk_score >= 90 THEN 'critical' WHEN final_risk_score >= 72 THEN 'high' WHEN final_risk_score >= 54 THEN 'medium' WHEN final_risk_score >= 30 THEN 'low' ELSE 'informational' END AS severity FROM score2)"""
