"""Sinks: CSV exports, dead letters, outcomes of an ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wiretide.functions.scalars import anonymize_ip, csv_safe

# What a flow export may hold.
FLOW_FIELDS = (
    "event_id", "timestamp_start", "timestamp_end", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "application_protocol", "direction", "duration_ms", "packets_forward", "packets_reverse", "bytes_forward", "bytes_reverse", "packet_rate", "byte_rate",
    "packet_length_mean", "packet_length_std", "iat_mean", "iat_std", "tcp_syn_count", "tcp_ack_count", "tcp_fin_count", "tcp_rst_count", "source_adapter", "feature_extractor_version",
)
ENVELOPE = ("flow", "signature", "detection")
MAX_BYTES = 1 << 20


def export_rows(df: DataFrame, fields: tuple[str, ...] = FLOW_FIELDS, salt: bytes | None = None) -> DataFrame:
    """The allowed columns that df has, as safe cells; with a salt, addresses as keyed digests."""
    kinds = dict(df.dtypes)
    address = lambda c: anonymize_ip(F.col(c), salt) if salt is not None and c in ("src_ip", "dst_ip") else F.col(c)
    return df.select(*[csv_safe(address(c), kinds[c]).alias(c) for c in fields if c in kinds])


# What an alert export holds.
ALERT_FIELDS = ("alert_id", "timestamp_start", "src_ip", "dst_ip", "protocol", "severity", "verdict", "risk", "reason_codes", "acknowledged")


def export_alerts(view: DataFrame, salt: bytes | None = None) -> DataFrame:
    """Alerts joined with their detection and flow (queries.alerts_view) as safe cells, the reasons as a JSON list."""
    return export_rows(view.withColumn("reason_codes", F.to_json("reason_codes")), ALERT_FIELDS, salt)


def export_candidates(feedback: DataFrame, alerts: DataFrame, detections: DataFrame, flows: DataFrame) -> DataFrame:
    """Retraining candidates as safe cells, a column a feature."""
    from wiretide.operators.queries import retraining_candidates

    rows = retraining_candidates(feedback, alerts, detections, flows)
    return export_rows(rows, tuple(rows.columns))


def upsert_sensors(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """(sensor_id, first_us, last_us, flows) of stored sensors and those of a batch of flows (sensor_id, ts_us): old batches change nothing that is later."""
    seen = batch.groupBy("sensor_id").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("flows"))
    return stored.select("sensor_id", "first_us", "last_us", "flows").unionByName(seen).groupBy("sensor_id").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("flows").alias("flows"))


def ingest_result(batch: DataFrame, stored: DataFrame, key: str = "detection_id", order: str = "arrival") -> DataFrame:
    """(detection_id, alert_id, is_new) for every detection of a batch, against the stored ones: first write wins, a repeat in the batch is no news."""
    fresh = first_writes(batch, stored, key, order).select(key, F.lit(True).alias("is_new"))
    once = batch.groupBy(key).agg(F.min_by("verdict", order).alias("verdict")).join(stored.select(key, F.col("verdict").alias("_stored")), key, "left")
    verdict = F.coalesce("_stored", "verdict")
    return once.join(fresh, key, "left").select(key, F.when(verdict != "benign", F.concat(F.lit("alert-"), key)).alias("alert_id"), F.coalesce("is_new", F.lit(False)).alias("is_new"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quoteAll", False).mode("errorifexists").csv(path)


def dead_letters(lines: DataFrame, source: str, error: Column, value: str = "value") -> DataFrame:
    """(source, error_code, event_sha256, expected_fields_present, unexpected_field_count): what is told of a reject; its content isn't."""
    keys = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
    return lines.where(error.isNotNull()).select(
        F.lit(source).alias("source"), error.alias("error_code"), F.sha2(F.encode(F.coalesce(F.col(value), F.lit("")), "UTF-8"), 256).alias("event_sha256"),
        F.array_sort(F.array_intersect(keys, F.array(*map(F.lit, ENVELOPE)))).alias("expected_fields_present"), F.size(F.array_except(keys, F.array(*map(F.lit, ENVELOPE)))).alias("unexpected_field_count"),
    )


def over_limit(value: Column, most: int = MAX_BYTES) -> Column:
    return F.octet_length(value) > most


def first_writes(batch: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of a batch whose key is stored nowhere, one a key, the first."""
    w = Window.partitionBy(key).orderBy(order)
    once = batch.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return once.join(stored.select(key).distinct(), key, "left_anti")
