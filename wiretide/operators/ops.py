"""Governance: retention, table snapshots, gates, sustainability, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# What a model's report must reach.
CRITERIA = {
    "observed_label_macro_f1": (">=", 0.60), "benign_false_positive_rate": ("<=", 0.01), "suspicious_unknown_detection_rate": (">=", 0.50), "unknown_detection_or_review_rate": (">=", 0.80),
    "expected_calibration_error": ("<=", 0.10), "false_alerts_per_replay_hour": ("<=", 10.0), "train_test_overlap_fraction": ("<=", 0.01),
}


def retention(tables: dict[str, DataFrame], cutoff: Column, audit_cutoff: Column | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The rows that stay of each table, and (table, removed). Old flows take their detections, alerts, memberships and feedback
    along; incidents without a member go; ledgers go by time. tables has flows (event_id, timestamp_end), detections
    (detection_id, flow_event_id), alerts (alert_id, detection_id), members (alert_id, incident_id), incidents (incident_id),
    feedback (alert_id), and any of signatures, drift_events, health_events, audit_events with timestamp."""
    t, kept = tables, {}
    kept["flows"] = t["flows"].where(F.coalesce(F.col("timestamp_end") >= cutoff, F.lit(True)))
    old = t["flows"].where(F.col("timestamp_end") < cutoff).select(F.col("event_id").alias("flow_event_id")).distinct()
    old_detections = t["detections"].join(old, "flow_event_id", "left_semi").select("detection_id").distinct()
    old_alerts = t["alerts"].join(old_detections, "detection_id", "left_semi").select("alert_id").distinct()
    kept["detections"] = t["detections"].join(old, "flow_event_id", "left_anti")
    kept["alerts"] = t["alerts"].join(old_detections, "detection_id", "left_anti")
    kept["feedback"], kept["members"] = (t[x].join(old_alerts, "alert_id", "left_anti") for x in ("feedback", "members"))
    kept["incidents"] = t["incidents"].join(kept["members"].select("incident_id").distinct(), "incident_id", "left_semi")
    for x in ("signatures", "drift_events", "health_events", "audit_events"):
        if x in t:
            limit = audit_cutoff if x == "audit_events" and audit_cutoff is not None else cutoff
            kept[x] = t[x].where(F.coalesce(F.col("timestamp") >= limit, F.lit(True)))
    count = lambda df, sign: df.agg((F.count("*") * sign).alias("n"))
    parts = [count(df, sign).select(F.lit(x).alias("table"), "n") for x in kept for df, sign in ((t[x], 1), (kept[x], -1))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return kept, every.groupBy("table").agg(F.sum("n").alias("removed"))


def snapshot(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(table, rows, digest) by primary key; the digest doesn't depend on order and needs no gathering."""
    out = None
    for name, (df, keys) in tables.items():
        one = df.agg(F.count("*").alias("rows"), F.concat_ws("-", F.coalesce(F.bit_xor(F.xxhash64(*keys)), F.lit(0)), F.coalesce(F.sum(F.xxhash64(F.lit(1), *keys).cast("decimal(20,0)")), F.lit(0))).alias("digest")).select(F.lit(name).alias("table"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def compare_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table, rows_before, rows_after, same) of tables in either."""
    a, b = (df.select("table", F.col("rows").alias(f"rows_{n}"), F.col("digest").alias(f"_{n}")) for df, n in ((before, "before"), (after, "after")))
    return a.join(b, "table", "full").select("table", "rows_before", "rows_after", (F.col("_before").eqNullSafe(F.col("_after")) & F.col("rows_before").eqNullSafe(F.col("rows_after"))).alias("same"))


def readiness_gate(metrics: DataFrame) -> DataFrame:
    """(criterion, value, operator, threshold, status) of a metric table (criterion, value); a null value isn't applicable. Never promotes."""
    rules = metrics.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("criterion"), F.lit(op).alias("operator"), F.lit(v).alias("threshold")) for k, (op, v) in CRITERIA.items()])))
    joined = rules.join(metrics, "criterion", "left")
    ok = F.when(F.col("operator") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return joined.select("criterion", "value", "operator", "threshold", F.when(F.col("value").isNull(), "not_applicable").when(ok, "pass").otherwise("fail").alias("status"))


def gate_status(criteria: DataFrame) -> DataFrame:
    """One row: pass if something applies and all of it passes."""
    on = F.col("status") != "not_applicable"
    return criteria.agg(F.when((F.count_if(on) > 0) & (F.count_if(F.col("status") == "fail") == 0), "pass").otherwise("fail").alias("status"), F.lit(False).alias("automatic_promotion_allowed"))


def candidate_assessment(reports: DataFrame, candidates: DataFrame, required: list[str]) -> DataFrame:
    """(candidate_id, covered, blockers). reports has candidate_id, filename, gate_status, covered_modes; candidates candidate_id,
    dataset_fingerprints and bundle_schema_version."""
    seen = reports.groupBy("candidate_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("covered_modes")))).alias("covered"), F.array_sort(F.collect_list(F.when(F.col("gate_status") != "pass", F.concat(F.lit("report_gate_failed:"), "filename")))).alias("_failed"))
    j = candidates.join(seen, "candidate_id", "left").withColumns({"covered": F.coalesce("covered", F.array().cast("array<string>")), "_failed": F.coalesce("_failed", F.array().cast("array<string>"))})
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.col("covered")))
    prints = F.col("dataset_fingerprints")
    return j.select("candidate_id", "covered", F.concat("_failed", F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("missing_evaluation_modes:"), F.array_join(missing, ","))),
        F.when(F.coalesce(F.size(prints), F.lit(0)) < 1, F.lit("bundle_missing_training_fingerprints")).when(F.exists(prints, lambda p: F.lower(p).startswith("synthetic")), F.lit("synthetic_training_bundle")),
        F.when(F.coalesce("bundle_schema_version", F.lit(0)) < 3, F.lit("bundle_schema_precedes_empirical_calibration")),
    ))).alias("blockers"))


def sustainability(run: DataFrame, latency_budget_ms: float, depth_budget: int, growth_tolerance: float, target_rate: float) -> DataFrame:
    """Six criteria and their conjunction for a row of totals: planned, published, persisted_flows, persisted_detections, samples,
    achieved_rate, p95_ms, final_depth, max_depth, growth."""
    c = F.col
    held = {
        "input_rate_maintained": c("achieved_rate") >= 0.98 * target_rate, "queue_depth_bounded": (c("max_depth") <= depth_budget) & (c("growth") <= growth_tolerance),
        "no_unexplained_loss": (c("published") == c("planned")) & (c("persisted_flows") == c("published")) & (c("persisted_detections") == c("published")), "latency_sample_complete": c("samples") == c("published"),
        "latency_within_budget": F.coalesce(c("p95_ms") <= latency_budget_ms, F.lit(False)), "returned_to_steady_state": c("final_depth") == 0,
    }
    flagged = run.withColumns(held)
    return flagged.withColumns({"sustainable": F.forall(F.array(*held), lambda x: x), "failures": F.array_compact(F.array(*[F.when(~c(k), F.lit(k)) for k in held]))})


def evidence_verify(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status): match, changed, missing or unlisted, by size and digest."""
    f, m = files.select("path", F.col("length").alias("_l"), F.col("sha256").alias("_s")), manifest.select("path", "length", "sha256")
    status = F.when(F.col("_s").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when((F.col("_s") == F.col("sha256")) & (F.col("_l") == F.col("length")), "match").otherwise("changed")
    return f.join(m, "path", "full").select("path", status.alias("status"))


def durable_latencies(flows: DataFrame, detections: DataFrame, seen: DataFrame) -> DataFrame:
    """(flow_event_id, latency_ms) of detections not yet seen, never negative."""
    j = detections.join(seen, "flow_event_id", "left_anti").join(flows.withColumnRenamed("event_id", "flow_event_id"), ["flow_event_id", "sensor_id"])
    return j.select("flow_event_id", F.greatest((F.col("observed_us") - F.col("ts_us")) / 1000, F.lit(0.0)).alias("latency_ms"))


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
