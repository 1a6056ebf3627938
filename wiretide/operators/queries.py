"""The read layer: alerts, flows, hosts, overview tiles, ledgers, retraining candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wiretide.operators.validate import matching


def alerts_view(alerts: DataFrame, detections: DataFrame, flows: DataFrame) -> DataFrame:
    """Alerts with their detection and flow: inner joins on ids."""
    return alerts.join(detections, "detection_id").join(flows, "flow_event_id")


def newest(df: DataFrame, order: str, key: str, limit: int = 100, offset: int = 0, most: int = 500) -> DataFrame:
    """A page, newest first; the key breaks ties."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"a page has 1..{most} rows from 0 on")
    return df.orderBy(F.desc(order), F.asc(key)).offset(offset).limit(limit)


def recent_ascending(df: DataFrame, order: str, key: str, n: int = 24) -> DataFrame:
    """The newest n rows, oldest first."""
    return newest(df, order, key, n).orderBy(order, key)


def alerts_page(view: DataFrame, limit: int = 100, offset: int = 0, **filters) -> tuple[DataFrame, DataFrame]:
    """A page of alerts and, as one row, the total that the filters match."""
    found = matching(view, **filters)
    return newest(found, "timestamp_start", "alert_id", limit, offset), found.agg(F.count("*").alias("total"))


def flows_page(flows: DataFrame, limit: int = 100, offset: int = 0, event_ids: list[str] | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    found = matching(flows, **filters)
    if event_ids is not None:
        found = found.where(F.col("event_id").isin(event_ids))
    return newest(found, "timestamp_start", "event_id", limit, offset), found.agg(F.count("*").alias("total"))


def flow_detail(flows: DataFrame, detections: DataFrame, alerts: DataFrame, signatures: DataFrame, event_id: str | None = None) -> DataFrame:
    """Flows with detection, alert and, in order of id, the signatures of their community id."""
    own = flows if event_id is None else flows.where(F.col("event_id") == event_id)
    listed = signatures.groupBy("community_flow_id").agg(F.array_sort(F.collect_list(F.struct("signature_id", "signature_name", "signature_severity"))).alias("signatures"))
    joined = own.join(detections.withColumnRenamed("flow_event_id", "event_id"), "event_id", "left").join(alerts, "detection_id", "left").join(listed, "community_flow_id", "left")
    return joined.withColumn("signatures", F.coalesce("signatures", F.array().cast(listed.schema["signatures"].dataType)))


def host_summary(flows: DataFrame, alerting: DataFrame, newest_alerts: int | None = None) -> DataFrame:
    """Flows, distinct destinations and whether a source has an alert (among the newest so many, or any)."""
    seen = alerting if newest_alerts is None else alerting.orderBy(F.desc("ts_us"), "alert_id").limit(newest_alerts)
    hosts = seen.select(F.col("src_ip").alias("host")).distinct().withColumn("alerting", F.lit(True))
    counts = flows.groupBy(F.col("src_ip").alias("host")).agg(F.count("*").alias("flows"), F.count_distinct("dst_ip").alias("destinations"))
    return counts.join(hosts, "host", "left").withColumn("alerting", F.coalesce("alerting", F.lit(False)))


def host_drilldown(flows: DataFrame, alerts: DataFrame) -> DataFrame:
    """For each host as either end: flows, alerts, the largest risk, and the last time."""
    ends = lambda df, *more: df.select(F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("host"), *more)
    f = ends(flows, "ts_us").groupBy("host").agg(F.count("*").alias("flows"), F.max("ts_us").alias("latest_us"))
    a = ends(alerts, "risk").groupBy("host").agg(F.count("*").alias("alerts"), F.max("risk").alias("peak_risk"))
    return f.join(a, "host", "left").withColumns({"alerts": F.coalesce("alerts", F.lit(0)), "peak_risk": F.coalesce("peak_risk", F.lit(0.0))})


def counts_of(df: DataFrame, column: str, values: tuple[str, ...] = ()) -> DataFrame:
    """Rows of each value; the named values appear with 0 too."""
    found = df.groupBy(column).agg(F.count("*").alias("n"))
    if not values:
        return found
    every = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(column))
    return every.join(found, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def observed_flow_rate(flows: DataFrame, ts_us: str = "ts_us") -> DataFrame:
    """Flows a second over the observed span, of a second at least; the count itself for fewer than two flows."""
    span = F.greatest((F.max(ts_us) - F.min(ts_us)) / 1e6, F.lit(1.0))
    return flows.agg(F.when(F.count("*") < 2, F.count("*").cast("double")).otherwise(F.count("*") / span).alias("rate"))


def risk_histogram(alerts: DataFrame, risk: str = "risk") -> DataFrame:
    """Alerts a bin of 20, from 0 to below 100, zeros included; a risk of 100 is in none."""
    bins = alerts.sparkSession.range(5).select((F.col("id") * 20).alias("bin"))
    found = alerts.where((F.col(risk) >= 0) & (F.col(risk) < 100)).groupBy((F.floor(F.col(risk) / 20) * 20).alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def overview(alerts: DataFrame, flows: DataFrame, hosts: int = 5, newest: int = 24) -> DataFrame:
    """(tile, key, value): the tiles of the overview in one frame: severities, verdicts and protocols by count, bins of risk, flow rate,
    busiest destinations, and the newest alerts by time. Keys are text, values numbers."""
    tile = lambda name, df, key, value: df.select(F.lit(name).alias("tile"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
    parts = [
        tile("severity", counts_of(alerts, "severity", ("low", "medium", "high", "critical")), "severity", "n"), tile("verdict", counts_of(alerts, "verdict"), "verdict", "n"),
        tile("protocol", counts_of(flows, "protocol"), "protocol", "n"), tile("risk", risk_histogram(alerts), "bin", "n"), tile("flow_rate", observed_flow_rate(flows).withColumn("key", F.lit("per_second")), "key", "rate"),
        tile("top_hosts", top_values(flows, "dst_ip", hosts), "dst_ip", "n"), tile("timeline", recent_ascending(alerts, "ts_us", "alert_id", newest), "alert_id", "ts_us"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def status_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n), counted in one job."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def runtime_metrics(scored: DataFrame) -> DataFrame:
    """(metric, label, n): detections by verdict, severity and reason."""
    pair = lambda name, value: F.struct(F.lit(name).alias("metric"), value.alias("label"))
    one = scored.select(F.explode(F.concat(F.array(pair("verdict", F.col("verdict")), pair("severity", F.col("severity"))), F.transform("reason_codes", lambda r: pair("reason", r)))).alias("m"))
    return one.groupBy("m.metric", "m.label").agg(F.count("*").alias("n"))


def throughput(rows: DataFrame, ts: str = "timestamp_start", seconds: int = 60) -> DataFrame:
    """Rows a window; the same for a stream."""
    return rows.groupBy(F.window(ts, f"{seconds} seconds")).agg(F.count("*").alias("n")).select(F.unix_micros(F.col("window.start")).alias("start_us"), "n")


def retraining_candidates(feedback: DataFrame, alerts: DataFrame, detections: DataFrame, flows: DataFrame) -> DataFrame:
    """The registry features, without endpoints, of flows whose alerts analysts marked as benign new behaviour."""
    from wiretide.operators.features import registry_features

    chosen = feedback.where("eligible_for_retraining and disposition = 'benign_new_behaviour'")
    joined = chosen.join(alerts, "alert_id").join(detections, "detection_id").join(flows.withColumnRenamed("event_id", "flow_event_id"), "flow_event_id")
    return registry_features(joined, "feedback_id", "alert_id", "original_verdict")


def ledger(rows: DataFrame, order: str, key: str, limit: int = 200, **equal) -> DataFrame:
    """The newest rows of an append-only table, by actor, action or the like."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return newest(rows, order, key, limit)


def candidate_view(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Model candidates with their reviews in order."""
    told = reviews.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("reviewed_us", "reviewer", "decision"))).alias("reviews"))
    return candidates.join(told, "candidate_id", "left").withColumn("reviews", F.coalesce("reviews", F.array().cast(told.schema["reviews"].dataType)))


def top_features(spark: SparkSession, names: list[str], coefficients: list[float], n: int = 10) -> DataFrame:
    """The n coefficients of largest magnitude of a fitted model."""
    rows = spark.range(1).select(F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.array(*map(F.lit, map(float, coefficients))).alias("coefficient"))).alias("r")).select("r.*")
    return rows.orderBy(F.desc(F.abs("coefficient")), "feature").limit(n)


def rising_edges(samples: DataFrame, used: Column, capacity: Column, threshold: float, order: str) -> DataFrame:
    """samples with utilization, full and edge: whether it is full now and wasn't in the row before. Samples are taken in blocks of
    the order, a number without ties, each with the row before it."""
    from pyspark.sql import Window

    from wiretide.operators.drift import blocked

    limit = min(max(threshold, 0.1), 1.0)
    flagged = samples.withColumn("utilization", used / F.greatest(capacity, F.lit(1))).withColumn("full", F.col("utilization") >= limit)
    placed = blocked(flagged.withColumn("_all", F.lit(0)), ["_all"], order, 1)
    before = F.lag("full").over(Window.partitionBy("_block").orderBy("_n"))
    return placed.withColumn("edge", F.col("full") & ~F.coalesce(before, F.lit(False))).where("_own").drop("_all", "_n", "_block", "_own")
