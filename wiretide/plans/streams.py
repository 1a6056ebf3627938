"""Queries over streams and stores: each runs the streaming job over given rows, in micro-batches, and returns what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wiretide.operators import datasets as ds, drift, eve, incidents, models, queries as q, temporal
from wiretide.plans import basics, relational
from wiretide.plans.basics import rounded
from wiretide.plans.flowview import FLOW, SCORED, flows, scored
from wiretide.plans.offline import _EVE, _cic, _envelopes, _eve_lines
from wiretide.plans.relational import _ALERTS, _SHORT, _SKEW, _WIN, _alerts, _members, _seq
from wiretide.scratch import folder
from wiretide.sources import bus, readers, store
from wiretide.streaming import jobs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def batches(rows: DataFrame, by: str, n: int = 3) -> list[DataFrame]:
    """rows in n parts by a number."""
    cuts = sorted(set(rows.approxQuantile(by, [i / n for i in range(1, n)], 0.01)))
    edges = [None, *cuts, None]
    part = lambda low, high: (F.lit(True) if low is None else F.col(by) > low) & (F.lit(True) if high is None else F.col(by) <= high)
    return [rows.where(part(a, b)) for a, b in zip(edges, edges[1:])]


def streamed(spark: SparkSession, parts: list[DataFrame], job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the job writes for the parts, each of which is a micro-batch that comes once the one before is done."""
    top = folder(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{top}/in")
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{top}/in")
        with jobs.ending(spark):
            run = job(stream).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{top}/out")


_W1 = relational.ORACLE["w1_temporal_features"]


@query("t1_stream_temporal", _W1)
def t1(spark, d):
    """The temporal features of flows that came in three batches, in order of arrival, each answered as it came."""
    out = streamed(spark, batches(relational._sequenced(spark, d), "arrival"), lambda x: jobs.stream_temporal(x, _WIN, _SHORT, _SKEW, idle_s=1e6))
    return rounded(out.select("event_id", *temporal.FEATURES), 6)


@query("t5_stream_incidents")
def t5(spark, d):
    """The incidents of alerts that came in three batches, in order of time. The fold has no SQL; a test holds the stream against the batch."""
    return streamed(spark, batches(_alerts(spark, d), "ts_us"), jobs.stream_incidents)


@query("t6_stream_drift", relational.ORACLE["w3_drift_events"].replace("SELECT sensor_id, n, round(a, 6)", "SELECT sensor_id AS model_version, CAST(n AS VARCHAR) AS detection_id, round(a, 9)").replace("round(b, 6)", "round(b, 9)"))
def t6(spark, d):
    s = scored(spark, d).select(F.col("sensor_id").alias("model_version"), F.lit("anomaly_score").alias("signal"), F.col("n").cast("string").alias("detection_id"), F.col("n").alias("arrival"), F.col("anomaly_score").alias("value"))
    out = streamed(spark, batches(s, "arrival"), lambda x: jobs.stream_drift(x, 16, {"anomaly_score": 0.1}))
    return rounded(out.select("model_version", "detection_id", "reference_mean", "recent_mean"))


@query("t9_alert_feed", f"WITH {_ALERTS} SELECT alert_id, ts_us, severity FROM alert ORDER BY ts_us DESC, alert_id LIMIT 20")
def t9(spark, d):
    """What the feed told last, of alerts that came in three batches, the newest first."""
    a = _alerts(spark, d).select("alert_id", "ts_us", "severity")
    top, told = folder(spark), []
    for part in reversed(batches(a, "ts_us")):
        part.write.mode("append").parquet(f"{top}/in")
        jobs.alert_feed(spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{top}/in"), f"{top}/state", told.append).awaitTermination()
    return spark.createDataFrame(told[-1] if told else [], a.schema)


@query("s4_read_topic", "SELECT CAST(event_id AS VARCHAR) AS event_id FROM events")
def s4(spark, d):
    """The flows' envelopes, published to a topic and read as a stream in batches of at most 4,096."""
    top = folder(spark)
    bus.publish(_envelopes(spark, d), f"{top}/topic")
    read = bus.read_topic_stream(spark, f"{top}/topic", 4096).select(F.get_json_object("value", "$.flow.event_id").alias("event_id"))
    run = read.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").start()
    run.processAllAvailable()
    run.stop()
    return spark.read.schema("event_id string").parquet(f"{top}/out")


@query("s5_publish_detections", f"WITH {SCORED} SELECT event_id, verdict, severity, round(final_risk_score, 6) AS risk, signature_severity FROM scored WHERE dst_port IS NOT NULL")
def s5(spark, d):
    """Envelopes from a folder of text to a topic of `{{flow, signature, detection}}`, read back."""
    top = folder(spark)
    _envelopes(spark, d).write.text(f"{top}/in")
    jobs.start_publication(readers.read_flow_stream(spark, f"{top}/in", 1_000_000), f"{top}/topic", f"{top}/state").awaitTermination()
    told = bus.read_topic(spark, f"{top}/topic")
    e = F.from_json("value", "flow struct<event_id: string>, signature struct<severity: string>, detection struct<verdict: string, severity: string, final_risk_score: double>")
    parsed = told.select(e.alias("e"))
    return parsed.select("e.flow.event_id", "e.detection.verdict", "e.detection.severity", F.round("e.detection.final_risk_score", 6).alias("risk"), F.col("e.signature.severity").alias("signature_severity"))


def _ingested(spark, d) -> tuple[str, DataFrame, DataFrame]:
    """A store that has taken a third of the detections, and the outcomes of a batch of half of them, benign in it, that was run twice."""
    s = scored(spark, d).select(F.concat(F.lit("d"), "n").alias("detection_id"), "event_id", F.col("n").alias("arrival"), "verdict", "severity", "final_risk_score", "sensor_id", "src_ip", "dst_ip", "ts_us", "signature_severity")
    at = folder(spark)
    store.ingest(s.where("arrival % 3 = 0"), at, "1")
    two = s.where("arrival % 2 = 0").withColumn("verdict", F.lit("benign"))
    store.ingest(two, at, "2")
    return at, s, store.ingest(two, at, "2")


@query("s8_ingest_store", f"WITH {SCORED} SELECT 'd' || n AS detection_id, CASE WHEN n % 3 = 0 AND verdict <> 'benign' THEN 'alert-d' || n END AS alert_id, n % 3 <> 0 AS is_new FROM scored WHERE n % 2 = 0")
def s8_store(spark, d):
    return _ingested(spark, d)[2]


@query("s8_store_tables", f"""WITH {SCORED}, u AS (SELECT * FROM scored WHERE n % 3 = 0 OR n % 2 = 0) SELECT 'detections' AS "table", count(*) AS n FROM u UNION ALL SELECT 'flows', count(DISTINCT event_id) FROM u UNION ALL SELECT 'signatures', count(*) FROM u WHERE signature_severity IS NOT NULL
UNION ALL SELECT 'alerts', count(*) FROM u WHERE n % 3 = 0 AND verdict <> 'benign' UNION ALL SELECT sensor_id, count(*) FROM u GROUP BY 1""")
def s8_tables(spark, d):
    at, s, _ = _ingested(spark, d)
    tables = {"detections": s.schema, "flows": s.select("event_id").schema, "signatures": store.SIGNATURE, "alerts": store.ALERT}
    counts = q.status_counts({name: store.read(spark, at, name, schema) for name, schema in tables.items()})
    return counts.unionByName(store.sensors(spark, at).select(F.col("sensor_id").alias("table"), F.col("flows").alias("n")))


@query("s3_read_eve", f"WITH {_EVE} SELECT CASE WHEN error IS NOT NULL THEN 'error' WHEN type = 'stats' THEN 'ignored' ELSE type END AS kind, count(*) AS n FROM k GROUP BY 1")
def s3(spark, d):
    top = folder(spark)
    _eve_lines(spark, d).select("value").write.text(f"{top}/eve")
    return eve.parse_eve(readers.read_eve_lines(spark, f"{top}/eve"), ipv6=False).groupBy("kind").agg(F.count("*").alias("n"))


@query("s15_ops_logs", f"WITH {FLOW} SELECT coalesce(sum(k) FILTER (n % 3 = 0 AND n % 5 <> 1), 0)::BIGINT AS published FROM flow")
def s15(spark, d):
    n = F.col("n")
    line = F.when(n % 5 == 1, "plain text").otherwise(F.to_json(F.struct(F.when(n % 3 == 0, "detection_batch_persisted").otherwise("other").alias("event"), F.col("k").alias("published_count"))))
    top = folder(spark)
    flows(spark, d).select(line.alias("value")).write.text(f"{top}/log")
    return readers.read_ops_logs(spark.read.text(f"{top}/log"))


@query("d2_repeated_headers", f"WITH {FLOW} SELECT protocol, count(*) AS n FROM flow WHERE n % 50 <> 0 GROUP BY 1")
def d2(spark, d):
    """Files of flows in which every fiftieth row repeats the header."""
    top, names = folder(spark), ["event_id", "src_ip", "dst_ip", "protocol"]
    flows(spark, d).select(*[F.when(F.col("n") % 50 == 0, F.lit(c if c != "src_ip" else " src_ip ")).otherwise(F.col(c)).alias(c) for c in names]).write.option("header", True).csv(f"{top}/csv")
    return readers.read_flow_csv(spark, f"{top}/csv").groupBy("protocol").agg(F.count("*").alias("n"))


@query("d6_group_assignment", f"WITH {FLOW} SELECT coalesce(CAST(nullif(n % 5, 0) AS VARCHAR), '<missing>') AS \"group\", CASE k % 3 WHEN 0 THEN 'dos' WHEN 1 THEN 'benign' ELSE 'port_scan' END AS label, count(*) AS n FROM flow GROUP BY ALL")
def d6(spark, d):
    of = F.col("event_id").cast("long") % 5
    told, _ = ds.canonicalize(_cic(spark, d).withColumn("Day", F.when(of > 0, of)), "cic", group="Day")
    return told.groupBy("group", "label").agg(F.count("*").alias("n"))


_REPORTED = ["duration_ms", "k", "packets_reverse"]


@query("d7_quality_report", f"""WITH {FLOW}, v AS (SELECT duration_ms, k, packets_reverse, count(*) AS n, count(DISTINCT label) AS labels FROM flow GROUP BY 1, 2, 3),
o AS (SELECT (SELECT count(*) FROM flow) AS rows, (SELECT count(DISTINCT label) FROM flow) AS classes, (SELECT sum(n - 1) FROM v) AS dup, (SELECT count(*) FROM v WHERE labels > 1) AS bad)
SELECT 'rows' AS section, 'rows' AS item, rows::BIGINT AS value FROM o UNION ALL SELECT 'rows', 'classes', classes FROM o UNION ALL SELECT 'rows', 'duplicate_rows', dup::BIGINT FROM o UNION ALL SELECT 'rows', 'conflicting_vectors', bad FROM o
UNION ALL SELECT 'label', label, count(*) FROM flow GROUP BY 2 UNION ALL SELECT 'group', sensor_id, count(*) FROM flow GROUP BY 2
{"".join(f" UNION ALL SELECT 'feature', '{c}.distinct', (SELECT count(DISTINCT {c}) FROM flow) UNION ALL SELECT 'feature', '{c}.missing', 0 UNION ALL SELECT 'feature', '{c}.infinite', 0 UNION ALL SELECT 'feature', '{c}.out_of_range', {'(SELECT count(*) FROM flow WHERE duration_ms > 1000)' if c == 'duration_ms' else 0}" for c in _REPORTED)}
UNION ALL SELECT 'blocking', 'conflicting_vectors', bad FROM o WHERE bad > 0""")
def d7(spark, d):
    f = flows(spark, d).withColumn("group", F.col("sensor_id"))
    return ds.quality_report(f, _REPORTED, {"duration_ms": (0.0, 1000.0)})


@query("q7_overview", f"""WITH {_ALERTS} SELECT 'severity' AS tile, s AS key, count(severity)::DOUBLE AS value FROM (SELECT unnest(['low', 'medium', 'high', 'critical']) AS s) LEFT JOIN alert ON s = severity GROUP BY s
UNION ALL SELECT 'verdict', verdict, count(*) FROM alert GROUP BY 2 UNION ALL SELECT 'protocol', protocol, count(*) FROM flow GROUP BY 2 UNION ALL SELECT 'risk', CAST(b AS VARCHAR), count(risk) FROM range(0, 100, 20) r(b) LEFT JOIN alert ON risk >= b AND risk < b + 20 GROUP BY b
UNION ALL SELECT 'flow_rate', 'per_second', round(count(*) / greatest((max(ts_us) - min(ts_us)) / 1e6, 1), 9) FROM flow
UNION ALL (SELECT 'top_hosts', dst_ip, count(*) AS n FROM flow GROUP BY dst_ip ORDER BY n DESC, dst_ip LIMIT 5) UNION ALL (SELECT 'timeline', alert_id, ts_us FROM alert ORDER BY ts_us DESC, alert_id LIMIT 24)""")
def q7(spark, d):
    return rounded(q.overview(_alerts(spark, d), flows(spark, d)))


@query("m27_grouping_reasons", f"""WITH {_ALERTS}, l AS (SELECT *, lag(src_ip) OVER w AS s1, lag(dst_ip) OVER w AS d1, lag(signature_severity) OVER w AS g1, lag(reason_codes) OVER w AS c1, lag(attack_stage) OVER w AS a1, lag(risk) OVER w AS r1, lag(risk, 2) OVER w AS r2,
  CASE severity WHEN 'informational' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS k0 FROM alert WINDOW w AS (PARTITION BY sensor_id ORDER BY ts_us, alert_id)),
m AS (SELECT *, lag(k0) OVER w AS k1, lag(k0, 2) OVER w AS k2 FROM l WINDOW w AS (PARTITION BY sensor_id ORDER BY ts_us, alert_id))
SELECT alert_id, array_to_string(list_filter(['time proximity', CASE WHEN s1 = src_ip THEN 'same source host' END, CASE WHEN d1 = dst_ip THEN 'shared destination' END, CASE WHEN g1 = signature_severity THEN 'common signature' END,
  CASE WHEN list_has_any(c1, reason_codes) THEN 'common reason' END, CASE WHEN a1 = attack_stage AND attack_stage NOT IN ('known_threat_activity', 'unclassified_anomaly', 'needs_review') THEN 'similar attack stage (' || attack_stage || ')' END,
  CASE WHEN (r2 < r1 AND r1 < risk) OR (k2 < k1 AND k1 < k0) THEN 'repeated escalation' END], lambda x: x IS NOT NULL), ',') AS reasons FROM m WHERE r2 IS NOT NULL""")
def m27(spark, d):
    """Why each alert would belong to an incident of the two before it at its sensor, of which the last has the hosts and reasons."""
    from pyspark.sql import Window

    need = ["sensor_id", "alert_id", "ts_us", "src_ip", "dst_ip", "signature_ids", "reason_codes", "attack_stage", "severity", "risk"]
    rows = drift.blocked(_alerts(spark, d).select(*need), ["sensor_id"], "ts_us", 2, sample=flows(spark, d).select("ts_us"), then=("alert_id",))
    w = Window.partitionBy("sensor_id", "_block").orderBy("_n")
    lag = lambda c, i=1: F.lag(c, i).over(w)
    old = F.struct(F.array(lag("src_ip")).alias("source_hosts"), F.array(lag("dst_ip")).alias("destination_hosts"), lag("signature_ids").alias("signature_ids"), lag("reason_codes").alias("reason_codes"), F.array(lag("attack_stage")).alias("attack_stages"), F.array(lag("severity", 2), lag("severity")).alias("severities"), F.array(lag("risk", 2), lag("risk")).alias("risks"))
    new = F.struct(F.col("src_ip").alias("source_host"), F.col("dst_ip").alias("destination_host"), "signature_ids", "reason_codes", "attack_stage", "severity", "risk")
    pairs = rows.withColumns({"incident": old, "alert": new}).where("_own and incident.risks[0] is not null")
    return pairs.select("alert_id", F.array_join(incidents.grouping_reasons(), ",").alias("reasons"))


@query("m29_incident_context", f"""WITH {_ALERTS}, m AS (SELECT *, sensor_id || '/' || (ts_us // 86400000000) AS incident_id FROM alert)
SELECT incident_id, array_to_string(list_sort(list(DISTINCT src_ip)), ',') AS source_hosts, array_to_string(list_sort(list(DISTINCT dst_ip)), ',') AS destination_hosts, coalesce(array_to_string(list_sort(list(DISTINCT signature_severity) FILTER (signature_severity IS NOT NULL)), ','), '') AS signature_ids,
  array_to_string(list_sort(list_distinct(flatten(list(reason_codes)))), ',') AS reason_codes, array_to_string(list_sort(list(DISTINCT attack_stage)), ',') AS attack_stages, array_to_string((list(severity ORDER BY ts_us, alert_id))[-2:], ',') AS severities,
  array_to_string((list(CAST(round(risk * 100) AS BIGINT) ORDER BY ts_us, alert_id))[-2:], ',') AS risks, max(ts_us) AS updated_us FROM m GROUP BY 1""")
def m29(spark, d):
    c = incidents.incident_context(_members(spark, d)).withColumn("risks", F.transform("risks", lambda r: F.round(r * 100).cast("long").cast("string")))
    names = ("source_hosts", "destination_hosts", "signature_ids", "reason_codes", "attack_stages", "severities", "risks")
    return c.select("incident_id", *[F.array_join(n, ",").alias(n) for n in names], "updated_us")


@query("m15_anomaly_calibration", f"WITH {FLOW} SELECT round(quantile_cont(iso_s, 0.5), 9) AS isolation_median, round(quantile_cont(iso_s, 0.03), 9) AS isolation_p03, round(quantile_cont(rec_s, 0.5), 9) AS reconstruction_p50, round(quantile_cont(rec_s, 0.97), 9) AS reconstruction_p97 FROM flow WHERE label = 'benign'")
def m15(spark, d):
    got = models.anomaly_calibration(flows(spark, d).where("label = 'benign'"), "iso_s", "rec_s")
    names = ("isolation_median", "isolation_p03", "reconstruction_p50", "reconstruction_p97")
    return rounded(spark.createDataFrame([tuple(float(got[n]) for n in names)], ", ".join(f"{n} double" for n in names)))


@query("w2_schema_b", f"SELECT * FROM ({basics.ORACLE['f2_portable_features'].replace(', 9)', ', 6)')}) JOIN ({_W1}) USING (event_id)")
def w2(spark, d):
    f = flows(spark, d).withColumn("arrival", _seq())
    return rounded(temporal.schema_b(f, window_s=_WIN, short_s=_SHORT, skew_s=_SKEW, most=1_000_000), 6)


@query("w2_rows_in_file_order", f"WITH {FLOW} SELECT count(*) AS n, count(*) AS distinct_positions, 0::BIGINT AS out_of_order FROM flow")
def w2_order(spark, d):
    """Files of flows as they were written, a file a range of ids: positions count up with the ids in each."""
    top = folder(spark)
    flows(spark, d).select("n", "event_id").repartitionByRange(4, "n").sortWithinPartitions("n").write.option("header", True).csv(f"{top}/csv")
    told = readers.with_positions(spark.read.option("header", True).option("maxPartitionBytes", "64k").schema("n long, event_id string").csv(f"{top}/csv"))
    first = told.groupBy("source_file").agg(F.min("n").alias("low"), F.min_by("n", "position").alias("first"), F.max("n").alias("high"), F.max_by("n", "position").alias("last"), F.corr(F.col("n").cast("double"), F.col("position").cast("double")).alias("r"))
    wrong = first.agg(F.count_if((F.col("low") != F.col("first")) | (F.col("high") != F.col("last"))).alias("out_of_order"))
    return told.agg(F.count("*").alias("n"), F.count_distinct("source_file", "position").alias("distinct_positions")).crossJoin(F.broadcast(wrong))
