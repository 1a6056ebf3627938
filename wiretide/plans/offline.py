"""Queries over logs, packets, datasets, quality, splits, governance, exports and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretide.functions.scalars import normalize_label
from wiretide.operators import datasets as ds, eve, features, fusion, incidents, models, ops, packets as pk, validate
from wiretide.plans.basics import anonymized, rounded
from wiretide.plans.flowview import FLOW, SCORED, flows, read, scored
from wiretide.scratch import folder
from wiretide.sources import readers, sinks
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


# Logs ---------------------------------------------------------------------------------------------


def _eve_lines(spark, d):
    """Log lines made of events: alerts, DNS records, types that aren't supported, and broken lines."""
    n = F.col("n")
    stamp = F.concat(F.date_format("timestamp_start", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000"))
    common = [stamp.alias("timestamp"), F.when(n % 4 == 0, "alert").when(n % 4 == 1, "dns").when(n % 4 == 2, "stats").otherwise("flow").alias("event_type"), F.col("event_id").alias("flow_id"), "src_ip", "src_port", F.col("dst_ip").alias("dest_ip"), F.col("dst_port").alias("dest_port"), F.col("protocol").alias("proto")]
    alert = F.when(n % 4 == 0, F.struct(F.concat(F.lit("s"), n % 7).alias("signature_id"), F.lit("Scan of ports").alias("signature"), (n % 5).cast("int").alias("severity"))).alias("alert")
    dns = F.when(n % 4 == 1, F.struct(F.lit("query").alias("type"), F.concat(F.lit("host"), n % 3).alias("rrname"))).alias("dns")
    flow = F.when((n % 4 == 3) & (n % 5 > 0), F.struct(F.lit("closed").alias("state"))).alias("flow")
    line = F.to_json(F.struct(*common, alert, dns, flow))
    return flows(spark, d).select("n", F.when(n % 50 == 7, F.substring(line, 1, 40)).otherwise(line).alias("value"))


_EVE = f"""{FLOW}, k AS (SELECT *, ['alert', 'dns', 'stats', 'flow'][n % 4 + 1] AS type, CASE WHEN n % 50 = 7 THEN 'malformed' WHEN n % 4 = 2 THEN NULL WHEN (n % 4 = 3 AND n % 5 = 0) OR (dst_port IS NOT NULL AND protocol = 'GRE') THEN 'incomplete_' || ['alert', 'dns', 'stats', 'flow'][n % 4 + 1] END AS error FROM flow)"""


@query("e1_parse_eve", f"""WITH {_EVE}, t AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN type = 'stats' THEN 'ignored' ELSE type END AS kind FROM k)
SELECT kind, error, CASE WHEN kind = 'alert' THEN CASE n % 5 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END END AS severity, CASE WHEN kind = 'dns' THEN sha256('host' || n % 3) END AS name_digest, count(*) AS n FROM t GROUP BY ALL""")
def e1(spark, d):
    p = eve.parse_eve(_eve_lines(spark, d), ipv6=False).withColumn("name_digest", F.col("metadata")["dns_rrname_sha256"])
    return p.groupBy("kind", "error", "severity", "name_digest").agg(F.count("*").alias("n"))


@query("e3_eve_health", f"WITH {_EVE} SELECT count(*) FILTER (error IS NULL AND type <> 'stats') AS parsed_events, count(error) AS malformed_events, 0::BIGINT AS duplicate_events FROM k")
def e3(spark, d):
    return eve.health(eve.parse_eve(_eve_lines(spark, d), ipv6=False)).drop("last_event_at")


@query("e2_dedupe_eve", f"WITH {_EVE} SELECT count(*) AS n FROM k WHERE error IS NULL AND type <> 'stats'")
def e2(spark, d):
    p = eve.parse_eve(_eve_lines(spark, d), ipv6=False).where("event_id is not null")
    return eve.dedupe(p.unionByName(p)).agg(F.count("*").alias("n"))


def _packets(spark, d):
    e = flows(spark, d)
    turn = F.col("n") % 2 == 1
    pick = lambda a, b: F.when(turn, b).otherwise(a)
    c, s = F.concat(F.lit("10.0.0."), F.col("k") % 9 + 1), F.lit("10.0.1.1")
    cp, sp = (50_000 + F.col("k") % 3).cast("int"), F.when(F.col("k") % 2 == 0, 80).otherwise(9000)
    return e.select((F.col("ts_us") / 1e6).alias("ts"), (F.col("k") % 1400 + 60).cast("int").alias("size"), pick(c, s).alias("src_ip"), pick(cp, sp).alias("src_port"), pick(s, c).alias("dst_ip"), pick(sp, cp).alias("dst_port"), F.lit("UDP").alias("protocol"), F.lit(0).alias("tcp_flags"), F.col("n").alias("seq"))


@query("e4_packets_to_flows", f"""WITH {FLOW}, p AS (SELECT ts_us / 1e6::DOUBLE AS ts, n, n % 2 = 1 AS back, k % 1400 + 60 AS size, '10.0.0.' || (k % 9 + 1) AS c, 50000 + k % 3 AS cp, CASE WHEN k % 2 = 0 THEN 80 ELSE 9000 END AS sp FROM flow),
i AS (SELECT *, CASE WHEN lag(ts) OVER w IS NOT NULL THEN greatest((ts - lag(ts) OVER w) * 1000, 0) END AS iat, first_value(back) OVER w AS first_back FROM p WINDOW w AS (PARTITION BY c, cp, sp ORDER BY ts, n)),
d AS (SELECT *, CASE WHEN sp = 80 THEN back ELSE back <> first_back END AS rev, CASE WHEN sp = 80 THEN false ELSE first_back END AS turned FROM i)
SELECT CASE WHEN any_value(turned) THEN '10.0.1.1' ELSE c END AS src_ip, CASE WHEN any_value(turned) THEN sp ELSE cp END AS src_port, count(*) FILTER (NOT rev) AS packets_forward, count(*) FILTER (rev) AS packets_reverse, coalesce(sum(size) FILTER (NOT rev), 0)::BIGINT AS bytes_forward, coalesce(sum(size) FILTER (rev), 0)::BIGINT AS bytes_reverse,
  round(avg(size), 6) AS packet_length_mean, round(stddev_pop(size), 6) AS packet_length_std, round(coalesce(max(iat), 0), 3) AS iat_max, round(coalesce(avg(iat), 0), 3) AS iat_mean FROM d GROUP BY c, cp, sp""")
def e4(spark, d):
    f = pk.packets_to_flows(_packets(spark, d), ipv6=False)
    r = lambda c, n: F.round(c, n).alias(c)
    return f.select("src_ip", "src_port", "packets_forward", "packets_reverse", "bytes_forward", "bytes_reverse", r("packet_length_mean", 6), r("packet_length_std", 6), r("iat_max", 3), r("iat_mean", 3))


@query("e6_normalize_export", f"WITH {FLOW} SELECT event_id, CASE WHEN n % 3 = 0 THEN dst_ip ELSE src_ip END AS src_ip, CASE WHEN n % 3 = 0 THEN packets_reverse ELSE packets_forward END AS packets_forward, CASE WHEN n % 3 = 0 THEN '-1,1' ELSE '1,-1' END AS directions FROM flow")
def e6(spark, d):
    f = flows(spark, d).select("event_id", "n", "src_ip", "src_port", "dst_ip", "dst_port", F.lit(6).alias("protocol"), F.col("duration_ms").alias("bidirectional_duration_ms"), F.col("packets_forward").alias("src2dst_packets"), F.col("packets_reverse").alias("dst2src_packets"), F.col("bytes_forward").alias("src2dst_bytes"), F.col("bytes_reverse").alias("dst2src_bytes"), F.array(F.lit(0), F.lit(1)).alias("splt_direction"), F.array(F.lit(60), F.lit(60)).alias("splt_ps"))
    made = pk.normalize_export(pk.swapped(f, F.col("n") % 3 == 0).withColumn("src_port", F.col("event_id").cast("int")), "s1")
    return made.select(F.col("src_port").cast("string").alias("event_id"), "src_ip", "packets_forward", F.array_join(F.col("first_packet_directions").cast("array<string>"), ",").alias("directions"))


# Datasets -----------------------------------------------------------------------------------------


def _cic(spark, d):
    f = flows(spark, d)
    name = {"Flow Duration": F.col("duration_ms") * 1000, " Total Fwd Packets": F.col("packets_forward"), "Total Backward Packets": F.col("packets_reverse"), "TotLen Fwd Pkts": F.col("bytes_forward"), "Total Length of Bwd Packets": F.col("bytes_reverse"), "Dst Port": F.coalesce("dst_port", F.lit(0))}
    return f.select("event_id", *[v.cast("string").alias(k) for k, v in name.items()], F.when(F.col("k") % 3 == 0, "DoS Hulk").when(F.col("k") % 3 == 1, "BENIGN").otherwise("PortScan").alias("Label"))


@query("d1_canonicalize", f"""WITH {FLOW} SELECT CASE k % 3 WHEN 0 THEN 'dos' WHEN 1 THEN 'benign' ELSE 'port_scan' END AS label, count(*) AS n, round(sum(duration_ms), 3) AS duration_ms, sum(packets_forward + packets_reverse)::DOUBLE AS packets_total, round(sum(CASE WHEN duration_ms > 0 THEN (bytes_forward + bytes_reverse) / (duration_ms / 1000) END), 3) AS byte_rate,
  round(sum(bytes_forward::DOUBLE / greatest(bytes_reverse, 1)), 3) AS ratio, 0.0::DOUBLE AS tcp_syn_count FROM flow GROUP BY 1""")
def d1(spark, d):
    c, _ = ds.canonicalize(_cic(spark, d), "cic")
    r = lambda c, a: F.round(F.sum(c), 3).alias(a)
    return c.groupBy("label").agg(F.count("*").alias("n"), r("duration_ms", "duration_ms"), F.sum("packets_total").alias("packets_total"), r("byte_rate", "byte_rate"), r("forward_reverse_byte_ratio", "ratio"), F.sum("tcp_syn_count").alias("tcp_syn_count"))


@query("d5_registry_exclusion", f"WITH {FLOW} SELECT count(*) FILTER (dst_port IS NULL) AS excluded FROM flow")
def d5(spark, d):
    return ds.registry_exclusion(features.registry_features(flows(spark, d)))[1]


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a18_quality_profile", "SELECT 'l_quantity' AS feature, count(DISTINCT l_quantity) AS \"distinct\", count(DISTINCT l_quantity) <= 1 AS constant, 0::BIGINT AS missing, 0::BIGINT AS infinite, count(*) FILTER (l_quantity > 40) AS out_of_range FROM lineitem UNION ALL SELECT 'l_discount', count(DISTINCT l_discount), count(DISTINCT l_discount) <= 1, 0, 0, 0 FROM lineitem UNION ALL SELECT 'l_tax', count(DISTINCT l_tax), count(DISTINCT l_tax) <= 1, 0, 0, 0 FROM lineitem UNION ALL SELECT 'l_extendedprice', count(DISTINCT l_extendedprice), count(DISTINCT l_extendedprice) <= 1, 0, 0, 0 FROM lineitem")
def a18(spark, d):
    return ds.quality_profile(read(spark, d, "lineitem"), _LI, {"l_quantity": (0.0, 40.0)})


@query("a18_duplicate_rows", "SELECT (SELECT count(*) FROM lineitem) - count(*) AS duplicate_rows FROM (SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem)")
def a18d(spark, d):
    return ds.duplicate_rows(read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_returnflag"])


@query("a19_column_label_purity", """WITH l AS (SELECT 'l_linestatus' AS c, l_linestatus AS v, l_returnflag AS y FROM lineitem UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), l_returnflag FROM lineitem), p AS (SELECT c, v, y, count(*) AS n FROM l GROUP BY ALL), g AS (SELECT c, v, max(n) AS top, sum(n) AS n FROM p GROUP BY ALL)
SELECT c AS "column", count(*) AS "distinct", round(count(*)::DOUBLE / sum(n), 9) AS unique_ratio, round(sum(top)::DOUBLE / sum(n), 9) AS purity, sum(top)::DOUBLE / sum(n) >= 0.98 AND count(*)::DOUBLE / sum(n) BETWEEN 0.001 AND 0.95 AS suspicious FROM g GROUP BY c""")
def a19(spark, d):
    return rounded(ds.column_label_purity(read(spark, d, "lineitem"), ["l_linestatus", "l_linenumber"], "l_returnflag"))


@query("u5_dedupe_conflicts", "SELECT l_quantity, l_discount, l_tax, any_value(l_returnflag) AS l_returnflag, min(id) AS id FROM (SELECT *, l_orderkey * 10 + l_linenumber AS id FROM lineitem) GROUP BY l_quantity, l_discount, l_tax HAVING count(DISTINCT l_returnflag) = 1")
def u5(spark, d):
    li = read(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return ds.dedupe_conflicts(li, ["l_quantity", "l_discount", "l_tax"], "l_returnflag", "id")


@query("u6_capped_sample")
def u6(spark, d):
    return ds.capped_sample(flows(spark, d), "event_id", 200, by="label").select("event_id", "label")


@query("w7_time_split", f"WITH {FLOW}, r AS (SELECT *, row_number() OVER (ORDER BY ts_us // 86400000000, event_id) AS i, count(*) OVER () AS n0 FROM flow) SELECT CASE WHEN i <= floor(n0 * 0.8) THEN 'train' ELSE 'test' END AS split, count(*) AS n, sum(n)::BIGINT AS ids FROM r GROUP BY 1")
def w7(spark, d):
    f = flows(spark, d).withColumn("day", F.floor(F.col("ts_us") / 86_400_000_000))
    return ds.time_split(f, "day", "event_id").groupBy("split").agg(F.count("*").alias("n"), F.sum("n").alias("ids"))


@query("m17_group_split")
def m17(spark, d):
    f = flows(spark, d).withColumn("day", F.date_trunc("day", "timestamp_start"))
    return ds.split_manifest(ds.group_split(f, "day"), "event_id", "day")


@query("m17_leave_family_out", f"WITH {FLOW} SELECT count(*) FILTER (label = 'botnet') AS held, 0::BIGINT AS leaked FROM flow")
def m17f(spark, d):
    s = ds.leave_family_out(flows(spark, d), "botnet")
    return s.agg(F.count_if((F.col("label") == "botnet") & (F.col("split") == "test")).alias("held"), F.count_if((F.col("label") == "botnet") & (F.col("split") == "train")).alias("leaked"))


@query("s12_file_provenance")
def s12(spark, d):
    return readers.file_provenance(spark, f"{d}/events.parquet")


# Governance and exports ---------------------------------------------------------------------------


@query("m32_retention_cleanup", f"""WITH {SCORED}, a AS (SELECT *, end_us < (SELECT quantile_disc(ts_us, 0.3) FROM flow) AS old, verdict <> 'benign' AS alert FROM scored), m AS (SELECT n // 5 AS incident, old FROM a WHERE alert)
SELECT 'flows' AS "table", count(*) FILTER (old) AS removed FROM a UNION ALL SELECT 'detections', count(*) FILTER (old) FROM a UNION ALL SELECT 'alerts', count(*) FILTER (old AND alert) FROM a UNION ALL SELECT 'members', count(*) FILTER (old AND alert) FROM a UNION ALL SELECT 'feedback', count(*) FILTER (old AND alert AND n % 10 = 0) FROM a UNION ALL SELECT 'incidents', count(*) FROM (SELECT incident FROM m GROUP BY incident HAVING bool_and(old))""")
def m32(spark, d):
    s = scored(spark, d)
    cut = F.lit(s.agg(F.expr("percentile_disc(0.3) within group (order by ts_us)")).first()[0])
    a = s.where("verdict <> 'benign'")
    members = a.select(F.col("event_id").alias("alert_id"), F.floor(F.col("n") / 5).alias("incident_id"))
    t = {
        "flows": s.select("event_id", F.unix_micros("timestamp_end").alias("timestamp_end")), "detections": s.select(F.col("event_id").alias("detection_id"), F.col("event_id").alias("flow_event_id")), "alerts": a.select(F.col("event_id").alias("alert_id"), F.col("event_id").alias("detection_id")),
        "members": members, "incidents": members.select("incident_id").distinct(), "feedback": a.where("n % 10 = 0").select(F.col("event_id").alias("alert_id")),
    }
    return ops.retention(t, cut)[1]


@query("a30_compare_snapshots", "SELECT 'events' AS \"table\", count(*) AS rows_before, count(*) FILTER (event_id <> 5) AS rows_after, false AS same FROM events UNION ALL SELECT 'orders', count(*), count(*), true FROM orders")
def a30(spark, d):
    e, o = read(spark, d, "events"), read(spark, d, "orders")
    return ops.compare_snapshots(ops.snapshot({"events": (e, ["event_id"]), "orders": (o, ["o_orderkey"])}), ops.snapshot({"events": (e.where("event_id <> 5"), ["event_id"]), "orders": (o.repartition(3), ["o_orderkey"])}))


@query("m20_readiness_gate", f"WITH {SCORED}, v AS (SELECT count(*) FILTER (label = 'benign' AND verdict <> 'benign')::DOUBLE / count(*) FILTER (label = 'benign') AS fpr FROM scored) SELECT 'benign_false_positive_rate' AS criterion, round(fpr, 9) AS value, CASE WHEN fpr <= 0.01 THEN 'pass' ELSE 'fail' END AS status FROM v UNION ALL SELECT unnest(['observed_label_macro_f1', 'suspicious_unknown_detection_rate', 'unknown_detection_or_review_rate', 'expected_calibration_error', 'false_alerts_per_replay_hour', 'train_test_overlap_fraction']), NULL, 'not_applicable'")
def m20(spark, d):
    fpr = scored(spark, d).agg((F.count_if((F.col("label") == "benign") & (F.col("verdict") != "benign")) / F.count_if(F.col("label") == "benign")).alias("value"))
    return rounded(ops.readiness_gate(fpr.select(F.lit("benign_false_positive_rate").alias("criterion"), "value")).select("criterion", "value", "status"))


@query("a29_sustainability", f"WITH {FLOW}, t AS (SELECT count(*) AS n, quantile_cont(duration_ms, 0.95) AS p FROM flow) SELECT n AS planned, p <= 500 AS latency_within_budget, true AS no_unexplained_loss, p <= 500 AS sustainable FROM t")
def a29(spark, d):
    run = flows(spark, d).agg(F.count("*").alias("planned"), F.percentile("duration_ms", F.lit(0.95)).alias("p95_ms")).select("*", *[F.col("planned").alias(c) for c in ("published", "persisted_flows", "persisted_detections", "samples")], F.lit(50.0).alias("achieved_rate"), F.lit(0).alias("final_depth"), F.lit(10).alias("max_depth"), F.lit(0.0).alias("growth"))
    return ops.sustainability(run, 500.0, 100, 0.1, 50.0).select("planned", "latency_within_budget", "no_unexplained_loss", "sustainable")


@query("m33_candidate_assessment", """WITH e AS (SELECT 'm' || (user_id % 20) AS candidate_id, event_type AS mode, user_id % 20 AS u FROM events) SELECT candidate_id, array_to_string(list_sort(list(DISTINCT mode)), ',') AS covered, any_value(u) % 2 = 0 AS synthetic, list_contains(list(mode), 'click') AND list_contains(list(mode), 'view') AND NOT any_value(u) % 2 = 0 AS clear FROM e GROUP BY candidate_id""")
def m33(spark, d):
    e = read(spark, d, "events").withColumn("candidate_id", F.concat(F.lit("m"), F.col("user_id") % 20))
    reports = e.select("candidate_id", F.lit("r.json").alias("filename"), F.lit("pass").alias("gate_status"), F.array("event_type").alias("covered_modes"))
    cands = e.select("candidate_id", F.array(F.when(F.col("user_id") % 2 == 0, "Synthetic-1").otherwise("abc")).alias("dataset_fingerprints"), F.lit(3).alias("bundle_schema_version")).distinct()
    out = ops.candidate_assessment(reports, cands, ["click", "view"])
    return out.select("candidate_id", F.array_join("covered", ",").alias("covered"), F.array_contains("blockers", "synthetic_training_bundle").alias("synthetic"), (F.size("blockers") == 0).alias("clear"))


@query("s9_export_flows", f"WITH {FLOW} SELECT event_id, {anonymized('src_ip', b'salt')} AS src_ip, {anonymized('dst_ip', b'salt')} AS dst_ip, src_port, protocol FROM flow")
def s9(spark, d):
    return sinks.export_rows(flows(spark, d), salt=b"salt").select("event_id", "src_ip", "dst_ip", "src_port", "protocol")


@query("s6_dead_letters", f"WITH {_EVE} SELECT error AS error_code, count(*) AS n FROM k WHERE error IS NOT NULL GROUP BY 1")
def s6(spark, d):
    lines = _eve_lines(spark, d)
    parsed = eve.parse_eve(lines, ipv6=False)
    bad = lines.join(parsed.where("error is not null").select(F.col("raw_event_hash"), "error"), F.sha2(F.encode("value", "UTF-8"), 256) == F.col("raw_event_hash"))
    return sinks.dead_letters(bad, "eve", F.col("error")).groupBy("error_code").agg(F.count("*").alias("n"))


def _envelopes(spark, d):
    s = scored(spark, d).withColumn("arrival", F.col("n"))
    names = [p.split()[0] for p in jobs.FLOW.split(", ")]
    flow = F.struct(*[F.col(c).alias(c) for c in names])
    return s.select(F.to_json(F.struct(flow.alias("flow"), F.when(F.col("signature_severity").isNotNull(), F.struct(F.col("signature_severity").alias("severity"))).alias("signature"))).alias("value"))


@query("t4_stream_detect_batch", f"WITH {SCORED} SELECT CASE WHEN dst_port IS NULL THEN 'dst_port' END AS error_code, verdict, count(*) AS n FROM scored GROUP BY ALL")
def t4(spark, d):
    return jobs.detect(_envelopes(spark, d)).groupBy("error_code", "verdict").agg(F.count("*").alias("n"))


@query("m36_replay_batch", f"WITH {SCORED} SELECT count(*) AS flows, count(*) FILTER (verdict <> 'benign') AS alerts, count(DISTINCT verdict) AS verdicts FROM scored WHERE dst_port IS NOT NULL")
def m36(spark, d):
    """Envelopes to validated, scored flows, alerts and their incidents, in one batch. What is scored is written once: incidents read it
    several times, and plans that parse and score envelopes anew each time fill the driver."""
    top = folder(spark)
    found = jobs.detect(_envelopes(spark, d)).where("error_code is null").withColumn("ts_us", F.unix_micros("timestamp_start"))
    found.select("event_id", "arrival", "sensor_id", "ts_us", "src_ip", "dst_ip", "signature_severity", "reason_codes", "verdict", "severity", "final_risk_score").write.parquet(top)
    good = spark.read.parquet(top)
    tagged = good.withColumns({"n": F.col("arrival"), "known_label": F.lit("dos")})
    alerts = incidents.alerts_of(tagged)
    members = incidents.assign_incidents(alerts, ("sensor_id",)).agg(F.count("alert_id").alias("alerts"))
    return good.agg(F.count("*").alias("flows"), F.count_distinct("verdict").alias("verdicts")).crossJoin(F.broadcast(members)).select("flows", "alerts", "verdicts")


# Models -------------------------------------------------------------------------------------------

_NUM = ["duration_ms", "packets_forward", "bytes_forward", "iat_std", "packet_length_std"]


def _numeric(spark, d):
    f = flows(spark, d)
    return features.robust_transform(f, features.robust_fit(f, _NUM))


@query("m9_isolation_forest")
def m9(spark, d):
    f = _numeric(spark, d)
    return models.IsolationForest(_NUM, trees=50).fit(f.where("label = 'benign'"), "event_id").decision(f).select("event_id", F.round("decision", 9).alias("decision"))


@query("m10_autoencoder")
def m10(spark, d):
    f = _numeric(spark, d).select("event_id", "label", *_NUM)
    return models.Autoencoder(_NUM, hidden=(4, 2, 4)).fit(f.where("label = 'benign'"), epochs=5).errors(f).select("event_id", F.round("reconstruction_error", 6).alias("reconstruction_error"))


@query("m11_robust_covariance")
def m11(spark, d):
    f = _numeric(spark, d)
    mean, cov = models.robust_covariance(f.where("label = 'benign'"), _NUM)
    return f.select("event_id", F.round(models.mahalanobis(_NUM, mean, cov), 6).alias("distance"))


@query("m12_local_outlier_factor")
def m12(spark, d):
    f = _numeric(spark, d)
    return models.local_outlier_factor(f, f.where("label = 'benign'"), _NUM, "event_id").withColumn("lof", F.round("lof", 6))


@query("m13_supervised_logistic")
def m13(spark, d):
    f = models.balanced_weights(_numeric(spark, d))
    return models.class_probabilities(models.baseline("logistic", _NUM).fit(f), f).select("event_id", "label", "pred")


@query("m14_platt")
def m14(spark, d):
    f = flows(spark, d).withColumns({"y": (F.col("label") != "benign").cast("int"), "fold": (F.col("n") % 3).cast("int")})
    return f.select("event_id", F.round(models.platt(f, "known_p", "y", "fold"), 6).alias("calibrated"))


_VERDICTS = ("benign", "known_attack", "suspicious_unknown", "needs_review")


@query("m24_select_fusion", f"""WITH {SCORED}, g AS (SELECT 0 AS candidate, 0.43 AS kw, 0.72 AS kt, 0.70 AS an, 30.0 AS bm
  UNION ALL SELECT row_number() OVER (ORDER BY kw, kt, an, bm), kw, kt, an, bm FROM (SELECT unnest([0.38, 0.43, 0.48]) AS kw), (SELECT unnest([0.68, 0.72, 0.76]) AS kt), (SELECT unnest([0.66, 0.70, 0.74]) AS an), (SELECT unnest([26.0, 30.0, 34.0]) AS bm)),
c AS (SELECT candidate, kw::DOUBLE AS kw, (0.70 - kw)::DOUBLE AS aw, kt::DOUBLE AS kt, an::DOUBLE AS an, bm::DOUBLE AS bm FROM g),
r AS (SELECT c.*, known_p, confidence, anomaly_score, signature_score, CASE label WHEN 'benign' THEN 'benign' WHEN 'botnet' THEN 'suspicious_unknown' ELSE 'known_attack' END AS y,
  floor(least(100 * (kw * known_p + aw * anomaly_score + 0.20::DOUBLE * signature_score + 0.10::DOUBLE * contextual_score) + 8 * disagreement, 100) * 100 + 0.5) / 100 AS risk FROM score1 CROSS JOIN c),
v AS (SELECT candidate, kw, kt, an, bm, y, CASE WHEN signature_score >= 0.5 OR (known_p >= kt AND confidence >= 0.58) THEN 'known_attack' WHEN anomaly_score >= an AND known_p < kt THEN 'suspicious_unknown'
  WHEN risk <= bm AND anomaly_score < an THEN 'benign' ELSE 'needs_review' END AS p FROM r),
f AS (SELECT candidate, kw, kt, an, bm, count(*) AS n, {", ".join(f"count(*) FILTER (y = '{v}') AS n{i}, coalesce(2.0::DOUBLE * count(*) FILTER (y = '{v}' AND p = '{v}') / nullif(count(*) FILTER (y = '{v}') + count(*) FILTER (p = '{v}'), 0), 0) AS f{i}" for i, v in enumerate(_VERDICTS))} FROM v GROUP BY ALL),
s AS (SELECT *, (f0 + f1 + f2 + f3) / 4 AS m, (f0 * n0 + f1 * n1 + f2 * n2 + f3 * n3) / n AS w FROM f)
SELECT candidate, kw AS known_weight, kt AS known_threshold, an AS anomaly_threshold, bm AS benign_max_risk, round(m, 9) AS macro_f1, round(w, 9) AS weighted_f1,
  row_number() OVER (ORDER BY m DESC, w DESC, abs(kw - 0.43::DOUBLE), abs(kt - 0.72::DOUBLE), abs(an - 0.70::DOUBLE), abs(bm - 30), candidate) AS place FROM s""")
def m24(spark, d):
    y = F.when(F.col("label") == "benign", "benign").when(F.col("label") == "botnet", "suspicious_unknown").otherwise("known_attack")
    out = models.select_fusion(scored(spark, d).withColumn("y", y), models.fusion_grid(), "y", {"known": "known_p", "confidence": "confidence", "anomaly": "iso_s", "reconstruction": "rec_s", "signature": "signature_score", "context": "contextual_score", "disagreement": "disagreement"})
    return rounded(out)


@query("m25_operating_curve", f"""WITH {FLOW}, b AS (SELECT iso_s, row_number() OVER (ORDER BY iso_s) AS i, count(*) OVER () AS n FROM flow WHERE label = 'benign'), t AS (SELECT q AS budget, (SELECT min(iso_s) FROM b WHERE i >= ceil((n - 1) * (1 - q)) + 1) AS threshold FROM (SELECT unnest([0.005, 0.01, 0.03, 0.05])::DOUBLE AS q))
SELECT budget, round(threshold, 9) AS threshold, round((SELECT avg((iso_s > threshold)::INT) FROM flow WHERE label = 'benign'), 9) AS benign_fpr, round((SELECT avg((iso_s > threshold)::INT) FROM flow WHERE label = 'dos'), 9) AS detected FROM t""")
def m25(spark, d):
    return rounded(models.operating_curve(flows(spark, d), "iso_s", F.col("label") == "benign", F.col("label") == "dos"))


@query("m26_site_percentiles")
def m26(spark, d):
    f = flows(spark, d).withColumn("fold", (F.col("n") % 2).cast("int"))
    return rounded(models.site_percentiles(f, ["iso_s", "rec_s"], "fold", F.col("label") == "benign", "event_id"))


@query("d4_label_counts", f"WITH {FLOW} SELECT CASE k % 3 WHEN 0 THEN 'dos' WHEN 1 THEN 'benign' ELSE 'port_scan' END AS label, count(*) AS n FROM flow GROUP BY 1")
def d4(spark, d):
    return _cic(spark, d).groupBy(normalize_label(ds.resolve_label(_cic(spark, d), "cic")).alias("label")).agg(F.count("*").alias("n"))


@query("v4_gate_feedback", "SELECT coalesce(CASE WHEN event_id % 2 = 0 AND event_type <> 'view' THEN 'eligible_for_retraining' END, 'ok') AS error_code, count(*) AS n FROM events GROUP BY 1")
def v4(spark, d):
    e = read(spark, d, "events").select((F.col("event_id") % 2 == 0).alias("eligible_for_retraining"), F.when(F.col("event_type") == "view", "benign_new_behaviour").otherwise("false_positive").alias("disposition"))
    return validate.gate_feedback(e).groupBy(F.coalesce("error_code", F.lit("ok")).alias("error_code")).agg(F.count("*").alias("n"))
