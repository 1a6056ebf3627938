"""Validation: every rule is an expression that gives an error code; bad rows are set apart, never changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiretide.functions.scalars import SEVERITIES, ip_hex

# What the contracts allow.
CAPTURE_MODES = ("demo", "pcap", "live")
DIRECTIONS = ("outbound", "inbound", "lateral", "unknown")
VERDICTS = ("benign", "known_attack", "suspicious_unknown", "needs_review", "processing_error")
#: Feature and its largest value; the least is 0.
REGISTRY_LIMITS = {
    "duration_ms": 86_400_000, "packets_forward": 1e9, "packets_reverse": 1e9, "bytes_forward": 1e15, "bytes_reverse": 1e15, "packet_rate": 1e9, "byte_rate": 1e15,
    "packet_length_mean": 65_535, "packet_length_std": 65_535, "iat_mean": 86_400_000, "iat_std": 86_400_000, "tcp_syn_count": 1e9, "tcp_rst_count": 1e9,
    "destination_port": 65_535, "forward_reverse_byte_ratio": 1e12, "syn_ack_ratio": 1e9, "packets_total": 2e9, "bytes_total": 2e15,
}


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))


def first_error(rules: dict[str, Column]) -> Column:
    """The name of the first rule that doesn't hold (null counts as not holding); null if all do."""
    return F.get(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()])), F.lit(0))


def with_error(df: DataFrame, rules: dict[str, Column], column: str = "error_code") -> DataFrame:
    return df.withColumn(column, first_error(rules))


def split(df: DataFrame, column: str = "error_code") -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows: one bad row never fails a batch."""
    return df.where(F.col(column).isNull()).drop(column), df.where(F.col(column).isNotNull())


def flow_rules(df: DataFrame, ipv6: bool = True) -> dict[str, Column]:
    """The flow contract for the columns that df has; ids, addresses, times and counters are required."""
    has = set(df.columns)
    c = F.col
    need = [x for x in ("event_id", "sensor_id", "timestamp_start", "timestamp_end", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "duration_ms", "packets_forward", "packets_reverse", "bytes_forward", "bytes_reverse") if x not in has]
    rules: dict[str, Column] = {f"missing_{x}": F.lit(False) for x in need}
    length = lambda x, most, least=1: F.char_length(x).between(least, most)
    if "sensor_id" in has:
        rules["sensor_id"] = length(c("sensor_id"), 128)
    if "protocol" in has:
        rules["protocol"] = length(c("protocol"), 32)
    if "application_protocol" in has:
        rules["application_protocol"] = c("application_protocol").isNull() | length(c("application_protocol"), 64, 0)
    if "direction" in has:
        rules["direction"] = c("direction").isin(*DIRECTIONS)
    if "capture_mode" in has:
        rules["capture_mode"] = c("capture_mode").isin(*CAPTURE_MODES)
    if {"timestamp_start", "timestamp_end"} <= has:
        rules["timestamp_order"] = c("timestamp_end") >= c("timestamp_start")
    for x in ("src_port", "dst_port"):
        if x in has:
            rules[x] = c(x).between(0, 65_535)
    for x in ("duration_ms", "packet_rate", "byte_rate", "packet_length_min", "packet_length_max", "packet_length_mean", "packet_length_std", "iat_min", "iat_max", "iat_mean", "iat_std"):
        if x in has:
            rules[x] = finite(c(x)) & (c(x) >= 0)
    for x in ("packets_forward", "packets_reverse", "bytes_forward", "bytes_reverse", "tcp_syn_count", "tcp_ack_count", "tcp_fin_count", "tcp_rst_count", "tcp_psh_count"):
        if x in has:
            rules[x] = c(x) >= 0
    if {"src_ip", "dst_ip"} <= has:
        a, b = ip_hex(c("src_ip"), ipv6), ip_hex(c("dst_ip"), ipv6)
        rules["src_ip"], rules["dst_ip"] = a.isNotNull(), b.isNotNull()
        rules["ip_version"] = F.length(a) == F.length(b)
        if "ip_version" in has:
            rules["ip_version"] &= F.length(a) == F.when(c("ip_version") == 4, 8).when(c("ip_version") == 6, 32)
    for low, high in (("packet_length_min", "packet_length_max"), ("iat_min", "iat_max")):
        if {low, high} <= has:
            rules[f"{low}_order"] = c(low) <= c(high)
    for x, ok in (("first_packet_sizes", lambda v: v >= 0), ("first_packet_directions", lambda v: v.isin(-1, 1)), ("first_packet_interarrival_times", lambda v: v >= 0)):
        if x in has:
            rules[x] = (F.size(x) <= 20) & F.forall(x, ok)
    if "community_flow_id" in has:
        rules["community_flow_id"] = length(c("community_flow_id"), 160)
    return rules


def validate_flow(df: DataFrame, ipv6: bool = True) -> DataFrame:
    """df with error_code: the first rule of the flow contract that a row breaks."""
    return with_error(df, flow_rules(df, ipv6))


def validate_signature(df: DataFrame) -> DataFrame:
    c = F.col
    return with_error(df, {"raw_event_hash": c("raw_event_hash").rlike("^[a-f0-9]{64}$"), "severity": c("severity").isin(*SEVERITIES), "source": c("source").isin("suricata", "fixture"), "signature_id": F.char_length("signature_id") >= 1})


def validate_detection(df: DataFrame) -> DataFrame:
    """Unit ranges, risk up to 100, known verdicts, and class probabilities that sum to 1 within 1e-5."""
    c = F.col
    unit = [x for x in ("known_attack_probability", "classifier_confidence", "anomaly_score", "anomaly_percentile", "open_set_score", "reconstruction_score", "signature_score", "contextual_score") if x in df.columns]
    rules = {x: c(x).between(0, 1) for x in unit}
    rules |= {"final_risk_score": c("final_risk_score").between(0, 100), "verdict": c("verdict").isin(*VERDICTS), "severity": c("severity").isin(*SEVERITIES)}
    if "class_probabilities" in df.columns:
        p = F.map_values("class_probabilities")
        rules["class_probabilities"] = F.forall(p, lambda x: x.between(0, 1)) & (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) <= 1e-5)
    return with_error(df, rules)


def gate_feedback(df: DataFrame) -> DataFrame:
    """Feedback may be marked for retraining only as benign new behaviour."""
    return with_error(df, {"eligible_for_retraining": ~F.col("eligible_for_retraining") | (F.col("disposition") == "benign_new_behaviour")})


def registry_rules(columns: dict[str, float] = REGISTRY_LIMITS) -> dict[str, Column]:
    return {x: finite(F.col(x)) & F.col(x).cast("double").between(0.0, float(most)) for x, most in columns.items()}


def registry_range_check(features: DataFrame) -> DataFrame:
    """features with error_code: the first registry feature that isn't finite or lies outside of its range."""
    return with_error(features, registry_rules())


def validate_observation(df: DataFrame, ipv6: bool = True) -> DataFrame:
    c = F.col
    rules = {x: F.char_length(x) >= 1 for x in ("event_id", "sensor_id")} | {"timestamp": c("timestamp").isNotNull()}
    rules |= {"ip_version": F.length(ip_hex(c("src_ip"), ipv6)) == F.length(ip_hex(c("dst_ip"), ipv6))}
    rules |= {x: finite(c(x)) & (c(x) >= 0) for x in ("duration_ms", "packets_forward", "packets_reverse", "bytes_forward", "bytes_reverse")}
    return with_error(df, rules | {"dst_port": c("dst_port").isNull() | c("dst_port").between(0, 65_535)})


def matching(df: DataFrame, host: str | None = None, start=None, end=None, severity: str | None = None, verdict: str | None = None, protocol: str | None = None, time_col: str = "timestamp_start") -> DataFrame:
    """The optional filters of the query layer. They are plain predicates, so scans prune by them."""
    c = F.col
    for value in (start, end):
        if value is not None and value.tzinfo is None:
            raise ValueError("times must name their zone")
    if start is not None and end is not None and start > end:
        raise ValueError("start is after end")
    if host is not None:
        df = df.where((c("src_ip") == host) | (c("dst_ip") == host))
    if start is not None:
        df = df.where(c(time_col) >= F.lit(start))
    if end is not None:
        df = df.where(c(time_col) <= F.lit(end))
    for column, value in (("severity", severity), ("verdict", verdict), ("protocol", protocol and protocol.strip().upper())):
        if value is not None:
            df = df.where(c(column) == value)
    return df


def text_search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows whose columns, joined by spaces, hold the text in any case."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(x).cast("string") if dict(df.dtypes)[x] != "array<string>" else F.col(x) for x in columns])), F.lit(text.strip().lower())))
