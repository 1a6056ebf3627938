"""Detection scores: normalisation, calibration, open-set score, and risk fusion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wiretide.functions.scalars import ladder, severity_from_risk, uuid5

# Explanations of verdicts.
EXPLAIN_BENIGN = "The flow matches the learned benign baseline and has no signature evidence."
EXPLAIN_KNOWN = "Known-threat evidence dominated the fused score: "
EXPLAIN_UNKNOWN = "The flow is statistically unusual without a confident known-attack match; investigate it as suspicious, not as a confirmed zero-day."
EXPLAIN_REVIEW = "Detection signals conflict or sit near a decision threshold; analyst review is needed."


@dataclass(frozen=True)
class FusionConfig:
    version: str = "1.0.0"
    known_weight: float = 0.43
    anomaly_weight: float = 0.27
    signature_weight: float = 0.20
    context_weight: float = 0.10
    known_threshold: float = 0.72
    anomaly_threshold: float = 0.70
    benign_max_risk: float = 30.0
    review_max_risk: float = 54.0
    high_risk: float = 72.0
    critical_risk: float = 90.0

    def __post_init__(self) -> None:
        weights = (self.known_weight, self.anomaly_weight, self.signature_weight, self.context_weight)
        if abs(sum(weights) - 1) > 1e-9 or not all(0 <= x <= 1 for x in (*weights, self.known_threshold, self.anomaly_threshold)):
            raise ValueError("weights must be in 0..1 and sum to 1")
        rising = (self.benign_max_risk, self.review_max_risk, self.high_risk, self.critical_risk)
        if not (0 <= rising[0] and rising[-1] <= 100 and all(a < b for a, b in zip(rising, rising[1:]))):
            raise ValueError("risk thresholds must rise within 0..100")


def unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def rounded(c: Column, digits: int) -> Column:
    """Half up, the same in every engine."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def class_decision(df: DataFrame, probabilities: str = "class_probabilities") -> DataFrame:
    """df with known_p (1 less benign), confidence (the largest) and known_label (the likeliest that isn't benign, the first of equals by name)."""
    p = F.col(probabilities)
    attacks = F.filter(F.map_entries(p), lambda e: e["key"] != "benign")
    best = F.array_sort(attacks, lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1))
    return df.withColumns({"known_p": 1 - F.coalesce(p["benign"], F.lit(0.0)), "confidence": F.array_max(F.map_values(p)), "known_label": F.get(best, F.lit(0))["key"]})


def normalize_isolation(decision: Column, median: float, p03: float, tail: float = 0.70) -> Column:
    return unit((F.lit(median) - decision) / max(median - p03, 1e-9) * tail)


def logistic_isolation(decision: Column, center: float = 0.0, scale: float = 0.1) -> Column:
    """Where no benign quantiles are known."""
    return unit(1 / (1 + F.exp((decision - center) / max(scale, 1e-6))))


def normalize_reconstruction(error: Column, p50: float, p97: float, tail: float = 0.70) -> Column:
    return unit((error - p50) / max(p97 - p50, 1e-9) * tail)


def anomaly_score(isolation: Column, reconstruction: Column, validation_scale: float = 1.0) -> Column:
    return F.greatest(unit(isolation * validation_scale), unit(reconstruction * validation_scale))


def knot_percentile(score: Column, values: list[float], probabilities: list[float]) -> Column:
    """The calibrated percentile of a score: interpolated between knots, 0 below the first, 1 from the last on."""
    knots = F.array(*[F.struct(F.lit(float(v)).alias("v"), F.lit(float(p)).alias("p")) for v, p in zip(values, probabilities)])
    below = F.element_at(F.filter(knots, lambda k: k["v"] <= score), -1)
    above = F.get(F.filter(knots, lambda k: k["v"] > score), F.lit(0))
    between = below["p"] + (score - below["v"]) / (above["v"] - below["v"]) * (above["p"] - below["p"])
    return F.when(score < values[0], F.lit(0.0)).when(score >= values[-1], F.lit(1.0)).otherwise(between)


def uncertainty(probabilities: Column) -> Column:
    """The largest of 1 less the top probability, 1 less its lead, and the normalised entropy. probabilities is an array."""
    p = F.sort_array(probabilities, asc=False)
    n = F.size(p)
    entropy = -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.log(F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0)))) / F.log(F.greatest(n, F.lit(2)).cast("double"))
    return F.when(n <= 1, 1 - F.get(p, F.lit(0))).otherwise(unit(F.greatest(1 - F.get(p, F.lit(0)), 1 - (F.get(p, F.lit(0)) - F.get(p, F.lit(1))), entropy)))


def open_set_score(anomaly: Column, probabilities: Column) -> Column:
    return anomaly * uncertainty(probabilities)


def out_of_range(*signals: Column) -> Column:
    """Whether a signal is null or outside of 0..1."""
    return ~F.coalesce(F.forall(F.array(*signals), lambda v: v.between(0, 1)), F.lit(False))


def risk_of(known: Column, unusual: Column, signature: Column, context: Column, disagreement: Column, t) -> Column:
    """The risk by a configuration, whose fields may be columns."""
    score = 100 * (t.known_weight * known + t.anomaly_weight * unusual + t.signature_weight * signature + t.context_weight * context) + 8 * disagreement
    return rounded(F.least(score, F.lit(100.0)), 2)


def verdict_of(risk: Column, known: Column, confidence: Column, unusual: Column, signature: Column, t) -> Column:
    """The verdict by a configuration, whose fields may be columns."""
    return ladder([
        ((signature >= 0.5) | (known >= t.known_threshold) & (confidence >= 0.58), F.lit("known_attack")),
        ((unusual >= t.anomaly_threshold) & (known < t.known_threshold), F.lit("suspicious_unknown")),
        ((risk <= t.benign_max_risk) & (unusual < t.anomaly_threshold), F.lit("benign")),
    ], F.lit("needs_review"))


def fuse_risk(df: DataFrame, known: str, confidence: str, anomaly: str, reconstruction: str, signature: str, context: str, disagreement: str, config: FusionConfig = FusionConfig()) -> DataFrame:
    """df with final_risk_score, reason_codes, verdict, severity, explanation and error_code (set where a signal lies outside of 0..1).

    The columns are those of the seven signals. Risk is rounded half up to two digits.
    """
    k, conf, a, r, s, x, d = (F.col(c).cast("double") for c in (known, confidence, anomaly, reconstruction, signature, context, disagreement))
    bad = out_of_range(k, conf, a, r, s, x, d)
    unusual = F.greatest(a, r)
    t = config
    marks = {
        "SURICATA_SIGNATURE_MATCH": s >= 0.5, "HIGH_KNOWN_ATTACK_PROBABILITY": k >= t.known_threshold, "ISOLATION_OUTLIER": a >= t.anomaly_threshold,
        "HIGH_RECONSTRUCTION_ERROR": r >= t.anomaly_threshold, "LOW_CLASSIFIER_CONFIDENCE": conf < 0.58, "UNUSUAL_DESTINATION_FANOUT": x >= 0.65, "MODEL_DISAGREEMENT": d >= 0.5,
    }
    risk = F.col("final_risk_score")
    scored = df.withColumns({
        "error_code": F.when(bad, F.lit("signal_range")), "final_risk_score": F.when(~bad, risk_of(k, unusual, s, x, d, t)),
        "reason_codes": F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in marks.items()])),
    }).withColumns({"verdict": F.when(bad, F.lit("processing_error")).otherwise(verdict_of(risk, k, conf, unusual, s, t)), "severity": severity_from_risk(risk, t.benign_max_risk, t.review_max_risk, t.high_risk, t.critical_risk)})
    v = F.col("verdict")
    said = ladder([(v == "benign", F.lit(EXPLAIN_BENIGN)), (v == "known_attack", F.concat(F.lit(EXPLAIN_KNOWN), F.array_join("reason_codes", ", "))), (v == "suspicious_unknown", F.lit(EXPLAIN_UNKNOWN))], F.lit(EXPLAIN_REVIEW))
    return scored.withColumn("explanation", said)


def build_detection(scored: DataFrame, version: str = "1.0.0", config: FusionConfig = FusionConfig()) -> DataFrame:
    """Detection rows of scored flows: scores to 8 digits, a deterministic id from flow and model version, the label only if it is likely enough.

    Detections carry event time, the end of the flow, so that batch and stream agree.
    """
    e = lambda x: rounded(F.col(x), 8).alias(x)
    label = F.col("known_label") if "known_label" in scored.columns else F.lit(None).cast("string")
    return scored.select(
        uuid5(F.concat(F.lit("wiretide-detection:"), F.col("event_id"), F.lit(f":{version}"))).alias("detection_id"),
        F.col("event_id").alias("flow_event_id"), F.col("timestamp_end").alias("timestamp"),
        F.when(F.col("known_p") >= config.known_threshold, label).alias("known_attack_label"),
        rounded(F.col("known_p"), 8).alias("known_attack_probability"), rounded(F.col("confidence"), 8).alias("classifier_confidence"),
        e("anomaly_score"), F.col("signature_score"), F.col("contextual_score"), "final_risk_score", "verdict", "severity", "reason_codes", "explanation",
        F.lit(version).alias("classifier_model_version"), F.lit(config.version).alias("threshold_version"),
    )
