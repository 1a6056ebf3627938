"""Runtime metrics of streams: what a query observes of its rows, and what Spark tells of its batches, as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

# The codes of rejects and the verdicts that are counted.
ERROR_CODES = ("malformed", "payload_too_large", "missing_fields", "timestamp_order", "src_ip", "dst_ip", "src_port", "dst_port", "duration_ms", "protocol", "signal_range")
VERDICTS = ("benign", "known_attack", "suspicious_unknown", "needs_review")
SCHEMA = "query string, batch long, kind string, metric string, label string, value double"


def observed(found: DataFrame, name: str = "detections", codes: tuple[str, ...] = ERROR_CODES) -> DataFrame:
    """found (as of jobs.detect()) with counters and gauges of each micro-batch, made while its rows go by: rows, sound ones, rejects by
    code (other for codes that aren't named), verdicts, signature matches, the largest risk and the largest lag of event time."""
    count = lambda c, alias: F.count_if(c).alias(alias)
    bad = F.col("error_code").isNotNull()
    lag = F.max(F.unix_millis(F.current_timestamp()) - F.unix_millis(F.col("timestamp_end"))).alias("gauge.lag_ms.event_time")
    return found.observe(
        name, F.count(F.lit(1)).alias("counter.rows.all"), count(~bad, "counter.rows.sound"), *[count(F.col("error_code") == c, f"counter.error.{c}") for c in codes],
        count(bad & ~F.col("error_code").isin(*codes), "counter.error.other"), *[count(~bad & (F.col("verdict") == v), f"counter.verdict.{v}") for v in VERDICTS],
        count(~bad & F.col("signature_severity").isNotNull(), "counter.signal.signature"), F.max(F.when(~bad, F.col("final_risk_score"))).alias("gauge.risk.largest"), lag,
    )


class Recorder(StreamingQueryListener):
    """Keeps a few numbers a micro-batch of the queries of a session; table() gives them as rows. Counters add up over batches, gauges are of the batch."""

    def __init__(self, most: int = 10_000) -> None:
        self.most = most
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        failed = event.exception is not None
        self._add((str(event.id), None, "counter", "terminated", "failed" if failed else "ended", 1.0))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        tell = lambda kind, metric, label, value: self._add((name, p.batchId, kind, metric, label, float(value)))
        tell("counter", "input_rows", "all", p.numInputRows or 0)
        tell("gauge", "rows_per_second", "processed", p.processedRowsPerSecond or 0)
        for stage, ms in (p.durationMs or {}).items():
            tell("gauge", "duration_ms", stage, ms)
        for state in p.stateOperators or []:
            tell("gauge", "state_rows", state.operatorName, state.numRowsTotal)
        for observation, row in (p.observedMetrics or {}).items():
            for key, value in row.asDict().items():
                if value is not None:
                    kind, metric, label = key.split(".", 2)
                    tell(kind, metric, label, value)

    def _add(self, row: tuple) -> None:
        self.rows.append(row)
        del self.rows[: -self.most]

    def table(self, spark: SparkSession) -> DataFrame:
        """(query, batch, kind, metric, label, value) of the last numbers."""
        return spark.createDataFrame(list(self.rows), SCHEMA)


def totals(table: DataFrame) -> DataFrame:
    """(query, kind, metric, label, value): counters added up, gauges of the last batch."""
    last = F.max_by("value", F.coalesce("batch", F.lit(-1)))
    return table.groupBy("query", "kind", "metric", "label").agg(F.when(F.col("kind") == "counter", F.sum("value")).otherwise(last).alias("value"))
