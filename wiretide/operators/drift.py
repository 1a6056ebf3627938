"""Drift: two-window mean shift with hysteresis, runtime signals, rolling flow rate, feature drift."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window, functions as F

from wiretide.functions.scalars import uuid5
from wiretide.operators.metrics import _ranges

#: Rows of a key that one task takes together.
BLOCK = 100_000

# Signals and the shift that counts as drift.
THRESHOLDS = {"anomaly_score": 0.20, "known_class_confidence": 0.20, "flow_rate": 0.15, "feature_duration": 0.15, "feature_bytes_total": 0.15, "feature_packet_length_mean": 0.15, "alert_rate": 0.25}


def _same(keys: list[str], prefix: str) -> Column:
    """Whether the columns equal those with the prefix, null being equal to null."""
    return functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def blocked(rows: DataFrame, by: list[str], order: str, halo: int, most: int = BLOCK, sample: DataFrame | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """rows with _n, their number from 1 within the columns by; _block, the run of `most` of them that they are in; and _own.

    Each block also holds the halo, the last so many rows before it, with _own false: a window that looks back no further can
    be taken by block, so that a key with all the rows is many tasks. order is a number, without ties within a key but for those
    that the columns then put in order. Rows are
    numbered within ranges of the order, offset by a count a key and range. Bounds are taken from the sample, if one is given that
    is cheaper to read than the rows.
    """
    most = max(most, halo)
    ranged = rows.withColumn("_range", _ranges(rows if sample is None else sample, order))
    sizes = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*[F.col(k).alias(f"_of_{k}") for k in [*by, "_range"]], F.coalesce(before, F.lit(0)).alias("_offset"))
    numbered = ranged.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(order, *then))).join(offsets, _same([*by, "_range"], "_of_"))
    mine = F.floor((F.col("_n") - 1) / most)
    in_halo = (F.col("_n") - 1) % most >= most - halo
    placed = numbered.withColumn("_n", F.col("_n") + F.col("_offset")).withColumn("_block", F.explode(F.when(in_halo, F.array(mine, mine + 1)).otherwise(F.array(mine))))
    return placed.withColumn("_own", F.col("_block") == mine).drop("_range", "_offset", *[f"_of_{k}" for k in [*by, "_range"]])


def drift_events(signals: DataFrame, by: list[str], order: str, value: str = "value", threshold: Column | float = 0.20, window: int = 64, block: int = BLOCK) -> DataFrame:
    """The rows at which drift begins, with reference_mean, recent_mean and magnitude: the means of the window rows before the
    last window rows and of the last window rows differ by the threshold or more, and no drift is on. It is over once they
    differ by less than 0.6 of it. Rows before the windows are full decide nothing.

    The state is the last decision before a row, so no loop is needed. Keys are taken in blocks, each of which gives the rows at
    which its decision changes; these few rows of a key are then put in line.
    """
    return _begins(blocked(signals, by, order, 2 * window - 1, block), by, value, threshold, window)


def _begins(at: DataFrame, by: list[str], value: str, threshold: Column | float, window: int) -> DataFrame:
    """drift_events() of rows that are in blocks, with a halo of 2 x window - 1 rows or more."""
    w = Window.partitionBy(*by, "_block").orderBy("_n")
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    means = at.withColumns({
        "reference_mean": F.avg(value).over(w.rowsBetween(-2 * window + 1, -window)), "recent_mean": F.avg(value).over(w.rowsBetween(-window + 1, 0)),
    }).where("_own").withColumn("magnitude", F.abs(F.col("recent_mean") - F.col("reference_mean")))
    full = F.col("_n") >= 2 * window
    turned = means.withColumn("_turn", F.when(full & (F.col("magnitude") >= limit), F.lit(1)).when(full & (F.col("magnitude") < limit * 0.6), F.lit(0)))
    state = F.last("_turn", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    changes = turned.withColumn("_before", state).where("_turn is not null and (_before is null or _before <> _turn)")
    line = Window.partitionBy(*by).orderBy("_n")  # a row a change
    return changes.withColumn("_before", F.coalesce(F.lag("_turn").over(line), F.lit(0))).where("_turn = 1 and _before = 0").drop("_n", "_block", "_own", "_turn", "_before")


def _rated(at: DataFrame, ts_us: str, by: list[str], most: int) -> DataFrame:
    """blocked() rows with flow_rate; the halo must have `most` rows."""
    w = Window.partitionBy(*by, "_block").orderBy("_n")
    parts = at.withColumn("_part", F.sum(F.when(F.col(ts_us) < F.lag(ts_us).over(w), 1).otherwise(0)).over(w))
    p = Window.partitionBy(*by, "_block", "_part").orderBy("_n")
    placed = parts.withColumns({"_i": F.row_number().over(p), "_cap": F.lag(ts_us, most - 1).over(p)})
    # within a part time doesn't fall, so the rows of the last minute up to this one are counted by subtracting those before it
    r = Window.partitionBy(*by, "_block", "_part").orderBy(ts_us).rangeBetween(-60_000_000, 0)
    framed = placed.withColumns({"_first": F.min("_i").over(r), "_start": F.min(ts_us).over(r)})
    n = F.least(F.col("_i") - F.col("_first") + 1, F.lit(most))
    start = F.when(F.col("_i") - F.col("_first") + 1 > most, F.col("_cap")).otherwise(F.col("_start"))
    rate = F.when(n < 2, n.cast("double")).otherwise((n - 1) / F.greatest((F.col(ts_us) - start) / 1e6, F.lit(0.001)))
    return framed.withColumn("flow_rate", F.log1p(F.least(rate, F.lit(10_000.0))) / math.log1p(10_000.0)).drop("_part", "_i", "_cap", "_first", "_start")


def rolling_flow_rate(rows: DataFrame, order: str = "arrival", ts_us: str = "ts_us", by: tuple[str, ...] = ("model_version",), most: int = 256, block: int = BLOCK) -> DataFrame:
    """rows with flow_rate in 0..1: of the last 60 s and at most the last 256 rows, counted anew when time runs back."""
    return _rated(blocked(rows, [*by], order, most, block), ts_us, [*by], most).where("_own").drop("_n", "_block", "_own")


def _signals(detections: DataFrame, order: str, by: list[str], window: int, block: int, halo: int) -> DataFrame:
    """The seven signals of each detection, as rows in blocks whose last `halo` halo rows have right values too."""
    once = detections.withColumn("_rn", F.row_number().over(Window.partitionBy("detection_id").orderBy(order))).where("_rn = 1").drop("_rn")
    w = Window.partitionBy(*by, "_block").orderBy("_n")
    placed = blocked(once, by, order, max(256, window) + halo, block, sample=detections)
    wide = _rated(placed, "ts_us", by, 256).select(
        *by, order, "detection_id", F.col("anomaly_score").cast("double"), F.col("confidence").cast("double").alias("known_class_confidence"), "flow_rate",
        (F.log1p("duration_ms") / math.log1p(86_400_000)).alias("feature_duration"), (F.log1p(F.col("bytes_forward") + F.col("bytes_reverse")) / math.log1p(2e15)).alias("feature_bytes_total"),
        (F.col("packet_length_mean") / 65_535).alias("feature_packet_length_mean"), F.avg((F.col("verdict") != "benign").cast("double")).over(w.rowsBetween(-window + 1, 0)).alias("alert_rate"), "_own", "_n", "_block",
    )
    return wide.unpivot([*by, order, "detection_id", "_own", "_n", "_block"], list(THRESHOLDS), "signal", "value")


def runtime_signals(detections: DataFrame, order: str = "arrival", by: tuple[str, ...] = ("model_version",), window: int = 64, block: int = BLOCK) -> DataFrame:
    """(by, order, detection_id, signal, value): the seven drift signals of each detection, repeated ids once.

    detections has detection_id, ts_us, anomaly_score, confidence, verdict, duration_ms, bytes_forward, bytes_reverse and
    packet_length_mean.
    """
    return _signals(detections, order, [*by], window, block, 0).where("_own").drop("_own", "_n", "_block")


def runtime_drift(detections: DataFrame, order: str = "arrival", by: tuple[str, ...] = ("model_version",), window: int = 64, block: int = BLOCK) -> DataFrame:
    """Drift events of the seven signals, with deterministic ids. Detections are numbered and put in blocks once, before they become
    seven rows each."""
    signals = _signals(detections, order, [*by], window, block, 2 * window - 1)
    limit = F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv])[F.col("signal")]
    found = _begins(signals, [*by, "signal"], "value", limit, window)
    return found.withColumn("event_id", uuid5(F.concat(F.lit("wiretide-drift:"), F.col("detection_id"), F.lit(":"), F.col("signal"), F.lit(":"), F.format_string("%.12f", "magnitude"))))


def feature_drift(reference: DataFrame, comparison: DataFrame, features: list[str]) -> DataFrame:
    """(feature, shift, missing_reference, missing_comparison): how far the mean moved in pooled population deviations, over finite values."""

    def of(df: DataFrame) -> DataFrame:
        ok = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c).cast("double"))
        one = df.agg(*[F.struct(F.avg(ok(c)).alias("m"), F.var_pop(ok(c)).alias("v"), (F.count("*") - F.count(ok(c))).alias("missing")).alias(c) for c in features])
        return one.unpivot([], features, "feature", "s").select("feature", "s.*")

    a, b = of(reference).alias("a"), of(comparison).alias("b")
    pooled = F.greatest(F.sqrt((F.col("a.v") + F.col("b.v")) / 2), F.lit(1e-12))
    return a.join(b, "feature").select("feature", (F.abs(F.col("b.m") - F.col("a.m")) / pooled).alias("shift"), F.col("a.missing").alias("missing_reference"), F.col("b.missing").alias("missing_comparison"))
