"""Evaluation: confusion, per-class scores, calibration, ranking metrics, latency, drift of quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def confusion_matrix(df: DataFrame, labels: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(truth, pred, n) for every pair of labels, zeros included."""
    each = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("l"))
    grid = each.select(F.col("l").alias("truth")).crossJoin(F.broadcast(each.select(F.col("l").alias("pred"))))  # labels are a parameter, a few
    found = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return grid.join(found, ["truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def classification_report(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(label, precision, recall, f1, support) of each label seen in truth or prediction; 0 where a ratio has no denominator."""
    both = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    rows = both.select(F.explode(F.array_distinct(F.array("t", "p"))).alias("label"), "t", "p", "n").groupBy("label").agg(
        F.sum(F.when((F.col("t") == F.col("label")) & (F.col("p") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("t") == F.col("label"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("p") == F.col("label"), F.col("n")).otherwise(0)).alias("predicted"),
    )
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    pr = rows.withColumns({"precision": part(F.col("tp"), F.col("predicted")), "recall": part(F.col("tp"), F.col("support"))})
    return pr.select("label", "precision", "recall", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def summary_scores(df: DataFrame, truth: str = "truth", pred: str = "pred", labels: list[str] | None = None) -> DataFrame:
    """One row: accuracy, balanced accuracy (over labels in truth), macro F1 over the observed and over the fixed labels, weighted F1."""
    r = classification_report(df, truth, pred)
    accuracy = F.sum(F.col("recall") * F.col("support")) / F.sum("support")
    fixed = F.sum(F.when(F.col("label").isin(*(labels or [])), F.col("f1")).otherwise(0.0)) / len(labels) if labels else F.avg("f1")
    return r.agg(
        accuracy.alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1_observed"),
        fixed.alias("macro_f1_fixed"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )


def expected_calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """One row: the mean distance of confidence and truth over bins open below and closed above; 0 is in no bin but counts as a row."""
    at = F.ceil(F.round(F.col(confidence) * bins, 9))
    rows = df.select(F.col(confidence).cast("double").alias("c"), F.col(correct).cast("double").alias("y"), at.alias("bin"))
    each = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("c").alias("c"), F.avg("y").alias("y"))
    return each.agg((F.sum(F.when(F.col("bin") > 0, F.col("n") * F.abs(F.col("c") - F.col("y"))).otherwise(0.0)) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, probability: str, truth: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(probability) - F.col(truth).cast("double"), F.lit(2.0))).alias("brier"))


def multiclass_brier(df: DataFrame, probabilities: Column, one_hot: Column) -> DataFrame:
    """The mean squared distance of two arrays, summed over classes."""
    return df.agg(F.avg(F.aggregate(F.zip_with(probabilities, one_hot, lambda p, y: (p - y) * (p - y)), F.lit(0.0), lambda a, x: a + x)).alias("brier"))


def _ranges(counts: DataFrame, score: str = "score") -> Column:
    """The range of score that a row is in, from 0: bounds are fixed once, as many at most as shuffle partitions, so that every
    use of the column deals rows alike, whether or not an exchange is reused."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = counts.select(F.col(score).cast("double").alias("score")).approxQuantile("score", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = sorted(set(bounds))

    def below(low: int, high: int) -> Column:
        """How many bounds are below the score, known to be from low to high: halved until one number is left; null is in the first range."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.coalesce(F.col(score).cast("double") <= bounds[middle], F.lit(True)), below(low, middle)).otherwise(below(middle + 1, high))

    return below(0, len(bounds))


def _before(totals: DataFrame, names: list[str], descending: bool = False) -> DataFrame:
    """(_part, names): the sums over the ranges before each; as many rows as ranges."""
    before = Window.orderBy(F.desc("_part") if descending else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in names])


def by_threshold(df: DataFrame, score: str, truth: str) -> DataFrame:
    """(score, pos, neg, tp, fp): counts at each distinct score and of all scores not below it.

    Scores are aggregated first; the running sums are made within ranges of scores and offset by the ranges' totals, so no
    task sees all distinct scores.
    """
    each = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    parts = each.withColumn("_part", _ranges(each))
    offsets = _before(parts.groupBy("_part").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n")), ["_p", "_n"], descending=True)
    within = Window.partitionBy("_part").orderBy(F.desc("score"))
    run = parts.withColumns({"tp": F.sum("pos").over(within), "fp": F.sum("neg").over(within)})
    return run.join(F.broadcast(offsets), "_part").select("score", "pos", "neg", (F.col("tp") + F.col("_p")).alias("tp"), (F.col("fp") + F.col("_n")).alias("fp"))


def ranking_scores(df: DataFrame, score: str, truth: str) -> DataFrame:
    """One row: roc_auc (ties count half) and pr_auc (average precision, a step sum over distinct scores); null without both classes."""
    t = by_threshold(df, score, truth)
    total = F.sum("pos")
    lower = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))  # positives above each negative, ties half
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return t.agg(F.try_divide(lower, total * F.sum("neg")).alias("roc_auc"), F.when(F.sum("neg") > 0, F.try_divide(ap, total)).alias("pr_auc"))


def pr_curve_summary(df: DataFrame, score: str) -> DataFrame:
    return df.agg(F.count_distinct(score).alias("thresholds"), F.min(score).cast("double").alias("least"), F.max(score).cast("double").alias("largest"))


def false_alert_rate(df: DataFrame, truth: str, pred: str, ts_us: str) -> DataFrame:
    """One row: benign rows flagged an hour of the observed span (null without one) and alerts for 10,000 benign rows."""
    benign, flagged = F.col(truth) == "benign", F.col(pred) != "benign"
    hours = (F.max(ts_us) - F.min(ts_us)) / 3.6e9
    return df.agg(F.when(hours > 0, F.count_if(benign & flagged) / hours).alias("per_hour"), F.try_divide(F.count_if(benign & flagged) * 10_000, F.count_if(benign)).alias("per_10k_benign"))


def known_unknown(df: DataFrame, truth: str, verdict: str, unknown: Column) -> DataFrame:
    """One row of the open-set rates: benign flagged, unknown found, found or put to review."""
    benign, v = F.col(truth) == "benign", F.col(verdict)
    share = lambda hit, of: F.try_divide(F.count_if(hit & of), F.count_if(of))
    return df.agg(
        F.count_if(unknown).alias("unknown"), F.count_if(~unknown).alias("known"), F.count_if(v == "needs_review").alias("needs_review"), share(v != "benign", benign).alias("benign_fpr"),
        share(v.isin("known_attack", "suspicious_unknown"), unknown).alias("unknown_detect"), share(v != "benign", unknown).alias("unknown_detect_or_review"),
    )


def latency_percentiles(df: DataFrame, column: str) -> DataFrame:
    """One row: p50, p90, p95, p97 and p99, interpolated between ranks; null without a value. Ranks are counted within ranges."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("score")).agg(F.count("*").alias("c"))
    at = _cumulative(counts).crossJoin(F.broadcast(counts.agg(F.sum("c").alias("n"))))  # a row
    value = lambda rank: F.min(F.when(F.col("until") > rank, F.col("score")))
    out = []
    for percent in (50, 90, 95, 97, 99):
        place = (F.col("n") - 1) * (percent / 100)
        part = F.max(place - F.floor(place))
        out.append((value(F.floor(place)) * (1 - part) + value(F.ceil(place)) * part).alias(f"p{percent}"))
    return at.agg(*out)


def higher_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row: the value of rank ceil((n - 1) q), never interpolated."""
    n = df.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"))
    run = _cumulative(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("score")).agg(F.count("*").alias("c")))
    return run.crossJoin(F.broadcast(n)).where(F.col("until") >= F.ceil((F.col("n") - 1) * q) + 1).agg(F.min("score").alias("value"))


def _cumulative(counts: DataFrame) -> DataFrame:
    """(score, c, until): running sums of c by score, made within ranges and offset by the ranges' totals."""
    parts = counts.withColumn("_part", _ranges(counts))
    offsets = _before(parts.groupBy("_part").agg(F.sum("c").alias("_c")), ["_c"])
    run = parts.withColumn("until", F.sum("c").over(Window.partitionBy("_part").orderBy("score")))
    return run.join(F.broadcast(offsets), "_part").select("score", "c", (F.col("until") + F.col("_c")).alias("until"))


def empirical_cdf(df: DataFrame, column: str, knots: int = 2049) -> DataFrame:
    """(value, probability): the right-continuous empirical distribution at the ranks rint(linspace(0, n - 1, k)), one row a value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("score")).agg(F.count("*").alias("c"))
    run = _cumulative(counts)
    n = counts.agg(F.sum("c").alias("n"))
    ranked = run.crossJoin(F.broadcast(n)).withColumn("k", F.least(F.col("n"), F.lit(knots)))
    # a value covers the ranks [until - c, until); a knot j has rank rint(j (n - 1) / (k - 1)), so the first knot at or after a rank is near ceil(rank (k - 1) / (n - 1))
    step = F.when(F.col("k") > 1, (F.col("n") - 1) / (F.col("k") - 1)).otherwise(F.lit(1.0))
    guess = F.floor((F.col("until") - F.col("c")) / step)
    hit = F.exists(F.sequence(guess - 1, guess + 2), lambda j: (j >= 0) & (j <= F.col("k") - 1) & (F.rint(j * step) >= F.col("until") - F.col("c")) & (F.rint(j * step) < F.col("until")))
    return ranked.where(hit).select(F.col("score").alias("value"), (F.col("until") / F.col("n")).alias("probability"))


def empirical_percentile(reference: DataFrame, queries: DataFrame, column: str, id_col: str) -> DataFrame:
    """(id, percentile): the share of reference values not above each query's, by a running count over both and no range join."""
    both = reference.groupBy(F.col(column).cast("double").alias("score")).agg(F.count("*").alias("c")).unionByName(queries.select(F.col(column).cast("double").alias("score"), F.lit(0).cast("long").alias("c")).distinct())
    run = _cumulative(both.groupBy("score").agg(F.sum("c").alias("c")))
    n = reference.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"))
    return queries.select(F.col(id_col), F.col(column).cast("double").alias("score")).join(run, "score").crossJoin(F.broadcast(n)).select(id_col, (F.col("until") / F.col("n")).alias("percentile"))


def stage_profile(df: DataFrame, stage: str, ms: str, rows: str) -> DataFrame:
    """(stage, total_ms, ms_per_flow, share)."""
    each = df.groupBy(stage).agg(F.sum(ms).alias("total_ms"), (F.sum(ms) / F.greatest(F.sum(rows), F.lit(1))).alias("ms_per_flow"))
    return each.crossJoin(F.broadcast(each.agg(F.sum("total_ms").alias("_all")))).withColumn("share", F.col("total_ms") / F.col("_all")).drop("_all")


def error_buckets(df: DataFrame, dimensions: dict[str, Column], truth: str, pred: str, least: int = 5) -> DataFrame:
    """(dimension, category, n, false_positive_rate, miss_rate) of each category of each dimension with enough rows."""
    wide = df.select((F.col(truth) == "benign").alias("_benign"), (F.col(pred) == "benign").alias("_passed"), *[c.cast("string").alias(k) for k, c in dimensions.items()])
    rows = wide.unpivot(["_benign", "_passed"], list(dimensions), "dimension", "category")
    return rows.groupBy("dimension", "category").agg(
        F.count("*").alias("n"), F.try_divide(F.count_if(F.col("_benign") & ~F.col("_passed")), F.count_if("_benign")).alias("false_positive_rate"),
        F.try_divide(F.count_if(~F.col("_benign") & F.col("_passed")), F.count_if(~F.col("_benign"))).alias("miss_rate"),
    ).where(F.col("n") >= least)


def run_summary(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    return df.groupBy(name).agg(*[f(v).alias(f"{v}_{k}") for v in values for k, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def queue_growth(samples: DataFrame, elapsed: str, depth: str) -> DataFrame:
    """One row: the least-squares slope over the second half of the samples; 0 for fewer than four. Samples are numbered in ranges
    of the time, which has no ties."""
    from wiretide.operators.drift import blocked

    placed = blocked(samples.select(F.lit(0).alias("_all"), elapsed, depth), ["_all"], elapsed, 0)
    late = placed.crossJoin(F.broadcast(samples.agg(F.count("*").alias("_of")))).where((F.col("_of") >= 4) & (F.col("_n") > F.floor(F.col("_of") / 2)))
    return late.agg(F.coalesce(F.regr_slope(depth, elapsed), F.lit(0.0)).alias("slope"))
