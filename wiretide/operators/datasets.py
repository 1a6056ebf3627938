"""Dataset harmonisation: canonical features by alias, labels, quality, splits, leakage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from wiretide.scratch import checkpoints
from wiretide.functions.scalars import normalize_label
from wiretide.operators.features import REGISTRY
from wiretide.operators.validate import REGISTRY_LIMITS, finite

# Source columns of the public flow datasets, by canonical feature, each with its scale.
_KINDS: dict[str, dict[str, tuple[tuple[str, ...], float]]] = {
    "cic": {
        "duration_ms": (("Flow Duration",), 0.001), "packets_forward": (("Total Fwd Packets", "Tot Fwd Pkts"), 1), "packets_reverse": (("Total Backward Packets", "Tot Bwd Pkts"), 1),
        "bytes_forward": (("Total Length of Fwd Packets", "TotLen Fwd Pkts"), 1), "bytes_reverse": (("Total Length of Bwd Packets", "TotLen Bwd Pkts"), 1), "packet_rate": (("Flow Packets/s", "Flow Pkts/s"), 1), "byte_rate": (("Flow Bytes/s", "Flow Byts/s"), 1),
        "packet_length_mean": (("Packet Length Mean", "Pkt Len Mean"), 1), "packet_length_std": (("Packet Length Std", "Pkt Len Std"), 1), "iat_mean": (("Flow IAT Mean",), 0.001), "iat_std": (("Flow IAT Std",), 0.001),
        "tcp_syn_count": (("SYN Flag Count", "SYN Flag Cnt"), 1), "tcp_ack_count": (("ACK Flag Count", "ACK Flag Cnt"), 1), "tcp_rst_count": (("RST Flag Count", "RST Flag Cnt"), 1), "destination_port": (("Destination Port", "Dst Port"), 1),
    },
    "unsw": {
        "duration_ms": (("dur",), 1000), "packets_forward": (("spkts",), 1), "packets_reverse": (("dpkts",), 1), "bytes_forward": (("sbytes",), 1), "bytes_reverse": (("dbytes",), 1), "packet_rate": (("rate",), 1), "byte_rate_forward": (("sload",), 0.125), "byte_rate_reverse": (("dload",), 0.125),
        "packet_length_mean_forward": (("smean",), 1), "packet_length_mean_reverse": (("dmean",), 1), "iat_mean_forward": (("sinpkt",), 1), "iat_mean_reverse": (("dinpkt",), 1), "destination_port": (("dsport", "destination_port"), 1),
    },
    "nfstream": {
        "duration_ms": (("duration_ms", "bidirectional_duration_ms"), 1), "packets_forward": (("packets_forward", "src2dst_packets"), 1), "packets_reverse": (("packets_reverse", "dst2src_packets"), 1), "bytes_forward": (("bytes_forward", "src2dst_bytes"), 1), "bytes_reverse": (("bytes_reverse", "dst2src_bytes"), 1),
        "packet_rate": (("packet_rate", "bidirectional_packets_rate"), 1), "byte_rate": (("byte_rate", "bidirectional_bytes_rate"), 1), "packet_length_mean": (("packet_length_mean", "bidirectional_mean_ps"), 1), "packet_length_std": (("packet_length_std", "bidirectional_stddev_ps"), 1),
        "iat_mean": (("iat_mean", "bidirectional_mean_piat_ms"), 1), "iat_std": (("iat_std", "bidirectional_stddev_piat_ms"), 1), "tcp_syn_count": (("tcp_syn_count", "bidirectional_syn_packets"), 1), "tcp_ack_count": (("tcp_ack_count", "bidirectional_ack_packets"), 1),
        "tcp_rst_count": (("tcp_rst_count", "bidirectional_rst_packets"), 1), "destination_port": (("destination_port", "dst_port"), 1),
    },
    "hikari": {
        "duration_ms": (("flow_duration",), 1000), "packets_forward": (("fwd_pkts_tot",), 1), "packets_reverse": (("bwd_pkts_tot",), 1), "bytes_forward_payload": (("fwd_pkts_payload.tot",), 1), "bytes_reverse_payload": (("bwd_pkts_payload.tot",), 1),
        "bytes_forward_header": (("fwd_header_size_tot",), 1), "bytes_reverse_header": (("bwd_header_size_tot",), 1), "packet_rate": (("flow_pkts_per_sec",), 1), "byte_rate": (("payload_bytes_per_second",), 1), "packet_length_std": (("flow_pkts_payload.std",), 1),
        "iat_mean": (("flow_iat.avg",), 0.001), "iat_std": (("flow_iat.std",), 0.001), "tcp_syn_count": (("flow_SYN_flag_count",), 1), "tcp_ack_count": (("flow_ACK_flag_count",), 1), "tcp_rst_count": (("flow_RST_flag_count",), 1), "destination_port": (("responp",), 1),
    },
    "iot23": {"duration_ms": (("duration",), 1000), "packets_forward": (("orig_pkts",), 1), "packets_reverse": (("resp_pkts",), 1), "bytes_forward": (("orig_ip_bytes",), 1), "bytes_reverse": (("resp_ip_bytes",), 1), "destination_port": (("id.resp_p",), 1)},
}
LABEL_COLUMNS = {"cic": ("Label",), "unsw": ("attack_cat", "label"), "nfstream": ("label",), "hikari": ("traffic_category", "Label"), "iot23": ("detailed-label", "label")}
DERIVED = ("packet_length_std", "iat_mean", "iat_std", "tcp_syn_count", "tcp_rst_count", "tcp_ack_count")


def squash(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.strip().lower())


def lookup(df: DataFrame, *names: str) -> str | None:
    """The first column of df that one of the names stands for."""
    have = {squash(c): c for c in reversed(df.columns)}
    return next((have[squash(n)] for n in names if squash(n) in have), None)


def drop_repeated_headers(df: DataFrame) -> DataFrame:
    """Without rows that repeat the header inside of a file."""
    same = [F.coalesce(F.trim(F.col(f"`{c}`").cast("string")) == c.strip(), F.lit(False)) for c in df.columns[:3]]
    out = same[0]
    for s in same[1:]:
        out = out & s
    return df.where(~out)


def canonicalize(df: DataFrame, kind: str, label: str | None = None, group: str | None = None) -> tuple[DataFrame, tuple[str, ...]]:
    """The 18 canonical features, raw_label, label and group of a public dataset's rows, and notes on what was derived.

    Columns are found by name without case and punctuation and cast to numbers (null if they aren't). Directional means are
    weighted by packets, directional rates added, header and payload bytes added; what a source lacks is 0, with a note.
    """
    d = lambda c: F.col(f"`{c}`").try_cast("double")
    v: dict[str, Column] = {}
    for feature, (names, scale) in _KINDS[kind].items():
        if column := lookup(df, *names):
            v[feature] = d(column) * float(scale)
    notes = []
    if kind == "iot23":
        v["duration_ms"], v["destination_port"] = F.coalesce(v["duration_ms"], F.lit(0.0)), F.coalesce(v["destination_port"], F.lit(0.0))
        notes.append("flows without an interval or a port have 0; rates are over at least a microsecond")
    if kind == "unsw" and "destination_port" not in v:
        v["destination_port"] = F.lit(0.0)
        notes.append("destination_port is 0: the source has none")
    for side in ("forward", "reverse"):
        if f"bytes_{side}_payload" in v and f"bytes_{side}_header" in v:
            v[f"bytes_{side}"] = v[f"bytes_{side}_payload"] + v[f"bytes_{side}_header"]
            notes.append(f"bytes_{side} adds payload and headers")
    if missing := [x for x in ("duration_ms", "packets_forward", "packets_reverse", "bytes_forward", "bytes_reverse", "destination_port") if x not in v]:
        raise ValueError("the dataset lacks " + ", ".join(missing))
    packets, size = v["packets_forward"] + v["packets_reverse"], v["bytes_forward"] + v["bytes_reverse"]
    some = F.when(packets > 0, packets)
    for name in ("packet_length_mean", "iat_mean"):
        if f"{name}_forward" in v and f"{name}_reverse" in v:
            v[name] = (v[f"{name}_forward"] * v["packets_forward"] + v[f"{name}_reverse"] * v["packets_reverse"]) / some
            notes.append(f"{name} is weighted by packets")
    if "byte_rate_forward" in v and "byte_rate_reverse" in v:
        v["byte_rate"] = v["byte_rate_forward"] + v["byte_rate_reverse"]
        notes.append("byte_rate adds both directions")
    seconds = v["duration_ms"] / 1000
    floor = F.greatest(seconds, F.lit(1e-6)) if kind == "iot23" else F.when(seconds > 0, seconds)
    v.setdefault("packet_rate", packets / floor)
    v.setdefault("byte_rate", size / floor)
    v.setdefault("packet_length_mean", size / (F.greatest(packets, F.lit(1.0)) if kind == "iot23" else some))
    for name in DERIVED:
        if name not in v:
            v[name] = F.lit(0.0)
            notes.append(f"{name} is 0: the source has none")
    v |= {"forward_reverse_byte_ratio": v["bytes_forward"] / F.greatest(v["bytes_reverse"], F.lit(1.0)), "syn_ack_ratio": v["tcp_syn_count"] / F.greatest(v["tcp_ack_count"], F.lit(1.0)), "packets_total": packets, "bytes_total": size}
    raw = resolve_label(df, kind, label)
    of = F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("<missing>")) if group else F.lit("all")
    return df.select(*[v[f].alias(f) for f in REGISTRY], raw.alias("raw_label"), normalize_label(raw).alias("label"), of.alias("group")), tuple(notes)


def resolve_label(df: DataFrame, kind: str, label: str | None = None) -> Column:
    """The label text: a named column, or the dataset's own in order of preference; a blank or dash falls through to the next."""
    names = (label,) if label else LABEL_COLUMNS[kind]
    found = [c for n in names if (c := lookup(df, n))]
    if not found:
        raise ValueError("the dataset has no label column")
    text = [F.trim(F.col(f"`{c}`").cast("string")) for c in found]
    return F.coalesce(*[F.when((t != "") & (t != "-"), t) for t in text], F.lit(""))


def registry_exclusion(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose features are finite and in range; and, as one row, how many weren't."""
    ok = F.lit(True)
    for name, most in REGISTRY_LIMITS.items():
        ok = ok & finite(F.col(name)) & F.col(name).between(0.0, float(most))
    return df.where(ok), df.agg(F.count_if(~ok).alias("excluded"))


def quality_profile(df: DataFrame, features: list[str], limits: dict[str, tuple[float, float]] | None = None, label: str = "label") -> DataFrame:
    """(feature, distinct, constant, missing, infinite, out_of_range), one row a feature, from one aggregate. NaN and null are missing."""
    limits = limits or {}
    d = lambda c: F.col(c).cast("double")
    gone = lambda c: d(c).isNull() | F.isnan(d(c))
    each = lambda c: F.struct(
        (F.count_distinct(F.when(~gone(c), d(c))) + F.max(gone(c).cast("int"))).alias("distinct"), F.count_if(gone(c)).alias("missing"), F.count_if(~gone(c) & (F.abs(d(c)) == float("inf"))).alias("infinite"),
        (F.count_if((d(c) < limits[c][0]) | (~gone(c) & (d(c) > limits[c][1]))) if c in limits else F.lit(0).cast("long")).alias("out_of_range"),
    )
    return df.agg(*[each(c).alias(c) for c in features]).unpivot([], features, "feature", "s").select("feature", "s.distinct", (F.col("s.distinct") <= 1).alias("constant"), "s.missing", "s.infinite", "s.out_of_range")


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows that repeat an earlier one in these columns."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def quality_report(df: DataFrame, features: list[str], limits: dict[str, tuple[float, float]] | None = None, label: str = "label", group: str = "group") -> DataFrame:
    """The report on a development dataset as one frame (section, item, value): rows, classes, rows of each class and group, repeated rows,
    vectors with more than one label, and of each feature what is distinct, missing, infinite or out of range; and as section blocking
    what must be nothing for the set to be used: no rows, one class, constant features, missing or infinite values, conflicts."""
    item = lambda section, name, value, rows: rows.select(F.lit(section).alias("section"), name.alias("item"), value.cast("long").alias("value"))
    profile = quality_profile(df, features, limits, label)
    each = profile.unpivot(["feature"], [F.col("distinct").cast("long").alias("distinct"), F.col("missing").cast("long").alias("missing"), F.col("infinite").cast("long").alias("infinite"), F.col("out_of_range").cast("long").alias("out_of_range")], "measure", "n")
    count = lambda c: df.groupBy(c).agg(F.count("*").alias("n"))
    vectors = df.groupBy(*features).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels"))
    repeated = vectors.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"), F.count_if(F.col("labels") > 1).alias("conflicting_vectors"))
    totals = df.agg(F.count("*").alias("rows"), F.count_distinct(label).alias("classes"))
    bad = profile.agg(F.count_if(F.col("constant")).alias("constant_features"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_values"), F.coalesce(F.sum("infinite"), F.lit(0)).alias("infinite_values"))
    one = totals.crossJoin(F.broadcast(repeated)).crossJoin(F.broadcast(bad))  # a row each
    blocking = one.selectExpr(
        "stack(6, 'no_rows', cast(rows = 0 as bigint), 'one_class', cast(classes < 2 as bigint), 'constant_features', constant_features, 'missing_values', missing_values, "
        "'infinite_values', infinite_values, 'conflicting_vectors', conflicting_vectors) as (item, value)"
    ).where("value > 0")
    told = one.unpivot([], ["rows", "classes", "duplicate_rows", "conflicting_vectors"], "item", "value")
    parts = [
        item("rows", F.col("item"), F.col("value"), told), item("label", F.col(label).cast("string"), F.col("n"), count(label)), item("group", F.col(group).cast("string"), F.col("n"), count(group)),
        item("feature", F.concat("feature", F.lit("."), "measure"), F.col("n"), each), item("blocking", F.col("item"), F.col("value"), blocking),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def identifier_like(name: str) -> bool:
    n = squash(name)
    return n in {"id", "recordid", "uid", "originh", "responh", "idorigh", "idresph"} or any(t in n for t in ("srcip", "sourceip", "dstip", "destinationip", "flowid", "sessionid"))


def column_label_purity(df: DataFrame, columns: list[str], label: str = "label", most: int = 10_000) -> DataFrame:
    """(column, distinct, unique_ratio, purity, suspicious): how well a column's value alone tells the label. Nulls are a value; purity is 0 beyond `most` values."""
    long = df.select(F.col(label).alias("_label"), *[F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias(c) for c in columns]).unpivot(["_label"], columns, "column", "value")
    pairs = long.groupBy("column", "value", "_label").agg(F.count("*").alias("n"))
    values = pairs.groupBy("column", "value").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    out = values.groupBy("column").agg(F.count("*").alias("distinct"), F.sum("n").alias("rows"), F.sum("top").alias("top"))
    purity = F.when(F.col("distinct") <= F.least(F.lit(most), F.col("rows")), F.col("top") / F.col("rows")).otherwise(0.0)
    ratio = F.col("distinct") / F.col("rows")
    return out.select("column", "distinct", ratio.alias("unique_ratio"), purity.alias("purity"), ((purity >= 0.98) & ratio.between(0.001, 0.95)).alias("suspicious"))


def dataset_fingerprint(files: DataFrame, name: str) -> DataFrame:
    """One row: a digest of the files' digests in order, the name and the number of rows. files has path, sha256 and rows: a row a file."""
    return files.agg(F.sha2(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda f: f["sha256"]), ""), F.lit(name), F.sum("rows").cast("string")).cast("binary"), 256).alias("fingerprint"))


def row_overlap(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """One row: test rows, those whose columns all equal those of some train row (nulls equal), and their share."""
    known = train.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct().withColumn("_hit", F.lit(1))
    on = None
    for c in columns:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = same if on is None else on & same
    return test.join(known, on, "left").agg(F.count("*").alias("rows"), F.count("_hit").alias("overlapping")).withColumn("share", F.try_divide(F.col("overlapping"), F.col("rows")))


def frozen_sources(inputs: DataFrame, frozen: DataFrame) -> DataFrame:
    """Training inputs whose digest is one of the frozen set; must be empty."""
    return inputs.join(frozen.select("sha256").distinct(), "sha256", "left_semi")


def dedupe_conflicts(df: DataFrame, features: list[str], label: str, id_col: str) -> DataFrame:
    """One row a feature vector, that of the least id, without vectors that occur with more than one label."""
    return df.groupBy(*features).agg(F.min_by(F.struct(label, id_col), id_col).alias("_first"), F.min(label).alias("_a"), F.max(label).alias("_b")).where("_a = _b").select(*features, f"_first.{label}", f"_first.{id_col}")


def capped_sample(df: DataFrame, id_col: str, n: int, by: str | None = None, seed: int = 0) -> DataFrame:
    """At most n rows (of each class), by a seeded hash of the id: a sampling operator."""
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    if by is None:
        return df.orderBy(h, id_col).limit(n)
    # rows are counted in 4,096 bins of the hash; only those of the bins that reach up to the n-th are ranked
    binned = df.withColumn("_bin", F.shiftright(h, 52))
    before = F.sum("_c").over(Window.partitionBy(by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    needed = binned.groupBy(by, "_bin").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < n).select(F.col(by).alias("_of"), F.col("_bin").alias("_in"))
    few = binned.join(needed, F.col(by).eqNullSafe(F.col("_of")) & (F.col("_bin") == F.col("_in")), "left_semi")
    w = Window.partitionBy(by).orderBy(h, id_col)
    return few.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn", "_bin")


def time_split(df: DataFrame, ts: str, id_col: str, test_share: float = 0.2) -> DataFrame:
    """df with split: the first 1 - test_share of rows by time and id train.

    The cut is found from counts of distinct times. Of the rows of the time at the cut the ids are sorted by ranges and counted
    by range; the range that holds the last one that trains is ranked, and its id is the bound. No other row is ranked.
    """
    from wiretide.operators.metrics import _cumulative

    spark = df.sparkSession
    checkpoints(spark)
    counts = df.groupBy(F.col(ts).alias("score")).agg(F.count("*").alias("c"))
    total = counts.agg(F.floor(F.sum("c") * (1 - test_share)).alias("_cut"))
    at = _cumulative(counts).crossJoin(F.broadcast(total)).where("until >= _cut").agg(F.min("score").alias("_t"), F.min_by(F.col("_cut") - (F.col("until") - F.col("c")), "score").alias("_left")).checkpoint()
    ties = df.join(F.broadcast(at), F.col(ts) == F.col("_t")).select(F.col(id_col).alias("_id"), "_left")
    dealt = ties.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_id").withColumn("_range", F.spark_partition_id()).checkpoint()
    upto = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = dealt.groupBy("_range", "_left").agg(F.count("*").alias("_size")).withColumn("_before", upto).where((F.col("_before") < F.col("_left")) & (F.col("_left") <= F.col("_before") + F.col("_size")))
    ranked = dealt.join(F.broadcast(starts.select("_range", "_before")), "_range").withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("_id")))
    bound = ranked.where("_rank = _left").agg(F.max("_id").alias("_bound"))
    train = (F.col(ts) < F.col("_t")) | ((F.col(ts) == F.col("_t")) & F.coalesce(F.col(id_col) <= F.col("_bound"), F.lit(False)))
    return df.crossJoin(F.broadcast(at)).crossJoin(F.broadcast(bound)).withColumn("split", F.when(train, "train").otherwise("test")).drop("_t", "_left", "_bound")


def group_split(df: DataFrame, group: str, test_share: float = 0.2, seed: int = 0) -> DataFrame:
    """df with split: whole groups (a capture day, a file) go to either side, by a seeded hash of the group."""
    return df.withColumn("split", F.when(F.pmod(F.xxhash64(F.lit(seed), F.col(group).cast("string")), F.lit(10_000)) < int(test_share * 10_000), "test").otherwise("train"))


def leave_family_out(df: DataFrame, family: str, label: str = "label") -> DataFrame:
    """df with split: the family is in the test rows only; other rows are split by hash of all columns."""
    return df.withColumn("split", F.when((F.col(label) == family) | (F.pmod(F.xxhash64(*df.columns), F.lit(5)) == 0), "test").otherwise("train"))


def split_manifest(df: DataFrame, id_col: str, group: str) -> DataFrame:
    """One row a split: rows, an order-free digest of its ids, and groups that are on both sides."""
    sides = df.groupBy(group).agg(F.count_distinct("split").alias("_s")).where("_s > 1").agg(F.count("*").alias("shared_groups"))
    return df.groupBy("split").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(F.col(id_col))).alias("id_digest")).crossJoin(F.broadcast(sides))
