"""Correlation of signature events with flows: by id, by endpoints in time, best signature, orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wiretide.functions.scalars import severity_rank

TOLERANCE_US = 3_000_000
#: Buckets of time by which hot endpoint pairs are split.
BUCKET_US = 60_000_000


def endpoint_key(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, protocol: Column) -> Column:
    """Both ends in order and the protocol in upper case; null if any is missing."""
    a, b = F.struct(src_ip.alias("ip"), src_port.cast("long").alias("port")), F.struct(dst_ip.alias("ip"), dst_port.cast("long").alias("port"))
    known = src_ip.isNotNull() & dst_ip.isNotNull() & src_port.isNotNull() & dst_port.isNotNull() & protocol.isNotNull()
    return F.when(known, F.concat_ws("|", F.least(a, b)["ip"], F.least(a, b)["port"], F.greatest(a, b)["ip"], F.greatest(a, b)["port"], F.upper(protocol)))


def correlate_by_id(events: DataFrame, flows: DataFrame) -> DataFrame:
    """(signature_event_id, flow_event_id) by community id, without regard to time: the first flow in their order.

    The first flow of an id is found by an aggregate, so an id of many flows meets its events as one row.
    """
    first = flows.groupBy("community_flow_id").agg(F.min_by("event_id", "flow_seq").alias("flow_event_id"))
    return events.join(first, "community_flow_id").select("signature_event_id", "flow_event_id")


def correlate_by_endpoints(events: DataFrame, flows: DataFrame, tolerance_us: int = TOLERANCE_US, bucket_us: int = BUCKET_US) -> DataFrame:
    """(signature_event_id, flow_event_id): the flow of the same unordered ends and protocol whose time, widened by the tolerance,
    holds the event, and whose start is nearest (the first of equals).

    An equi join on ends and a time bucket; a flow is in each bucket that its widened time touches, so a busy pair of ends
    is as many keys as it has minutes, and the rest of the range predicate sees little.
    """
    ends = lambda df: endpoint_key(*[df[c] for c in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")])
    f = flows.select(ends(flows).alias("ends"), "event_id", "flow_seq", "start_us", "end_us").where("ends is not null")
    f = f.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("start_us") - tolerance_us) / bucket_us), F.floor((F.col("end_us") + tolerance_us) / bucket_us))))
    e = events.select(ends(events).alias("ends"), "signature_event_id", "ts_us", F.floor(F.col("ts_us") / bucket_us).alias("bucket")).where("ends is not null")
    near = e.join(f, ["ends", "bucket"]).where((F.col("ts_us") >= F.col("start_us") - tolerance_us) & (F.col("ts_us") <= F.col("end_us") + tolerance_us))
    return near.groupBy("signature_event_id").agg(F.min_by("event_id", F.struct(F.abs(F.col("ts_us") - F.col("start_us")), "flow_seq")).alias("flow_event_id"))


def correlate(events: DataFrame, flows: DataFrame, tolerance_us: int = TOLERANCE_US) -> DataFrame:
    """By id where that finds a flow, else by ends and time."""
    one = correlate_by_id(events, flows)
    rest = events.join(one, "signature_event_id", "left_anti")
    return one.unionByName(correlate_by_endpoints(rest, flows, tolerance_us))


def best_signature(matches: DataFrame, events: DataFrame) -> DataFrame:
    """One signature a flow: the most severe, the earliest of equals."""
    rows = matches.join(events, "signature_event_id").withColumn("_rank", severity_rank(F.col("signature_severity")))
    w = Window.partitionBy("flow_event_id").orderBy(F.desc("_rank"), "event_seq")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("flow_event_id", "signature_event_id", "signature_severity")


def orient(flows: DataFrame, records: DataFrame) -> DataFrame:
    """flows with ends and counters as the record of their direction has them, and error where its ends are others.

    records has event_id, event_seq, to_ip and to_port (of the server). A flow whose source is the server is turned around; the
    last record of several decides.
    """
    last = records.groupBy("event_id").agg(F.max_by(F.struct("to_ip", "to_port"), "event_seq").alias("to"))
    joined = flows.join(last, "event_id", "left")
    is_src = (F.col("to.to_ip") == F.col("src_ip")) & (F.col("to.to_port") == F.col("src_port"))
    is_dst = (F.col("to.to_ip") == F.col("dst_ip")) & (F.col("to.to_port") == F.col("dst_port"))
    swap = F.coalesce(is_src & ~is_dst, F.lit(False))
    turned = joined.withColumns({"_swap": swap, "error_code": F.when(F.col("to").isNotNull() & ~(is_src | is_dst), F.lit("direction_mismatch"))})
    pairs = [(a, b) for a, b in (("src_ip", "dst_ip"), ("src_port", "dst_port"), ("packets_forward", "packets_reverse"), ("bytes_forward", "bytes_reverse")) if a in flows.columns]
    both = {c: F.when(F.col("_swap"), F.col(o)).otherwise(F.col(c)) for a, b in pairs for c, o in ((a, b), (b, a))}
    return turned.withColumns(both).withColumn("swapped", F.col("_swap")).drop("_swap", "to")
