"""Packets to flows: direction, counters, spreads, first packets; and records of bidirectional exporters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wiretide.functions.scalars import canonical_flow_key, community_id, uuid5

WELL_KNOWN_MAX, EPHEMERAL_MIN, FIRST = 1023, 49_152, 20
FLAGS = {"syn": 0x02, "ack": 0x10, "fin": 0x01, "rst": 0x04, "psh": 0x08}


def packets_to_flows(packets: DataFrame, sensor_id: str = "capture", ipv6: bool = True) -> DataFrame:
    """One flow for each unordered pair of ends and protocol of a packet table (ts seconds, size, src_ip, src_port, dst_ip, dst_port,
    protocol, tcp_flags, seq).

    The source is the sender of the first SYN without ACK, else the client of a well-known port, else the first sender. Spreads
    are those of populations. The first 20 packets are taken by rank before they are gathered, so a long flow stays rows.
    """
    key = canonical_flow_key(*[F.col(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")], ipv6=ipv6)
    keyed = packets.withColumn("_key", key)
    order = Window.partitionBy("_key").orderBy("ts", "seq")
    gap = (F.col("ts") - F.lag("ts").over(order)) * 1000
    iat = F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0)))  # the first packet has none
    own = F.struct(F.col("src_ip").alias("src_ip"), F.col("src_port").alias("src_port"), F.col("dst_ip").alias("dst_ip"), F.col("dst_port").alias("dst_port"))
    tcp = F.upper("protocol") == "TCP"
    flag = lambda bit: F.coalesce(F.col("tcp_flags"), F.lit(0)).bitwiseAND(bit) != 0
    syn = tcp & flag(FLAGS["syn"]) & ~flag(FLAGS["ack"])
    timed = keyed.withColumns({"_iat": iat, "_rank": F.row_number().over(order), "_own": own, "_syn": syn})
    w = Window.partitionBy("_key")
    at = F.struct("ts", "seq")
    opened = timed.withColumns({"_first_syn": F.min_by(F.when(F.col("_syn"), F.col("_own")), F.when(F.col("_syn"), at)).over(w), "_first": F.min_by("_own", at).over(w)})
    f = F.col("_first")
    client = F.when((f["src_port"] >= EPHEMERAL_MIN) & (f["dst_port"] <= WELL_KNOWN_MAX), f).when((f["dst_port"] >= EPHEMERAL_MIN) & (f["src_port"] <= WELL_KNOWN_MAX), F.struct(f["dst_ip"].alias("src_ip"), f["dst_port"].alias("src_port"), f["src_ip"].alias("dst_ip"), f["src_port"].alias("dst_port")))
    basis = F.when(F.col("_first_syn").isNotNull(), "tcp_syn_without_ack").when(client.isNotNull(), "well_known_service_ephemeral_client").otherwise("first_packet")
    placed = opened.withColumns({"_ends": F.coalesce("_first_syn", client, f), "direction_basis": basis})
    forward = (F.col("src_ip") == F.col("_ends.src_ip")) & (F.col("src_port") == F.col("_ends.src_port"))
    placed = placed.withColumn("_fwd", forward)
    first = F.when(F.col("_rank") <= FIRST, F.struct(F.col("_rank").alias("r"), F.col("size").alias("size"), F.when(F.col("_fwd"), 1).otherwise(-1).alias("dir"), F.coalesce("_iat", F.lit(0.0)).alias("iat")))
    total = placed.groupBy("_key", "_ends", "direction_basis", F.upper("protocol").alias("protocol")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("_n"), F.sum("size").alias("_bytes"),
        F.count_if("_fwd").alias("packets_forward"), F.count_if(~F.col("_fwd")).alias("packets_reverse"),
        F.sum(F.when(F.col("_fwd"), F.col("size")).otherwise(0)).alias("bytes_forward"), F.sum(F.when(~F.col("_fwd"), F.col("size")).otherwise(0)).alias("bytes_reverse"),
        F.min("size").alias("packet_length_min"), F.max("size").alias("packet_length_max"), F.avg("size").alias("packet_length_mean"), F.stddev_pop("size").alias("packet_length_std"),
        *[F.coalesce(g("_iat"), F.lit(0.0)).alias(f"iat_{k}") for k, g in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))],
        *[F.count_if(tcp & flag(bit)).alias(f"tcp_{k}_count") for k, bit in FLAGS.items()],
        F.array_sort(F.collect_list(first)).alias("_firsts"),
    )
    ms = F.greatest((F.col("end") - F.col("start")) * 1000, F.lit(0.001))
    out = total.withColumns({
        "src_ip": F.col("_ends.src_ip"), "src_port": F.col("_ends.src_port"), "dst_ip": F.col("_ends.dst_ip"), "dst_port": F.col("_ends.dst_port"), "sensor_id": F.lit(sensor_id), "duration_ms": ms,
        "packet_rate": F.col("_n") / (ms / 1000), "byte_rate": F.col("_bytes") / (ms / 1000), "timestamp_start": F.timestamp_micros((F.col("start") * 1e6).cast("bigint")), "timestamp_end": F.timestamp_micros((F.col("end") * 1e6).cast("bigint")),
        "first_packet_sizes": F.transform("_firsts", lambda x: x["size"]), "first_packet_directions": F.transform("_firsts", lambda x: x["dir"]), "first_packet_interarrival_times": F.transform("_firsts", lambda x: x["iat"]),
        "event_id": uuid5(F.concat(F.lit("wiretide-packets:"), F.format_string("%.9f", "start"), F.lit(":"), F.to_json("_key"))),
    })
    cid = community_id(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("protocol"), ipv6=ipv6)
    return out.withColumn("community_flow_id", cid).drop("_key", "_ends", "_firsts", "_n", "_bytes", "start", "end")


def swapped(df: DataFrame, swap: Column) -> DataFrame:
    """Exporter records with source and destination exchanged where swap holds: ends, directional counters, and signs of packet directions."""
    pairs = [("src_ip", "dst_ip"), ("src_port", "dst_port"), ("src2dst_packets", "dst2src_packets"), ("src2dst_bytes", "dst2src_bytes")]
    both = {c: F.when(swap, F.col(o)).otherwise(F.col(c)) for a, b in pairs for c, o in ((a, b), (b, a))}
    if "splt_direction" in df.columns:
        both["splt_direction"] = F.when(swap, F.transform("splt_direction", lambda x: F.when(x == 0, 1).otherwise(0))).otherwise(F.col("splt_direction"))
    return df.withColumns(both)


def normalize_export(df: DataFrame, sensor_id: str) -> DataFrame:
    """Flow rows of a bidirectional exporter's records: counters, rates over at least a microsecond, first packets with directions 1 and -1."""
    ms = F.greatest(F.col("bidirectional_duration_ms").cast("double"), F.lit(0.001))
    name = F.when(F.col("protocol") == 6, "TCP").when(F.col("protocol") == 17, "UDP").when(F.col("protocol") == 1, "ICMP").when(F.col("protocol") == 58, "ICMPV6").otherwise(F.col("protocol").cast("string"))
    packets, size = F.col("src2dst_packets") + F.col("dst2src_packets"), F.col("src2dst_bytes") + F.col("dst2src_bytes")
    return df.select(
        F.lit(sensor_id).alias("sensor_id"), "src_ip", "src_port", "dst_ip", "dst_port", name.alias("protocol"), ms.alias("duration_ms"),
        F.col("src2dst_packets").alias("packets_forward"), F.col("dst2src_packets").alias("packets_reverse"), F.col("src2dst_bytes").alias("bytes_forward"), F.col("dst2src_bytes").alias("bytes_reverse"),
        (packets / (ms / 1000)).alias("packet_rate"), (size / (ms / 1000)).alias("byte_rate"),
        F.transform(F.slice("splt_direction", 1, FIRST), lambda x: F.when(x == 0, 1).otherwise(-1)).alias("first_packet_directions"), F.slice("splt_ps", 1, FIRST).alias("first_packet_sizes"),
    )
