"""Signature-engine logs: parsing, metadata, duplicates, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiretide.functions.scalars import community_id, eve_severity, hash_private, is_community_id, iso_timestamp, uuid5

TYPES = ("alert", "anomaly", "flow", "dns", "tls", "http")
MAX_LINE = 1 << 20
# What is kept of each section, and what is kept as a digest only.
SECTION_KEYS = {
    "anomaly": ("type", "event", "layer"), "flow": ("state", "reason", "age", "pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient"),
    "dns": ("type", "rrtype", "rcode", "tx_id"), "tls": ("version", "notbefore", "notafter", "ja3", "ja3s"), "http": ("http_method", "protocol", "status", "length"),
}
PRIVATE_KEYS = {"dns": ("rrname",), "tls": ("sni", "subject", "issuerdn"), "http": ("hostname",)}
_SECTIONS = ", ".join(f"{s} STRUCT<{', '.join(f'{k}: STRING' for k in dict.fromkeys(SECTION_KEYS.get(s, ()) + PRIVATE_KEYS.get(s, ())))}{', queries: ARRAY<STRUCT<type: STRING, rrtype: STRING, rcode: STRING, tx_id: STRING, rrname: STRING>>' if s == 'dns' else ''}>" for s in SECTION_KEYS)
SCHEMA = (
    "timestamp STRING, event_type STRING, community_id STRING, flow_id STRING, src_ip STRING, src_port INT, dest_ip STRING, dest_port INT, proto STRING, app_proto STRING, "
    f"alert STRUCT<signature_id: STRING, signature: STRING, category: STRING, severity: INT>, {_SECTIONS}"
)


def flow_identifier(e: Column, ipv6: bool = True) -> Column:
    """The event's own community id, one computed from its ends, or a digest of the native flow id; null if none can be had or its own is invalid."""
    made = community_id(e["src_ip"], e["src_port"], e["dest_ip"], e["dest_port"], e["proto"], ipv6=ipv6)
    whole = e["src_ip"].isNotNull() & e["src_port"].isNotNull() & e["dest_ip"].isNotNull() & e["dest_port"].isNotNull() & e["proto"].isNotNull()
    native = F.concat(F.lit("native-flow:"), F.substring(F.sha2(F.encode(F.nullif(e["flow_id"], F.lit("")), "UTF-8"), 256), 1, 32))
    return F.when(e["community_id"].isNotNull(), F.when(is_community_id(e["community_id"]), e["community_id"])).when(whole, made).otherwise(native)


def metadata(e: Column) -> Column:
    """map<string, string> of ends, protocols, the section's listed keys as type_key, and digests of names. The first DNS query fills gaps."""
    entries = [("src_ip", e["src_ip"]), ("src_port", e["src_port"].cast("string")), ("dst_ip", e["dest_ip"]), ("dst_port", e["dest_port"].cast("string")), ("proto", e["proto"]), ("app_proto", e["app_proto"])]
    found = [(k, F.substring(v, 1, 128)) for k, v in entries]
    for section, keys in SECTION_KEYS.items():
        on = e["event_type"] == section
        query = F.get(e["dns"]["queries"], F.lit(0))
        get = lambda k, s=section, q=query: F.coalesce(e[s][k], q[k]) if s == "dns" else e[s][k]
        found += [(f"{section}_{k}", F.when(on, F.substring(get(k), 1, 256))) for k in keys]
        found += [(f"{section}_{k}_sha256", F.when(on, hash_private(get(k)))) for k in PRIVATE_KEYS.get(section, ())]
    return F.map_filter(F.create_map(*[x for k, v in found for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def parse_eve(lines: DataFrame, value: str = "value", ipv6: bool = True) -> DataFrame:
    """One row a line: kind (an event type, ignored or error), error, and of good lines event_id, timestamp, community_flow_id,
    raw_event_hash, signature fields (alerts) and metadata. Names of hosts are kept as digests only."""
    # generators keep what they make as columns: later filters don't copy the parsing and hashing into each condition
    read = lines.select(value, F.inline(F.array(F.struct(F.from_json(value, SCHEMA + ", _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"}).alias("_e")))))
    e = F.col("_e")
    made = F.struct(iso_timestamp(e["timestamp"]).alias("_stamp"), flow_identifier(e, ipv6).alias("_flow"), F.sha2(F.encode(F.col(value), "UTF-8"), 256).alias("_digest"))
    raw = read.select("*", F.inline(F.array(made)))
    stamp, flow, digest = F.col("_stamp"), F.col("_flow"), F.col("_digest")
    section = F.lit(False)
    for t in TYPES:
        section = F.when(e["event_type"] == t, e[t].isNotNull()).otherwise(section)
    supported = F.coalesce(e["event_type"].isin(*TYPES), F.lit(False))
    incomplete = stamp.isNull() | flow.isNull() | ~section | ((e["event_type"] == "alert") & (e["alert"]["signature_id"].isNull() | e["alert"]["signature"].isNull()))
    error = F.when(F.octet_length(value) > MAX_LINE, "line_too_long").when(e.isNull() | e["_corrupt"].isNotNull() | ~F.ltrim(value).startswith("{"), "malformed").when(supported & incomplete, F.concat(F.lit("incomplete_"), e["event_type"]))
    good = error.isNull() & supported
    alert = good & (e["event_type"] == "alert")
    when = lambda c, x: F.when(c, x)
    return raw.select(
        F.when(error.isNotNull(), "error").when(supported, e["event_type"]).otherwise("ignored").alias("kind"), error.alias("error"), when(good, uuid5(F.concat(F.lit("wiretide-eve:"), digest))).alias("event_id"), when(good, stamp).alias("timestamp"),
        when(good, flow).alias("community_flow_id"), digest.alias("raw_event_hash"), when(good, e["src_ip"]).alias("src_ip"), when(good, e["src_port"]).alias("src_port"), when(good, e["dest_ip"]).alias("dst_ip"), when(good, e["dest_port"]).alias("dst_port"), when(good, e["proto"]).alias("protocol"),
        when(alert, e["alert"]["signature_id"]).alias("signature_id"), when(alert, F.substring(e["alert"]["signature"], 1, 512)).alias("signature_name"), when(alert, F.substring(F.coalesce(e["alert"]["category"], F.lit("unknown")), 1, 256)).alias("category"),
        when(alert, eve_severity(e["alert"]["severity"])).alias("severity"), when(good, metadata(e)).alias("metadata"),
    )


DEDUPE_KEYS = ["kind", "signature_id", "community_flow_id", "second", "raw_event_hash"]


def dedupe(events: DataFrame, within: str | None = None) -> DataFrame:
    """Events once by kind, signature, flow, second and digest. In a stream, within bounds how long a repeat is known."""
    keyed = events.withColumn("second", F.date_trunc("second", "timestamp"))
    out = keyed.dropDuplicates(DEDUPE_KEYS) if within is None else keyed.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(DEDUPE_KEYS)
    return out.drop("second")


def health(parsed: DataFrame) -> DataFrame:
    """One row: events, malformed lines, duplicates, and the last event's time."""
    good = F.col("event_id").isNotNull()
    key = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("kind", "signature_id", "community_flow_id")], F.date_trunc("second", "timestamp").cast("string"), "raw_event_hash")
    return parsed.agg(F.count_if(good).alias("parsed_events"), F.count_if(F.col("kind") == "error").alias("malformed_events"), (F.count_if(good) - F.count_distinct(F.when(good, key))).alias("duplicate_events"), F.max("timestamp").alias("last_event_at"))
