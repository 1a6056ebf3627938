import hashlib
import hmac
import uuid

import pytest
from pyspark.sql import functions as F

from wiretide.functions import scalars as x


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("src,sport,dst,dport,proto,want", [
    ("128.232.110.120", 34855, "66.35.250.204", 80, "6", "1:LQU9qZlK+B5F3KDmev6m5PMibrg="),
    ("66.35.250.204", 80, "128.232.110.120", 34855, "tcp", "1:LQU9qZlK+B5F3KDmev6m5PMibrg="),
    ("192.168.1.52", 54585, "8.8.8.8", 53, "17", "1:d/FP5EW3wiY1vCndhwleRRKHowQ="),
    ("2001:470:e5bf:dead:4957:2174:e82c:4887", 63943, "2607:f8b0:400c:c03::1a", 25, "TCP", "1:/qFaeAR+gFe1KYjMzVDsMv+wgU4="),
    ("10.0.0.1", 50000, "10.0.0.2", 443, "TCP", "1:B4H0bMN0Rih3qr9C82AA7esBYLM="),
])
def test_community_id_vectors(spark, src, sport, dst, dport, proto, want):
    c = x.community_id(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("e"))
    assert one(spark, c, a=src, b=sport, c=dst, d=dport, e=proto) == want
    assert one(spark, x.is_community_id(F.lit(want)))


def test_community_id_icmp_and_errors(spark):
    def of(kind, src, dst):
        p = x.icmp_ports(F.lit(58), F.lit(kind), F.lit(0))
        return one(spark, x.community_id(F.lit(src), p["src_port"], F.lit(dst), p["dst_port"], F.lit("ICMPv6"), one_way=p["one_way"]))

    a, b = "3ffe:507:0:1:200:86ff:fe05:80da", "3ffe:501:0:1001::2"
    assert of(128, a, b) == of(129, b, a) == "1:+TW+HtLHvV1xnGhV1lv7XoJrqQg="
    assert one(spark, x.community_id(F.lit("10.0.0.1"), F.lit(1), F.lit("::1"), F.lit(2), F.lit("TCP"))) is None
    assert one(spark, x.community_id(F.lit("10.0.0.1"), F.lit(None).cast("int"), F.lit("10.0.0.2"), F.lit(2), F.lit("TCP"))) is None
    assert not one(spark, x.is_community_id(F.lit("1:fixture"))) and not one(spark, x.is_community_id(F.lit("tuple:private"))) and not one(spark, x.is_community_id(F.lit(None).cast("string")))


def test_canonical_key_is_the_same_both_ways(spark):
    key = lambda a, b, c, d: one(spark, F.to_json(x.canonical_flow_key(F.lit(a), F.lit(b), F.lit(c), F.lit(d), F.lit("TCP"))))
    assert key("203.0.113.9", 55000, "10.0.0.5", 443) == key("10.0.0.5", 443, "203.0.113.9", 55000)
    assert '"low":"0a000005' in key("203.0.113.9", 55000, "10.0.0.5", 443)


def test_ids_and_digests(spark):
    assert one(spark, x.uuid5(F.lit("a name"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a name"))
    for salt in (b"s", b"x" * 100):
        assert one(spark, x.anonymize_ip(F.lit("10.0.0.1"), salt)) == "ip_" + hmac.new(salt, b"10.0.0.1", hashlib.sha256).hexdigest()[:16]
    assert one(spark, x.protocol_number(F.lit(" icmp_v6 "))) == 58 and one(spark, x.protocol_number(F.lit("300"))) is None and one(spark, x.protocol_number(F.lit("gre"))) is None


def test_text(spark):
    assert one(spark, x.csv_safe(F.lit(" =1+1\n x "))) == "'=1+1 x" and one(spark, x.csv_safe(F.lit(None).cast("string"))) == ""
    assert one(spark, x.redact_log(F.lit("Password: abc, from 10.1.2.3\x01 ok"))) == "Password: [redacted], from [ip-redacted] ok"
    assert one(spark, x.clean_evidence(F.lit("a 10.0.0.1 b fe80::1 c 12:30 d ::1"), 200)) == "a [redacted-address] b [redacted-address] c 12:30 d [redacted-address]"
    for raw, want in (("BENIGN", "benign"), ("FTP-Patator", "brute_force"), ("DDoS", "ddos"), ("DoS Hulk", "dos"), ("Odd Thing!", "odd_thing"), ("", "unlabeled"), ("C&C-FileDownload", "command_and_control")):
        assert one(spark, x.normalize_label(F.lit(raw))) == want


def test_times(spark):
    us = lambda c: one(spark, F.unix_micros(c))
    assert us(x.parse_timestamp(F.lit("03/07/2017 08:05"))) == us(F.lit("2017-07-03 08:05:00").cast("timestamp"))
    assert us(x.parse_timestamp(F.lit("1.5"), unix_seconds=True)) == 1_500_000 and us(x.parse_timestamp(F.lit("never"))) is None
    assert us(x.iso_timestamp(F.lit("2026-01-01T02:00:00+0200"))) == us(x.iso_timestamp(F.lit("2026-01-01T00:00:00Z"))) and us(x.iso_timestamp(F.lit("2026-01-01T00:00:00"))) is None


@pytest.mark.parametrize("reason,name,verdict,want", [
    ("PORT_SWEEP", "", "x", "reconnaissance"), ("REPEATED_AUTH_FAILURE", "", "x", "credential_access"), ("LARGE_OUTBOUND_TRANSFER", "", "x", "exfiltration"), ("R", "possible C2 beacon", "x", "command_and_control"),
    ("R", "attempted exploit", "x", "execution"), ("R", "denial of service", "x", "impact"), ("R", "", "known_attack", "known_threat_activity"), ("R", "", "suspicious_unknown", "unclassified_anomaly"), ("R", "", "benign", "needs_review"),
])
def test_attack_stage(spark, reason, name, verdict, want):
    assert one(spark, x.attack_stage(F.array(F.lit(reason)), F.lit(name), F.lit(""), F.lit(verdict))) == want


def test_csv_safe_query_covers_whole_texts(spark, tmp_path):
    import hashlib

    from wiretide.plans import basics

    text = "a" * 300 + "\t\n b\x1f " + "c" * 300
    spark.createDataFrame([(0, text), (1, text), (2, text), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cell = "a" * 300 + " b " + "c" * 300
    got = {r["doc_id"]: r["digest"] for r in basics.QUERIES["x8_csv_safe_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(v.encode()).hexdigest() for i, v in enumerate(["'=" + cell, "'@" + cell, cell, ""])}
