"""Scalar functions over columns: identifiers, addresses, labels, text cleaning. All are native expressions unless noted."""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# Protocol numbers, protocols with ports, ICMP message pairs.
PROTOCOL_NUMBERS = {"ICMP": 1, "TCP": 6, "UDP": 17, "ICMPV6": 58, "SCTP": 132}
PORT_PROTOCOLS = (1, 6, 17, 58, 132)
ICMP_PAIRS = {
    1: {0: 8, 8: 0, 9: 10, 10: 9, 13: 14, 14: 13, 15: 16, 16: 15, 17: 18, 18: 17},
    58: {128: 129, 129: 128, 130: 131, 131: 130, 133: 134, 134: 133, 135: 136, 136: 135, 139: 140, 140: 139, 144: 145, 145: 144},
}
# Benign labels, and families of attack labels with what marks them, in the order in which they are tried.
BENIGN_LABELS = ("benign", "normal", "normaltraffic", "0", "background")
LABEL_FAMILIES = {
    "command_and_control": ("c&c", "command and control"),
    "file_download": ("filedownload", "file download"),
    "brute_force": ("patator", "bruteforce", "brute force"),
    "web_attack": ("xss", "sql injection", "web attack"),
    "port_scan": ("portscan", "port scan", "reconnaissance", "probing"),
    "ddos": ("ddos", "distributed denial"),
    "dos": ("dos", "denial of service", "hulk", "slowloris", "goldeneye"),
    "infiltration": ("infiltration", "infilteration"),
    "botnet": ("botnet", " bot", "bot "),
    "heartbleed": ("heartbleed",),
    "cryptomining": ("cryptominer", "xmrig"),
}
# Terms of attack stages in the order in which they are tried.
STAGE_TERMS = {
    "exfiltration": ("EXFIL", "EGRESS", "DATA TRANSFER", "LARGE_OUTBOUND"),
    "credential_access": ("BRUTE", "AUTH", "LOGIN", "CREDENTIAL"),
    "reconnaissance": ("SCAN", "PROBE", "RECON", "DISCOVERY", "PORT_SWEEP"),
    "command_and_control": ("COMMAND AND CONTROL", "C2", "BEACON"),
    "execution": ("EXECUTION", "EXPLOIT", "SHELL", "MALWARE"),
    "impact": ("DENIAL", "DOS", "IMPACT", "DESTRUCT"),
}
SEVERITIES = ("informational", "low", "medium", "high", "critical")


def any_of(column: Column, terms: tuple[str, ...]) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.contains(column, F.lit(t)) for t in terms])


def ladder(cases: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first case that holds."""
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def opaque(df: DataFrame) -> DataFrame:
    """df as the output of a generator of one row: filters and joins above then see columns, and the optimizer doesn't copy what
    they are made of into every condition, which for long chains of derived columns takes exponential time."""
    return df.select(F.inline(F.array(F.struct("*"))))


# Identifiers and addresses ------------------------------------------------------------------------


@F.pandas_udf(StringType())
def _packed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for ips in parts:
        yield ips.map(lambda x: _pack(x))


def _pack(text: str | None) -> str | None:
    try:
        return ipaddress.ip_address(text).packed.hex() if text else None
    except ValueError:
        return None


def ipv4_hex(ip: Column) -> Column:
    """The address as 8 hex digits; null unless it is a dotted quad."""
    octets = F.split(ip, r"\.")
    digits = F.array_join(F.transform(octets, lambda o: F.lpad(F.hex(o.try_cast("bigint")), 2, "0")), "")
    valid = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$")
    return F.when(valid, F.lower(digits))


def ip_hex(ip: Column, ipv6: bool = True) -> Column:
    """The packed address in hex. IPv4 is native; IPv6 text goes through an Arrow function, which ipv6=False leaves out."""
    return F.coalesce(ipv4_hex(ip), _packed(F.when(F.contains(ip, F.lit(":")), ip))) if ipv6 else ipv4_hex(ip)


def protocol_number(protocol: Column) -> Column:
    """Number of a protocol by name or number; null if unknown or outside of 0..255."""
    name = F.replace(F.upper(F.trim(protocol.cast("string"))), F.lit("_"), F.lit(""))
    known = ladder([(name == k, F.lit(v)) for k, v in PROTOCOL_NUMBERS.items()], name.try_cast("int"))
    return F.when((known >= 0) & (known <= 255), known)


def canonical_flow_key(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, protocol: Column, ipv6: bool = True) -> Column:
    """struct<low, high, protocol>: endpoints by packed address and port, whichever comes first; so a flow and its reverse agree."""
    a = F.concat(ip_hex(src_ip, ipv6), F.lower(F.lpad(F.hex(src_port.cast("bigint")), 4, "0")))
    b = F.concat(ip_hex(dst_ip, ipv6), F.lower(F.lpad(F.hex(dst_port.cast("bigint")), 4, "0")))
    both = a.isNotNull() & b.isNotNull()
    return F.struct(F.when(both, F.least(a, b)).alias("low"), F.when(both, F.greatest(a, b)).alias("high"), protocol_number(protocol).alias("protocol"))


def community_id(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, protocol: Column, seed: int = 0, one_way: Column | None = None, ipv6: bool = True) -> Column:
    """Community ID v1. Null where an address or the protocol is invalid, the address families differ, or a protocol with ports lacks one."""
    if not 0 <= seed <= 65_535:
        raise ValueError("a Community ID seed is in 0..65535")
    number = protocol_number(protocol)
    port = lambda p: F.lower(F.lpad(F.hex(F.coalesce(p, F.lit(0)).cast("bigint")), 4, "0"))
    a, b = F.struct(ip_hex(src_ip, ipv6).alias("ip"), port(src_port).alias("port")), F.struct(ip_hex(dst_ip, ipv6).alias("ip"), port(dst_port).alias("port"))
    keep = F.coalesce(one_way, F.lit(False)) if one_way is not None else F.lit(False)
    first, second = F.when(keep, a).otherwise(F.least(a, b)), F.when(keep, b).otherwise(F.greatest(a, b))
    tail = F.when(number.isin(*PORT_PROTOCOLS), F.when(src_port.isNotNull() & dst_port.isNotNull(), F.concat(first["port"], second["port"]))).otherwise(F.lit(""))
    material = F.concat(F.lit(f"{seed:04x}"), first["ip"], second["ip"], F.lower(F.lpad(F.hex(number), 2, "0")), F.lit("00"), tail)
    same_family = F.length(a["ip"]) == F.length(b["ip"])
    return F.when(same_family, F.concat(F.lit("1:"), F.base64(F.unhex(F.sha1(F.unhex(material))))))


def is_community_id(value: Column) -> Column:
    """Whether a text is 1: and the base64 of 20 bytes."""
    shaped = F.coalesce(value.rlike(r"^1:(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.lit(False))
    return shaped & (F.coalesce(F.octet_length(F.try_to_binary(F.substring(F.when(shaped, value), 3, 200), F.lit("base64"))), F.lit(0)) == 20)


def icmp_ports(protocol: Column, kind: Column, code: Column) -> Column:
    """struct<src_port, dst_port, one_way> for ICMP and ICMPv6; null for other protocols."""
    other = F.lit(None).cast("int")
    for number, pairs in ICMP_PAIRS.items():
        other = F.when(protocol == number, ladder([(kind == k, F.lit(v)) for k, v in pairs.items()], None)).otherwise(other)
    return F.when(protocol.isin(*ICMP_PAIRS), F.struct(kind.cast("int").alias("src_port"), F.coalesce(other, code.cast("int")).alias("dst_port"), other.isNull().alias("one_way")))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The version 5 UUID of a name, natively."""
    d = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(d, 17, 2), 16, 10).cast("int").bitwiseAND(63)).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.concat(F.lit("5"), F.substring(d, 14, 3)), F.concat(variant, F.substring(d, 19, 2)), F.substring(d, 21, 12))


def anonymize_ip(ip: Column, salt: bytes) -> Column:
    """ip_ and 16 hex digits of HMAC-SHA256 under the salt, natively: the padded keys are literals. Null stays null."""
    key = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.unhex(F.lit(key.translate(hmac.trans_36).hex())), F.encode(ip, "UTF-8")), 256)
    outer = F.sha2(F.concat(F.unhex(F.lit(key.translate(hmac.trans_5C).hex())), F.unhex(inner)), 256)
    return F.concat(F.lit("ip_"), F.substring(outer, 1, 16))


def hash_private(text: Column) -> Column:
    """SHA-256 of a name that must not be kept; null if it is empty."""
    return F.when(text != "", F.sha2(F.encode(text, "UTF-8"), 256))


# Text ---------------------------------------------------------------------------------------------

_SPACE = r"[\s\u001C-\u001F\u0085\u00A0]+"


def squeeze(text: Column) -> Column:
    """White space runs become one space, and none is left at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def csv_safe(value: Column, kind: str = "string") -> Column:
    """A value as a CSV cell that no spreadsheet takes for a formula: null is empty, times are ISO in UTC, nested values canonical JSON."""
    if kind == "timestamp":
        value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    elif kind.startswith(("array", "map", "struct")):
        value = F.to_json(value)
    elif kind == "boolean":
        value = value.cast("string")
    elif kind != "string":
        return value
    text = squeeze(F.replace(value, F.lit("\0"), F.lit(" ")))
    return F.coalesce(F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text), F.lit(""))


# What log redaction masks, and the control characters that evidence must not hold.
LOG_CONTROL, EVIDENCE_CONTROL = r"[\x00-\x1f\x7f]+", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
LOG_SECRET = r"(?i)(authorization|api[_-]?key|password|secret|token)(\s*[:=]\s*)([^\s,;]+)"
LOG_ADDRESS, EVIDENCE_ADDRESS = r"(?<![\w:])(?:\d{1,3}\.){3}\d{1,3}(?![\w:])", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
LOG_MASK, EVIDENCE_MASK = "[ip-redacted]", "[redacted-address]"


def redact_log(text: Column, limit: int = 512) -> Column:
    """Log text without control characters, secrets after their keys, and IPv4 addresses; white space squeezed, cut at the limit."""
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, LOG_CONTROL, " "), LOG_SECRET, "$1$2[redacted]"), LOG_ADDRESS, LOG_MASK)
    return F.substring(squeeze(masked), 1, limit)


#: A strict IPv6 address: full, or with one run of zeros left out.
_IPV6 = r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z_:]))(?:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?))"


def clean_evidence(text: Column, limit: int) -> Column:
    """Evidence text without control characters and addresses, squeezed and cut."""
    masked = F.regexp_replace(F.regexp_replace(text, EVIDENCE_CONTROL, " "), EVIDENCE_ADDRESS, EVIDENCE_MASK)
    return F.substring(squeeze(F.regexp_replace(masked, rf"(?<![0-9A-Za-z_:]){_IPV6}(?![0-9A-Za-z_:])", EVIDENCE_MASK)), 1, limit)


def normalize_label(value: Column) -> Column:
    """benign, the first family whose marks a label holds, else the label as a slug; unlabeled if nothing is left."""
    raw = F.lower(F.trim(F.replace(F.coalesce(value.cast("string"), F.lit("none")), F.lit("\ufffd"), F.lit(""))))
    compact = F.regexp_replace(raw, "[^a-z0-9]", "")
    slug = F.regexp_replace(F.regexp_replace(raw, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    cases = [(compact.isin(*BENIGN_LABELS) | raw.isin(*BENIGN_LABELS), F.lit("benign"))]
    cases += [(any_of(raw, marks), F.lit(family)) for family, marks in LABEL_FAMILIES.items()]
    return ladder(cases, F.when(slug == "", F.lit("unlabeled")).otherwise(slug))


# Time ---------------------------------------------------------------------------------------------

#: Day-first formats that parse_timestamp tries in turn.
TIME_FORMATS = ("d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy h:mm:ss a", "d/M/yyyy h:mm a", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def parse_timestamp(value: Column, unix_seconds: bool = False) -> Column:
    """A timestamp from mixed text, day first, or from Unix seconds; null if invalid."""
    if unix_seconds:
        return F.timestamp_micros((value.try_cast("double") * 1_000_000).cast("bigint"))
    text = F.trim(value.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS])


def iso_timestamp(value: Column) -> Column:
    """A timestamp from ISO 8601 text that names its zone; null otherwise."""
    zoned = value.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d(?:\.\d{1,9})?)?(?:Z|[+-]\d\d:?\d\d)$")
    colon = F.regexp_replace(value, r"([+-]\d\d)(\d\d)$", "$1:$2")
    return F.when(zoned, colon.try_cast("timestamp"))


# Ladders ------------------------------------------------------------------------------------------


def attack_stage(reasons: Column, name: Column, category: Column, verdict: Column) -> Column:
    """The first stage whose terms the evidence holds, else by the verdict."""
    evidence = F.upper(F.concat_ws(" ", F.array_sort(reasons), F.coalesce(name, F.lit("")), F.coalesce(category, F.lit(""))))
    cases = [(any_of(evidence, terms), F.lit(stage)) for stage, terms in STAGE_TERMS.items()]
    cases += [(verdict == "known_attack", F.lit("known_threat_activity")), (verdict == "suspicious_unknown", F.lit("unclassified_anomaly"))]
    return ladder(cases, F.lit("needs_review"))


def severity_rank(severity: Column) -> Column:
    return ladder([(severity == s, F.lit(i)) for i, s in enumerate(SEVERITIES)], F.lit(-1))


def severity_from_risk(risk: Column, low: float = 30.0, medium: float = 54.0, high: float = 72.0, critical: float = 90.0) -> Column:
    return ladder([(risk >= critical, F.lit("critical")), (risk >= high, F.lit("high")), (risk >= medium, F.lit("medium")), (risk >= low, F.lit("low"))], F.lit("informational"))


def eve_severity(number: Column) -> Column:
    n = F.coalesce(number, F.lit(3))
    return ladder([(n == 1, F.lit("critical")), (n == 2, F.lit("high")), (n == 3, F.lit("medium"))], F.lit("low"))


def index_digest(ids: Column) -> Column:
    """An aggregate: SHA-256 of a group's ids in order, joined by commas. The group must fit one row; for tables see ops.snapshot()."""
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(ids)), lambda x: x.cast("string")), ",").cast("binary"), 256)
