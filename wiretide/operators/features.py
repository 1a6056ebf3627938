"""Flow features: the deployed registry, the portable schema, robust and standard scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiretide.functions.scalars import ladder
from wiretide.operators.quantiles import exact_quantiles
from wiretide.operators.validate import REGISTRY_LIMITS

REGISTRY = tuple(REGISTRY_LIMITS)
# Ports of services.
SERVICE_PORTS = {
    "dns": (53, 853), "web": (80, 443, 8000, 8080, 8443), "mail": (25, 110, 143, 465, 587, 993, 995), "remote_access": (22, 23, 3389, 5900),
    "file_transfer": (20, 21, 69, 115, 445, 2049), "database": (1433, 1521, 3306, 5432, 6379, 9042, 9200, 27017),
}
PROTOCOL_NAMES = {"tcp": ("6", "tcp"), "udp": ("17", "udp"), "icmp": ("1", "58", "icmp", "icmpv6", "icmp6")}
#: Severity of a signature and the score it gives.
SIGNATURE_SCORES = {"informational": 0.25, "low": 0.45, "medium": 0.65, "high": 0.85, "critical": 1.0}


def registry_columns() -> dict[str, Column]:
    d = lambda x: F.col(x).cast("double")
    plain = {x: d(x) for x in REGISTRY[:13]}
    return plain | {
        "destination_port": d("dst_port"),
        "forward_reverse_byte_ratio": d("bytes_forward") / F.greatest(d("bytes_reverse"), F.lit(1.0)),
        "syn_ack_ratio": d("tcp_syn_count") / F.greatest(d("tcp_ack_count"), F.lit(1.0)),
        "packets_total": d("packets_forward") + d("packets_reverse"),
        "bytes_total": d("bytes_forward") + d("bytes_reverse"),
    }


def registry_features(flows: DataFrame, *keep: str) -> DataFrame:
    """The 18 registry features in order, after the columns to keep."""
    return flows.select(*keep, *[c.alias(n) for n, c in registry_columns().items()])


def protocol_group(protocol: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(protocol.cast("string"), F.lit(""))))
    return ladder([(name.isin(*v), F.lit(k)) for k, v in PROTOCOL_NAMES.items()], F.lit("other"))


def service_group(port: Column) -> Column:
    return ladder([(port.isin(*v), F.lit(k)) for k, v in SERVICE_PORTS.items()], F.lit("other"))


def port_range(port: Column) -> Column:
    return ladder([(port.isNull(), F.lit("missing")), (port < 1024, F.lit("well_known")), (port < 49_152, F.lit("registered"))], F.lit("dynamic"))


def portable_columns() -> dict[str, Column]:
    d = lambda x: F.col(x).cast("double")
    seconds = F.greatest(d("duration_ms") / 1000, F.lit(1e-6))
    packets, size = d("packets_forward") + d("packets_reverse"), d("bytes_forward") + d("bytes_reverse")
    protocol, service, ports = protocol_group(F.col("protocol")), service_group(F.col("dst_port")), port_range(F.col("dst_port"))
    flag = lambda c: c.cast("double")
    out = {
        "duration_log1p_ms": F.log1p(d("duration_ms")),
        "packets_total_log1p": F.log1p(packets),
        "packets_forward_fraction": d("packets_forward") / F.greatest(packets, F.lit(1.0)),
        "bytes_total_log1p": F.log1p(size),
        "bytes_forward_fraction": d("bytes_forward") / F.greatest(size, F.lit(1.0)),
        "packet_rate_log1p_derived": F.log1p(packets / seconds),
        "byte_rate_log1p_derived": F.log1p(size / seconds),
        "packet_length_mean_log1p_derived": F.log1p(size / F.greatest(packets, F.lit(1.0))),
        "forward_reverse_byte_log_ratio": F.log1p(d("bytes_forward")) - F.log1p(d("bytes_reverse")),
    }
    out |= {f"protocol_{k}": flag(protocol == k) for k in (*PROTOCOL_NAMES, "other")}
    out |= {"destination_port_missing": flag(ports == "missing")} | {f"port_{k}": flag(ports == k) for k in ("well_known", "registered", "dynamic")}
    return out | {f"service_{k}": flag(service == k) for k in (*SERVICE_PORTS, "other")}


def portable_features(flows: DataFrame, *keep: str) -> DataFrame:
    """The 24 portable features (schema A) in order, after the columns to keep. A null port is missing, in no range and of service other."""
    return flows.select(*keep, *[c.alias(n) for n, c in portable_columns().items()])


def contextual_score(metadata: Column) -> Column:
    """Distinct destination ports of a source over 25, at most 1; 0 if unknown."""
    return F.least(F.coalesce(metadata["distinct_destination_ports"].try_cast("double"), F.lit(0.0)) / 25, F.lit(1.0))


def signature_score(severity: Column) -> Column:
    return ladder([(severity == k, F.lit(v)) for k, v in SIGNATURE_SCORES.items()], F.lit(0.0))


def robust_fit(df: DataFrame, columns: list[str], binary: tuple[str, ...] = ()) -> dict[str, tuple[float, float, float, float]]:
    """low, high, median and scale of each column, by exact quantiles: 0.5% and 99.5% bounds, median and interquartile range
    (1 if below 1e-9) of the clipped values. A column of binary whose values are all 0 or 1 passes unchanged. No task holds a
    column's values; five numbers a column are kept."""
    row = exact_quantiles(df, columns, [0.005, 0.25, 0.5, 0.75, 0.995])
    flags = df.agg(*[F.min(F.col(c).isin(0, 1)).alias(c) for c in binary]).first() if binary else {}
    out = {}
    for c in columns:
        if c in binary and flags[c]:
            out[c] = (float("-inf"), float("inf"), 0.0, 1.0)
            continue
        low, q1, median, q3, high = row[c]
        out[c] = (low, high, median, q3 - q1 if q3 - q1 >= 1e-9 else 1.0)
    return out


def robust_transform(df: DataFrame, fitted: dict[str, tuple[float, float, float, float]]) -> DataFrame:
    clip = lambda c, low, high: F.least(F.greatest(F.col(c).cast("double"), F.lit(low)), F.lit(high))
    return df.withColumns({c: (clip(c, low, high) - median) / scale for c, (low, high, median, scale) in fitted.items()})


def standard_fit(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (1 if 0) of each column."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}


def standard_transform(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in fitted.items()})
