"""Keyed temporal features over a running-maximum watermark, exactly and in batch."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wiretide.operators.drift import _same
from wiretide.operators.features import protocol_group
from wiretide.operators.metrics import _ranges

IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
FEATURES = (
    "source_flows_10s_log1p", "source_flows_60s_log1p", "unique_destinations_10s_log1p", "unique_destinations_60s_log1p", "unique_destination_ports_10s_log1p", "unique_destination_ports_60s_log1p",
    "destination_novelty_60s", "service_port_rarity_60s", "protocol_rarity_60s", "destination_fanout_entropy_60s", "connection_interval_mean_log1p_ms_60s", "connection_interval_std_log1p_ms_60s",
    "connection_burstiness_60s", "short_lived_ratio_60s", "temporal_cold_start", "temporal_late_event",
)


class Frame:
    """What a source's rows of the last window tell, kept up as rows come in order of arrival: O(log n) a row, whatever the window holds.

    Rows lie in order of time, the short window at their end. Destinations, ports and protocols are counted, so what is distinct
    is the size of a counter; entropy follows from a running sum of c ln c, gaps from the first and last time and a running sum
    of squares. Times are whole microseconds, so these sums are exact.
    """

    def __init__(self, window: int, short: int, skew: int, most: int) -> None:
        self.window, self.short, self.skew, self.most = window, short, skew, most
        self.rows: list[tuple] = []  # (time, arrival, ip, port, protocol, brief)
        self.low = self.near = 0  # where the window and the short window begin in rows; what is before is gone
        self.ips, self.ports, self.protocols, self.near_ips, self.near_ports = ({} for _ in range(5))
        self.briefs = self.squares = 0
        self.clog = 0.0

    def _count(self, row: tuple, by: int) -> None:
        _, _, ip, port, protocol, brief = row
        c = _add(self.ips, ip, by)
        self.clog += _clog(c) - _clog(c - by)
        _add(self.ports, port, by)
        _add(self.protocols, protocol, by)
        self.briefs += by * brief

    def _count_near(self, row: tuple, by: int) -> None:
        _add(self.near_ips, row[2], by)
        _add(self.near_ports, row[3], by)

    def _drop_first(self) -> None:
        row = self.rows[self.low]
        if self.near == self.low:
            self._count_near(row, -1)
            self.near += 1
        self._count(row, -1)
        self.low += 1
        if self.low < len(self.rows):
            self.squares -= (self.rows[self.low][0] - row[0]) ** 2
        if self.low > 64 and 2 * self.low > len(self.rows):
            del self.rows[: self.low]
            self.near -= self.low
            self.low = 0

    def _move(self, wm: int) -> None:
        while self.low < len(self.rows) and self.rows[self.low][0] < wm - self.window:
            self._drop_first()
        while self.near < len(self.rows) and self.rows[self.near][0] < wm - self.short:
            self._count_near(self.rows[self.near], -1)
            self.near += 1

    def load(self, rows: list[tuple], wm: int) -> None:
        """Takes up where another frame left: rows are those that it remembered, wm its watermark."""
        for row in sorted(rows):
            if self.rows:
                self.squares += (row[0] - self.rows[-1][0]) ** 2
            self.rows.append(row)
            self._count(row, 1)
            if row[0] >= wm - self.short:
                self._count_near(row, 1)
            else:
                self.near += 1

    def put(self, row: tuple, wm: int) -> None:
        """Remembers a row, unless it is more than the skew behind the watermark, which never falls."""
        self._move(wm)
        if row[0] < wm - min(self.skew, self.window):
            return
        at = len(self.rows)
        if at > self.low and row[:2] < self.rows[-1][:2]:
            at = bisect.bisect(self.rows, row[:2], lo=self.low, key=lambda r: r[:2])
        before = self.rows[at - 1][0] if at > self.low else None
        after = self.rows[at][0] if at < len(self.rows) else None
        if before is not None and after is not None:
            self.squares -= (after - before) ** 2
        self.squares += (row[0] - before) ** 2 if before is not None else 0
        self.squares += (after - row[0]) ** 2 if after is not None else 0
        self.rows.insert(at, row)
        self._count(row, 1)
        if row[0] >= wm - self.short:
            self._count_near(row, 1)
        else:
            self.near += 1
        if len(self.rows) - self.low > self.most:
            self._drop_first()

    def observe(self, row: tuple, wm: int) -> list[float]:
        """The 16 features of a row that arrives, which is then remembered."""
        self._move(wm)
        p = len(self.rows) - self.low
        same_ip, same_port, same_protocol = self.ips.get(row[2], 0), self.ports.get(row[3], 0), self.protocols.get(row[4], 0)
        self.put(row, wm)
        n = len(self.rows) - self.low
        gaps = n - 1
        span = self.rows[-1][0] - self.rows[self.low][0] if gaps > 0 else 0
        mean = span / gaps / 1000 if gaps > 0 else 0.0
        std = math.sqrt(gaps * self.squares - span * span) / gaps / 1000 if gaps > 1 else 0.0
        k = len(self.ips)
        entropy = max(0.0, math.log(n) - self.clog / n) / math.log(k) if k > 1 else 0.0
        return [
            math.log1p(len(self.rows) - self.near), math.log1p(n), math.log1p(len(self.near_ips)), math.log1p(k), math.log1p(len(self.near_ports)), math.log1p(len(self.ports)),
            float(p > 0 and not same_ip), 1 - same_port / p if p else 0.0, 1 - same_protocol / p if p else 0.0, entropy,
            math.log1p(mean), math.log1p(std), std / max(mean + std, 1e-9), self.briefs / n if n else 0.0, float(p == 0), float(row[0] < wm),
        ]

    def held(self) -> list[tuple]:
        """The rows remembered, as load() takes them."""
        return self.rows[self.low :]


def _add(counts: dict, value, by: int) -> int:
    """How often a value is counted now; what isn't counted any more is not in counts."""
    c = counts.get(value, 0) + by
    if c:
        counts[value] = c
    else:
        del counts[value]
    return c


def _clog(c: int) -> float:
    return c * math.log(c) if c > 1 else 0.0


def with_watermark(flows: DataFrame, by: list[str], order: str, ts: str = "ts_us") -> DataFrame:
    """flows with _wm, the largest time of a key up to the row in the order, which has no ties. The running maximum is taken within
    ranges of the order, and of the ranges' largest times before, so that a key with all rows is many tasks."""
    ranged = flows.withColumn("_range", _ranges(flows, order))
    within = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    tops = ranged.groupBy(*by, "_range").agg(F.max(ts).alias("_top"))
    before = F.max("_top").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    tops = tops.select(*[F.col(k).alias(f"_of_{k}") for k in [*by, "_range"]], before.alias("_before"))
    marked = ranged.withColumn("_within", F.max(ts).over(within)).join(tops, _same([*by, "_range"], "_of_"))
    return marked.withColumn("_wm", F.greatest("_within", "_before")).drop("_range", "_within", "_before", *[f"_of_{k}" for k in [*by, "_range"]])


def observed(flows: DataFrame) -> DataFrame:
    """The columns that a Frame takes of a row, with those of flows."""
    return flows.withColumns({"_port": F.coalesce("dst_port", F.lit(-1)), "_protocol": protocol_group(F.col("protocol")), "_brief": F.coalesce(F.col("duration_ms") <= 1000, F.lit(False))})


def temporal_features(flows: DataFrame, window_s: float = 60.0, short_s: float = 10.0, skew_s: float = 5.0, most: int = 2048, keep: tuple[str, ...] = (), block: int = 10) -> DataFrame:
    """(event_id, the columns to keep, the 16 temporal features) of each flow, in order of arrival per sensor and source.

    flows has event_id, sensor_id, src_ip, dst_ip, dst_port, protocol, duration_ms, ts_us (microseconds) and arrival (an order
    without ties, a number). Repeated event ids count once, the first to arrive. The watermark of a key is the running maximum of
    its times; a row before it is late, and one more than the skew before it is told so but isn't remembered; of a source at most
    the last `most` rows by time are. A null port is one value of its own, a null duration isn't short.

    As a watermark never falls, a key falls apart into blocks of `block` windows of its watermark, each with the rows of the
    window before it as a halo. Blocks are dealt by hash, sorted and folded as a stream by a Frame, so a source with all the rows
    is many tasks, none of which holds more than a frame and a batch; each row costs O(log most).
    """
    key = ["sensor_id", "src_ip"]
    first = Window.partitionBy("event_id").orderBy("arrival")
    kept = [c for c in dict.fromkeys(keep) if c != "event_id"]
    need = list(dict.fromkeys(["event_id", *key, "dst_ip", "dst_port", "protocol", "duration_ms", "ts_us", "arrival", *kept]))
    once = flows.select(*need).withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    window, short, skew = (int(x * 1e6) for x in (window_s, short_s, skew_s))
    length = block * window
    mine = F.floor(F.col("_wm") / length)
    marked = observed(with_watermark(once, key, "arrival"))
    halo = F.col("_wm") >= (mine + 1) * length - window
    placed = marked.withColumn("_block", F.explode(F.when(halo, F.array(mine, mine + 1)).otherwise(F.array(mine)))).withColumn("_own", F.col("_block") == mine)
    rows = placed.select(*[F.col(k).alias(f"_k_{k}") for k in key], "_block", "_own", "_wm", "ts_us", F.col("arrival").alias("_arrival"), F.col("dst_ip").alias("_ip"), "_port", "_protocol", "_brief", F.col("event_id").alias("_event"), *[F.col(c).alias(f"_keep_{c}") for c in kept])
    sorted_rows = rows.repartition("_k_sensor_id", "_k_src_ip", "_block").sortWithinPartitions("_k_sensor_id", "_k_src_ip", "_block", "_arrival")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, frame = None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(12)]
            out = []
            for sensor, source, part, own, wm, ts, arrival, ip, port, protocol, brief, _ in zip(*columns):
                if (sensor, source, part) != last:
                    last, frame = (sensor, source, part), Frame(window, short, skew, most)
                row = (ts, arrival, ip, port, protocol, brief)
                if own:
                    out.append(frame.observe(row, wm))
                else:
                    frame.put(row, wm)
            mask = batch.column(3)
            told = [batch.column(i).filter(mask) for i in range(11, batch.num_columns)]
            made = [pa.array(c, pa.float64()) for c in zip(*out)] if out else [pa.array([], pa.float64())] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*told, *made], names=["event_id", *kept, *FEATURES])

    kinds = dict(once.dtypes)
    return sorted_rows.mapInArrow(fold, ", ".join([f"event_id {kinds['event_id']}", *[f"`{c}` {kinds[c]}" for c in kept], *[f"{f} double" for f in FEATURES]]))


def schema_b(flows: DataFrame, **sizes) -> DataFrame:
    """(event_id, the 40 features): portable and temporal. The portable ones go along with the rows, so nothing is joined."""
    from wiretide.operators.features import portable_columns

    portable = portable_columns()
    wide = flows.withColumns(portable)
    return temporal_features(wide, keep=tuple(portable), **sizes)


def schema_b_available(flows: DataFrame) -> DataFrame:
    """One row: whether every row has a time and two addresses of one version."""
    version = lambda c: F.when(F.col(c).rlike(IPV4), 4).when(F.col(c).contains(":"), 6)
    fine = F.col("ts_us").isNotNull() & F.coalesce(version("src_ip") == version("dst_ip"), F.lit(False))
    return flows.agg((F.count_if(~fine) == 0).alias("available"))


def schema_b_of_files(rows: DataFrame, **sizes) -> DataFrame:
    """schema_b() of a dataset's rows in their order in each file (readers.with_positions: source_file, position), each file a sensor of its
    own; event ids are `file:position`. Without rows if any row of the dataset lacks a time or valid endpoints."""
    named = rows.withColumns({"event_id": F.concat_ws(":", "source_file", "position"), "sensor_id": F.col("source_file"), "arrival": F.col("position")})
    told = named.crossJoin(F.broadcast(schema_b_available(rows))).where("available").drop("available")  # one row
    return schema_b(told, **sizes)
