import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_operators import FOLD, T0, fold_rows, loop_drift, loop_temporal, temporal_frame, temporal_rows
from wiretide.operators import incidents, temporal
from wiretide.sources import bus, readers, sinks, store
from wiretide.streaming import jobs, metrics


def streamed(spark, df, folder, parts, by):
    """df as a stream of as many files as parts, in the order of a column."""
    n = df.count()
    for i in range(parts):
        df.where((F.col(by) >= n * i // parts) & (F.col(by) < n * (i + 1) // parts)).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def collected(spark, stream, folder, name):
    with jobs.ending(spark):
        q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    assert q.awaitTermination(180) and q.exception() is None
    return spark.table(name).collect()


def test_temporal_stream_equals_batch(spark, tmp_path):
    """Over three batches; a repeated id is told what it was told first and changes nothing."""
    rows = [(f"{key[1]}/{event}", key, *rest) for event, key, *rest in temporal_rows(60)]
    rows += rows[40:46]
    df = temporal_frame(spark, rows)
    want = {r["event_id"]: [r[f] for f in temporal.FEATURES] for r in temporal.temporal_features(df).collect()}
    got = collected(spark, jobs.stream_temporal(streamed(spark, df, tmp_path / "in", 3, "arrival")), tmp_path / "c", "temporal_out")
    assert sorted(r["arrival"] for r in got) == list(range(len(rows)))
    seen = set()
    for r in sorted(got, key=lambda r: r["arrival"]):
        assert [r[f] for f in temporal.FEATURES] == pytest.approx(want[r["event_id"]], abs=1e-9)
        assert r["repeated"] == (r["event_id"] in seen)
        seen.add(r["event_id"])


class CountedState:
    """A value or a map in memory that counts the calls to it."""

    calls = 0

    def __init__(self):
        self.at = {}

    def get(self):
        return self.getValue(None)

    def update(self, value):
        self.updateValue(None, value)

    def exists(self):
        return self.containsKey(None)

    def containsKey(self, key):
        CountedState.calls += 1
        return key in self.at

    def getValue(self, key):
        CountedState.calls += 1
        return self.at.get(key)

    def updateValue(self, key, value):
        CountedState.calls += 1
        self.at[key] = value

    def removeKey(self, key):
        CountedState.calls += 1
        del self.at[key]

    def iterator(self):
        CountedState.calls += 1
        return iter(list(self.at.items()))


class OneHandle:
    def __init__(self):
        self.timers, self.of = [], {}

    def getValueState(self, name, *_):
        return self.of.setdefault(name, CountedState())

    def getMapState(self, name, *_):
        return self.of.setdefault(name, CountedState())

    def registerTimer(self, at):
        self.timers.append(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


@pytest.mark.parametrize("answers", [4, 256])
def test_temporal_state_is_called_by_source_not_by_row(monkeypatch, answers):
    """A source's batch of a hundred rows makes a few calls to the state, answers are found in any number of buckets, and told anew once they are too old."""
    monkeypatch.setattr(jobs, "ANSWERS", answers, raising=False)
    rows = [(f"e{i}", *r[2:]) for i, r in enumerate(temporal_rows(400))]
    want = {e: f for e, f in loop_temporal([(e, "k", *r) for e, *r in rows], 60_000_000, 10_000_000, 5_000_000, 2048).items()}
    p = jobs.TemporalProcessor(60_000_000, 10_000_000, 5_000_000, 2048, 1000)
    p.init(OneHandle())
    CountedState.calls = 0

    def batch(part, first, ms):
        df = pd.DataFrame([(e, first + i, ts, ip, -1 if port is None else port, proto, d <= 1000) for i, (e, ts, ip, port, proto, d) in enumerate(part)], columns=["event_id", "arrival", "ts_us", "dst_ip", "port", "proto", "brief"])
        out = pd.concat(list(p.handleInputRows(("s", "a"), iter([df.sample(frac=1, random_state=1)]), At(ms)))).sort_values("arrival")
        return list(zip(out["event_id"], out["repeated"], out["features"]))

    for at in range(0, 400, 100):
        for e, repeated, f in batch(rows[at : at + 100], at, at):
            assert not repeated and list(f) == pytest.approx(want[e], abs=1e-9)
    if answers == 256:
        assert CountedState.calls < 40
    for e, repeated, f in batch(rows[::7], 400, 900):
        assert repeated and list(f) == pytest.approx(want[e], abs=1e-9)
    again = batch(rows[:150], 500, 1050)  # the first hundred were told at 0
    assert [r for _, r, _ in again] == [False] * 100 + [True] * 50
    buckets = len(p.answers.at)
    assert buckets == 1 if answers > 4 and len(want) <= answers else buckets > 1


def test_incident_stream_equals_batch(spark, tmp_path):
    rows = fold_rows() + [(f"b{i}", T0 + 700_000_000 + i * 1_000_000, *r[2:]) for i, r in enumerate(fold_rows())]
    df = spark.createDataFrame([(*r, "s", i) for i, r in enumerate(rows)], FOLD + ", sensor_id string, i long")
    want = {r["alert_id"]: (r["incident_id"], r["title"]) for r in incidents.assign_incidents(df, ("sensor_id",)).collect()}
    got = collected(spark, jobs.stream_incidents(streamed(spark, df, tmp_path / "in", 3, "i")), tmp_path / "c", "incident_out")
    ids = {r["alert_id"]: r["first_alert_id"] for r in got}
    assert set(ids) == set(want) and len(set(ids.values())) == len({v[0] for v in want.values()}) and {r["alert_id"]: r["title"] for r in got} == {k: v[1] for k, v in want.items()}


def test_drift_stream(spark, tmp_path):
    values = [0.1] * 20 + [0.9] * 20 + [0.1] * 40
    df = spark.createDataFrame([("m", "anomaly_score", f"d{i}", i, v) for i, v in enumerate(values)], "model_version string, signal string, detection_id string, arrival long, value double")
    got = collected(spark, jobs.stream_drift(streamed(spark, df, tmp_path / "in", 3, "arrival"), window=8), tmp_path / "c", "drift_out")
    assert sorted(int(r["detection_id"][1:]) for r in got) == loop_drift(values, 8, 0.20)


def envelope(i, port=80):
    flow = {"event_id": f"e{i}", "sensor_id": "s", "timestamp_start": "2026-01-01T00:00:00Z", "timestamp_end": "2026-01-01T00:00:01Z", "duration_ms": 1.0, "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "src_port": 5, "dst_port": port, "protocol": "TCP", "packets_forward": 1, "packets_reverse": 1, "bytes_forward": 1, "bytes_reverse": 1}
    return json.dumps({"flow": flow | {"known_p": 0.9, "confidence": 0.9, "iso_s": 0.1, "rec_s": 0.1, "contextual_score": 0.0, "arrival": i}, "odd": 1})


@pytest.fixture
def compiled(spark):
    """Scoring chains are long: interpreted, their shared parts would be worked out again and again."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


def test_detection_stream_is_idempotent_and_quarantines(spark, tmp_path, compiled):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("\n".join([envelope(1), envelope(2), envelope(1), envelope(3, 70_000), "{broken"]))
    run = lambda: jobs.start_detection(readers.read_flow_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(180)
    run()
    (source / "b.txt").write_text("\n".join([envelope(2), envelope(4)]))
    run()
    tables = {t: spark.read.parquet(str(tmp_path / "out" / t)) for t in ("detections", "alerts", "dead_letters")}
    assert tables["detections"].count() == tables["alerts"].count() == 3
    dead = {r["error_code"]: r for r in tables["dead_letters"].collect()}
    assert set(dead) == {"dst_port", "malformed"} and dead["dst_port"]["expected_fields_present"] == ["flow"] and dead["dst_port"]["unexpected_field_count"] == 1
    again = jobs.detect(spark.createDataFrame([(envelope(4),), (envelope(5),)], "value string")).drop("value", "error_code")
    out = store.ingest(again.withColumn("ts_us", F.unix_micros("timestamp_end")), str(tmp_path / "out"), "x").collect()
    assert sorted(r["is_new"] for r in out) == [False, True] and all(r["alert_id"] for r in out)


def test_alert_feed_tells_the_newest_of_all(spark, tmp_path):
    """Old alerts are no news; a changed one is; a restart goes on from what was told."""
    told = []
    rows = [("a", 5, "x"), ("b", 6, "x"), ("old", 1, "x"), ("older", 0, "x"), ("b", 6, "y"), ("c", 9, "x")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "alert_id string, ts_us long, state string, i long")
    jobs.alert_feed(streamed(spark, df.where("i < 4"), tmp_path / "in", 2, "i").drop("i"), str(tmp_path / "c"), told.append, n=2).awaitTermination(180)
    assert told == [[("b", 6, "x"), ("a", 5, "x")]]
    for i in (4, 5):
        df.where(F.col("i") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("i")
    jobs.alert_feed(again, str(tmp_path / "c"), told.append, n=2).awaitTermination(180)
    assert told[1:] == [[("b", 6, "y"), ("a", 5, "x")], [("c", 9, "x"), ("b", 6, "y")]]


def test_sources(spark, tmp_path):
    (tmp_path / "conn.log").write_text("#separator x\n#fields\tts\tuid\tid.resp_p\tproto\tduration\torig_pkts\tresp_pkts\torig_ip_bytes\tresp_ip_bytes\tdet_label\n1.5\tC1\t80\ttcp\t-\t1\t2\t3\t4\tOkiru\n")
    r = readers.read_conn_log(spark, str(tmp_path / "conn.log")).first()
    assert r["duration"] is None and r["id.resp_p"] == "80" and r["detailed-label"] == "Okiru"
    (tmp_path / "f.csv").write_text("a,b,c\n1,2,3\na,b,c\n4,5,6\n")
    assert readers.read_flow_csv(spark, str(tmp_path / "f.csv")).count() == 2
    with pytest.raises(ValueError):
        readers.read_flow_csv(spark, str(tmp_path / "f.csv"), max_rows=1)
    lines = spark.createDataFrame([('{"event":"detection_batch_persisted","published_count":3}',), ("plain",), ('{"event":"other","published_count":9}',)], "value string")
    assert readers.read_ops_logs(lines).first()["published"] == 3
    sinks.write_csv(sinks.export_rows(spark.createDataFrame([("=x", "10.0.0.1", 5)], "event_id string, src_ip string, secret int"), salt=b"k"), str(tmp_path / "out"))
    assert "secret" not in (text := "".join(f.read_text() for f in (tmp_path / "out").glob("*.csv"))) and "'=x" in text and "10.0.0.1" not in text


def scored_rows(spark, rows):
    return spark.createDataFrame(rows, "detection_id string, event_id string, arrival long, verdict string, severity string, final_risk_score double, sensor_id string, ts_us long, signature_severity string")


def test_store_asks_for_rows_once_for_filters_and_once_to_write(spark, tmp_path):
    """An empty store doesn't look at the keys; later a batch's rows are made for the filters and for the one shuffle to their buckets, however many segments are read."""
    at = str(tmp_path / "s")
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = lambda low, high: spark.range(low, high).selectExpr("concat('k', id % 90) AS k", "id", "id % 7 AS v").mapInArrow(count, "k string, id long, v long")
    store.put_new(rows(0, 50), at, "t", "k", "id", "1")
    assert made.value == 50
    store.commit(spark, at, "1")
    new = store.put_new(rows(30, 130), at, "t", "k", "id", "2")
    assert made.value == 50 + 2 * 100
    assert sorted(tuple(r) for r in new.select("k", "id", "v").collect()) == sorted((f"k{i}", i, i % 7) for i in range(50, 90))


def test_store(spark, tmp_path):
    """First write wins over batches; what isn't committed isn't seen; a batch again gives the same; few segments are read; compaction changes no answer."""
    at = str(tmp_path / "s")
    row = lambda i, verdict="needs_review", arrival=0, sig=None: (f"d{i}", f"e{i % 40}", arrival, verdict, "low", 1.0, f"s{i % 3}", 1000 + i, sig)
    one = scored_rows(spark, [row(i, "benign" if i % 2 else "needs_review", sig="high" if i % 5 == 0 else None) for i in range(50)] + [row(0, "benign", 5)])
    first = {r["detection_id"]: tuple(r[1:]) for r in store.ingest(one, at, "1").collect()}
    assert first == {f"d{i}": (None if i % 2 else f"alert-d{i}", True) for i in range(50)}
    schema = one.schema
    assert store.read(spark, at, "flows", schema).count() == 40 and store.read(spark, at, "signatures", store.SIGNATURE).count() == 8
    store.put_new(scored_rows(spark, [row(60)]), at, "detections", "detection_id", "arrival", "lost")  # never committed
    two = scored_rows(spark, [row(0, "benign"), row(1, "needs_review"), row(60), row(61, "benign"), (None, "e", 0, "benign", "low", 1.0, "s", 5, None)])
    want = {"d0": ("alert-d0", False), "d1": (None, False), "d60": ("alert-d60", True), "d61": (None, True), None: (None, False)}
    for _ in range(2):
        assert {r["detection_id"]: tuple(r[1:]) for r in store.ingest(two, at, "2").collect()} == want
    assert store.read(spark, at, "detections", schema).count() == 52 and store.read(spark, at, "alerts", store.ALERT).count() == 26
    assert len(store.segments(spark.createDataFrame([("d3",), ("none",)], "detection_id string"), at, "detections", "detection_id", "x", store.BUCKETS)) <= 2
    tables = {"detections": ("detection_id", schema), "alerts": ("detection_id", store.ALERT), "flows": ("event_id", store.read(spark, at, "flows", schema).drop("batch").schema), "sensors": (None, store.SENSOR)}
    before = sorted(map(str, store.sensors(spark, at).collect()))
    store.compact(spark, at, tables, ["1", "2"], "c1")
    assert [r[0] for r in store.committed(spark, at).collect()] == ["c1"] and sorted(map(str, store.sensors(spark, at).collect())) == before
    three = scored_rows(spark, [row(0, "benign"), row(61), row(70)])
    assert {r["detection_id"]: tuple(r[1:]) for r in store.ingest(three, at, "3").collect()} == {"d0": ("alert-d0", False), "d61": (None, False), "d70": ("alert-d70", True)}


def test_topic(spark, tmp_path):
    """Batches of bounded size in order; a publication is whole and once."""
    topic, out = str(tmp_path / "t"), str(tmp_path / "o")
    bus.publish(spark.createDataFrame([(f"a{i}",) for i in range(5)], "value string").coalesce(1), topic, "p1")
    bus.publish(spark.createDataFrame([(f"a{i}",) for i in range(5)], "value string").coalesce(1), topic, "p1")  # again
    bus.publish(spark.createDataFrame([(f"b{i}\n",) for i in range(4)], "value string").repartition(3), topic)
    assert sorted(r[0] for r in bus.read_topic(spark, topic).collect()) == [f"a{i}" for i in range(5)] + [f"b{i}\n" for i in range(4)]
    (tmp_path / "t" / "data" / "lost.jsonl").write_text('"x"\n')  # of a task whose batch was never committed
    sizes = []

    def see(batch, _):
        sizes.append(batch.count())
        if sizes[-1]:
            bus.publish(batch, out, f"see-{_}")

    q = bus.read_topic_stream(spark, topic, rows=4).writeStream.foreachBatch(see).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(n for n in sizes if n) == [1, 4, 4] and bus.read_topic(spark, out).count() == 9
    bus.publish(spark.createDataFrame([("c",)], "value string"), topic)
    q = bus.read_topic_stream(spark, topic, rows=4).writeStream.foreachBatch(see).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in bus.read_topic(spark, out).collect())[-1] == "c" and bus.read_topic(spark, out).count() == 10
    with pytest.raises(Exception, match="payload_too_large"):
        bus.publish(spark.createDataFrame([("y" * 70_000,)], "value string"), topic)
    assert bus.read_topic(spark, topic).count() == 10


def test_topic_goes_on_within_a_file(spark, tmp_path, monkeypatch):
    """A batch reads no more of a long file than from the last mark before it, and gets what reading from the start gets."""
    topic = str(tmp_path / "t")
    bus.publish(spark.range(3_000).select(F.format_string("%06d", "id").alias("value")).coalesce(1), topic)
    read, lines = [], bus._lines
    monkeypatch.setattr(bus, "_lines", lambda *a: (read.append(1) or x for x in lines(*a)))
    reader = bus.TopicStreamReader({"path": topic, "rows": 700})
    at, got = reader.initialOffset(), []
    while True:
        rows, end = reader.read(at)
        rows = [r[0] for r in rows]
        assert rows == [r[0] for r in reader.readBetweenOffsets(at, end)]
        if not rows:
            break
        got += rows
        at = end
    assert got == [f"{i:06}" for i in range(3_000)]
    assert len(read) <= 2 * (3_000 + 6 * bus.MARK)  # each message is read twice here, and less than MARK before each of five batches



def test_detections_are_published(spark, tmp_path, compiled):
    topic, out = str(tmp_path / "in"), str(tmp_path / "out")
    bus.publish(spark.createDataFrame([(envelope(1),), (envelope(2, 70_000),), ("{broken",), (envelope(3),)], "value string"), topic)
    q = jobs.start_publication(bus.read_topic_stream(spark, topic), out, str(tmp_path / "c"), processingTime="0 seconds")
    q.processAllAvailable()
    q.stop()
    told = [json.loads(r[0]) for r in bus.read_topic(spark, out).collect()]
    assert {t["flow"]["event_id"] for t in told} == {"e1", "e3"} and all(set(t) == {"flow", "signature", "detection"} and t["detection"]["verdict"] == "known_attack" and t["signature"] is None for t in told)


def test_runtime_metrics(spark, tmp_path, compiled):
    recorder = metrics.Recorder()
    spark.streams.addListener(recorder)
    try:
        source = tmp_path / "in"
        source.mkdir()
        (source / "a.txt").write_text("\n".join([envelope(1), envelope(2), envelope(3, 70_000), "{broken"]))
        found = metrics.observed(jobs.detect(readers.read_flow_stream(spark, str(source))))
        for _ in range(2):
            q = found.writeStream.format("noop").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination(180)
            (source / "b.txt").write_text(envelope(4))
        for _ in range(100):
            if sum(r[3] == "rows" and r[4] == "all" for r in recorder.rows) >= 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(recorder)
    told = {(r["metric"], r["label"]): r["value"] for r in metrics.totals(recorder.table(spark).where("query = 'watched'")).collect()}
    assert told["rows", "all"] == told["input_rows", "all"] == 5 and told["rows", "sound"] == 3 and told["error", "dst_port"] == told["error", "malformed"] == 1
    assert told["verdict", "known_attack"] == 3 and told["risk", "largest"] > 0 and told["lag_ms", "event_time"] > 0 and ("duration_ms", "triggerExecution") in told


def test_files_in_row_order(spark, tmp_path):
    """Positions follow the rows of a file over its splits; a dataset with one bad row has no temporal features."""
    names = ["src_ip", "dst_ip", "dst_port", "protocol", "duration_ms", "ts_us", "packets_forward", "packets_reverse", "bytes_forward", "bytes_reverse"]
    for f in range(2):
        rows = [f"10.0.{f}.{i % 3},10.1.0.{i % 5},{80 + i % 2},TCP,{i % 7}.0,{T0 + i * 1_000_000},1,1,10,10" for i in range(400)]
        (tmp_path / f"f{f}.csv").write_text("\n".join([",".join(names), *rows]) + "\n")
    kinds = "src_ip string, dst_ip string, dst_port int, protocol string, duration_ms double, ts_us long, packets_forward long, packets_reverse long, bytes_forward long, bytes_reverse long"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = readers.with_positions(spark.read.schema(kinds).option("header", True).csv(str(tmp_path)))
        got = rows.select("source_file", "position", "ts_us").collect()
        assert rows.rdd.getNumPartitions() > 2
        assert sorted((r[0], r[1]) for r in got) == [(f"f{f}.csv", i) for f in range(2) for i in range(400)]
        assert all(r["ts_us"] == T0 + r["position"] * 1_000_000 for r in got)
        out = temporal.schema_b_of_files(rows)
        want = temporal.temporal_features(rows.withColumns({"event_id": F.concat_ws(":", "source_file", "position"), "sensor_id": F.col("source_file"), "arrival": F.col("ts_us")}))
        assert len(out.columns) == 41 and out.count() == 800
        assert {tuple(r) for r in out.select(*want.columns).collect()} == {tuple(r) for r in want.collect()}
        bad = rows.withColumn("dst_ip", F.when((F.col("position") == 7) & (F.col("source_file") == "f0.csv"), "fe80::1").otherwise(F.col("dst_ip")))
        assert temporal.schema_b_of_files(bad).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_against_a_manifest(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text(name * 10)
    found = readers.file_provenance(spark, str(tmp_path))
    manifest = found.where("path <> 'c'").withColumn("sha256", F.when(F.col("path") == "b", "00").otherwise(F.upper("sha256"))).unionByName(spark.createDataFrame([("d", 1, "ff")], "path string, length long, sha256 string"))
    assert {r["path"]: r["status"] for r in readers.verify_files(found, manifest).collect()} == {"a": "ok", "b": "changed", "c": "unexpected", "d": "missing"}
