"""An append-only store of keyed tables: first write wins, by key filters, with one commit a batch.

Layout below a folder: `<table>/batch=<id>/bucket=<b>` holds rows, `_filters/<table>/batch=<id>` a bitmap of the keys of each bucket,
`_commits/batch=<id>` one row, written last. What has no commit is not read, and a batch that is run again after a loss writes
over what it left. Keys are dealt to buckets by hash. A batch reads the filters of the buckets that it touches, 4 KB for each
bucket of each batch, and of the stored rows only the keys of those buckets of those batches whose filter has a key's bit.
compact() merges batches, so that filters stay few.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

#: Buckets of a table. A bitmap has 32,768 bits, so a batch (or a compacted one) should have at most some thousand keys a bucket.
BUCKETS = 64
BITS = 32_768


def _hash(key: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"))


def _placed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """rows with bucket and the key's bit in its bucket's filter."""
    h = _hash(key)
    return rows.withColumns({"bucket": F.pmod(h, F.lit(buckets)).cast("int"), "_bit": F.pmod(F.shiftright(h, 17), F.lit(BITS)).cast("long")})


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that may not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


COMMIT = T.StructType([T.StructField("batch", T.StringType()), T.StructField("buckets", T.IntegerType()), T.StructField("replaces", T.ArrayType(T.StringType()))])
FILTER = T.StructType([T.StructField("batch", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("bits", T.BinaryType())])


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """(batch) of what is committed and not replaced by a compacted one."""
    log = read_or_empty(spark, f"{folder}/_commits", COMMIT)
    return log.join(log.select(F.explode("replaces").alias("batch")), "batch", "left_anti").select("batch")


def read(spark: SparkSession, folder: str, table: str, schema: T.StructType) -> DataFrame:
    """The rows of a table in all committed batches, with batch."""
    every = T.StructType([*[f for f in schema if f.name not in ("batch", "bucket")], T.StructField("batch", T.StringType()), T.StructField("bucket", T.IntegerType())])
    return read_or_empty(spark, f"{folder}/{table}", every).join(F.broadcast(committed(spark, folder)), "batch", "left_semi").drop("bucket")  # a name a batch


def segments(keys: DataFrame, folder: str, table: str, key: str, batch_id: str, buckets: int) -> list[tuple[str, int]]:
    """(batch, bucket) of the stored rows that may hold one of the keys: those whose filter has its bit. At most buckets x batches names."""
    spark = keys.sparkSession
    live = committed(spark, folder).where(F.col("batch") != batch_id)
    if live.isEmpty():
        return []
    filters = read_or_empty(spark, f"{folder}/_filters/{table}", FILTER).join(F.broadcast(live), "batch", "left_semi")
    asked = _placed(keys.select(key), key, buckets).groupBy("bucket").agg(F.collect_set("_bit").alias("_asked"))  # at most BITS numbers a bucket
    byte = lambda p: F.conv(F.hex(F.substring("bits", (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.exists("_asked", lambda p: F.bit_get(byte(p), (p % 8).cast("int")) == 1)
    return [(r["batch"], r["bucket"]) for r in filters.join(asked, "bucket").where(held).select("batch", "bucket").distinct().collect()]


def _read_segments(spark: SparkSession, found: list[tuple[str, int]], folder: str, table: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{folder}/{table}/batch={b}/bucket={n}" for b, n in sorted(found)])


def stored(keys: DataFrame, folder: str, table: str, key: str, schema: T.StructType, batch_id: str, buckets: int = BUCKETS) -> DataFrame:
    """The stored rows of a table that share a key with keys, read from the segments that may hold them."""
    spark = keys.sparkSession
    found = segments(keys, folder, table, key, batch_id, buckets)
    if not found:
        return spark.createDataFrame([], schema)
    return _read_segments(spark, found, folder, table, schema).join(keys.select(key).distinct(), key, "left_semi")


def put_new(rows: DataFrame, folder: str, table: str, key: str, order: str, batch_id: str, buckets: int = BUCKETS) -> DataFrame:
    """Writes the rows whose key is stored nowhere, of equal keys the first by order; returns them as written. They count once the batch is committed.

    Rows with a null key are left out. Repeating a batch writes over it. Rows and the stored keys of the segments that may hold
    theirs meet in the bucket that is written, so rows are shuffled once.
    """
    spark = rows.sparkSession
    named = _placed(rows.where(F.col(key).isNotNull()), key, buckets).drop("_bit").withColumn("_stored", F.lit(False))
    found = segments(named, folder, table, key, batch_id, buckets)
    if found:
        known = _placed(_read_segments(spark, found, folder, table, T.StructType([rows.schema[key]])), key, buckets).drop("_bit")
        named = named.unionByName(known.withColumn("_stored", F.lit(True)), allowMissingColumns=True)
    first = Window.partitionBy("bucket", key).orderBy(F.desc("_stored"), order)
    new = named.repartition("bucket").withColumn("_place", F.row_number().over(first)).where("_place = 1 and not _stored").drop("_place", "_stored")
    path = f"{folder}/{table}/batch={batch_id}"
    new.write.mode("overwrite").partitionBy("bucket").parquet(path)
    _index(spark, folder, table, key, rows.schema, batch_id, buckets)
    return spark.read.schema(rows.schema).parquet(path)


def _index(spark: SparkSession, folder: str, table: str, key: str, schema: T.StructType, batch_id: str, buckets: int) -> None:
    written = spark.read.schema(T.StructType([schema[key]])).parquet(f"{folder}/{table}/batch={batch_id}")
    bitmaps = _placed(written, key, buckets).groupBy("bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"))
    bitmaps.coalesce(1).write.mode("overwrite").parquet(f"{folder}/_filters/{table}/batch={batch_id}")


def commit(spark: SparkSession, folder: str, batch_id: str, replaces: list[str] | None = None, buckets: int = BUCKETS) -> None:
    """Makes what the batch wrote count, all tables at once."""
    row = spark.createDataFrame([(buckets, replaces or [])], T.StructType(COMMIT.fields[1:]))
    row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/_commits/batch={batch_id}")


def compact(spark: SparkSession, folder: str, tables: dict[str, tuple[str | None, T.StructType]], batches: list[str], batch_id: str, buckets: int = BUCKETS) -> None:
    """Merges committed batches into one, for all tables (name: (key, schema); key null for tables without one). Readers see either the old
    ones or the new one. Old folders are left for whoever still reads them."""
    for table, (key, schema) in tables.items():
        rows = read(spark, folder, table, schema).where(F.col("batch").isin(batches)).drop("batch")
        path = f"{folder}/{table}/batch={batch_id}"
        if key is None:
            rows.write.mode("overwrite").parquet(path)
        else:
            _placed(rows, key, buckets).drop("_bit").repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)
            _index(spark, folder, table, key, schema, batch_id, buckets)
    commit(spark, folder, batch_id, batches, buckets)


#: The columns of the tables that ingest() writes.
ALERT = T.StructType([T.StructField(n, T.StringType()) for n in ("detection_id", "alert_id", "flow_event_id", "severity", "verdict")] + [T.StructField("final_risk_score", T.DoubleType())])
SENSOR = T.StructType([T.StructField("sensor_id", T.StringType()), T.StructField("first_us", T.LongType()), T.StructField("last_us", T.LongType()), T.StructField("flows", T.LongType())])
SIGNATURE = T.StructType([T.StructField("signature_event_id", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("flow_event_id", T.StringType())])
FLOW_COLUMNS = ("event_id", "sensor_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ts_us", "duration_ms")


def ingest(batch: DataFrame, folder: str, batch_id: str, buckets: int = BUCKETS) -> DataFrame:
    """Writes a batch of scored flows to the tables flows, signatures, detections, alerts and sensors below folder, with one commit.
    Returns (detection_id, alert_id, is_new) for every detection of the batch; alert_id is null for benign ones.

    batch has detection_id, event_id, arrival, verdict, severity, final_risk_score and what there is of FLOW_COLUMNS; a row with a
    signature_severity has a signature, named by signature_event_id or else by its flow. First write wins: a detection that is
    stored changes nothing, and is answered by its stored alert; flows and signatures are written where they are absent, only for
    new detections; a sensor's times and counts are those of its new flows.
    """
    spark = batch.sparkSession
    args = (folder, batch_id)
    new = put_new(batch, folder, "detections", "detection_id", "arrival", batch_id, buckets)
    flow = put_new(new.select(*[c for c in FLOW_COLUMNS if c in new.columns], "arrival"), folder, "flows", "event_id", "arrival", batch_id, buckets)
    if "signature_severity" in new.columns:
        named = F.col("signature_event_id") if "signature_event_id" in new.columns else F.concat(F.lit("signature-"), "event_id")
        told = new.where("signature_severity is not null").select(named.cast("string").alias("signature_event_id"), F.col("signature_severity").alias("severity"), F.col("event_id").cast("string").alias("flow_event_id"))
        put_new(told, folder, "signatures", "signature_event_id", "flow_event_id", batch_id, buckets)
    alert = new.where("verdict <> 'benign'").select(
        F.col("detection_id").cast("string").alias("detection_id"), F.concat(F.lit("alert-"), "detection_id").alias("alert_id"), F.col("event_id").cast("string").alias("flow_event_id"),
        F.col("severity").cast("string").alias("severity"), F.col("verdict").cast("string").alias("verdict"), F.col("final_risk_score").cast("double").alias("final_risk_score"),
    )
    fresh = put_new(alert, folder, "alerts", "detection_id", "alert_id", batch_id, buckets)
    if {"sensor_id", "ts_us"} <= set(flow.columns):
        seen = flow.groupBy("sensor_id").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("flows"))
        seen.write.mode("overwrite").parquet(f"{folder}/sensors/batch={batch_id}")
    commit(spark, *args, buckets=buckets)
    asked = batch.select(F.col("detection_id").cast("string").alias("detection_id")).distinct()
    repeated = asked.join(new.select(F.col("detection_id").cast("string").alias("detection_id")), "detection_id", "left_anti")
    old = stored(repeated, folder, "alerts", "detection_id", ALERT, batch_id, buckets)
    known = fresh.select("detection_id", "alert_id").unionByName(old.select("detection_id", "alert_id"))
    told = new.select(F.col("detection_id").cast("string").alias("detection_id"), F.lit(True).alias("is_new"))
    return asked.join(told, "detection_id", "left").join(known, "detection_id", "left").select("detection_id", "alert_id", F.coalesce("is_new", F.lit(False)).alias("is_new"))


def sensors(spark: SparkSession, folder: str) -> DataFrame:
    """(sensor_id, first_us, last_us, flows), added up over the batches."""
    rows = read(spark, folder, "sensors", SENSOR)
    return rows.groupBy("sensor_id").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("flows").alias("flows"))
