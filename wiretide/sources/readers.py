"""Sources: flow datasets, connection logs, signature logs, operation logs, flow streams, file provenance."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wiretide.operators.datasets import drop_repeated_headers


def read_flow_csv(spark: SparkSession, paths: str | list[str], max_rows: int | None = None) -> DataFrame:
    """CSV files as text columns with source_file, without repeated headers. More rows than max_rows are an error, not a cut."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(paths)
    df = drop_repeated_headers(df).withColumn("source_file", F.col("_metadata.file_name"))
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return df


def with_positions(df: DataFrame) -> DataFrame:
    """A file source's rows with source_file and position, their number in the file from 0. Rows of a split follow one another in a
    partition, and splits of a file by where they start, so a split's offset is the number of rows before it: a row a split is joined
    back, and nothing is sorted."""
    at = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_row", F.monotonically_increasing_id())
    splits = at.groupBy(F.col("_path").alias("_p"), F.col("_block").alias("_b")).agg(F.min("_row").alias("_first"), F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.withColumn("_offset", before).select("_p", "_b", "_first", "_offset")
    met = at.join(offsets, (F.col("_path") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    return met.withColumn("position", F.col("_offset") + F.col("_row") - F.col("_first")).drop("_path", "_block", "_row", "_p", "_b", "_first", "_offset")


def verify_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status) of the files found and those of a manifest, both with path, length and sha256: ok, changed, missing or unexpected."""
    m = manifest.select(F.col("path").alias("_path"), F.col("length").alias("_length"), F.col("sha256").alias("_sha256"))
    both = found.join(m, F.col("path") == F.col("_path"), "full_outer")
    status = F.when(F.col("path").isNull(), "missing").when(F.col("_path").isNull(), "unexpected").when((F.col("length") == F.col("_length")) & (F.lower("sha256") == F.lower("_sha256")), "ok").otherwise("changed")
    return both.select(F.coalesce("path", "_path").alias("path"), status.alias("status"))


def read_conn_log(spark: SparkSession, paths: str | list[str], required: tuple[str, ...] = ("ts", "duration", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes", "id.resp_p", "proto")) -> DataFrame:
    """Connection logs with a #fields header: tabs or three and more spaces part the fields, - and (empty) are null. Files of different headers are read apart."""
    lines = spark.read.text(paths).withColumn("source_file", F.col("_metadata.file_path"))
    heads = lines.where(F.col("value").startswith("#fields")).groupBy("source_file").agg(F.first("value").alias("h")).collect()  # a row a file
    if not heads:
        raise ValueError("no #fields header")
    layouts: dict[str, list[str]] = {}
    for r in heads:
        layouts.setdefault(r["h"], []).append(r["source_file"])
    out = None
    for head, files in layouts.items():
        names = [n.strip() for n in re.split(r"\t| {3,}", head)[1:]]
        if missing := [n for n in required if n not in names]:
            raise ValueError("the log lacks " + ", ".join(missing))
        parts = lines.where(F.col("source_file").isin(files) & ~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("_p", F.split("value", r"\t| {3,}"))
        value = lambda i: F.when(~F.get("_p", F.lit(i)).isin("-", "(empty)", ""), F.get("_p", F.lit(i)))
        one = parts.select(*[value(i).alias("detailed-label" if n == "det_label" else n) for i, n in enumerate(names)], "source_file")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_eve_lines(spark: SparkSession, paths: str | list[str], stream: bool = False) -> DataFrame:
    """Raw log lines (value); a stream reads files as they come."""
    return (spark.readStream if stream else spark.read).text(paths)


def read_ops_logs(lines: DataFrame, event: str = "detection_batch_persisted") -> DataFrame:
    """One row: the sum of published_count over JSON log lines of that event; other lines don't count."""
    j = F.from_json("value", "event STRING, published_count BIGINT")
    return lines.select(j.alias("j")).where(F.col("j.event") == event).agg(F.coalesce(F.sum("j.published_count"), F.lit(0)).alias("published"))


def file_provenance(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length, sha256) of files of up to 2 GB each, hashed on the executors."""
    return spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def read_flow_stream(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """Envelopes {flow, signature} as JSON text lines; micro-batches take at most max_files files."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
