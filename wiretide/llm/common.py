"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space of the word rule: a word is a longest run of other characters.
WS = r"\x20\x09-\x0D"


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="wiretide-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, so that a lost executor costs one stage and nothing is computed twice."""
    ensure_checkpoint_dir(session_of(df))
    return df.checkpoint(eager=True)


def folder(spark: SparkSession) -> str:
    """A new name in the shared folder; what is written there is removed when the driver ends."""
    name = f"{ensure_checkpoint_dir(spark)}/wiretide-{uuid.uuid4()}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


def store(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder. Unlike cut() it forgets the plan's estimate of sizes, of which a loop of
    joins makes the product in each round, and plans what follows by the true size."""
    spark = session_of(df)
    name = folder(spark)
    df.write.parquet(name)
    return spark.read.parquet(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_spread(big: DataFrame, small: DataFrame, on: list[str], n: str, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """big joined with small, whose rows are unique in on and say in n how many rows of big they meet; how is inner or left.

    A key that meets more rows than an even share of a partition is salted: its row of small goes to as many places as it has
    such shares, and its rows of big are dealt over them. There are fewer such keys than partitions, so their list is
    broadcast. counts, small if not given, has on and n for all keys; it is read twice, so it should be written.
    """
    counts = small if counts is None else counts
    total = counts.agg(F.sum(n)).first()[0] or 0
    share = max(1, -(-total // partitions(session_of(big))))
    hot = F.broadcast(counts.where(F.col(n) > share).select(*on, F.ceil(F.col(n) / share).cast("int").alias("_places")))
    place = F.pmod(F.xxhash64(*[c for c in big.columns if c not in on]), F.coalesce("_places", F.lit(1))).cast("int")
    dealt = big.join(hot, on, "left").withColumn("_place", place).drop("_places")
    copies = small.join(hot, on, "left").withColumn("_place", F.explode(F.sequence(F.lit(0), F.coalesce("_places", F.lit(1)) - 1))).drop("_places")
    return dealt.join(copies, [*on, "_place"], how).drop("_place")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart that share an id; rows that agree in id and text are one document."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def as_bytes(text_col: str) -> Column:
    """The text as UTF-8 bytes for Arrow, null as empty."""
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
