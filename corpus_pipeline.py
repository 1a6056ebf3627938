"""From raw documents to token ids: quality rules, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wiretide.llm import bpe, decontam, linededup, quality, simhash
from wiretide.llm.common import folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the certified cutoffs reject go; null and empty texts are among them. Repeated rows share a verdict; other columns pass, whatever their names."""
    return quality.select_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, the first by id and line stays; n_chars follows the text. All rows stay, repeated ones and those with null ids or texts too."""
    out = linededup.deduplicate(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that pairs with a five-word Jaccard similarity of 0.8 or more connect: that of least id (null first), one of repeated rows. Null, empty and blank texts are one group."""
    return simhash.keep_one_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts hold none. Repeated rows share a verdict."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the token ids of every text, and the digest of the bytes that they decode to. A null text is empty; every row is answered."""
    back = bpe.round_trip(docs, bpe.vocabulary_path())
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte bpe", byte_bpe),
]

#: SQL has neither XXH64 with a seed nor byte-level BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each is written to the shared checkpoint folder and read by the next.

    The folder is removed when the driver ends. Empty tables go through all stages.
    """
    docs = table(spark, sf_dir, "documents")
    top = folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{top}/{i}")
            docs = spark.read.parquet(f"{top}/{i}")
    return docs
