"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wiretide.llm.common import as_bytes, partitions, session_of

#: Buckets of the n-gram hash.
BUCKETS = 1 << 16
#: Documents of a language that training reads at most; they are the same rows on every run. This bounds training alone.
PER_LANGUAGE = 5_000
#: Languages at most, so that the matrix stays below 100 MB.
LANGUAGES = 200
#: Odd multipliers of the hash, one a place, for two and for three characters.
FACTORS = {2: (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), 3: (0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)}
#: N-grams of a text from which they are counted before they are weighed.
LONG = 1 << 16


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: what it counts as (a letter in lower case, else a space), and whether it is a letter."""
    as_, letter = np.full(0x110000, 0x20, np.uint64), np.zeros(0x110000, bool)
    for c in range(0x110000):
        x = chr(c)
        if unicodedata.category(x)[0] == "L":
            low = x.lower()
            as_[c], letter[c] = ord(low[0]), True
    return as_, letter


def ngrams(text: str) -> tuple[np.ndarray, bool]:
    """Buckets of all pairs and triples of characters of a text with a space at either end, and whether it has a letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    as_, letter = _tables()
    c = np.concatenate(([np.uint64(0x20)], as_[points], [np.uint64(0x20)]))
    out = []
    for n, factors in FACTORS.items():
        h = sum(c[k : len(c) - n + 1 + k] * np.uint64(f) for k, f in enumerate(factors)) if len(c) >= n else np.zeros(0, np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(48)).astype(np.intp))
    return np.concatenate(out), bool(letter[points].any())


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[str]:
    return (x.as_py().decode("utf-8", "replace") for x in batch.column(column))


def learnable(id_col: str = "doc_id") -> Column:
    """Rows that training may see: the CRC-32 of the id as text, modulo 5, is not 0. Not for null ids."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) != 0, F.lit(False))


class Model:
    """Languages, the logarithm of their shares, and the log-probability of each bucket in each language."""

    def __init__(self, langs: list[str], prior: np.ndarray, weights: np.ndarray) -> None:
        self.langs, self.prior, self.weights = langs, prior, weights

    def score(self, text: str) -> tuple[str, float]:
        """The likeliest language and its posterior probability; und and 0 if the text has no letter or nothing was learnt."""
        buckets, has = ngrams(text)
        if not has or not self.langs:
            return "und", 0.0
        if len(buckets) >= LONG:
            total = np.bincount(buckets, minlength=BUCKETS) @ self.weights
        else:
            total = self.weights[buckets].sum(axis=0)
        total = total + self.prior
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fits the model on the given rows with a text and a language: all of a language with up to per_language such rows, else
    those whose hashed ids come first, about per_language. Counts are smoothed by adding one half.

    The counts are summed by Spark; 65,536 sums a language come to the driver, for at most LANGUAGES languages (more are an error).
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0)))
    langs = sorted(sizes)
    cut = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / sizes[k]))])[F.col("lang")]
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= cut * float(1 << 30)).select("lang", as_bytes("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), BUCKETS), np.int64)
        place = {k: i for i, k in enumerate(langs)}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
                sums[place[lang]] += np.bincount(ngrams(text)[0], minlength=BUCKETS)
        at, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[at, bucket])], names=["lang", "bucket", "n"])

    found = sample.coalesce(partitions(session_of(docs))).mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((BUCKETS, len(langs)), 0.5)
    counts[found["bucket"].to_numpy(), found["lang"].to_numpy()] += found["n"].to_numpy()
    shares = np.array([sizes[k] for k in langs], float)
    return Model(langs, np.log(shares / shares.sum()), np.log(counts / counts.sum(axis=0)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row: und and 0.0 where the text is null or has no letter. The text alone decides."""
    shared = session_of(docs).sparkContext.broadcast((model.langs, model.prior, model.weights))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(*shared.value)
        for batch in batches:
            found = [scorer.score(t) for t in _texts(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trains on the rows that are not held out and predicts every row.

    Rows with a null id are neither learnt from nor held out. Repeated rows come out as often as they go in; an empty table
    gives an empty one; other columns are not read. A text of any length is scored whole.
    """
    model = train(docs.where(learnable(id_col)), id_col, text_col, lang_col)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return predict(docs, model, id_col, text_col).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    from wiretide.llm.common import table

    return identify(table(spark, sf_dir, "documents"))
