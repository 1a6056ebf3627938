"""Benchmark decontamination: containment of short test items in long documents by size-partitioned MinHash sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wiretide.llm.common import as_bytes, cut, session_of
from wiretide.llm.wordhash import ngrams, starts_within, word_hashes

#: Words of a shingle (an item of fewer is one shingle) and the least share of an item's distinct shingles that a contaminated document holds.
WIDTH, SHARE = 5, 0.8
#: Shingle hashes of items up to which sketches and shingles are broadcast: 40 MB. More go by joins.
BROADCAST = 1_000_000
#: Bytes of text that are hashed together.
PORTION = 1_000_000


def _shingles(texts: list[bytes], widths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number, in order, of all shingles of these widths of the texts in lower case (A-Z)."""
    words, offsets = word_hashes([t.lower() for t in texts])
    found = []
    for width in widths:
        inside = starts_within(offsets, width)
        found.append((ngrams(words, width)[inside] * np.uint64(2 * width + 1), np.repeat(np.arange(len(texts)), np.maximum(0, np.diff(offsets) - width + 1))))
    if len(found) == 1:
        return found[0]
    hashes, of = (np.concatenate(v) for v in zip(*found))
    order = np.argsort(of, kind="stable")
    return hashes[order], of[order]


def item_shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and width of the shingles of items: those of fewer words than the width are one shingle, of none none."""
    _, offsets = word_hashes(texts)
    n = np.diff(offsets)
    out = []
    for w in range(1, width + 1):
        mine = np.flatnonzero(n == w if w < width else n >= w)
        if mine.size:
            hashes, of = _shingles([texts[i] for i in mine.tolist()], [w])
            out.append((hashes, mine[of], np.full(len(of), w)))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    at, size, group = 0, 0, []
    for i, x in enumerate(batch.column(1)):
        text = x.as_py()
        if group and size + len(text) > PORTION:
            yield at, group
            at, size, group = i, 0, []
        group.append(text)
        size += len(text)
    if group:
        yield at, group


def _distinct(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    signed = hashes.view(np.int64)
    order = np.lexsort((signed, of))
    signed, of = signed[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (signed[1:] != signed[:-1]) | (of[1:] != of[:-1])
    return signed[new], of[new]


def shingle_table(rows: DataFrame, id_col: str, text_col: str, widths: list[int], below: int | None = None) -> DataFrame:
    """(id, shingle): the distinct shingle hashes of each row, as signed longs; only those up to below, if given."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _portions(batch):
                hashes, of = _shingles(texts, widths)
                if below is not None:
                    low = hashes.view(np.int64) <= below
                    hashes, of = hashes[low], of[low]
                signed, of = _distinct(hashes, of)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + at)), pa.array(signed)], names=["id", "shingle"])

    return rows.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text")).mapInArrow(run, f"id {kind}, shingle long")


def item_table(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, shingle, width): the shingle hashes of each row of (item_id, text), and their widths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _portions(batch):
                hashes, of, widths = item_shingles(texts, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + at)), pa.array(hashes.view(np.int64)), pa.array(widths.astype(np.int32))], names=["id", "shingle", "width"])

    return items.select(F.col("item_id").alias("id"), as_bytes("text").alias("text")).mapInArrow(run, "id long, shingle long, width int")


def needed(size: int, share: float = SHARE) -> int:
    """Shingles of an item of so many that a document must hold."""
    return max(1, math.ceil(size * share - 1e-9))


def _item_sketches(shingles: DataFrame, share: float) -> DataFrame:
    """(item_id, size, shingle): the least hashes of each item, its bottom-k MinHash sketch. Items are partitioned by size, each
    number of shingles being a partition with a k of its own: k = size - needed + 1 is the least for which a document that holds
    enough of an item of that size must hold one of its sketch."""
    sized = shingles.groupBy("id").agg(F.sort_array(F.collect_list("shingle")).alias("all")).withColumn("size", F.size("all"))
    k = F.col("size") - F.greatest(F.lit(1), F.ceil(F.col("size") * share - 1e-9)) + 1
    return sized.select(F.col("id").alias("item_id"), "size", F.explode(F.slice("all", F.lit(1), k.cast("int"))).alias("shingle"))


def _by_broadcast(docs: DataFrame, items: list, id_col: str, text_col: str, share: float, widths: list[int]) -> DataFrame:
    names = [i for i, _ in items]
    sets = [np.sort(np.array(s, np.int64)) for _, s in items]
    need = np.array([needed(len(s), share) for s in sets], np.int64)
    sketch = [(int(h), j) for j, s in enumerate(sets) for h in s[: len(s) - need[j] + 1]]
    sketch.sort()
    keys, owners = np.array([h for h, _ in sketch], np.int64), np.array([j for _, j in sketch], np.int64)
    shared = session_of(docs).sparkContext.broadcast((names, sets, need, keys, owners))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sets, need, keys, owners = shared.value
        for batch in batches:
            doc, item, held = [], [], []
            for at, texts in _portions(batch):
                hashes, of = _shingles(texts, widths)
                signed = hashes.view(np.int64)
                low = np.flatnonzero(signed <= (keys[-1] if len(keys) else np.iinfo(np.int64).min))
                place = np.minimum(np.searchsorted(keys, signed[low]), max(0, len(keys) - 1))
                for d in np.unique(of[low[keys[place] == signed[low]]] if len(low) else of[:0]).tolist():
                    own = np.unique(signed[np.searchsorted(of, d) : np.searchsorted(of, d, side="right")])
                    found = np.searchsorted(keys, own)
                    until = np.searchsorted(keys, own, side="right")
                    candidates = np.unique(np.concatenate([owners[a:b] for a, b in zip(found, until) if a < b])) if (found < until).any() else []
                    for j in candidates:  # verified by the exact number of shingles held
                        n = int(np.isin(sets[j], own, assume_unique=True).sum())
                        if n >= need[j]:
                            doc.append(d + at)
                            item.append(j)
                            held.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array([names[j] for j in item], pa.int64()), pa.array([len(sets[j]) for j in item], pa.int64()), pa.array(held, pa.int64())],
                names=["doc_id", "item_id", "n_shingles", "n_held"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, item_id long, n_shingles long, n_held long")


def _by_join(docs: DataFrame, shingles: DataFrame, id_col: str, text_col: str, share: float, widths: list[int]) -> DataFrame:
    sketch = _item_sketches(shingles, share)
    top = sketch.agg(F.max("shingle").alias("m")).first()["m"]
    rows = docs.select(F.struct(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_k")).alias("_key"), F.col(text_col).alias("_text"))
    low = shingle_table(rows, "_key", "_text", widths, top)
    candidates = low.join(sketch, "shingle").select("id", "item_id", "size").distinct()
    wanted = shingles.select(F.col("id").alias("item_id"), "shingle").join(candidates, "item_id")
    every = shingle_table(rows.join(candidates.select(F.col("id").alias("_key")).distinct(), "_key", "left_semi"), "_key", "_text", widths)
    held = wanted.join(every, ["id", "shingle"]).groupBy("id", "item_id", "size").agg(F.count_distinct("shingle").alias("n_held"))
    enough = held.where(F.col("n_held") >= F.greatest(F.lit(1), F.ceil(F.col("size") * share - 1e-9)))
    again = rows.select(F.col("_key").alias("id")).join(enough, "id")  # one answer for every row
    return again.select(F.col("id._id").alias("doc_id"), "item_id", F.col("size").cast("long").alias("n_shingles"), F.col("n_held").cast("long"))


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", share: float = SHARE, width: int = WIDTH, broadcast: int = BROADCAST) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_held): the documents that hold at least the given share of an item's distinct shingles.

    Words are runs of other than ASCII white space, A-Z in lower case; shingles have width words. An item of fewer words is one
    shingle, its whole word sequence, which a document holds if it has these words in a row; an item without a word and null
    texts match nothing. Rows of docs that repeat, or have a null id, match alike and are answered as often as they occur; an
    item id that repeats stands for the shingles of all its rows; a null item id is left out. Empty tables give an empty one.
    Other columns are not read.

    The sketch misses nothing (see _item_sketches), and every candidate is verified by its exact number of shared shingles. A
    document's hashes above the largest sketch hash can't match and are passed over. Items are broadcast only if they have
    at most broadcast shingles, which is counted first; then documents are not shuffled. Beyond that both sides are joined,
    with the same rows as result.
    """
    given = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col("text").alias("text"))
    made = cut(item_table(given, width).distinct())
    widths = sorted(r["width"] for r in made.select("width").distinct().collect()) or [width]  # width of them at most
    shingles = made.select("id", "shingle").distinct()
    if shingles.limit(broadcast + 1).count() > broadcast:
        return _by_join(docs, shingles, id_col, text_col, share, widths)
    held = [(r["id"], r["s"]) for r in shingles.groupBy("id").agg(F.collect_list("shingle").alias("s")).collect()]
    return _by_broadcast(docs, held, id_col, text_col, share, widths)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item, all columns. Rows with a null id are judged like others."""
    rows = docs.withColumn("_wt_key", F.struct(F.col(id_col).alias("a"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("b")))
    hit = contained(rows.select("_wt_key", F.col(text_col).alias("_wt_text")), items, "_wt_key", "_wt_text")
    keys = hit.select(F.col("doc_id.a").alias("_wt_a"), F.col("doc_id.b").alias("_wt_b")).distinct()
    same: Column = (rows["_wt_key"]["b"] == keys["_wt_b"]) & rows["_wt_key"]["a"].eqNullSafe(keys["_wt_a"])
    return rows.join(keys, same, "left_anti").drop("_wt_key")


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    from wiretide.llm.common import table

    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_OP7 = f"""
WITH w AS (SELECT item_id AS id, true AS item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM benchmark
  UNION ALL SELECT doc_id, false, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') FROM documents),
v AS (SELECT DISTINCT least(len(w), {WIDTH}) AS v FROM w WHERE item AND len(w) > 0),
s AS (SELECT DISTINCT id, item, v, unnest(CASE WHEN len(w) < v THEN [] ELSE list_transform(range(1, len(w) - v + 2), lambda i: array_to_string(w[i:i + v - 1], ' ')) END) AS s
  FROM w JOIN v ON NOT item OR v = least(len(w), {WIDTH})),
n AS (SELECT id, count(*) AS n FROM s WHERE item GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n.n AS n_shingles, count(*) AS n_held
FROM s d JOIN s i ON d.s = i.s AND d.v = i.v AND NOT d.item AND i.item JOIN n ON n.id = i.id GROUP BY ALL HAVING count(*) >= ceil(n.n * {SHARE} - 1e-9)
"""
