"""Exact nearest neighbours of vectors, by cells of space and by the distances that still matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wiretide.scratch import checkpoints

#: Reference vectors a cell, vectors a leaf within it, and queries that are one task's of a cell. Sizes of work, not limits of results.
CELL, LEAF, PIECE = 32_768, 128, 65_536


def _halves(x: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """rows parted at medians of their widest feature into parts of at most `size`."""
    if len(rows) <= size:
        return [rows]
    some = x[rows]
    order = np.argpartition(some[:, int(np.argmax(some.max(axis=0) - some.min(axis=0)))], len(rows) // 2)
    return _halves(x, rows[order[: len(rows) // 2]], size) + _halves(x, rows[order[len(rows) // 2 :]], size)


def _apart(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squares of the least distances between boxes."""
    return (np.maximum(np.maximum(lows - high, low - highs), 0) ** 2).sum(axis=-1)


class Cell:
    """The reference vectors of a cell, in leaves with boxes; nearest() searches for those of queries."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        leaves = _halves(x, np.arange(len(x)), LEAF)
        at = np.concatenate(leaves)
        self.x, self.ids, self.counts = x[at], ids[at], counts[at]
        self.ends = np.cumsum([0, *map(len, leaves)])
        self.low, self.high = (np.stack([f(x[leaf], axis=0) for leaf in leaves]) for f in (np.min, np.max))

    def _squares(self, q: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([np.arange(self.ends[i], self.ends[i + 1]) for i in leaves])
        out = np.zeros((len(q), len(at)))
        for f in range(q.shape[1]):
            out += (q[:, f, None] - self.x[None, at, f]) ** 2
        return out, at

    def nearest(self, q: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(row of q, square of distance, id, count) of what is within each row's bound (a square) and isn't beyond its k-th
        vector, ties included, some hundred rows at a time; and (rows, squares of the k-th distances)."""
        for rows in _halves(q, np.arange(len(q)), 2 * LEAF):
            some, limit = q[rows], bound[rows]
            away = _apart(some.min(axis=0), some.max(axis=0), self.low, self.high)
            if not np.isfinite(limit).all():
                order = np.argsort(away, kind="stable")
                first = order[: int(np.searchsorted(np.cumsum(np.diff(self.ends)[order]), k)) + 2]
                d, _ = self._squares(some, first)
                if d.shape[1] >= k:
                    limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
            near = np.flatnonzero(away <= limit.max())
            if not len(near):
                yield rows[:0], np.zeros(0), self.ids[:0], self.counts[:0], rows, limit
                continue
            d, at = self._squares(some, near)
            if d.shape[1] >= k:
                limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero(d <= limit[:, None])
            yield rows[i], d[i, j], self.ids[at[j]], self.counts[at[j]], rows, limit


def _search(rows: DataFrame, width: int, k: int) -> DataFrame:
    """(vid, x, bound, d, v, c): for each asked row the neighbours in its cell, as arrays. Within a task a cell's reference rows
    come first and are kept; queries pass by as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, cell = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place, piece, ask, vid, n, bound = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            x = batch.column(6).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            cuts = [0, *(np.flatnonzero((np.diff(place) != 0) | (np.diff(piece) != 0) | (ask[1:] != ask[:-1])) + 1), len(place)]
            for a, b in zip(cuts, cuts[1:]):
                if (place[a], piece[a]) != key:
                    key, kept, cell = (place[a], piece[a]), [], None
                if not ask[a]:
                    kept.append((x[a:b], vid[a:b], n[a:b]))
                    continue
                if cell is None and kept:
                    cell = Cell(*(np.concatenate(v) for v in zip(*kept)))
                parts = list(cell.nearest(x[a:b], bound[a:b], k)) if cell else []
                at, d, v, c = (np.concatenate(p) for p in list(zip(*parts))[:4]) if parts else (np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
                limit = bound[a:b].copy()
                for p in parts:
                    limit[p[4]] = p[5]
                order = np.argsort(at, kind="stable")
                ends = pa.array(np.searchsorted(at[order], np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(values[order])) for values in (d, v, c)]
                yield pa.RecordBatch.from_arrays([pa.array(vid[a:b]), pa.FixedSizeListArray.from_arrays(pa.array(x[a:b].ravel()), width).cast(pa.list_(pa.float64())), pa.array(limit), *lists], names=["vid", "x", "bound", "d", "v", "c"])

    rows = rows.select("cell", "piece", "ask", "vid", "n", "bound", "x").repartition("cell", "piece").sortWithinPartitions("cell", "piece", "ask")
    return rows.mapInArrow(run, "vid long, x array<double>, bound double, d array<double>, v array<long>, c array<long>")


def _dealt(reference: DataFrame, asked: DataFrame) -> DataFrame:
    """Reference and asked rows by cell; a cell of many queries is several pieces, each with the cell's reference rows."""
    pieces = asked.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("_p"))
    queries = asked.join(pieces, "cell").select("cell", F.pmod(F.xxhash64("vid"), F.col("_p")).cast("int").alias("piece"), F.lit(True).alias("ask"), "vid", "n", "bound", "x")
    held = reference.join(pieces, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("piece"), F.lit(False).alias("ask"), "vid", "n", F.lit(float("inf")).alias("bound"), "x")
    return held.unionByName(queries)


def neighbours(vectors: DataFrame, k: int) -> DataFrame:
    """(vid, n, d, v, c) of each distinct vector (vid, n, x), with arrays of squared distances, ids and counts of the vectors of
    n > 0 (the reference) that hold its k nearest; a vector is among its own. Exact: all ties of the k-th are there.

    Space is parted into cells at medians of a bounded sample, which decides only what lies where. A vector is first sought in
    its own cell, which gives it a distance beyond which nothing matters, then in all cells whose box is within it.
    """
    spark = vectors.sparkSession
    checkpoints(spark)
    width = vectors.select(F.size("x").alias("w")).first()
    if width is None:
        return vectors.select("vid", "n", F.array().cast("array<double>").alias("d"), F.array().cast("array<long>").alias("v"), F.array().cast("array<long>").alias("c"))
    width = width["w"]
    reference = vectors.where("n > 0")
    size = reference.count()
    cells = -(-size // CELL)
    share = min(1.0, max(1, cells) * 256 / max(size, 1))
    some = np.array([r["x"] for r in reference.where(F.pmod(F.xxhash64(F.lit(17), "vid"), F.lit(1 << 30)) < int(share * (1 << 30))).select("x").collect()], float).reshape(-1, width) if cells > 1 else np.zeros((0, width))
    nodes: list[tuple[int, float, int, int]] = []  # (feature, cut, left, right); feature -1 is a cell

    def part(x: np.ndarray, wanted: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0))
        if wanted > 1 and len(x) > 1:
            f = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
            cut = float(np.median(x[:, f]))
            left = x[:, f] < cut
            if left.any() and not left.all():
                nodes[at] = (f, cut, part(x[left], wanted - wanted // 2), part(x[~left], wanted // 2))
        return at

    part(some, cells)
    tree = np.array(nodes, float)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            at = np.zeros(len(x), np.int64)
            while len(live := np.flatnonzero(tree[at, 0] >= 0)):
                t = tree[at[live]]
                at[live] = np.where(x[live, t[:, 0].astype(int)] < t[:, 1], t[:, 2], t[:, 3]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["vid", "n", "x", "cell"])

    placed = vectors.select("vid", "n", "x").mapInArrow(place, "vid long, n long, x array<double>, cell long").checkpoint()
    reference = placed.where("n > 0")
    found = _search(_dealt(reference, placed.withColumn("bound", F.lit(float("inf")))), width, k).checkpoint()
    # cells without reference vectors have no box, and their vectors no bound yet: they are sought in all cells
    boxes = reference.groupBy("cell").agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for n, f in (("l", F.min), ("h", F.max)) for i in range(width)]).toPandas()  # one row a cell
    names, low, high = boxes["cell"].to_numpy(), boxes[[f"l{i}" for i in range(width)]].to_numpy(float), boxes[[f"h{i}" for i in range(width)]].to_numpy(float)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            vid, bound, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            for a in range(0, len(x), 1000):
                q = x[a : a + 1000]
                i, j = np.nonzero((_apart(q[:, None], q[:, None], low[None], high[None]) <= bound[a : a + 1000, None]) & (names[None] != own[a : a + 1000, None]))
                yield pa.RecordBatch.from_arrays([pa.array(vid[a + i]), pa.FixedSizeListArray.from_arrays(pa.array(q[i].ravel()), width).cast(pa.list_(pa.float64())), pa.array(bound[a + i]), pa.array(names[j])], names=["vid", "x", "bound", "cell"])

    lists = found.select("vid", "d", "v", "c")
    if len(names) > 1:
        asked = found.join(placed.select("vid", "cell"), "vid").select("vid", "x", "bound", "cell").mapInArrow(others, "vid long, x array<double>, bound double, cell long").withColumn("n", F.lit(0).cast("long")).checkpoint()
        more = _search(_dealt(reference, asked), width, k).where(F.size("d") > 0)
        both = lists.unionByName(more.select("vid", "d", "v", "c"))
        lists = both.groupBy("vid").agg(*[F.flatten(F.array_sort(F.collect_list(F.struct(F.hash("v").alias("h"), "d", "v", "c")))[c]).alias(c) for c in ("d", "v", "c")])
    return lists.join(placed.select("vid", "n"), "vid").select("vid", "n", "d", "v", "c")
