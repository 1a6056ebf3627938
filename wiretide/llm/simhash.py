"""Near-duplicate documents by SimHash: tiled exact comparison of 64-bit fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from wiretide.llm.common import as_bytes, cut, partitions, row_key, session_of
from wiretide.llm.components import connected_components

#: Fingerprints in a block of the comparison grid, at most: 8 MB; and those below which a block isn't split, as each block more
#: makes another forest of candidates of every large group.
BLOCK, SMALL = 1_000_000, 8_192
#: Fingerprints in a tile: the tile product fits the processor's cache.
TILE = 256
#: Similar documents: the words of a shingle, the least Jaccard similarity of their shingle sets, and the bits by which fingerprints
#: may differ. Such pairs of sf0.1 differ in 14 bits at most; at a similarity of 0.8 about 10 are expected, with a deviation of 3.
SIMILAR_WIDTH, SIMILAR_SHARE, SIMILAR_RADIUS = 5, 0.8, 18
#: Classes of shingle hashes that are counted per document, and pairs that a cell holds before it thins them.
CLASSES, PAIRS = 64, 2_000_000
#: Classes of sizes from one size to the largest that can have the share with it, and the last class: at a share of 0.8, of more than
#: a billion shingles. Sizes that can have the share are at most STEPS + 1 classes apart, the one for rounding down.
STEPS, TOP_SIZE = 4, 400
#: Bins of the sketch of a shingle set, a byte each, and by how many standard deviations the sketches of a pair may agree less than
#: the share asks: five leave out less than one of a million pairs that have it.
BINS, DEVIATIONS = 256, 5.0
#: Words of 64 bits of the filter that tells which rows must move: 4 MB at most, whatever the input. A full one lets all rows move.
WORDS = 1 << 19


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text: A-Z in lower case, word shingles of the given width with repeats, XXH64 of each,
    and a bit for every position that more than half of the hashes set. Fewer words: one shingle. None: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    total, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())])
        total += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _tiles(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints in an order that keeps population counts together; per tile the least and largest counts of the whole and of its quarters."""
    quarters = np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(-1, 4)).astype(np.int16)
    whole = quarters.sum(axis=1, dtype=np.int16)
    order = np.lexsort((quarters[:, 2], quarters[:, 1], quarters[:, 0], whole))
    counts = np.column_stack((whole, quarters))[order]
    at = np.arange(0, len(fps), TILE)
    return fps[order], np.minimum.reduceat(counts, at, axis=0), np.maximum.reduceat(counts, at, axis=0)


class _Forest:
    """Disjoint sets over 0..n-1, many unions at a time."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        x = self.up[x]
        while (y := self.up[x])[0:].size and not np.array_equal(x, y):
            x = y
        return x

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while a.size:
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what differs in at most radius bits, within left or between left and right: a spanning forest, so
    never more links than fingerprints. Tile pairs whose population counts are further apart than the radius are skipped."""
    a, a_low, a_high = _tiles(left)
    b, b_low, b_high = (a, a_low, a_high) if right is None else _tiles(right)
    shift = 0 if right is None else len(a)
    forest = _Forest(len(a) + (0 if right is None else len(b)))
    for i in range(len(a_low)):
        gaps = np.maximum(0, np.maximum(a_low[i] - b_high, b_low - a_high[i]))
        near = np.flatnonzero(np.maximum(gaps[:, 0], gaps[:, 1:].sum(axis=1)) <= radius)
        if right is None:
            near = near[near >= i]
        mine = a[i * TILE : (i + 1) * TILE]
        for k in range(0, len(near), 16):
            at = (near[k : k + 16, None] * TILE + np.arange(TILE)).ravel()
            at = at[at < len(b)]
            x, y = np.nonzero(np.bitwise_count(mine[:, None] ^ b[at][None, :]) <= radius)
            if x.size:
                forest.union(x + i * TILE, at[y] + shift)
    every = a if right is None else np.concatenate((a, b))
    top = forest.roots(np.arange(len(every)))
    low = np.flatnonzero(top != np.arange(len(every)))
    return every[low], every[top[low]]


def _dealt(rows: DataFrame, order: Column, radius: int, top: int, by: str) -> DataFrame:
    """rows, all columns, with block and other: a grid over the classes 0 to top of order, a row for each block of classes that its own
    comes within the radius of. A class with more rows than a block is several blocks, dealt by the hash of column by."""
    spark = session_of(rows)
    sizes = {r["class"]: r["count"] for r in rows.groupBy(order.alias("class")).count().collect()}
    total = sum(sizes.values())
    most = max(SMALL, min(BLOCK, total // max(4, int((3 * partitions(spark)) ** 0.5)) + 1))
    first, parts, low, high = [0] * (top + 1), [1] * (top + 1), [], []
    filled = most
    for p in range(top + 1):
        n = sizes.get(p, 0)
        if filled + n <= most and low:
            first[p], filled, high[-1] = len(low) - 1, filled + n, p
        else:
            first[p], parts[p] = len(low), max(1, -(-n // most))
            low += [p] * parts[p]
            high += [p] * parts[p]
            filled = n if parts[p] == 1 else most
    reach = [[j for j in range(len(low)) if low[j] - high[i] <= radius and low[i] - high[j] <= radius] for i in range(len(low))]
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), at + 1)
    block = pick(first, order) + F.pmod(F.xxhash64(by), pick(parts, order)).cast("int")
    return rows.withColumn("block", block).select("*", F.explode(F.sequence(pick([r[0] for r in reach], F.col("block")), pick([r[-1] for r in reach], F.col("block")))).alias("other"))


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(u, v): links between the distinct fingerprints of column fp, enough to connect all that differ in at most radius bits.

    Blocks of at most BLOCK fingerprints, in the order of their population counts, form a grid; each cell of two blocks whose
    counts come within the radius is one group, compared tile by tile. Each fingerprint goes to as many cells as there are
    such blocks. The 65 counts of population counts are all that comes to the driver.
    """
    dealt = _dealt(fps.select("fp"), F.bit_count("fp").cast("int"), radius, 64, "fp")

    def cell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fp, mine = rows["fp"].to_numpy().view(np.uint64), rows["block"].to_numpy()
        left, right = fp[mine == key[0]], fp[mine == key[1]]
        if not left.size or not right.size:
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        u, v = links(left, None if key[0] == key[1] else right, radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return dealt.groupBy(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).applyInPandas(cell, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs: component_id is the smallest id among the documents that chains of
    fingerprints differing in at most radius bits connect, the row's own included.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows come out as often as they go in and
    share a component. A null id takes no part in the minimum; a component of null ids alone has a null component_id. An empty
    table gives an empty one. Other columns of docs are not read, so their names do not matter. The order of rows is free.

    Equal fingerprints are one node, so a group of copies, whatever its size, costs one row after a partial aggregate. The
    comparison is exact and therefore quadratic in the number of distinct fingerprints, with a constant of about one
    nanosecond for those tile pairs that population counts don't rule out.
    """
    found = cut(fingerprints(docs, id_col, text_col, width))
    nodes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    label = connected_components(near_links(nodes, radius))
    labelled = nodes.join(label, nodes["fp"] == label["node"], "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of = labelled.join(least, "label").select("fp", "component_id")
    return found.join(of, "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(text: bytes, width: int = SIMILAR_WIDTH, seed: int = 42) -> np.ndarray:
    """The distinct shingle hashes of a text in order, of the shingles that fingerprint() counts; no words are one empty shingle."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n))


def set_fingerprint(own: np.ndarray) -> int:
    """The fingerprint of a set of shingle hashes: a bit for every position that more than half of them set. Unlike fingerprint() it
    doesn't depend on how often a text repeats a shingle, which their Jaccard similarity doesn't either."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(own), 1 << 16):
        total += np.unpackbits(own[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(own)).tobytes(), "big")


def sketch(own: np.ndarray) -> np.ndarray:
    """One byte of the least hash of each of BINS classes of an ascending set of hashes, 0 where a class is empty: one-permutation MinHash."""
    out = np.zeros(BINS, np.uint8)
    bins, first = np.unique(own % np.uint64(BINS), return_index=True)
    out[bins.astype(np.int64)] = ((own[first] >> np.uint64(8)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out


def agree(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Which rows of sketches agree in so many of the bins that either fills as the share asks, but for chance."""
    common = ((a == b) & (a > 0)).sum(axis=1, dtype=np.int64)
    filled = ((a > 0) | (b > 0)).sum(axis=1, dtype=np.int64)
    return common >= share * filled - DEVIATIONS * np.sqrt(share * (1 - share) * filled) - 1e-9


def _set_rows(docs: DataFrame, width: int) -> DataFrame:
    """(key, node, fp, n, counts, sketch) of every row of (_key, _text): the digest and size of its shingle set, the set's fingerprint,
    how many of it are in each of CLASSES classes (a byte each, 255 for that many or more), and its sketch. All but key follow from node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, sizes, counts, sketches = [], [], [], [], []
            for x in batch.column(1):
                own = shingle_hashes(x.as_py(), width)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
                fps.append(set_fingerprint(own))
                sizes.append(len(own))
                counts.append(np.minimum(np.bincount((own % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes())
                sketches.append(sketch(own).tobytes())
            longs = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (nodes, fps)]
            rest = [pa.array(sizes, pa.int64()), pa.array(counts, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, *rest], names=["key", "node", "fp", "n", "counts", "sketch"])

    kind = docs.schema["_key"].dataType.simpleString()
    return docs.select("_key", as_bytes("_text").alias("_text")).mapInArrow(run, f"key {kind}, node long, fp long, n long, counts binary, sketch binary")


def _tree(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges make a minimum spanning forest of 0..n-1."""
    forest, kept = _Forest(n), []
    for w in np.unique(weight):
        at = np.flatnonzero(weight == w)
        while at.size:
            x, y = forest.roots(a[at]), forest.roots(b[at])
            apart = x != y
            at, low, high = at[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            _, first = np.unique(high, return_index=True)
            kept.append(at[first])
            forest.up[high[first]] = low[first]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _candidates(left: dict, right: dict | None, radius: int, share: float, thin: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places, in left and right, which lie in order of size, of the pairs of other labels whose fingerprints differ in at most radius bits, whose sizes and class
    counts allow the share (no more than the sum of the lesser counts can be common) and whose sketches agree. thin leaves a
    minimum spanning forest."""
    other = left if right is None else right
    shift = 0 if right is None else len(left["fp"])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def thinned() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, d = (np.concatenate(v) for v in zip(*found))
        at = _tree(x, y + shift, d, shift + len(other["fp"]))
        return x[at], y[at], d[at]

    for i in range(0, len(left["fp"]), TILE):
        sizes = left["n"][i : i + TILE]
        low, high = np.searchsorted(other["n"], (share * sizes[0] - 1, sizes[-1] / share + 1))  # beyond, no size can have the share
        for j in range(max(i, low) if right is None else low, high, 16 * TILE):
            bits = np.bitwise_count(left["fp"][i : i + TILE, None] ^ other["fp"][None, j : min(high, j + 16 * TILE)])
            x, y = np.nonzero(bits <= radius)
            d = bits[x, y]
            x, y = x + i, y + j
            n, m = left["n"][x], other["n"][y]
            fits = (np.minimum(n, m) >= share * np.maximum(n, m) - 1e-9) & (left["label"][x] != other["label"][y])
            if right is None:
                fits &= x < y
            x, y, d, n, m = (v[fits] for v in (x, y, d, n, m))
            for k in range(0, len(x), 1 << 16):
                one = slice(k, k + (1 << 16))
                least = np.minimum(left["counts"][x[one]], other["counts"][y[one]])
                common = least.sum(axis=1, dtype=np.int64)
                may = (common >= share * (n[one] + m[one] - common) - 1e-9) | (least == 255).any(axis=1)
                may[may] = agree(left["sketch"][x[one][may]], other["sketch"][y[one][may]], share)
                if may.any():
                    found.append((x[one][may], y[one][may], d[one][may]))
                    held += int(may.sum())
            if thin and held > PAIRS:
                found = [thinned()]
                held = len(found[0][0])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y, _ = thinned() if thin else (np.concatenate(v) for v in zip(*found))
    return x, y


def candidate_pairs(nodes: DataFrame, radius: int, share: float, thin: bool) -> DataFrame:
    """(u, v): the pairs of (node, fp, n, counts, sketch, label) that _candidates() leaves, cell by cell of a grid over the sizes of sets.

    Sets of such a share differ in size by that share at most, so a set goes only to the cells of the few blocks whose sizes come
    within it of its own. Population counts, which lie close together, would send it to nearly all of them.
    """
    width = max(-math.log(share), 1e-3) / STEPS
    size = F.least(F.floor(F.log(F.col("n").cast("double")) / width), F.lit(TOP_SIZE)).cast("int")

    def cell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        def side(block: int) -> dict:
            own = rows[rows["block"] == block].sort_values("n")
            packed = {c: np.frombuffer(b"".join(own[c]), np.uint8).reshape(-1, n) for c, n in (("counts", CLASSES), ("sketch", BINS))}
            return packed | {"fp": own["fp"].to_numpy().view(np.uint64)} | {c: own[c].to_numpy() for c in ("node", "n", "label")}

        left, right = side(key[0]), None if key[0] == key[1] else side(key[1])
        x, y = _candidates(left, right, radius, share, thin)
        return pd.DataFrame({"u": left["node"][x], "v": (left if right is None else right)["node"][y]})

    return _dealt(nodes, size, STEPS + 1, TOP_SIZE, "node").groupBy(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).applyInPandas(cell, "u long, v long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, share: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets, made of the texts (node, text), have the share as Jaccard similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, keep = (None, None), []
            for u, a, b in zip(batch.column("u").to_pylist(), batch.column("a"), batch.column("b")):
                if last[0] != u:
                    last = u, shingle_hashes(a.as_py(), width)
                one, two = last[1], shingle_hashes(b.as_py(), width)
                common = np.intersect1d(one, two, assume_unique=True).size
                keep.append(common >= share * (len(one) + len(two) - common) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    own = lambda end, name: texts.select(F.col("node").alias(end), F.col("text").alias(name))
    return pairs.join(own("v", "b"), "v").join(own("u", "a"), "u").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def similar_links(docs: DataFrame, found: DataFrame, radius: int, width: int, share: float) -> DataFrame:
    """(u, v): links between the shingle sets of found, _set_rows(docs), enough to connect all pairs that differ in at most radius
    bits and have the share as Jaccard similarity or more; each is verified by the exact similarity.

    Candidates are thinned to a spanning forest of each cell first, so that a group of near copies is verified in about as many
    pairs as it has members. Then every candidate pair that the verified ones don't connect is verified, none left out. Sketches
    keep most pairs below the share, by a tenth or more, from moving texts, and a filter of fixed size all texts that are in no pair.
    """
    nodes = cut(found.groupBy("node").agg(F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("sketch").alias("sketch")))
    of = docs.select(F.col("_key").alias("key"), as_bytes("_text").alias("text"))

    def verified(labelled: DataFrame, thin: bool) -> DataFrame:
        pairs = cut(candidate_pairs(labelled, radius, share, thin).distinct())
        wanted = cut(nodes.join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi").select("node", "key"))
        near = _marked(of, F.xxhash64("key.a", "key.b"), wanted.select(F.xxhash64("key.a", "key.b").alias("hash"))).where("_wt_may")
        return cut(_verified(pairs, near.join(wanted, "key").groupBy("node").agg(F.first("text").alias("text")), width, share))

    plain = nodes.select("node", "fp", "n", "counts", "sketch")
    first = verified(plain.withColumn("label", F.col("node")), True)
    label = connected_components(first).withColumnRenamed("label", "found")
    rest = verified(plain.join(label, "node", "left").withColumn("label", F.coalesce("found", "node")).drop("found"), False)
    return first.unionByName(rest)


def _marked(rows: DataFrame, own: Column, wanted: DataFrame) -> DataFrame:
    """rows with _wt_may: false if their hash own isn't in column hash of wanted, true if it is or, by chance, if it isn't."""
    word = lambda h: F.pmod(h, F.lit(WORDS))
    bit = lambda h: F.shiftrightunsigned(h, 58).cast("int")
    bits = cut(wanted.select(word(F.col("hash")).alias("_wt_word"), bit(F.col("hash")).alias("bit")).groupBy("_wt_word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("_wt_bits")))
    found = rows.withColumn("_wt_hash", own).withColumn("_wt_word", word(F.col("_wt_hash"))).join(F.broadcast(bits), "_wt_word", "left")
    return found.withColumn("_wt_may", F.coalesce(F.bit_get("_wt_bits", bit(F.col("_wt_hash"))) == 1, F.lit(False))).drop("_wt_hash", "_wt_word", "_wt_bits")


def _firsts(docs: DataFrame, keys: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id and row key are in (_wt_a, _wt_b), one of each; keys has both, as key, of every row of docs.

    Rows that go and repeated ones are sought by a join; all others are told from them by a filter and stay where they are.
    """
    first = cut(first)
    known = keys.groupBy(F.col("key.a").alias("a"), F.col("key.b").alias("b")).agg(F.count("*").alias("n"))
    doubt = known.join(first, (known["b"] == first["_wt_b"]) & known["a"].eqNullSafe(first["_wt_a"]), "left").where("n > 1 or _wt_b is null")
    rows = _marked(docs.withColumn("_wt_key", row_key(id_col, text_col)), F.xxhash64(id_col, "_wt_key"), doubt.select(F.xxhash64("a", "b").alias("hash")))
    moved = rows.where("_wt_may")
    kept = moved.join(first, (moved["_wt_key"] == first["_wt_b"]) & moved[id_col].eqNullSafe(first["_wt_a"]), "left_semi").dropDuplicates(["_wt_key", id_col])
    return rows.where("not _wt_may").unionByName(kept).drop("_wt_key", "_wt_may")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.struct(F.col(id_col).alias("a"), row_key(id_col, text_col).alias("b"))
    return docs.select(key.alias("_key"), F.col(text_col).alias("_text"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """docs, all columns, with one row of each component of near_duplicates(): that of the smallest id (null first), of several with it one."""
    found = cut(near_duplicates(_keyed(docs, id_col, text_col), "_key", "_text", radius, width).select(F.col("doc_id").alias("key"), "component_id"))
    first = found.select(F.col("component_id.a").alias("_wt_a"), F.col("component_id.b").alias("_wt_b")).distinct()
    return _firsts(docs, found, first, id_col, text_col)


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = SIMILAR_RADIUS, width: int = SIMILAR_WIDTH, share: float = SIMILAR_SHARE) -> DataFrame:
    """docs, all columns, with one row of each group that chains of documents with the share as exact Jaccard similarity or more
    connect: that of the smallest id (null first), of several with it one.

    Candidates are the pairs whose sets' fingerprints differ in at most radius bits, compared tile by tile within a grid over their sizes.
    Equal shingle sets are one node. Texts of fewer words than a shingle are one shingle; null and blank ones are alike.
    """
    keyed = _keyed(docs, id_col, text_col)
    found = cut(_set_rows(keyed, width))
    label = connected_components(similar_links(keyed, found, radius, width, share)).withColumnRenamed("node", "_node")
    nodes = found.groupBy("node").agg(F.min("key").alias("key"))
    labelled = nodes.join(label, nodes["node"] == label["_node"], "left").select("key", F.coalesce("label", "node").alias("label"))
    first = labelled.groupBy("label").agg(F.min("key").alias("key")).select(F.col("key.a").alias("_wt_a"), F.col("key.b").alias("_wt_b"))
    return _firsts(docs, found, first, id_col, text_col)


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from wiretide.llm.common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
